"""Repair and prefix trie of conversations against brute force, SQL, and on odd inputs."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest
from pyspark.sql import functions as F

from palisade.llm import repair, trie
from palisade.llm.queries import ORACLES, QUERIES
from palisade.llm.tables import table

TURNS = "conv_id long, turn long, role string, text string, score double, pos string"
ODD = [
    (1, None, None, None), (1, None, "user", "twice."), (1, 0, "user", "Hi there"), (1, 0, "user", "Hi there"), (1, 5, "robot", "x.\n"),
    (2, 1, "assistant", ""), (3, 2, "user", "  \t"), (None, 0, "user", "No id."), (None, 1, "assistant", None), (4, 0, "", "Empty role!"),
    (5, 0, "system", "Only a system turn."), (6, 3, "user", "long " * 30000), (20, 0, "user", "Hi there"), (21, 0, "user", "Hi there"), (-7, 1, "user", "é ü?"),
]


def conversations(spark, rows):
    """Rows beside columns whose names clash with results."""
    return spark.createDataFrame([(*r, 1.0, "p") for r in rows], TURNS).repartition(3)


def same_as_sql(query, name, rows):
    """The rows of a query and those of its SQL over ``conversations``."""
    held = rows.select("conv_id", "turn", "role", "text").toPandas()
    con = duckdb.connect()
    con.register("held", held.astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("CREATE VIEW conversations AS SELECT conv_id, turn, role, text FROM held")
    found = con.sql(ORACLES[name])
    want = sorted(map(repr, found.fetchall()))
    assert sorted(repr(tuple(r[c] for c in found.columns)) for r in query.collect()) == want
    assert sorted(query.columns) == sorted(found.columns)


# Repair


def plain_repair(rows):
    """The fields of a report of examined rows of one conversation, from all (cost, letters) that can be reached."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))

    def follows(text, initial):
        return re.fullmatch("(s?(ua)*u?)", text + initial)

    @lru_cache(None)
    def best(i, read):
        """Least (cost, letters, lines) from row i, where the initials ``read`` (shortened) stand."""
        ways = []
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", read):
            return 0, "", ()
        short = lambda s: s[:1] + s[1:][-2:] if len(s) > 6 else s
        if i < len(rows):
            _, role, text = rows[i]
            c, a, out = best(i + 1, read)
            ways.append((c + 4, "D" + a, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if role and follows(read, role[0]):
                    c, a, out = best(i + 1, read + role[0])
                    ways.append((c + more, "K" + a, ((role, text), *out)))
                for other in ("user", "assistant"):
                    if follows(read, other[0]):
                        c, a, out = best(i + 1, read + other[0])
                        ways.append((c + 3 + more, "R" + a, ((other, text), *out)))
        if len(read) - i < 4:
            for other in ("user", "assistant"):
                if follows(read, other[0]):
                    c, a, out = best(i, read + other[0])
                    ways.append((c + 3, "I" + a, ((other, ""), *out)))
        return min(ways) if ways else (10**6, "", ())

    cost, letters, lines = best(0, "")
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost,
        letters,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
    )


@pytest.mark.parametrize("chunk", [1, 2, 256])
def test_repair_equals_brute_force(spark, chunk):
    rnd = random.Random(chunk)
    rows = []
    for conv in range(60):
        for turn in range(rnd.randint(0, 7)):
            role = rnd.choice(["user", "assistant", "assistant", "user", "system", "tool", ""])
            rows.append((conv, rnd.choice([turn, turn, turn * 2, None]), role, rnd.choice(["One.", "Two!", "Three", " ", "", f"Turn {turn}?"])))
    frame = conversations(spark, rows)
    found = repair.repair_report(frame, frame.select("conv_id"), chunk)
    got = {r["conv_id"]: tuple(r[c] for c in found.columns[1:]) for r in found.collect()}
    held = {c: [r[1:] for r in rows if r[0] == c] for c in {r[0] for r in rows}}
    assert got == {c: plain_repair(r) for c, r in held.items()}


def test_chunks_converge_to_what_one_chunk_gives(spark):
    """Chunks that speculate wrongly are run again: a turn of s, u or a with rows of x far behind."""
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool"]), f"Text {t}" + rnd.choice([".", ""])) for c in range(4) for t in range(300)]
    frame = conversations(spark, rows)
    reports = [{r["conv_id"]: r for r in repair.repair_report(frame, frame, chunk).collect()} for chunk in (1, 7, 1024)]
    assert reports[0] == reports[1] == reports[2]
    held = repair.examined(frame).cache()
    chunks = repair.searched(held, 7).collect()
    by = {(r["conv_id"], r["chunk"]): r for r in chunks}
    for (conv, at), r in by.items():
        assert tuple(r["start"]) == repair.start_costs(r["symbols"], tuple(r["used"]))
        if not r["last"]:
            after = by[conv, at + 1]["start"]
            assert r["used"] == [v - min(after) for v in after]


def test_repaired_turns_are_what_the_hash_is_of(spark, sf_dir):
    rows = repair.examined(repair.damaged(table(spark, sf_dir, "conversations"))).cache()
    letters = repair.traced(repair.searched(rows))
    lines, edits = {}, {}
    for r in repair.repaired_turns(rows, letters).orderBy("conv_id", "n").collect():
        edits[r["conv_id"]] = edits.get(r["conv_id"], "") + r["edit"]
        if r["edit"] != "D":
            lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in repair.digests(rows, letters).collect():
        kept = lines.get(r["conv_id"], [])
        assert edits[r["conv_id"]] == r["audit"]
        assert hashlib.sha256("\n".join(kept).encode()).hexdigest() == r["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in kept))


def test_repair_query_equals_its_sql(spark, sf_dir):
    same_as_sql(QUERIES["op11_repair"](spark, sf_dir), "op11_repair", table(spark, sf_dir, "conversations"))


def test_repair_of_odd_rows_equals_its_sql(spark):
    odd = conversations(spark, ODD)
    same_as_sql(repair.repair_report(repair.damaged(odd), odd), "op11_repair", odd)


# Trie


def plain_trie(turns):
    """Nodes of {conv_id: [(turn, words)]} from a dictionary of prefixes."""
    members = {}
    for conv, own in turns.items():
        for d in range(len(own) + 1):
            members.setdefault(tuple(own[:d]), []).append(conv)
    nodes = []
    for path, held in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        ends = sorted(c for c in held if len(turns[c]) == len(path))
        nodes.append((
            min(held), len(path), min(members[path[:-1]]) if path else None, len(held), sum(len(p) == len(path) + 1 for p in below), len(leaves),
            sum((len(members[p]) - 1) * p[-1][1] for p in below if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(nodes, key=str)


def rows_of_turns(spark, turns):
    rows = [(c, i, None if t is None else str(t[0]).encode(), 0 if t is None else t[1]) for c, own in turns.items() for i, t in enumerate([None, *own])]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, pos long, key binary, words long").repartition(3)


def trees():
    rnd = random.Random(8)
    mixed = {c: [(rnd.choice("ab"), 0), *((x, len(x)) for x in rnd.choices(["x", "yy", "zzz"], k=rnd.randint(0, 5)))][rnd.randint(0, 1) :] for c in range(70)}
    mixed = {c: [(k, ord(k[0])) for k, _ in own] for c, own in mixed.items()}
    return {
        "mixed": mixed,
        "growing": {c: [("t%d" % d, d) for d in range(c)] for c in range(33)},
        "copies": {c * 1000: [("same", 3), ("turns", 2)] for c in range(40)} | {7: [], -5: [("same", 3)]},
    }


@pytest.mark.parametrize("kind", ["mixed", "growing", "copies"])
def test_trie_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(trie, "BLOCK_CONVERSATIONS", 4)
    turns = trees()[kind]
    found = trie.prefix_trie(rows_of_turns(spark, turns)).collect()
    assert sorted(map(tuple, found), key=str) == plain_trie(turns)


def test_blocks_are_bounded_and_whole():
    import pyarrow as pa

    rows = [(c, k) for c in range(3000) for k in (None, b"a", b"b")]
    batches = [pa.RecordBatch.from_pydict({"conv_id": [r[0] for r in rows[i : i + 70]], "key": [r[1] for r in rows[i : i + 70]], "words": [1] * len(rows[i : i + 70])}) for i in range(0, len(rows), 70)]
    blocks = list(trie._blocks(batches))
    assert [len(ids) for ids, _ in blocks] == [1024, 1024, 952]
    assert all(len(own) == 2 for _, turns in blocks for own in turns)


def test_trie_query_equals_its_sql(spark, sf_dir):
    same_as_sql(QUERIES["op12_trie"](spark, sf_dir), "op12_trie", table(spark, sf_dir, "conversations"))


def test_trie_of_odd_rows_equals_its_sql(spark):
    odd = conversations(spark, [*ODD, (0, 0, "user", "Hi there"), (0, 1, "user", "Hi there")])
    same_as_sql(trie.prefix_trie(trie.share_heads(trie.ordered(odd))), "op12_trie", odd)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], TURNS)
    assert repair.repair_report(repair.damaged(empty), empty).collect() == []
    assert trie.prefix_trie(trie.share_heads(trie.ordered(empty))).collect() == []


def test_damage_follows_the_remainder(spark):
    rows = [(c, t, "assistant", "A. B!") for c in range(20) for t in range(10)]
    found = {}
    for r in repair.damaged(conversations(spark, rows)).select("conv_id", "turn", F.struct("role", "text").alias("x")).collect():
        found.setdefault((r[0], r[1]), []).append(tuple(r[2]))
    for c, t, role, text in rows:
        way = zlib.crc32(f"{c}:{t}".encode()) % 20
        want = {0: None, 1: [(role, "")], 2: [(role, "A B")], 3: [(role, text)] * 2, 4: [("user", text)]}.get(way, [(role, text)])
        assert found.get((c, t)) == want
