"""Repair of the structure of conversations by the cheapest edits, with a rank-convergence parallel Viterbi search.

A conversation is repaired when the initials of its roles read ``(s?(ua)+)?``. Four states say what has been read:
nothing, a system turn, a user turn, an assistant turn. Edits and their costs:

======  =====================================  ====
letter  edit                                   cost
======  =====================================  ====
K       keep                                   0
R       role becomes user or assistant         3
D       delete; the only one for a row that
        is blank or was seen before            4
I       insert a turn without text             3
======  =====================================  ====

A row whose text breaks off costs 3 more where it is not deleted. The letters of an edit sequence determine the roles.

Conversations are cut into chunks of ``CHUNK`` rows, one symbol a row. Each chunk computes, from its end to its start,
the cost to finish from each state. All but the last chunk of a conversation begin with a speculative vector of
zeros. Fix-up passes run those chunks again whose following chunk now starts with another vector; vectors that differ by
a constant are the same, since only differences decide. When nothing changes, the constants are summed to the cost, and
every chunk traces the ASCII-least cheapest letters from each state that may enter it. Chunks are then folded in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import written
from .tables import CRC_SQL, crc32_sql, table

CHUNK = 256
BLANKS = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, CUT_OFF = 4, 3, 3, 3
#: The cost to finish from each state (nothing, system, user, assistant read) where no rows are left.
FINISH = (0, 6, 3, 0)
#: The state after an inserted turn or a new role: the only one of user and assistant that may follow.
NEXT = (2, 2, 3, 2)
#: The state after a kept row, by its initial and the state before.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ROLE = {2: "user", 3: "assistant"}
LEGAL = ("su", "ua", "au")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text), damaged by crc32 of ``conv_id:turn``, where a null counts as one space.

    Of 20 remainders, 0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3
    repeats it and 4 makes its role ``user``. Null roles and texts become one space.
    """
    space = F.lit(" ")
    held = F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)
    way = F.crc32(F.concat(held[0], F.lit(":"), held[1]).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), way.alias("way"))
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("way") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    rows = rows.where(F.col("way") != 0).select("conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies)
    return rows.select("conv_id", "turn", "role", "text")


def examined(rows: DataFrame) -> DataFrame:
    """``rows`` by turn (nulls first, then by role and text) with pos from 1, their first fault, and one symbol each.

    ``fault`` is blank, duplicate (role and text stand earlier in the conversation), truncated (the last character
    that is no blank ends no sentence) or null. The symbol is x for rows that must go, else the initial of the role (? for others than s,
    u and a), as a capital (! for ?) where the row is truncated. ``illegal`` marks a row that may not follow
    the one before, ``fresh`` the first row of a turn that is not null. Rows without conv_id are one conversation.
    """
    conv, turn = F.col("conv_id"), F.col("turn")
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = Window.partitionBy(conv).orderBy(turn.asc_nulls_first(), "role", "text")
    same = Window.partitionBy(conv, "role", "text").orderBy("pos")
    bare = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    fault = F.when(bare == "", "blank").when(F.row_number().over(same) > 1, "duplicate").when(~F.right(bare, F.lit(1)).isin(*".!?"), "truncated")
    pair = F.concat(F.lag(initial).over(order), initial)
    ranked = rows.select(
        "*",
        F.row_number().over(order).cast("long").alias("pos"),
        F.coalesce(~pair.isin(*LEGAL), F.lit(False)).alias("illegal"),
        (turn.isNotNull() & ~F.coalesce(F.lag(turn).over(order) == turn, F.lit(False))).alias("fresh"),
    ).withColumn("fault", fault)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("?")
    symbol = F.when(F.col("fault") == "truncated", F.translate(letter, "sua?", "SUA!")).when(F.col("fault").isNotNull(), "x").otherwise(letter)
    return ranked.withColumn("symbol", symbol)


def _step(symbol: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """The costs to finish before a row, from those after it."""
    extra = CUT_OFF if symbol in "SUA!" else 0
    kept = KEPT.get(symbol.lower(), {})
    direct = []
    for state in range(4):
        cost = DELETE + after[state]
        if symbol != "x":
            cost = min(cost, REROLE + extra + after[NEXT[state]])
            if state in kept:
                cost = min(cost, extra + after[kept[state]])
        direct.append(cost)
    return tuple(min(direct[s], INSERT + direct[NEXT[s]], 2 * INSERT + direct[NEXT[NEXT[s]]]) for s in range(4))


@lru_cache(1 << 14)
def start_costs(symbols: str, end: tuple[int, ...]) -> tuple[int, ...]:
    """The costs to finish before a chunk, from those after it."""
    for symbol in reversed(symbols):
        end = _step(symbol, end)
    return end


@lru_cache(1 << 14)
def trace(symbols: str, end: tuple[int, ...], last: bool, entries: tuple[int, ...]) -> tuple[list[int], list[str]]:
    """From each state of ``entries``: the state after the chunk, and the ASCII-least cheapest letters through it."""
    costs = [end]
    for symbol in reversed(symbols):
        costs.append(_step(symbol, costs[-1]))
    costs.reverse()
    exits, letters = [], []
    for state in entries:
        found, i = [], 0
        while i < len(symbols):
            symbol, best, after = symbols[i], costs[i][state], costs[i + 1]
            extra = CUT_OFF if symbol in "SUA!" else 0
            kept = KEPT.get(symbol.lower(), {}).get(state)
            if best == DELETE + after[state]:
                found.append("D")
            elif best == INSERT + costs[i][NEXT[state]]:
                found.append("I")
                state = NEXT[state]
                continue
            elif kept is not None and best == extra + after[kept]:
                found.append("K")
                state = kept
            else:
                found.append("R")
                state = NEXT[state]
            i += 1
        while last and FINISH[state]:
            found.append("I")
            state = NEXT[state]
        exits.append(state)
        letters.append("".join(found))
    return exits, letters


def _spread(costs: tuple[int, ...]) -> tuple[int, ...]:
    """``costs`` without the constant that they share."""
    return tuple(c - min(costs) for c in costs)


def _run_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run the chunks whose ``wanted`` end costs are not those that they were last run with."""
    for batch in batches:
        used, start = batch.column("used").to_pylist(), batch.column("start").to_pylist()
        for i, (symbols, wanted) in enumerate(zip(batch.column("symbols").to_pylist(), batch.column("wanted").to_pylist())):
            if wanted != used[i]:
                used[i], start[i] = wanted, list(start_costs(symbols, tuple(wanted)))
        kept = [batch.column(c) for c in ("conv_id", "chunk", "symbols", "last")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(used, pa.list_(pa.int64())), pa.array(start, pa.list_(pa.int64()))], ["conv_id", "chunk", "symbols", "last", "used", "start"])


def _trace_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        exits, letters = [], []
        for symbols, used, last, chunk in zip(*(batch.column(c).to_pylist() for c in ("symbols", "used", "last", "chunk"))):
            found = trace(symbols, tuple(used), last, (0, 1, 2, 3) if chunk else (0,))
            exits.append(found[0])
            letters.append(found[1])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), pa.array(exits, pa.list_(pa.int64())), pa.array(letters, pa.list_(pa.string()))], ["conv_id", "chunk", "exits", "letters"])


def searched(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunks (conv_id, chunk, symbols, last, used, start) of ``examined`` rows whose cost vectors have converged."""
    at = F.floor((F.col("pos") - 1) / chunk).cast("long")
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"])
    chunks = rows.groupBy("conv_id", at.alias("chunk")).agg(F.array_join(in_order, "").alias("symbols"))
    along = Window.partitionBy("conv_id").orderBy("chunk")
    vector = "array<bigint>"
    finish, zeros = (F.array(*(F.lit(int(v)).cast("long") for v in values)) for values in (FINISH, (0, 0, 0, 0)))
    now = chunks.withColumn("last", F.lead("chunk").over(along).isNull())
    now = now.withColumn("wanted", F.when(F.col("last"), finish).otherwise(zeros)).withColumn("used", F.lit(None).cast(vector)).withColumn("start", F.lit(None).cast(vector))
    kind = dict(rows.dtypes)["conv_id"]
    schema = f"conv_id {kind}, chunk long, symbols string, last boolean, used {vector}, start {vector}"
    now = written(now.mapInArrow(_run_chunks, schema))
    after = F.lead("start").over(along)
    spread = F.transform(after, lambda v: v - F.array_min(after))
    while True:
        wanted = now.withColumn("wanted", F.when(F.col("last"), F.col("used")).otherwise(spread))
        if not wanted.where(F.col("wanted") != F.col("used")).limit(1).count():
            return now
        now = written(wanted.mapInArrow(_run_chunks, schema))


def traced(chunks: DataFrame) -> DataFrame:
    """The letters of each chunk from each state that may enter it, and the state after them."""
    kind = dict(chunks.dtypes)["conv_id"]
    return chunks.mapInArrow(_trace_chunks, f"conv_id {kind}, chunk long, exits array<bigint>, letters array<string>")


def least_costs(chunks: DataFrame) -> DataFrame:
    """(conv_id, cost): the cost from the start of the first chunk, and the constants that the vectors of the others share."""
    first = F.col("chunk") == 0
    return chunks.groupBy("conv_id").agg(F.sum(F.when(first, F.col("start")[0]).otherwise(F.array_min("start"))).alias("cost"))


def _edits(batches: Iterator[pa.RecordBatch], kinds: list[pa.DataType]) -> Iterator[tuple]:
    """(conversation begins, conv_id, letter, role, text) of each edit in order, from chunks' letters and rows, sorted together.

    Appends the type of conv_id to ``kinds``.
    """
    conv, state, entry, letters, begun = None, 0, 0, [], False

    def inserted():
        nonlocal state
        while letters and letters[-1] == "I":
            letters.pop()
            state = NEXT[state]
            yield False, conv, "I", ROLE[state], ""

    for batch in batches:
        kinds.append(batch.column("conv_id").type)
        for now, role, text, exits, found in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "exits", "letters"))):
            if found is not None:
                yield from inserted()
                if not begun or now != conv:
                    conv, state, entry, begun = now, 0, 0, True
                    yield True, conv, "", None, None
                which = entry if len(found) > 1 else 0
                letters, entry = list(reversed(found[which])), exits[which]
                continue
            yield from inserted()
            letter = letters.pop()
            if letter == "K":
                state = KEPT[role[:1]][state]
            elif letter == "R":
                state = NEXT[state]
                role = ROLE[state]
            yield False, conv, letter, role, text
    yield from inserted()


def _beside(rows: DataFrame, letters: DataFrame, chunk: int) -> DataFrame:
    """Rows and the letters of their chunks, sorted together by conversation and position."""
    exits, found = F.lit(None).cast("array<bigint>").alias("exits"), F.lit(None).cast("array<string>").alias("letters")
    texts = rows.select("conv_id", "pos", F.lit(1).alias("kind"), "role", "text", exits, found)
    empty = F.lit(None).cast("string")
    marks = letters.select("conv_id", (F.col("chunk") * chunk + 1).alias("pos"), F.lit(0).alias("kind"), empty.alias("role"), empty.alias("text"), "exits", "letters")
    return texts.unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "kind")


def repaired_turns(rows: DataFrame, letters: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Every edit of every conversation as (conv_id, n, edit, role, text); those that are no deletion make up the repaired conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n, kinds = [], 0, 0, []

        def told():
            types = (kinds[0], pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], ["conv_id", "n", "edit", "role", "text"])

        for fresh, conv, letter, role, text in _edits(batches, kinds):
            if fresh:
                n = 0
                continue
            n += 1
            held.append((conv, n, letter, role, text))
            size += len(text)
            if size > 1 << 20 or len(held) == 4096:
                yield told()
                held, size = [], 0
        if held:
            yield told()

    kind = rows.schema["conv_id"].dataType.simpleString()
    return _beside(rows, letters, chunk).mapInArrow(run, f"conv_id {kind}, n long, edit string, role string, text string")


def digests(rows: DataFrame, letters: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, audit, repaired_sha256): all letters, and the hash of the repaired ``role:text`` lines, read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kinds = [], []

        def told():
            done = [(conv, "".join(audit), state.hexdigest()) for conv, audit, state in held]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (kinds[0], pa.string(), pa.string()))], ["conv_id", "audit", "repaired_sha256"])

        lines = 0
        for fresh, conv, letter, role, text in _edits(batches, kinds):
            if fresh:
                if len(held) == 1024:
                    yield told()
                    held = []
                held.append((conv, [], hashlib.sha256()))
                lines = 0
                continue
            _, audit, state = held[-1]
            audit.append(letter)
            if letter != "D":
                state.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
        if held:
            yield told()

    kind = rows.schema["conv_id"].dataType.simpleString()
    return _beside(rows, letters, chunk).mapInArrow(run, f"conv_id {kind}, audit string, repaired_sha256 string")


def repair_report(rows: DataFrame, every: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row for each conv_id of ``every``: faults of ``rows``, the cost of the cheapest edits, their letters and the hash of the result.

    ``gaps`` are turns missing between the first and the last (nulls ignored). A conversation without rows
    has zeros, no letters and the hash of the empty string. An empty table gives no rows.
    """
    held = written(examined(rows))
    chunks = searched(held, chunk)
    fault = lambda name: F.sum((F.coalesce("fault", F.lit("")) == name).cast("long")).alias(name)
    gaps = F.max("turn") - F.min("turn") + 1 - F.sum(F.col("fresh").cast("long"))
    faults = held.groupBy("conv_id").agg(gaps.cast("long").alias("gaps"), *map(fault, ("blank", "duplicate", "truncated")), F.sum(F.col("illegal").cast("long")).alias("illegal"))
    parts = [every.select("conv_id"), faults, least_costs(chunks), digests(held, traced(chunks), chunk)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return whole.groupBy("conv_id").agg(
        *(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations and their cheapest repair: see ``damaged``, ``examined`` and ``repair_report``."""
    conversations = table(spark, sf_dir, "conversations")
    return repair_report(damaged(conversations), conversations)


def _oracle() -> str:
    extra = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
    gone = "coalesce(fault IN ('blank', 'duplicate'), false)"
    kept = {0: "CASE ini WHEN 's' THEN v1 WHEN 'u' THEN v2 END", 1: "CASE ini WHEN 'u' THEN v2 END", 2: "CASE ini WHEN 'a' THEN v3 END", 3: "CASE ini WHEN 'u' THEN v2 END"}
    direct = ", ".join(f"least(4 + v{s}, CASE WHEN NOT {gone} THEN least(3 + {extra} + v{NEXT[s]}, coalesce({extra} + ({kept[s]}), 1000000000)) ELSE 1000000000 END) AS d{s}" for s in range(4))
    closed = ", ".join(f"least(d{s}, 3 + d{NEXT[s]}, 6 + d{NEXT[NEXT[s]]}) AS v{s}" for s in range(4))
    of = lambda row, state: f"[{row}.v0, {row}.v1, {row}.v2, {row}.v3][{state} + 1]"
    follow = "[2, 2, 3, 2][w.s + 1]"
    keep = "CASE WHEN r.ini = 's' AND w.s = 0 THEN 1 WHEN r.ini = 'u' AND w.s <> 2 THEN 2 WHEN r.ini = 'a' AND w.s = 2 THEN 3 END"
    return rf"""
WITH RECURSIVE {CRC_SQL},
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS way
  FROM conversations, crc
),
rows AS (
  SELECT conv_id, turn, CASE way WHEN 4 THEN 'user' ELSE role END AS role,
    CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, (SELECT unnest([1, 2]) AS copy) WHERE way <> 0 AND (copy = 1 OR way = 3)
),
ranked AS (
  SELECT *, left(role, 1) AS ini, row_number() OVER w AS pos, lag(left(role, 1)) OVER w AS prior
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
),
marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS seen FROM ranked)
),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (prior IS NOT NULL AND prior || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM marked GROUP BY conv_id
),
back AS (
  SELECT conv_id, n + 1 AS pos, 0 AS v0, 6 AS v1, 3 AS v2, 0 AS v3 FROM faults
  UNION ALL
  SELECT conv_id, pos, {closed} FROM (SELECT r.conv_id, r.pos, {direct} FROM back b JOIN marked r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.pos = b.pos - 1)
),
walk AS (
  SELECT conv_id, 1::BIGINT AS pos, 0 AS s, '' AS audit, NULL::VARCHAR AS lines FROM faults
  UNION ALL
  SELECT conv_id, pos + (op <> 'I')::INTEGER, CASE op WHEN 'D' THEN s WHEN 'K' THEN ks ELSE fs END, audit || op,
    CASE op WHEN 'D' THEN lines ELSE coalesce(lines || chr(10), '') || CASE op WHEN 'K' THEN role ELSE [NULL, NULL, 'user', 'assistant'][fs + 1] END
      || ':' || CASE op WHEN 'I' THEN '' ELSE text END END
  FROM (
    SELECT w.conv_id, w.pos, w.s, w.audit, w.lines, r.role, r.text, {follow} AS fs, {keep} AS ks,
      CASE WHEN r.pos IS NOT NULL AND {of("b", "w.s")} = 4 + {of("n", "w.s")} THEN 'D'
        WHEN {of("b", "w.s")} = 3 + {of("b", follow)} THEN 'I'
        WHEN {of("b", "w.s")} = {extra.replace("fault", "r.fault")} + {of("n", keep)} THEN 'K' ELSE 'R' END AS op
    FROM walk w JOIN back b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.pos = w.pos
    LEFT JOIN marked r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos
    LEFT JOIN back n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.pos = w.pos + 1
    WHERE r.pos IS NOT NULL OR {of("b", "w.s")} > 0
  )
),
ended AS (SELECT conv_id, audit, lines FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(audit) DESC) = 1),
costs AS (SELECT conv_id, v0 AS cost FROM back WHERE pos = 1)
SELECT i.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0)::BIGINT AS blank, coalesce(f.duplicate, 0)::BIGINT AS duplicate,
  coalesce(f.truncated, 0)::BIGINT AS truncated, coalesce(f.illegal, 0)::BIGINT AS illegal, coalesce(c.cost, 0)::BIGINT AS cost,
  coalesce(e.audit, '') AS audit, sha256(coalesce(e.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN costs c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id"""


ORACLE = _oracle()
