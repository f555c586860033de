"""The graph of tools against brute force on small branching graphs with types that many tools share."""

import itertools
import random
import re
from collections import Counter

import pytest

from palisade.operators import attack_graph

KIND = "server string, name string, description string, types_in array<string>, types_out array<string>"
WORDS = ["read the file", "send it", "receive input", "open a shell", "write all", "count", None, ""]


def random_tools(seed, n=16, types=5, least=0.45):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        some = lambda: [f"t{t}" for t in range(types) if rnd.random() < (least if t else 2 * least) / types * 2] or None
        rows.append((f"s{rnd.randrange(4)}", rnd.choice(["get_", "list", "do_", "x"]) + str(i), rnd.choice(WORDS), some(), some()))
    return rows


def plain_edges(rows):
    return {
        ((a[0], a[1]), (b[0], b[1])): sorted(set(a[4]) & set(b[3]))
        for a, b in itertools.product(rows, rows)
        if a[0] != b[0] and set(a[4] or ()) & set(b[3] or ())
    }


def plain_paths(rows, most):
    after = {}
    for a, b in plain_edges(rows):
        after.setdefault(a, []).append(b)
    best, now = {}, [[(r[0], r[1])] for r in rows]
    for _ in range(most - 1):
        now = [[*p, b] for p in now for b in after.get(p[-1], ()) if b not in p]
        for p in now:
            key = tuple(sorted(p))
            best[key] = min(best.get(key, p), p)
    return {k: tuple(p) for k, p in best.items()}


@pytest.mark.parametrize("seed, hub", [(1, 20_000), (2, 2), (3, 1)])
def test_paths_equal_brute_force(spark, seed, hub):
    rows = random_tools(seed)
    nodes = spark.createDataFrame(rows, KIND)
    for most in (2, 5, 6):
        got = [tuple(tuple(n) for n in r["path"]) for r in attack_graph.attack_paths(nodes, max_nodes=most, hub=hub).collect()]
        want = plain_paths(rows, most)
        assert len(got) == len(set(got)) and set(got) == set(want.values()) and len(want) > 10


def test_counts_are_those_of_the_listed_edges(spark):
    rows = random_tools(5, 40, 4, 0.6)
    nodes = spark.createDataFrame(rows, KIND)
    edges = plain_edges(rows)
    assert {(tuple(r["src"]), tuple(r["dst"])): r["shared"] for r in attack_graph.type_edges(nodes).collect()} == edges
    counts = Counter()
    types = {(r[0], r[1]): (tuple(sorted(r[4] or ())), tuple(sorted(r[3] or ()))) for r in rows}
    for a, b in edges:
        counts[types[a][0], types[b][1]] += 1
    assert {(tuple(r["outs"]), tuple(r["ins"])): r["edges"] for r in attack_graph.edge_counts(nodes).collect()} == counts
    got = {(r["server"], r["name"]): (r["out_degree"], r["in_degree"]) for r in attack_graph.degrees(nodes).collect()}
    assert got == {k: (sum(a == k for a, _ in edges), sum(b == k for _, b in edges)) for k in types}


def test_edges_of_a_hot_type_are_not_listed(spark):
    """A hundred thousand tools of one type: ten billion edges, counted."""
    rows = spark.range(100_000).selectExpr("cast(id % 10 as string) AS server", "cast(id AS string) AS name", "array('string') AS types_in", "array('string') AS types_out")
    assert [r["edges"] for r in attack_graph.edge_counts(rows).collect()] == [100_000 * 90_000]


def test_escalations_equal_brute_force(spark):
    found = 0
    for seed in range(4):
        rows = random_tools(seed, 24, 6, 0.3)
        after = {}
        for a, b in plain_edges(rows):
            after.setdefault(a, set()).add(b)
        writes = {(r[0], r[1]) for r in rows if re.search(r"\b(write|shell)\b", f"{r[1]} {r[2] or ''}")}
        reads = {(r[0], r[1]) for r in rows if re.match("get|list", r[1])} - writes
        want = {}
        for start in reads:
            now = {start}
            for step in (1, 2, 3):
                now = {b for a in now for b in after.get(a, ())}
                for end in now & writes:
                    if end[0] != start[0]:
                        want.setdefault((start, end), (step, "direct" if step == 1 else "chain"))
        got = {(tuple(r["start"]), tuple(r["end"])): (r["steps"], r["kind"]) for r in attack_graph.escalations(spark.createDataFrame(rows, KIND)).collect()}
        assert got == want
        found += len({v for v in want.values()})
    assert found > 4


def test_kinds_of_paths(spark):
    rows = random_tools(10, 30, 8, 0.3)
    nodes = spark.createDataFrame(rows, KIND)
    said = {(r[0], r[1]): r[2] or "" for r in rows}
    want = Counter()
    for p in plain_paths(rows, 4).values():
        first, last = said[p[0]], f"{p[-1][1]} {said[p[-1]]}"
        if first == "read the file" and "send" in last:
            kind = ("exfiltration", "critical")
        elif first == "receive input" and "shell" in last:
            kind = ("command_injection", "critical")
        else:
            kind = ("long_chain", "high") if len(p) > 2 else ("pair", "medium")
        want[kind] += 1
    got = Counter((r["kind"], r["severity"]) for r in attack_graph.path_kinds(attack_graph.attack_paths(nodes, max_nodes=4), nodes).collect())
    assert got == want and len(want) == 4


def test_empty_and_odd_tools(spark):
    rows = [("a", "x", None, None, [None, "t"]), ("b", "y", "write", ["t", "t", None], []), (None, "z", None, ["t"], None), ("a", "x", None, ["u"], ["t"])]
    nodes = spark.createDataFrame(rows, KIND)
    assert [(r["src"]["name"], r["dst"]["name"], r["shared"]) for r in attack_graph.type_edges(nodes).collect()] == [("x", "y", ["t"])]
    assert [r["n"] for r in attack_graph.attack_paths(nodes).collect()] == [2]
    none = nodes.limit(0)
    for f in (attack_graph.type_edges, attack_graph.edge_counts, attack_graph.degrees, attack_graph.attack_paths, attack_graph.escalations):
        assert f(none).count() == 0


def test_kinds_by_ends_equal_those_of_the_paths(spark):
    nodes = spark.createDataFrame(random_tools(10, 30, 8, 0.3), KIND)
    paths = attack_graph.attack_paths(nodes, max_nodes=4)
    want = Counter((r["n"], r["path"][0], r["path"][-1], r["kind"], r["severity"]) for r in attack_graph.path_kinds(paths, nodes).collect())
    assert Counter(map(tuple, attack_graph.attack_path_kinds(nodes, max_nodes=4).collect())) == want and want


def test_paths_carry_numbers(spark):
    """What joins and groups carry is the tools' numbers, in the tools' order; from some starts only, and over more tools than one number holds."""
    nodes = spark.createDataFrame(random_tools(1), KIND)
    paths, tools = attack_graph._numbered_paths(nodes, None, 4, 20_000)
    assert paths.schema["path"].dataType.simpleString() == "array<int>"
    order = [(tuple(r["node"]), r["id"]) for r in tools.collect()]
    assert [i for _, i in sorted(order)] == list(range(len(order)))
    start = [p for p in plain_paths(random_tools(1), 3).values()][0][0]
    some = attack_graph.attack_paths(nodes, spark.createDataFrame([(start,)], "node struct<server:string,name:string>"), 3).collect()
    assert some and {tuple(r["path"][0]) for r in some} == {start}
    chain = spark.createDataFrame([(f"s{i:02}", "t", "", [str(i)], [str(i + 1)]) for i in range(18)], KIND)
    long = attack_graph.attack_paths(chain, max_nodes=17).collect()
    assert Counter(r["n"] for r in long) == {n: 19 - n for n in range(2, 18)} and all(r["path"] == r["nodes"] for r in long)


def test_edges_are_a_query(spark, sf_dir):
    """The query lists edges, as many as its SQL joins; counts by types are a query beside it."""
    from palisade.plans import registry

    found = registry.QUERIES["ref079_type_edges"](spark, sf_dir)
    assert found.columns == ["src", "dst", "shared", "n"] and found.count() > 1000
    assert registry.QUERIES["ref079_edge_counts"](spark, sf_dir).columns == ["outs", "ins", "shared", "edges"]


@pytest.mark.parametrize("operator", [attack_graph.type_edges, attack_graph.edge_counts, attack_graph.degrees])
def test_tools_are_read_once(spark, operator):
    """Whatever follows starts from one copy of the tools, not from their source."""
    nodes = spark.createDataFrame(random_tools(3), KIND)
    assert "ExistingRDD" not in operator(nodes)._jdf.queryExecution().executedPlan().toString()


def test_tools_without_a_server_have_no_edges(spark):
    rows = [(None, "x", "", ["t"], ["t"]), ("a", "y", "", ["t"], ["t"]), ("b", "z", "", ["t"], ["u"]), ("b", "z", "", None, ["t", "u"])]
    nodes = spark.createDataFrame(rows, KIND)
    assert {r["name"]: (r["out_degree"], r["in_degree"]) for r in attack_graph.degrees(nodes).collect()} == {"x": (0, 0), "y": (1, 1), "z": (1, 1)}
    assert sum(r["edges"] for r in attack_graph.edge_counts(nodes).collect()) == attack_graph.type_edges(nodes).count() == 2


def test_writing_is_told_by_any_row_of_a_tool(spark):
    """Rows without types count for tools that have types in another row, and the types start from one copy."""
    rows = [("a", "get_x", "", None, ["t"]), ("b", "y", "", ["t"], None), ("b", "y", "write all", None, None), ("c", "z", "", ["t"], None), ("d", "w", "write", None, None)]
    found = attack_graph.escalations(spark.createDataFrame(rows, KIND))
    assert [(r["start"]["name"], r["end"]["name"], r["steps"]) for r in found.collect()] == [("get_x", "y", 1)]
    assert "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString()


def test_tools_of_paths_are_looked_up_in_groups(spark):
    """Every tool of every path was looked up by itself and brought back to its path; now once for the paths that go through one tool, dealt to parts where they are many."""
    rows = random_tools(3)
    found, tools = attack_graph._numbered_paths(spark.createDataFrame(rows, KIND), None, 5, 20_000, again=True)
    want = set(plain_paths(rows, 5).values())
    for most in (1, 7, 256):
        named = attack_graph._named(found, tools, most)
        got = [tuple(tuple(n) for n in r["path"]) for r in named.collect()]
        assert len(got) == len(want) and set(got) == want
    plan = attack_graph.attack_paths(spark.createDataFrame(rows, KIND))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[path#", plan) and "Aggregate [mid#" in plan
