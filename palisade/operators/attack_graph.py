"""The graph of tools that can feed each other: edges counted, paths and reachability without listing hot types.

An output type of one tool that is an input type of a tool of another server makes an edge. Every join goes
from tools to types and from types to tools; edges are listed only where they are the result. Tools of the same types
count alike, so edges and degrees are sums over the different sets of types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import numbered, spread, written_copy
from ..functions.text import unicode_pattern
from .crossref import READS, SENDS, WRITES, tool_text

#: Consumers of a type that one task of a join takes at most; types of more are split.
HUB = 20_000
#: Paths that look up their tools together at most; rows that may be broadcast.
GROUP, HELD = 256, 100_000
#: What takes input, what runs commands, and how names of reading tools begin.
TAKES = ("input", "receive")
RUNS = r"\b(?:exec|eval|shell|bash|cmd|subprocess|command|spawn|sudo)\b"
RUN_PARTS = ("exec", "shell", "spawn", "sudo", "cmd")
READ_NAME = r"^(?:get|list|read|fetch|search|query|browse|show|describe)"


def _types_of(types: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(types, F.array().cast("array<string>")))))


def _types(column: str) -> Column:
    return _types_of(F.col(column))


def _tools(nodes: DataFrame, *flags: str) -> DataFrame:
    """node (server, name), server, ins and outs of every different tool, with the types of all rows of it, and ``flags`` that are true if one of its rows says so.

    Different rows are written once. Only tools that have several of them are merged; the others are as they stand.
    """
    rows = written_copy(nodes.select("server", "name", _types("types_in").alias("ins"), _types("types_out").alias("outs"), *flags).distinct())
    keys = written_copy(rows.groupBy("server", "name").agg(F.count("*").alias("n")).where("n > 1").select("server", "name"))
    same = lambda: rows["server"].eqNullSafe(keys["server"]) & rows["name"].eqNullSafe(keys["name"])
    union = lambda c: _types_of(F.flatten(F.collect_set(c))).alias(c)
    merged = rows.join(keys, same(), "left_semi").groupBy("server", "name").agg(union("ins"), union("outs"), *[F.max(c).alias(c) for c in flags])
    tools = rows.join(keys, same(), "left_anti").unionByName(merged)
    return tools.select(F.struct("server", "name").alias("node"), "server", "ins", "outs", *flags)


def type_edges(nodes: DataFrame) -> DataFrame:
    """Edges one by one: src, dst and the sorted shared types. As many rows as edges; ``edge_counts`` counts them.

    Two tools meet at each type that they share; they are an edge where they meet at the least one.
    """
    tools = _tools(nodes)
    out = tools.select(F.col("node").alias("src"), "outs", F.explode("outs").alias("type"))
    into = tools.select(F.col("node").alias("dst"), "ins", F.explode("ins").alias("type"))
    pairs = out.join(into, "type").where(F.col("src.server") != F.col("dst.server")).withColumn("shared", F.array_sort(F.array_intersect("outs", "ins")))
    return pairs.where(F.get("shared", F.lit(0)) == F.col("type")).select("src", "dst", "shared")


def _meeting(tools: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbers of tools by (outs, server) and (ins, server), and the sets of types that share one: outs, ins, shared."""
    tools = tools.where("server is not null")  # others cannot be told from those of its server
    outs = tools.where(F.size("outs") > 0).groupBy("outs", "server").agg(F.count("*").alias("n_out"))
    ins = tools.where(F.size("ins") > 0).groupBy("ins", "server").agg(F.count("*").alias("n_in"))
    a = outs.select("outs").distinct().select("outs", F.explode("outs").alias("type"))
    b = ins.select("ins").distinct().select("ins", F.explode("ins").alias("type"))
    met = a.join(b, "type").groupBy("outs", "ins").agg(F.array_sort(F.collect_set("type")).alias("shared"))
    return outs, ins, met


def edge_counts(nodes: DataFrame) -> DataFrame:
    """How many edges lead from tools of one set of output types to tools of one set of input types: outs, ins, shared, edges.

    The edges are the pairs of their tools less those within one server; none of them is listed.
    """
    outs, ins, met = _meeting(_tools(nodes))
    total_out = outs.groupBy("outs").agg(F.sum("n_out").alias("n_out"))
    total_in = ins.groupBy("ins").agg(F.sum("n_in").alias("n_in"))
    within = outs.join(ins, "server").groupBy("outs", "ins").agg(F.sum(F.col("n_out") * F.col("n_in")).alias("within"))
    rows = met.join(total_out, "outs").join(total_in, "ins").join(within, ["outs", "ins"], "left")
    edges = F.col("n_out") * F.col("n_in") - F.coalesce("within", F.lit(0))
    return rows.select("outs", "ins", "shared", edges.alias("edges")).where("edges > 0")


def degrees(nodes: DataFrame) -> DataFrame:
    """server, name, out_degree, in_degree of every tool: how many tools of other servers it feeds, and how many feed it."""
    tools = _tools(nodes)
    outs, ins, met = _meeting(tools)

    def counted(own: DataFrame, side: str, other: DataFrame, theirs: str, n: str) -> DataFrame:
        """What the tools of one set of types and server reach: those of all servers less those of its own."""
        reach = met.select("outs", "ins").join(other, theirs)
        every, home = reach.groupBy(side).agg(F.sum(n).alias("all")), reach.groupBy(side, "server").agg(F.sum(n).alias("home"))
        return own.select(side, "server").join(every, side).join(home, [side, "server"], "left").select(side, "server", (F.col("all") - F.coalesce("home", F.lit(0))).alias("n"))

    # Tools meet their degrees once, by what they have in common.
    kinds = tools.groupBy("server", "outs", "ins").agg(F.count("*").alias("_n")).drop("_n")
    for own, side, other, theirs, n, name in ((outs, "outs", ins, "ins", "n_in", "out_degree"), (ins, "ins", outs, "outs", "n_out", "in_degree")):
        kinds = kinds.join(counted(own, side, other, theirs, n), [side, "server"], "left").withColumn(name, F.coalesce("n", F.lit(0))).drop("n")
    same = tools["server"].eqNullSafe(kinds["server"]) & (tools["outs"] == kinds["outs"]) & (tools["ins"] == kinds["ins"])
    return tools.join(kinds, same, "left").select("node.server", "node.name", "out_degree", "in_degree")


def _split(types: DataFrame, hub: int) -> DataFrame:
    """The types of more consumers than ``hub``, with the number of parts they are dealt to."""
    return types.groupBy("type").agg(F.count("*").alias("n")).where(F.col("n") > hub).select("type", F.ceil(F.col("n") / hub).alias("parts"))


def _edges(tools: DataFrame, hub: int) -> DataFrame:
    """src and dst, the numbers (column id) of the tools of each edge. Types of many consumers are dealt to parts, which their producers visit one by one."""
    out = tools.select(F.col("id").alias("src"), F.col("server").alias("from"), F.explode("outs").alias("type"))
    into = tools.select(F.col("id").alias("dst"), F.col("server").alias("to"), F.explode("ins").alias("type"))
    split = _split(into, hub)
    parts = F.coalesce("parts", F.lit(1))
    into = into.join(split, "type", "left").withColumn("part", F.pmod(F.xxhash64("dst"), parts)).drop("parts")
    out = out.join(into.select("type").distinct(), "type", "left_semi").join(split, "type", "left")
    out = out.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    return out.join(into, ["type", "part"]).where(F.col("from") != F.col("to")).select("src", "dst").distinct()


#: Paths of up to as many tools have the places of their tools in one number.
PLACES = 15


def _code(path: Column, nodes: Column, most: int) -> Column:
    """The places of a path's tools among the sorted ones: in the order of the paths over the same tools."""
    places = F.transform(path, lambda x: F.array_position(nodes, x))
    return F.aggregate(places, F.lit(0).cast("long"), lambda total, x: total * 16 + x) if most <= PLACES else places


def _decoded(most: int) -> Column:
    """The path of nodes and code."""
    if most > PLACES:
        return F.transform("code", lambda i: F.element_at("nodes", i.cast("int")))
    return F.expr("transform(sequence(size(nodes) - 1, 0), i -> element_at(nodes, cast(shiftright(code, 4 * i) & 15 as int)))")


def _numbered_paths(nodes: DataFrame, starts: DataFrame | None, max_nodes: int, hub: int, again: bool = False) -> tuple[DataFrame, DataFrame]:
    """path, the numbers of the tools of each simple path, the least for each set of tools; and tools with their numbers (id), in the order of the tools.

    Of the paths over the same tools with the same end, which go on alike, the least is kept. Each number of tools is
    one step from paths to edges, and is written once for the result and the next step; the last one too if the paths are read ``again``.
    """
    tools = numbered(_tools(nodes.where("size(types_in) > 0 or size(types_out) > 0")), "node")
    edges = written_copy(_edges(tools, hub))
    first = edges
    if starts is not None:
        begin = tools.join(starts.select("node").distinct(), "node", "left_semi").select(F.col("id").alias("src"))
        first = edges.join(begin, "src", "left_semi")
    longer = first.select(F.array("src", "dst").alias("path"))
    found = None
    for n in range(2, max_nodes + 1):
        sets = longer.withColumn("nodes", F.array_sort("path")).select("nodes", F.element_at("path", -1).alias("last"), _code(F.col("path"), F.col("nodes"), max_nodes).alias("code"))
        if n == max_nodes:
            least = sets.groupBy("nodes").agg(F.min("code").alias("code"))
            least = written_copy(least) if again else least
        else:
            # One shuffle by sets serves both steps.
            ends = sets.repartition("nodes").groupBy("nodes", "last").agg(F.min("code").alias("code"))
            kept = written_copy(ends.groupBy("nodes").agg(F.collect_list("code").alias("codes")))
            least = kept.select("nodes", F.array_min("codes").alias("code"))
            onward = kept.select("nodes", F.explode("codes").alias("code")).withColumn("path", _decoded(max_nodes))
            met = onward.select("path", F.element_at("path", -1).alias("src")).join(edges, "src").where(~F.array_contains("path", F.col("dst")))
            longer = met.select(F.concat("path", F.array("dst")).alias("path"))
        least = least.select(_decoded(max_nodes).alias("path"))
        found = least if found is None else found.unionByName(least)
    return found, tools


def attack_paths(nodes: DataFrame, starts: DataFrame | None = None, max_nodes: int = 6, hub: int = HUB) -> DataFrame:
    """Simple paths of two to ``max_nodes`` tools, one for each set of tools (the least path): nodes, n, path.

    ``starts`` (column node) are where paths may begin, by default everywhere. Paths are followed and told apart by the numbers of
    their tools; what the tools are called is looked up for those that are found.
    """
    found, tools = _numbered_paths(nodes, starts, max_nodes, hub, again=True)
    return _named(found, tools).select(F.array_sort("path").alias("nodes"), F.size("path").alias("n"), "path")


def _named(found: DataFrame, tools: DataFrame, most: int = GROUP) -> DataFrame:
    """path, the tools (node) of each path of numbers (id).

    Paths with the same tool in the middle have most of their tools in common: they are dealt by it, and each tool is looked up
    once for them. Those of a tool in the middle of more paths than ``most`` are dealt to parts.
    """
    rows = found.select("path", F.element_at("path", F.shiftright(F.size("path") + 1, 1)).alias("mid"))
    many = written_copy(rows.groupBy("mid").agg(F.count("*").alias("n")).where(F.col("n") > most).select("mid", F.ceil(F.col("n") / most).alias("parts")))
    rows = rows.join(F.broadcast(many) if many.count() <= HELD else many, "mid", "left")
    part = F.pmod(F.xxhash64("path"), F.coalesce("parts", F.lit(1)))
    # No path is empty and every tool is known: keys that cannot be null and outer forms ask for no filters, so that both reads are alike and the paths are shuffled once.
    rows = spread(rows.select(F.coalesce("mid", F.lit(0)).alias("mid"), F.coalesce(part, F.lit(0)).alias("part"), "path"), "mid", "part")
    ids = rows.select("mid", "part", F.explode_outer("path").alias("id")).distinct()
    names = ids.join(tools.select("id", "node"), "id", "left").groupBy("mid", "part").agg(F.map_from_entries(F.collect_list(F.struct("id", "node"))).alias("names"))
    return rows.join(names, ["mid", "part"], "left").select(F.transform("path", lambda x: F.element_at("names", x)).alias("path"))


def attack_path_kinds(tools: DataFrame, starts: DataFrame | None = None, max_nodes: int = 6, hub: int = HUB) -> DataFrame:
    """``path_kinds`` of all ``attack_paths`` with their ends alone: n, first, last, kind, severity. ``tools`` has what both take."""
    found, known = _numbered_paths(tools, starts, max_nodes, hub)
    said = known.select("id", "node").join(_said(tools), "node")
    ends = found.select(F.size("path").alias("n"), F.element_at("path", 1).alias("a"), F.element_at("path", -1).alias("b"))
    rows = ends.join(said.select(F.col("id").alias("a"), F.col("node").alias("first"), "reads", "takes"), "a")
    rows = rows.join(said.select(F.col("id").alias("b"), F.col("node").alias("last"), "sends", "runs"), "b")
    return rows.select("n", "first", "last", _kind().alias("k")).select("n", "first", "last", "k.*")


def _said(tools: DataFrame) -> DataFrame:
    """node with what its name and description say: reads, takes, sends, runs."""
    told = tools.groupBy(F.struct("server", "name").alias("node")).agg(F.min(F.coalesce("description", F.lit(""))).alias("description"))
    text = F.concat_ws(" ", "node.name", "description")
    takes = F.exists(F.array(*[F.lit(x) for x in TAKES]), lambda x: F.contains(F.lower("description"), x))
    said = {"reads": text.rlike(unicode_pattern(READS)), "takes": takes, "sends": text.rlike(unicode_pattern(SENDS)), "runs": text.rlike(unicode_pattern(RUNS))}
    return told.select("node", *[c.alias(k) for k, c in said.items()])


def _kind() -> Column:
    case = lambda kind, severity: F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))
    found = F.when(F.col("reads") & F.col("sends"), case("exfiltration", "critical")).when(F.col("takes") & F.col("runs"), case("command_injection", "critical"))
    return found.when(F.col("n") >= 3, case("long_chain", "high")).otherwise(case("pair", "medium"))


def path_kinds(paths: DataFrame, tools: DataFrame) -> DataFrame:
    """C006: attack paths (columns n, path) with kind and severity, by what their first and last tool (server, name, description) say."""
    said = _said(tools)
    first = said.select(F.col("node").alias("first"), "reads", "takes")
    last = said.select(F.col("node").alias("last"), "sends", "runs")
    rows = paths.withColumns({"first": F.element_at("path", 1), "last": F.element_at("path", -1)}).join(first, "first").join(last, "last")
    return rows.select("n", "path", _kind().alias("k")).select("n", "path", "k.*")


def escalations(nodes: DataFrame, max_steps: int = 3) -> DataFrame:
    """C007: reading tools from which a writing tool of another server is reached: start, end, steps, kind (direct or chain), severity.

    A tool writes if its name and description hold a word for writing or a part of a word for running commands; it reads if it does
    not write and its name begins with a word for reading. ``nodes`` has server, name, description, types_in and types_out.
    Each step goes from reading tools of the same server and output types to types, never from tool to tool: what
    produces a type is known by the least and the greatest server, since a consumer needs one that is not its own.
    """
    text = tool_text()
    runs = F.exists(F.array(*[F.lit(x) for x in RUN_PARTS]), lambda x: F.contains(F.lower(text), x))
    typed = (F.size(_types("types_in")) > 0) | (F.size(_types("types_out")) > 0)
    # Rows without types tell at most whether a tool that has types in another row writes: only those of such tools are searched for words.
    own, rest = nodes.where(typed), nodes.where(~typed)
    known = own.select("server", "name").distinct()
    rest = rest.join(known, rest["server"].eqNullSafe(known["server"]) & rest["name"].eqNullSafe(known["name"]), "left_semi")
    rows = own.unionByName(rest).withColumn("writes", F.coalesce(text.rlike(unicode_pattern(WRITES)) | runs, F.lit(False)))
    tools = _tools(rows, "writes").withColumn("reads", F.col("node.name").rlike(unicode_pattern(READ_NAME)))
    readers = tools.where("reads and not writes").select("node", F.struct("server", "outs").alias("group"))
    writers = tools.where("writes").select(F.col("node").alias("end"), F.explode("ins").alias("type"))
    through = tools.select("server", F.explode("ins").alias("type"), "outs").select("server", "type", F.explode("outs").alias("next")).distinct()
    other = lambda server: (F.col("low") != server) | (F.col("high") != server)
    now = readers.select("group").distinct().select("group", F.explode("group.outs").alias("type"), F.col("group.server").alias("low"), F.col("group.server").alias("high"))
    found = None
    for step in range(1, max_steps + 1):
        met = now.join(writers, "type").where(other(F.col("end.server")) & (F.col("group.server") != F.col("end.server")))
        met = met.select("group", "end", F.lit(step).alias("steps"))
        found = met if found is None else found.unionByName(met)
        if step < max_steps:
            onward = now.join(through, "type").where(other(F.col("server")))
            now = onward.groupBy("group", F.col("next").alias("type")).agg(F.min("server").alias("low"), F.max("server").alias("high"))
    pairs = found.groupBy("group", "end").agg(F.min("steps").alias("steps")).join(readers, "group")
    kind = F.when(F.col("steps") == 1, "direct").otherwise("chain")
    return pairs.select(F.col("node").alias("start"), "end", "steps", kind.alias("kind"), F.lit("critical").alias("severity"))
