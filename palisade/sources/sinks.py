"""Exports: SARIF, CEF, JSON, CSV, DOT, SBOM, badges and Markdown as columns of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stats import rank_of


def sarif_level(severity: str = "severity") -> Column:
    return F.when(F.col(severity).isin("critical", "high"), "error").when(F.col(severity) == "medium", "warning").otherwise("note")


def sarif_results(findings: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``result``, a SARIF 2.1.0 result in JSON. A location path:line is physical, any other logical."""
    line = F.regexp_extract("location", r"^(.*):(\d+)$", 2)
    path = F.regexp_extract("location", r"^(.*):(\d+)$", 1)
    physical = F.when(
        line != "",
        F.struct(F.struct(F.struct(path.alias("uri")).alias("artifactLocation"), F.struct(line.try_cast("int").alias("startLine")).alias("region")).alias("physicalLocation")),
    )
    logical = F.when(line == "", F.struct(F.array(F.struct(F.col("location").alias("fullyQualifiedName"))).alias("logicalLocations")))
    result = F.struct(
        F.col("rule_id").alias("ruleId"),
        sarif_level().alias("level"),
        F.struct(F.col("title").alias("text")).alias("message"),
        F.coalesce(F.to_json(physical), F.to_json(logical)).alias("_location"),
    )
    text = F.to_json(result)
    # The location is JSON of one of two shapes: it is put in as an array of one.
    return findings.select(
        *keys,
        F.concat(
            F.regexp_replace(text, r',?"_location":.*$', ""), F.lit(',"locations":['), result["_location"], F.lit("]}")
        ).alias("result"),
    )


def sarif_documents(findings: DataFrame, by: str) -> DataFrame:
    """A whole SARIF document for each value of ``by``: a scan's findings, most severe first."""
    rows = sarif_results(findings.withColumn("_rank", -rank_of("severity")), [by, "_rank", "rule_id"])
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "rule_id", "result"))), lambda r: r["result"]), ",")
    head = '{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":"palisade"}},"results":['
    return rows.groupBy(by).agg(F.concat(F.lit(head), ordered, F.lit("]}]}")).alias("document"))


def cef_escape(text: Column) -> Column:
    """A value of a CEF line: backslashes, equals signs, bars and line ends are escaped."""
    for plain, escaped in (("\\", "\\\\"), ("=", "\\="), ("\n", "\\n"), ("\r", "\\r"), ("|", "\\|")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


#: How grave CEF takes a finding to be; the name of the score in a line.
CEF_LEVELS = {"low": 3, "medium": 5, "high": 8, "critical": 10}
SCORE_LABEL = "MRS-v1"


def cef_lines(findings: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``line``, in CEF:0, of findings (rule_id, severity, title, description, server, tool, and n_findings and n_tools of the scan).

    The score is half the tenth of findings per tool, 10 at most; descriptions end after 120 characters.
    """
    level = F.lit("5")
    for name, n in CEF_LEVELS.items():
        level = F.when(F.col("severity") == name, str(n)).otherwise(level)
    score = F.when(F.col("n_tools") == 0, 0.0).otherwise(F.least(F.lit(10.0), F.try_divide(F.col("n_findings"), F.col("n_tools")) * 5))
    value = lambda c: cef_escape(F.coalesce(F.col(c), F.lit("")))
    title = cef_escape(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("rule_id")))
    server = cef_escape(F.coalesce(F.nullif(F.col("server"), F.lit("")), F.lit("unknown")))
    fields = {
        "suser": value("tool"), "cs1": server, "cs2": F.lit("scanner"), "cs3": F.lit("1.0"), "cn1": F.format_string("%.1f", F.bround(score, 1)),
        "cn1Label": F.lit(SCORE_LABEL), "cs4": F.col("severity"), "cs5": F.substring(value("description"), 1, 120), "cs6": value("rule_id"), "msg": title,
    }
    head = F.concat_ws("|", F.lit("CEF:0|palisade|scanner|1.0"), value("rule_id"), title, level)
    line = F.concat(head, F.lit("|"), F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), v) for k, v in fields.items()]))
    return findings.select(*keys, line.alias("line"))


def cef_payloads(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """scan_id and ``payload``, JSON to post: each scan (scan_id, server, transport, scanned_at, n_tools) with the CEF lines of its findings (with ord)."""
    counts = findings.groupBy("scan_id").agg(F.count("*").alias("n_findings"))
    counted = findings.join(counts, "scan_id").join(scans.select("scan_id", F.greatest("n_tools", F.lit(1)).alias("n_tools")), "scan_id")
    lines = cef_lines(counted, ["scan_id", "ord"]).groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("l"))
    rows = scans.join(lines, "scan_id", "left").withColumn("lines", F.coalesce(F.col("l.line"), F.array().cast("array<string>")))
    fields = {
        "vendor": F.lit("palisade"), "product": F.lit("scanner"), "version": F.lit("1.0"), "target": F.col("server"), "transport": F.col("transport"),
        "tool_count": F.col("n_tools"), "finding_count": F.size("lines"), "cef_lines": F.col("lines"), "timestamp": F.col("scanned_at"),
    }
    return rows.select("scan_id", F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("payload"))


def json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def write_csv(findings: DataFrame, path: str) -> None:
    findings.select("rule_id", "severity", "title", "server", "tool", "location").write.mode("overwrite").option("header", True).csv(path)


#: Colours of servers in turn; of tools that write or run, that read, and others; words of tools that run.
SERVER_COLOURS = ("#e8eaf6", "#fce4ec", "#e8f5e9", "#fff3e0", "#e0f7fa", "#f3e5f5", "#efebe9", "#e0e0e0")
WRITING, READING, PLAIN = "#ffcdd2", "#c8e6c9", "#ffffff"
RUNNING = ("exec", "shell", "spawn", "sudo", "cmd")


def _dot_id(*parts: str) -> Column:
    return F.regexp_replace(F.concat_ws("_", *parts), r"[^A-Za-z0-9_]", "_")


def _dot_text(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def dot_clusters(nodes: DataFrame) -> DataFrame:
    """A Graphviz cluster for each server (server, tool, description): tools by what they do; identifiers hold letters, digits and _ only."""
    from ..functions.text import unicode_pattern
    from ..operators.crossref import WRITES
    from ..operators.surfaces import READING_NAME

    text = F.concat_ws(" ", "tool", "description")
    runs = F.exists(F.array(*[F.lit(x) for x in RUNNING]), lambda x: F.contains(F.lower(text), x))
    colour = F.when(text.rlike(unicode_pattern(WRITES)) | runs, WRITING).when(F.col("tool").rlike(READING_NAME), READING).otherwise(PLAIN)
    node = F.concat(F.lit("    "), _dot_id("server", "tool"), F.lit(' [label="'), _dot_text(F.col("tool")), F.lit('", fillcolor="'), colour, F.lit('"];'))
    return nodes.groupBy("server").agg(F.array_join(F.array_sort(F.collect_set(node)), "\n").alias("body")).select(
        "server", F.concat(F.lit("  subgraph cluster_"), _dot_id("server"), F.lit(' {\n    label="'), _dot_text(F.col("server")), F.lit('";\n'), "body", F.lit("\n  }")).alias("cluster"),
    )


def dot_edges(edges: DataFrame) -> DataFrame:
    """src, dst and ``line``, the Graphviz line of each edge (src, dst: server and name; shared: types)."""
    line = F.concat(
        F.lit('  "'), _dot_id("src.server", "src.name"), F.lit('" -> "'), _dot_id("dst.server", "dst.name"), F.lit('" [label="'), F.array_join("shared", ", "), F.lit('"];')
    )
    return edges.select("src", "dst", line.alias("line"))


def write_dot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The lines of one digraph as text files whose order is that of the graph; the fill of a server goes by the hash of its name."""
    fill = F.element_at(F.array(*[F.lit(c) for c in SERVER_COLOURS]), (F.pmod(F.xxhash64("server"), F.lit(len(SERVER_COLOURS))) + 1).cast("int"))
    clusters = dot_clusters(nodes).select(F.lit(1).alias("part"), F.replace("cluster", F.lit(" {\n"), F.concat(F.lit(' {\n    style=filled;\n    fillcolor="'), fill, F.lit('";\n'))).alias("line"))
    lines = clusters.unionByName(dot_edges(edges).select(F.lit(2).alias("part"), "line"))
    ends = nodes.sparkSession.createDataFrame([(0, "digraph AttackGraph {\n  rankdir=LR;\n  node [shape=box, style=filled];"), (3, "}")], "part int, line string")
    lines.unionByName(ends).orderBy("part", "line").select("line").write.mode("overwrite").text(path)


def purl(ecosystem: str = "ecosystem", name: str = "name", version: str = "version") -> Column:
    """The package URL of a dependency; the @ and / of names stay."""
    quoted = F.url_encode(F.col(name))
    for coded, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%40", "@"), ("%2F", "/")):
        quoted = F.replace(quoted, F.lit(coded), F.lit(plain))
    return F.concat(F.lit("pkg:"), F.when(F.col(ecosystem) == "npm", "npm").otherwise("pypi"), F.lit("/"), quoted, F.lit("@"), F.col(version))


def integrity_hash(integrity: str = "integrity") -> Column:
    """struct(alg, content) of algorithm-digest or algorithm:digest, the digest in hex or base64; null if it is none."""
    kind = F.upper(F.regexp_extract(integrity, r"(?i)^(sha(?:1|256|384|512))[-:]", 1))
    digest = F.regexp_extract(integrity, r"(?i)^sha\d+[-:](.*)$", 1)
    raw = F.lower(F.hex(F.try_to_binary(digest, F.lit("base64"))))
    content = F.when(digest.rlike("^[0-9a-fA-F]*$"), F.lower(digest)).otherwise(raw)
    return F.when((kind != "") & content.isNotNull(), F.struct(F.replace(kind, F.lit("SHA"), F.lit("SHA-")).alias("alg"), content.alias("content")))


def name_uuid(text: Column) -> Column:
    """The name-based UUID (version 5, namespace of URLs) of a text."""
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(text, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def sbom_components(dependencies: DataFrame) -> DataFrame:
    """project, name, version, purl and ``component``, in the terms of CycloneDX, of dependencies as ``manifests.dependencies`` gives them."""
    prop = lambda k, v: F.struct(F.lit(f"palisade:dependency:{k}").alias("name"), v.alias("value"))
    properties = F.array(prop("scope", F.when(F.col("direct"), "direct").otherwise("transitive")), prop("source", F.col("source")))
    hashes = integrity_hash()
    component = F.struct(
        F.lit("library").alias("type"), F.col("purl").alias("bom-ref"), "name", "version", "purl", properties.alias("properties"),
        F.when(hashes.isNotNull(), F.array(hashes)).alias("hashes"),
        F.when(F.col("license") != "", F.array(F.struct(F.struct(F.col("license").alias("name")).alias("license")))).alias("licenses"),
    )
    return dependencies.withColumn("purl", purl()).select("project", "name", "version", "purl", F.to_json(component).alias("component"))


def sbom_edges(dependencies: DataFrame) -> DataFrame:
    """project, ref, depends_on of dependencies: names are looked up in lower case, of several versions of a name the greatest purl counts."""
    rows = dependencies.withColumn("purl", purl())
    by_name = rows.groupBy("project", F.lower("name").alias("needed")).agg(F.max("purl").alias("depends_on"))
    needs = rows.select("project", F.col("purl").alias("ref"), F.explode("requires").alias("needed")).withColumn("needed", F.lower("needed"))
    return needs.join(by_name, ["project", "needed"]).select("project", "ref", "depends_on").distinct()


def sbom_documents(dependencies: DataFrame, projects: DataFrame) -> DataFrame:
    """project and ``document``, a CycloneDX 1.7 document, for each project (project, name, version, ecosystem).

    Components are in the order of their lower-case names and versions; the root depends on what is direct. The serial is
    made of the root and the components, so equal projects have equal documents; a document bears no time.
    """
    plain = lambda c, order: F.transform(F.array_sort(F.collect_list(F.struct(*order, c))), lambda x: x[c])
    parts = sbom_components(dependencies).withColumn("low", F.lower("name"))
    parts = parts.groupBy("project").agg(plain("component", ["low", "version"]).alias("components"), plain("purl", ["low", "version"]).alias("refs"))
    rows = dependencies.withColumn("ref", purl())
    edges = sbom_edges(dependencies).groupBy("project", "ref").agg(F.array_sort(F.collect_set("depends_on")).alias("dependsOn"))
    each = rows.select("project", "ref", "direct").join(edges, ["project", "ref"], "left")
    entry = F.struct("ref", F.coalesce("dependsOn", F.array().cast("array<string>")).alias("dependsOn"))
    each = each.groupBy("project").agg(F.array_sort(F.collect_set(entry)).alias("needs"), F.array_sort(F.collect_set(F.when(F.col("direct"), F.col("ref")))).alias("direct"))
    root = F.when(F.col("ecosystem").isNull(), F.concat(F.lit("pkg:generic/"), "name", F.lit("@"), "version")).otherwise(purl())
    joined = projects.withColumn("root", root).join(parts, "project", "left").join(each, "project", "left")
    texts = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    serial = name_uuid(F.to_json(F.struct("root", texts("refs").alias("components"))))
    first = F.struct(F.col("root").alias("ref"), texts("direct").alias("dependsOn"))
    needs = F.concat(F.array(first), F.coalesce("needs", F.array().cast("array<struct<ref:string,dependsOn:array<string>>>")))
    identity = F.struct(F.lit("application").alias("type"), F.col("root").alias("bom-ref"), "name", "version", F.col("root").alias("purl"))
    document = F.concat(
        F.lit('{"$schema":"https://cyclonedx.org/schema/bom-1.7.schema.json","bomFormat":"CycloneDX","specVersion":"1.7","serialNumber":"urn:uuid:'),
        serial, F.lit('","version":1,"metadata":{"component":'), F.to_json(identity), F.lit('},"components":['), F.array_join(texts("components"), ","),
        F.lit('],"dependencies":'), F.to_json(needs), F.lit("}"),
    )
    return joined.select("project", document.alias("document"))


def badge(grade: Column, score: Column) -> Column:
    """A small SVG badge."""
    colour = F.lit("#e05d44")
    for g, c in (("D", "#fe7d37"), ("C", "#dfb317"), ("B", "#97ca00"), ("A", "#4c1")):
        colour = F.when(grade == g, c).otherwise(colour)
    return F.format_string(
        '<svg xmlns="http://www.w3.org/2000/svg" width="90" height="20"><rect width="90" height="20" fill="%s"/>'
        '<text x="6" y="14" fill="#fff">%s %.1f</text></svg>',
        colour, grade, score,
    )


def markdown_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    cells = [F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")) for c in columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("row"))


def envelope(rows: DataFrame, key: str, *fields: str) -> DataFrame:
    """The canonical JSON of each row (fields in order of their names) and its SHA-256, for a signature to cover."""
    payload = F.to_json(F.struct(*sorted(fields)))
    return rows.select(key, payload.alias("payload"), F.sha2(payload, 256).alias("sha256"))
