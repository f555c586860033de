"""Queries of feeds, lock files, filters, matches and the audit table, with their SQL."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.rows import spread
from ..operators import policy, scoring, stats, surfaces
from ..sources import adapters as A
from ..sources import documents, manifests, readers, sinks
from ..sources.adapters import with_views
from ..streaming import changes, outbox
from . import exports, relational

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _nvd(spark, d, published: str, version: str):
    """JSON text of a CVE for every part; half of them have the newer metric."""
    metric = lambda name, value: F.concat(F.lit(f'"{name}":[{{"cvssData":{{"baseSeverity":"'), value, F.lit('"}}]'))
    severity = F.when(F.col("p_size") % 3 == 0, "HIGH").otherwise("LOW")
    metrics = F.when(F.col("p_size") % 4 == 0, "").otherwise(metric("cvssMetricV30", severity))
    metrics = F.when(F.col("p_size") % 4 == 1, F.concat(metrics, F.lit(","), metric("cvssMetricV31", F.lit("Critical")))).otherwise(metrics)
    return A.table(spark, d, "part").select(
        F.concat(
            F.lit('{"id":"CVE-'), F.col("p_partkey").cast("string"), F.lit(f'","published":"{published}","descriptions":[{{"lang":"es","value":"no"}},{{"lang":"en","value":"'), "p_name",
            F.lit(f' {version}"}}],"metrics":{{'), metrics, F.lit('},"references":[{"url":"http://x/1"}]}'),
        ).alias("text"),
        F.col("p_partkey"),
    )


_NVD = "CASE p_size % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'critical' ELSE CASE WHEN p_size % 3 = 0 THEN 'high' ELSE 'low' END END"


@query("ref006_nvd_items", f"""SELECT 'CVE-' || p_partkey AS cve_id, p_name || ' new' AS description, {_NVD} AS severity, '2024-05' AS published FROM part""")
def nvd_items(spark, d):
    return readers.nvd_rows(_nvd(spark, d, "2024-05", "new")).drop("references")


@query("ref005_feed_union", f"""SELECT 'CVE-' || p_partkey AS cve_id, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' new' ELSE ' seed' END AS description, {_NVD} AS severity,
CASE WHEN p_partkey % 3 = 0 THEN '2024-05' ELSE '2023-01' END AS published FROM part""")
def feed_union(spark, d):
    """A seed of all parts with a newer feed of a third of them."""
    seed = readers.nvd_rows(_nvd(spark, d, "2023-01", "seed"))
    feed = readers.nvd_rows(_nvd(spark, d, "2024-05", "new").where("p_partkey % 3 = 0"))
    return readers.feed_union(seed, feed).drop("references")


def _locked(spark, d, source: str, content):
    """Dependencies of one manifest for every part; ``content`` is made of a name and a number."""
    part = spread(A.table(spark, d, "part").select("p_partkey", "p_name", "p_size"))
    text = content(F.regexp_replace("p_name", " ", "-"), F.col("p_size").cast("string"))
    files = part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("project"), F.lit(f"app/{source}").alias("path"), text.alias("content"))
    return manifests.dependencies(files).select("project", "source", "ecosystem", "name", "version", "direct", "integrity", "license")


def _locked_sql(source: str, ecosystem: str, *rows: str) -> str:
    each = " UNION ALL ".join(f"SELECT project, '{source}' AS source, '{ecosystem}' AS ecosystem, {row} FROM p" for row in rows)
    return f"WITH p AS (SELECT 'P' || p_partkey AS project, replace(p_name, ' ', '-') AS n, p_size AS s FROM part) {each}"


def _text(template: str):
    """A column from a text in which @ stands for the name and # for the number."""
    return lambda name, size: F.replace(F.replace(F.lit(template), F.lit("@"), name), F.lit("#"), size)


@query("ref013_npm_locks", _locked_sql("package-lock.json", "npm", "n AS name, s || '.0.1' AS version, true AS direct, 'sha512-x' AS integrity, 'MIT' AS license", "'deep', '1.2.3', false, '', ''"))
def npm_locks(spark, d):
    return _locked(spark, d, "package-lock.json", _text('{"packages":{"":{"version":"9"},"node_modules/@":{"version":"#.0.1","integrity":"sha512-x","license":"MIT"},"node_modules/@/node_modules/deep":{"version":"1.2.3"},"node_modules/none":{}}}'))


@query("ref015_pnpm_locks", _locked_sql("pnpm-lock.yaml", "npm", "n AS name, s || '.1.0' AS version, false AS direct, 'sha512-q' AS integrity, '' AS license", "'@scope/' || n, '2.0.0', false, '', ''"))
def pnpm_locks(spark, d):
    scoped = lambda name, size: F.replace(_text("packages:\n  /@%#.1.0:\n    resolution: {integrity: sha512-q}\n  '%scope/@%2.0.0(react%18)':\n    dev: true\n")(name, size), F.lit("%"), F.lit("@"))
    return _locked(spark, d, "pnpm-lock.yaml", scoped)


@query("ref016_yarn_locks", _locked_sql("yarn.lock", "npm", "n AS name, s || '.0.3' AS version, false AS direct, 'sha512-y' AS integrity, '' AS license", "'@scope/' || n, '1.0.5', false, '', ''"))
def yarn_locks(spark, d):
    text = '# yarn lockfile v1\n\n\n@%^#.0.0, @%~#.0.0:\n  version "#.0.3"\n  integrity sha512-y\n  dependencies:\n    other "^1.0.0"\n\n"%scope/@%^1.0.0":\n  version "1.0.5"\n'
    return _locked(spark, d, "yarn.lock", lambda name, size: F.replace(_text(text)(name, size), F.lit("%"), F.lit("@")))


@query("ref018_pyprojects", _locked_sql("pyproject.toml", "PyPI", "n AS name, s || '.1' AS version, true AS direct, '' AS integrity, '' AS license", "n || '-b', s || '.2', true, '', ''", "n || '-c', s || '.3.1', true, '', ''"))
def pyprojects(spark, d):
    return _locked(spark, d, "pyproject.toml", _text('[project]\ndependencies = ["@>=#.1,<99", "free"]\n[tool.poetry.dependencies]\npython = "^3.11"\n@-b = "^#.2"\n@-c = {version = "~#.3.1", extras = ["x"]}\n'))


@query("ref019_python_locks", _locked_sql("poetry.lock", "PyPI", "n AS name, s || '.5' AS version, false AS direct, 'sha256:a' AS integrity, '' AS license", "n || '-b', '0.1', false, 'sha256:w', ''"))
def python_locks(spark, d):
    return _locked(spark, d, "poetry.lock", _text('[[package]]\nname = "@"\nversion = "#.5"\nsdist = {url = "u", hash = "sha256:a"}\n[[package]]\nname = "@-b"\nversion = "0.1"\nwheels = [{hash = "sha256:w"}]\n[[package]]\nname = "none"\n'))


@query("ref051_enabled_rules", f"""{with_views("findings")} SELECT rule_id, severity, count(*) AS n FROM findings WHERE rule_id NOT IN ('R101', 'R103') GROUP BY 1, 2""")
def enabled_rules(spark, d):
    return stats.without_rules(A.findings(spark, d), ["R101", "R103"]).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


_GLOBS = ("r*", "*[aeiou]?", "?l*e *", "*[!a-m]", "small [b-p]*", "")


@query("ref054_globs", " UNION ALL ".join(f"SELECT p_partkey AS id, {i} AS glob FROM part WHERE p_name GLOB '{g}'" for i, g in enumerate(_GLOBS)))
def globs(spark, d):
    part = A.table(spark, d, "part")
    hits = F.array_compact(F.array(*[F.when(F.col("p_name").rlike(X.glob_pattern(g)), i) for i, g in enumerate(_GLOBS)]))
    return part.select(F.col("p_partkey").alias("id"), F.explode(hits).alias("glob"))


@query("ref087_greedy_pairs", """WITH e AS (SELECT l_suppkey AS target_name, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_orderkey, l_linenumber) AS expected, l_linenumber AS rule FROM lineitem WHERE l_returnflag = 'R'),
f AS (SELECT l_suppkey AS target_name, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS detected, l_linenumber AS rule FROM lineitem WHERE l_returnflag = 'A'),
a AS (SELECT *, row_number() OVER (PARTITION BY target_name, rule ORDER BY expected) AS i FROM e), b AS (SELECT *, row_number() OVER (PARTITION BY target_name, rule ORDER BY detected) AS i FROM f)
SELECT target_name, expected, detected FROM a LEFT JOIN b USING (target_name, rule, i)""")
def greedy_pairs(spark, d):
    """Returned lines as expectations of a supplier, accepted ones as detections: the first of a rule takes the first that is left."""
    line = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("target_name"), F.concat(F.lit("R"), F.col("l_linenumber").cast("string")).alias("rule_id"), "l_returnflag", "l_partkey", "l_orderkey", "l_linenumber")
    number = lambda flag, *order: line.where(F.col("l_returnflag") == flag).withColumn("ord", F.row_number().over(policy.Window.partitionBy("target_name").orderBy(*order)))
    expected = number("R", "l_partkey", "l_orderkey", "l_linenumber").select("target_name", "ord", "rule_id", F.lit("*").alias("target_glob"))
    detected = number("A", "l_orderkey", "l_linenumber").select("target_name", "ord", "rule_id", F.col("l_partkey").cast("string").alias("tool"))
    return policy.greedy_pairs(expected, detected)


@query("ref111_dominant", f"""{with_views("findings", "tools")}, {relational._TAGS}, m AS (SELECT server, max_by(tag, w) AS tag FROM tags GROUP BY server)
SELECT server, coalesce(tag, 'pure_compute') AS dominant FROM (SELECT DISTINCT server FROM tools) LEFT JOIN m USING (server)""")
def dominant(spark, d):
    return relational._server_rows(spark, d).select("server", scoring.dominant("tags").alias("dominant"))


@query("ref211_segments", """SELECT p_partkey AS id, regexp_matches(lower(p_name), '(?:^|[^a-z])red(?:[^a-z]|$)') AS whole FROM part WHERE contains(lower(p_name), 'red')""")
def segments(spark, d):
    rows = A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("text")).where(F.contains("text", F.lit("red")))
    return rows.select("id", surfaces.has_segment("red").alias("whole"))


@query("ref221_severities", """SELECT l_orderkey AS scan_id, l_linenumber AS ord, CASE WHEN l_discount = 0 THEN 'medium' WHEN l_quantity >= 45 THEN 'critical' WHEN l_quantity >= 35 THEN 'high' WHEN l_quantity >= 20 THEN 'medium' ELSE 'low' END AS severity FROM lineitem""")
def severities(spark, d):
    score = F.when(F.col("l_discount") != 0, F.col("l_quantity").cast("double") / 5)
    return A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("ord"), X.cvss_severity(score).alias("severity"))


@query("ref034_json_export", f"""{with_views("findings")} SELECT '{{"scan_id":' || scan_id || ',"ord":' || ord || ',"rule_id":"' || rule_id || '","severity":"' || severity || '"}}' AS value FROM findings""")
def json_export(spark, d):
    return sinks.json_lines(A.findings(spark, d).select("scan_id", "ord", "rule_id", "severity"))


@query("ref035_csv_export", f"""{with_views("findings")} SELECT rule_id, severity, 'Finding, "of" ' || rule_id AS title, server, tool, 'tool/' || tool AS location, count(*) AS n FROM findings GROUP BY ALL""")
def csv_export(spark, d):
    """All findings written as CSV and read back."""
    path = f"{changes.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    rows = A.findings(spark, d).withColumn("title", F.concat(F.lit('Finding, "of" '), "rule_id")).withColumn("location", F.concat(F.lit("tool/"), "tool"))
    sinks.write_csv(rows, path)
    back = spark.read.option("header", True).csv(path)
    return back.groupBy(*back.columns).agg(F.count("*").alias("n"))


@query("ref044_markdown_rows", """SELECT '| ' || s_name || ' | ' || s_suppkey || '\\|' || s_nationkey || ' |' AS row FROM supplier""")
def markdown_rows(spark, d):
    rows = A.table(spark, d, "supplier").withColumn("pair", F.concat_ws("|", "s_suppkey", "s_nationkey"))
    return sinks.markdown_rows(rows, ["s_name", "pair"])


@query("ref033_audit_table", f"""{with_views("audit")} SELECT event_id, event_type, target FROM audit WHERE CAST(timestamp AS TIMESTAMP) >= TIMESTAMP '2024-01-05 12:00:00' AND event_id % 11 <> 0""")
def audit_table(spark, d):
    """The audit log appended by a stream; then what is old and one event in eleven are deleted."""
    folder = f"{changes.shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    copy = changes.written_copy(A.audit(spark, d).select(F.col("event_id").alias("id"), F.col("timestamp").cast("timestamp").alias("timestamp"), "event_type", "target"))
    stream = spark.readStream.schema(copy.schema).parquet(copy.inputFiles()[0].rpartition("/")[0])
    changes.append_audit(stream, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    changes.delete_events(spark, f"{folder}/table", gone=copy.where("id % 11 = 0").select("id"), before="2024-01-05 12:00:00")
    return spark.read.parquet(f"{folder}/table").select(F.col("id").alias("event_id"), "event_type", "target")


@query("ref042_leaderboard_document", f"""WITH r AS ({relational.ORACLES["leaderboard_rank"]}), n AS (SELECT *, row_number() OVER w AS i, count(*) OVER () AS n FROM r WINDOW w AS (ORDER BY n_tools = 0, coalesce(score, 11), n_tools DESC, name))
SELECT name, score, grade, i = 1 AS opens, i = n AS closes, '<text x="6" y="14" fill="#fff">' || grade || ' ' || printf('%.1f', score) || '</text>' AS badge FROM n""")
def leaderboard_document(spark, d):
    """The leaderboard written as one JSON array, its lines read back, and the text of each server's badge."""
    path = f"{changes.shared_folder(spark)}/leaderboard-{uuid.uuid4().hex}"
    rows = relational.leaderboard(spark, d).select("name", "scanned", "score", "n_tools", "grade", "driver")
    documents.write_leaderboard(rows, path)
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    closes = F.endswith("value", F.lit("}]"))
    text = F.when(closes, F.expr("substring(value, 2, length(value) - 2)")).otherwise(F.expr("substring(value, 2)"))
    back = lines.select(F.from_json(text, "name string, score double, grade string").alias("r"), F.startswith("value", F.lit("[")).alias("opens"), closes.alias("closes"))
    return back.select("r.*", "opens", "closes", F.regexp_extract(sinks.badge(F.col("r.grade"), F.col("r.score")), "<text.*</text>", 0).alias("badge"))


@query("ref242_alerts", exports.ORACLES["ref240_watch"])
def alerts(spark, d):
    """The changes of ref240 as alerts, handed over batch by batch through the outbox; the first attempt of each batch fails."""
    root = f"{changes.shared_folder(spark)}/alerts-{uuid.uuid4().hex}"
    tried = set()

    def send(found, number: int) -> None:
        if number not in tried:
            tried.add(number)
            raise OSError("receiver is away")
        found.write.mode("overwrite").parquet(f"{root}/received/{number}")

    query = changes.watch(exports.snapshots(spark, d)).writeStream.foreachBatch(lambda batch, n: outbox.deliver(batch, n, root, send))
    query.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(changes.CHANGES).parquet(f"{root}/received/*")


@query("ref144_pending", """WITH r AS (SELECT o_custkey AS name, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS file, o_orderkey % 8 <> 0 AS incomplete, CASE WHEN o_orderkey % 11 > 0 THEN o_orderdate END AS scanned_at, o_orderkey % 7 = 0 AS stub FROM orders),
g AS (SELECT name, bool_or(NOT incomplete AND NOT stub) AS done, max(scanned_at) FILTER (incomplete) AS last, min_by(file, (NOT stub, file)) AS file FROM r GROUP BY name)
SELECT name, file FROM g WHERE NOT done AND coalesce(last <= TIMESTAMP '2000-11-25', true)""")
def pending(spark, d):
    """Customers as servers, their orders as result files: who is still to be scanned a week later."""
    key = F.col("o_orderkey")
    rows = A.table(spark, d, "orders").select(
        F.col("o_custkey").alias("name"),
        F.lpad(key.cast("string"), 9, "0").alias("file"),
        (key % 8 != 0).alias("incomplete"),
        F.when(key % 11 > 0, F.col("o_orderdate").cast("timestamp")).alias("scanned_at"),
        F.when(key % 7 == 0, "registry-pending").otherwise("scanned").alias("status"),
    )
    return policy.pending(rows, datetime(2000, 12, 2))
