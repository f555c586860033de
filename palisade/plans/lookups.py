"""Queries of the smaller operators: exports read back, gaps, thresholds, first rows, migration and names, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import schema
from ..functions import text as X
from ..operators import lists, policy, posture
from ..sources import adapters as A
from ..sources import documents
from ..sources.adapters import with_views
from ..streaming.changes import shared_folder
from . import detections

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


@query("ref036_audit_array", f"""{with_views("audit")}, n AS (SELECT *, row_number() OVER (ORDER BY timestamp, event_id) AS i, count(*) OVER () AS n FROM audit)
SELECT event_id, event_type, target, i = 1 AS opens, i = n AS closes FROM n""")
def audit_array(spark, d):
    """The audit log written as one JSON array in parts, and its lines read back: only the first opens it, only the last closes it."""
    path = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    documents.export_audit(A.audit(spark, d), path, "json")
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    closes = F.endswith("value", F.lit("}]"))
    event = F.from_json(F.when(closes, F.expr("substring(value, 2, length(value) - 2)")).otherwise(F.expr("substring(value, 2)")), "event_id long, event_type string, target string")
    return lines.select(event.alias("e"), F.startswith("value", F.lit("[")).alias("opens"), closes.alias("closes")).select("e.*", "opens", "closes")


@query("ref120_evidence_gaps", """WITH c AS (SELECT l_partkey AS part, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag = 'A') AS n FROM lineitem GROUP BY 1)
SELECT part, greatest(0, 9 - p) AS more_positive, greatest(0, 9 - n) AS more_negative FROM c WHERE p < 9 OR n < 9""")
def evidence_gaps(spark, d):
    flag = lambda x: F.count_if(F.col("l_returnflag") == x)
    counts = A.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(flag("R").alias("positive"), flag("A").alias("negative"))
    return policy.evidence_gaps(counts, "part", 9)


@query("ref142_first_findings", """SELECT l_suppkey AS server, l_partkey AS tool, min((l_orderkey, l_linenumber))[1] AS scan_id FROM lineitem GROUP BY 1, 2""")
def first_findings(spark, d):
    rows = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("server"), F.col("l_partkey").alias("tool"), F.col("l_orderkey").alias("scan_id"), "l_linenumber")
    return policy.first_of(rows, ["server", "tool"], ["scan_id", "l_linenumber"]).drop("l_linenumber")


@query("ref185_typosquat_findings", f"""SELECT name, 'T001' AS rule_id, 'high' AS severity, 'close to ' || suspected AS title FROM ({detections.ORACLES["ref084_typosquats"]})""")
def typosquat_findings(spark, d):
    return posture.typosquat_findings(detections.QUERIES["ref084_typosquats"](spark, d))


@query("ref188_migration_issues", """SELECT s_name AS target, 'session' AS issue FROM supplier WHERE s_suppkey % 3 > 0 AND s_suppkey % 4 IN (0, 3)""")
def migration_issues(spark, d):
    """Suppliers that keep sessions, under versions before and of the profile."""
    version = F.element_at(F.array(*[F.lit(x) for x in ("2024-11-05", "2025-06-18", "2025-06", "2025-03-26")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    rows = A.table(spark, d, "supplier").select(F.col("s_name").alias("target"), version.alias("protocol_version"), (F.col("s_suppkey") % 3 > 0).alias("uses_session"))
    return posture.migration_issues(rows)


@query("ref202_canonical_schemas", """SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN NULL ELSE '{"a":[{"c":1,"d":null}],"b":{"x":"' || p_name || '","y":' || p_size || '}}' END AS canonical FROM part""")
def canonical_schemas(spark, d):
    text = F.concat(F.lit('{ "b": {"y": '), F.col("p_size").cast("string"), F.lit(', "x":"'), "p_name", F.lit('"}, "a" : [{"d":null,"c":1}]'), F.when(F.col("p_size") % 5 == 0, "").otherwise("}"))
    rows = A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("text"))
    return rows.select("id", schema.canonical_json("text").alias("canonical"))


@query("ref218_repositories", """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'own' || p_size || '/' || replace(p_name, ' ', '-') WHEN 1 THEN 'own/name' WHEN 5 THEN 'a/b' END AS repository FROM part""")
def repositories(spark, d):
    name, size, k = F.regexp_replace("p_name", " ", "-"), F.col("p_size").cast("string"), F.col("p_partkey") % 6
    url = F.when(k == 0, F.concat(F.lit("https://github.com/own"), size, F.lit("/"), name, F.lit(".git"))).when(k == 1, "git+ssh://git@github.com/own/name/tree/main?x=1#y")
    url = url.when(k == 2, F.concat(F.lit("https://github.com/"), name)).when(k == 3, "https://gitlab.com/own/name").when(k == 4, "github.com/own/name").otherwise("//www.github.com//a/b/")
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.repository(url).alias("repository"))


@query("ref237_thresholds", """WITH c AS (SELECT p_brand AS module, sum(p_size) * 100.0::DOUBLE / sum(50) AS share FROM part GROUP BY 1),
t AS (SELECT DISTINCT p_brand AS module, 52.0::DOUBLE AS threshold FROM part WHERE p_size = 7)
SELECT module, round(share, 6) AS share FROM c LEFT JOIN t USING (module) WHERE share < coalesce(threshold, 50)""")
def thresholds(spark, d):
    """Brands as modules: a few have a threshold of their own."""
    part = A.table(spark, d, "part").withColumn("module", F.col("p_brand"))
    coverage = part.groupBy("module").agg(F.sum("p_size").alias("covered"), F.sum(F.lit(50)).alias("total"))
    own = part.where("p_size = 7").select("module", F.lit(52.0).alias("threshold")).distinct()
    return lists.below_threshold(coverage, own, 50.0).withColumn("share", F.round("share", 6))
