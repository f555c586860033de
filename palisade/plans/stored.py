"""Queries over the snapshot store: commits, replacement, deletion and fingerprints, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import adapters as A
from ..sources import envelopes, readers, store
from ..sources.adapters import with_views
from ..streaming.changes import shared_folder

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


@query("ref030_store", f"""{with_views("scans", "findings")}, kept AS (SELECT scan_id, target, scan_id % 3 = 0 AS again FROM scans WHERE scan_id % 5 <> 0),
n AS (SELECT scan_id, count(*) AS n, count(DISTINCT tool) AS tools, string_agg(rule_id, ',' ORDER BY ord) AS rules FROM findings GROUP BY scan_id)
SELECT k.scan_id, target || CASE WHEN again THEN '-again' ELSE '' END AS target, CASE WHEN again THEN 0 ELSE coalesce(n, 0) END AS findings, coalesce(tools, 0) AS tools,
  CASE WHEN again THEN '' ELSE coalesce(rules, '') END AS rules FROM kept k LEFT JOIN n USING (scan_id)""")
def stored_scans(spark, d):
    """Every scan with its findings and tools: one in three is put again without findings, one in five deleted; what the newest version holds."""
    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    scans = A.scans(spark, d).select("scan_id", "target")
    found = A.findings(spark, d)
    children = {"findings": found.select("scan_id", "ord", "rule_id"), "tools": found.select("scan_id", F.col("tool").alias("name")).distinct()}
    third = F.col("scan_id") % 3 == 0
    store.commit(spark, root, scans, children)
    store.commit(spark, root, scans.where(third).withColumn("target", F.concat("target", F.lit("-again"))), {"tools": children["tools"].where(third)})
    store.delete_scans(spark, root, scans.where("scan_id % 5 = 0").select("scan_id"))
    rules = store.read(spark, root, "findings").groupBy("scan_id").agg(F.count("*").alias("findings"), F.array_sort(F.collect_list(F.struct("ord", "rule_id"))).alias("r"))
    tools = store.read(spark, root, "tools").groupBy("scan_id").agg(F.count("*").alias("tools"))
    rows = store.read(spark, root, "scans").join(rules, "scan_id", "left").join(tools, "scan_id", "left").fillna(0, ["findings", "tools"])
    return rows.select("scan_id", "target", "findings", "tools", F.coalesce(F.array_join("r.rule_id", ","), F.lit("")).alias("rules"))


@query("ref032_fingerprints", """WITH n AS (SELECT CAST(l_suppkey AS VARCHAR) AS server_id, l_orderkey % 2 AS half, max(l_orderkey) AS last_seen, count(*) AS tool_count FROM lineitem GROUP BY 1, 2)
SELECT server_id, max(last_seen) AS last_seen, max_by(tool_count, last_seen) AS tool_count FROM n WHERE CAST(server_id AS INT) % 7 <> 0 GROUP BY server_id""")
def stored_fingerprints(spark, d):
    """Fingerprints of every server from the orders of odd and then of even number: the newer stays, whichever came first; one server in seven is deleted."""
    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    rows = A.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("server_id"), (F.col("l_orderkey") % 2).alias("half"))
    rows = rows.agg(F.max("l_orderkey").alias("last_seen"), F.count("*").alias("tool_count"))
    for half in (1, 0):
        store.merge_fingerprints(spark, root, rows.where(F.col("half") == half).drop("half"))
    store.delete_fingerprints(spark, root, rows.where("cast(server_id AS int) % 7 = 0").select("server_id"))
    return store.fingerprints(spark, root)


#: Reports by a part's number modulo 7, and the faults that each has.
_REPORTS = (
    ('{"target":"@","tools":[{"name":"a"}],"findings":[{"rule_id":"R1","severity":"High"}]}', ()),
    ('{"target":["@"],"incomplete":"yes"}', (("target", 'no text: ["@"]'), ("incomplete", 'no flag: "yes"'))),
    ('{"target":"@","findings":[{"severity":"odd","title":3},{"severity":"low","detail":[1]}]}', (("findings[0].severity", "no severity: odd"), ("findings[1].detail", "no object: [1]"))),
    ('{"target":"@","tools":[5,{"name":{"x":1},"input_schema":"@"}]}', (("tools[0]", "no object: 5"), ("tools[1].name", 'no text: {"x":1}'), ("tools[1].input_schema", 'no object: "@"'))),
    ('{"target":"@","tools":{},"findings":7}', (("tools", "no list: {}"), ("findings", "no list: 7"))),
    ('["@"]', (("", "no report"),)),
    ('{"target":"@"', (("", "no report"),)),
)
_FAULTS = ", ".join(f"({n}, '{field}', '{problem}')" for n, (_, faults) in enumerate(_REPORTS) for field, problem in faults)


def _reports(spark, d):
    text = F.element_at(F.array(*[F.lit(t) for t, _ in _REPORTS]), (F.col("p_partkey") % len(_REPORTS) + 1).cast("int"))
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("source"), F.replace(text, F.lit("@"), F.col("p_name")).alias("text"))


@query("ref003_report_errors", f"""SELECT p_partkey AS source, field, replace(problem, '@', p_name) AS problem FROM part JOIN (VALUES {_FAULTS}) AS f(n, field, problem) ON n = p_partkey % {len(_REPORTS)}""")
def report_errors(spark, d):
    """What the type guards refuse of a report for every part."""
    return readers.report_rows(_reports(spark, d))[3]


@query("ref003_report_findings", """SELECT p_partkey AS source, 0 AS ord, 'R1' AS rule_id, 'high' AS severity, '{}' AS detail FROM part WHERE p_partkey % 7 = 0
UNION ALL SELECT p_partkey, 1, '', 'low', '{}' FROM part WHERE p_partkey % 7 = 2""")
def report_findings(spark, d):
    return readers.report_rows(_reports(spark, d))[2].select("source", "ord", "rule_id", "severity", "detail")


@query("ref043_signed_envelopes", """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 1 THEN 'digest differs' WHEN 2 THEN 'signature is wrong' WHEN 3 THEN 'key id of another key' WHEN 4 THEN 'no JSON' END AS problem FROM part""")
def signed_envelopes(spark, d):
    """An envelope for every part, four in five of them changed after they were signed, and what verification says."""
    part = A.table(spark, d, "part")
    payload = F.to_json(F.struct(F.col("p_name").alias("target"), F.struct("p_type", "p_size").alias("detail"), F.array("p_brand").alias("tools")))
    rows = envelopes.sign_payloads(part.select(F.col("p_partkey").alias("id"), payload.alias("payload")), bytes(range(32)), "2024-01-01T00:00:00+00:00")
    text, k = F.col("envelope"), F.col("id") % 5
    changed = F.when(k == 1, F.regexp_replace(text, '"target":"', '"target":"x')).when(k == 3, F.regexp_replace(text, '"key_id":"..', '"key_id":"zz')).when(k == 4, F.concat(text, F.lit("}")))
    # A digest that fits the changed payload leaves only the signature to tell.
    other = F.regexp_replace("payload", '"target":"', '"target":"x')
    forged = envelopes.sign_payloads(rows.select("id", "envelope", other.alias("payload")).withColumnRenamed("envelope", "own"), bytes(32), "2024-01-01T00:00:00+00:00")
    forged = forged.where(k == 2).withColumn("envelope", F.regexp_replace("envelope", '"signature":.*$', "")).withColumn("envelope", F.concat("envelope", F.regexp_extract("own", '("signature":.*)$', 1)))
    whole = rows.where(k != 2).select("id", F.coalesce(changed, text).alias("envelope")).unionByName(forged.select("id", "envelope"))
    return envelopes.verify_envelopes(whole).select("id", "problem")
