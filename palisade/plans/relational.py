"""Queries over scans, findings and the audit log, with their SQL.

Times are compared with fixed instants instead of the clock, so that a query
gives the same rows on any day.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff, policy, scoring, stats
from ..operators.rules import CAPABILITIES, capability_tags
from ..sources import adapters as A
from ..sources.adapters import with_views

UNTIL, SINCE = datetime(2001, 1, 1), datetime(1998, 1, 1)
CUTOFF = datetime(1997, 1, 1)
AUDIT_SINCE, AUDIT_UNTIL = datetime(2024, 1, 8), datetime(2024, 2, 1)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("ref100_scan_counts", f"""{with_views("scans")}
SELECT target, count(*) AS scans, min(scanned_at) AS first_scan, max(scanned_at) AS last_scan FROM scans GROUP BY target""")
def scan_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.scan_counts(A.scans(spark, d))


@query("ref101_severity_counts", f"""{with_views("findings", "scans")}
SELECT target, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium,
       count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'critical') AS critical
FROM findings JOIN scans USING (scan_id) GROUP BY target""")
def severity_counts(spark, d):
    return stats.severity_counts(A.findings(spark, d).join(A.scans(spark, d).select("scan_id", "target"), "scan_id"), "target")


@query("ref102_overview", f"""{with_views("findings", "scans")}
SELECT (SELECT count(*) FROM scans) AS scans, (SELECT count(DISTINCT target) FROM scans) AS targets,
       (SELECT count(*) FROM findings) AS findings""")
def overview(spark, d):
    return stats.overview(A.scans(spark, d), A.findings(spark, d))


@query("ref103_top_rules", f"""{with_views("findings")}
SELECT rule_id, count(*) AS n FROM findings GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 5""")
def top_rules(spark, d):
    return stats.top(A.findings(spark, d), "rule_id")


@query("ref103_top_targets", f"""{with_views("scans")}
SELECT target, count(*) AS n FROM scans GROUP BY target ORDER BY n DESC, target LIMIT 5""")
def top_targets(spark, d):
    return stats.top(A.scans(spark, d), "target")


_DAILY = """daily AS (
  SELECT CAST(scanned_at AS DATE) AS day, count(*) AS scans, CAST(coalesce(sum(found), 0) AS BIGINT) AS findings
  FROM scans LEFT JOIN (SELECT scan_id, count(*) AS found FROM findings GROUP BY scan_id) USING (scan_id)
  WHERE scanned_at >= TIMESTAMP '1998-01-01' AND scanned_at < TIMESTAMP '2001-01-01' GROUP BY 1)"""


@query("ref104_daily_counts", f"""{with_views("findings", "scans")}, {_DAILY}
SELECT CAST(day AS VARCHAR) AS day, scans, findings FROM daily""")
def daily_counts(spark, d):
    return stats.daily(A.scans(spark, d), A.findings(spark, d), SINCE, UNTIL).withColumn("day", F.col("day").cast("string"))


@query("ref105_audit_counts", f"""{with_views("audit")}
SELECT target, count(*) AS events, count(*) FILTER (CAST(json_extract(detail, '$.k') AS INT) > 0) AS positive FROM audit
WHERE timestamp >= TIMESTAMP '2024-01-08' AND timestamp < TIMESTAMP '2024-02-01' GROUP BY target""")
def audit_counts(spark, d):
    return stats.audit_counts(A.audit(spark, d), "k", AUDIT_SINCE, AUDIT_UNTIL)


_TREND = """halves AS (
  SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY day) AS i, count(*) OVER (PARTITION BY {by}) AS days FROM counted),
means AS (
  SELECT {by}, max(days) AS days, avg(n) FILTER (i <= days // 2) AS b, avg(n) FILTER (i > days // 2) AS a FROM halves GROUP BY {by}),
changes AS (
  SELECT *, CASE WHEN days < 2 THEN 0.0 WHEN b > 0 THEN (a - b) / b WHEN a > 0 THEN 1.0 ELSE 0.0 END AS change FROM means)
SELECT {by}, days, CASE WHEN change > 0.2 THEN '{up}' WHEN change < -0.2 THEN '{down}' ELSE 'stable' END AS trend FROM changes"""


def _by_day(spark, d, *by):
    joined = A.findings(spark, d).join(A.scans(spark, d).select("scan_id", "target", "scanned_at"), "scan_id")
    return joined.groupBy(*by, F.to_date("scanned_at").alias("day")).agg(F.count("*").alias("n"))


@query("ref106_trend", f"""{with_views("findings", "scans")}, counted AS (
  SELECT target, CAST(scanned_at AS DATE) AS day, count(*) AS n FROM findings JOIN scans USING (scan_id) GROUP BY 1, 2),
{_TREND.format(by="target", up="worsening", down="improving")}""")
def finding_trend(spark, d):
    return stats.trend(_by_day(spark, d, "target"), ["target"], "day", "n", "worsening", "improving")


@query("ref107_severity_trend", f"""{with_views("findings", "scans")}, counted AS (
  SELECT target, severity, CAST(scanned_at AS DATE) AS day, count(*) AS n FROM findings JOIN scans USING (scan_id) GROUP BY 1, 2, 3),
{_TREND.format(by="target, severity", up="up", down="down")}""")
def severity_trend(spark, d):
    return stats.trend(_by_day(spark, d, "target", "severity"), ["target", "severity"], "day", "n", "up", "down")


_COUNTS = """counts AS (
  SELECT server, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
         count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low,
         count(*) AS n_findings, avg(CASE WHEN rule_id IN ('R001','R101','R106','R107') THEN 0.9
           WHEN rule_id IN ('R102','R104','R108','R109','R111') THEN 0.7 ELSE 0.5 END) AS confidence,
         bool_or(rule_id = 'R106') AS threat
  FROM findings GROUP BY server),
sizes AS (SELECT server, count(*) AS n_tools FROM tools GROUP BY server)"""
_GRADE = "CASE WHEN score <= 0.9 THEN 'A' WHEN score <= 2.9 THEN 'B' WHEN score <= 4.9 THEN 'C' WHEN score <= 6.9 THEN 'D' ELSE 'F' END"


def sizes(spark, d):
    return A.tools(spark, d).groupBy("server").agg(F.count("*").alias("n_tools"))


@query("ref108_finding_scores", f"""{with_views("findings", "tools")}, {_COUNTS}, scored AS (
  SELECT server, n_tools, critical, high, medium, low, n_findings,
         least(10.0, round((critical * 10 + high * 7 + medium * 4 + low) / greatest(n_tools, 1)::DOUBLE
           * greatest(0.5, least(2.0, n_findings / greatest(n_tools, 1)::DOUBLE * 5)), 1))::DOUBLE AS score,
         round(confidence, 9)::DOUBLE AS confidence FROM sizes JOIN counts USING (server))
SELECT *, {_GRADE} AS grade FROM scored""")
def finding_scores(spark, d):
    return scoring.finding_scores(A.findings(spark, d), sizes(spark, d)).withColumn("confidence", F.round("confidence", 9))


#: What a few parts are for, by their number modulo 997, so that servers differ in what their tools can do.
_DUTIES = {0: "run_command in a shell", 30: "page_click", 60: "database upsert", 90: "write_file", 120: "vault access-token", 150: "http webhook", 180: "read_file"}
_TAGS = """duty AS (SELECT p_partkey, ' ' || replace(lower(replace(p_name, ' ', '_') || ' ' || p_type || ' ' || p_brand || ' ' || coalesce(CASE p_partkey % 997 """ + " ".join(
    f"WHEN {n} THEN '{x}'" for n, x in _DUTIES.items()
) + """ END, '')), '-', '_') || ' ' AS text FROM part),
tags AS (SELECT DISTINCT server, unnest(list_filter([""" + ", ".join(
    f"CASE WHEN regexp_matches(text, '{_quoted(p.replace('(?![a-z])', '(?:[^a-z]|$)'))}'){' AND NOT regexp_matches(text, ' + chr(39) + _quoted(CAPABILITIES['fs_write']) + chr(39) + ')' if c == 'fs_read' else ''} THEN {scoring.CAPABILITY_WEIGHTS[c]}::DOUBLE END"
    for c, p in CAPABILITIES.items()
) + f"""], lambda x: x IS NOT NULL)) AS w, unnest(list_filter([""" + ", ".join(
    f"CASE WHEN regexp_matches(text, '{_quoted(p.replace('(?![a-z])', '(?:[^a-z]|$)'))}'){' AND NOT regexp_matches(text, ' + chr(39) + _quoted(CAPABILITIES['fs_write']) + chr(39) + ')' if c == 'fs_read' else ''} THEN '{c}' END"
    for c, p in CAPABILITIES.items()
) + """], lambda x: x IS NOT NULL)) AS tag FROM tools JOIN duty ON p_partkey = ord),
agentic AS (SELECT server, least(10.0, max(w) + 0.5 * (count(*) FILTER (w >= 2) - (max(w) >= 2)::INT))::DOUBLE AS aars FROM tags GROUP BY server)"""


def _server_rows(spark, d, dependency: str = ""):
    """Per server n_tools, severity counts (those of the rule ``dependency`` apart), threat and aars, from one pass over the findings.

    Findings are summed by server and tool first; capabilities are told once a part and joined to these sums.
    """
    found = A.findings(spark, d)
    counts = {s: (F.col("severity") == s) & (F.col("rule_id") != dependency) for s in stats.SEVERITIES}
    counts |= {f"dep_{s}": (F.col("severity") == s) & (F.col("rule_id") == dependency) for s in ("critical", "high", "medium")}
    uses = found.groupBy("server", "tool").agg(*(F.count_if(c).alias(n) for n, c in counts.items()), F.bool_or(F.col("rule_id") == "R106").alias("threat"))
    number = F.col("p_partkey") % 997
    duty = F.lit("")
    for n, text in _DUTIES.items():
        duty = F.when(number == n, text).otherwise(duty)
    part = A.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("tool"), F.regexp_replace("p_name", " ", "_").alias("name"), F.concat_ws(" ", "p_type", "p_brand", duty).alias("description"))
    part = part.select("tool", capability_tags().alias("own"))
    rows = uses.join(part, "tool").groupBy("server").agg(
        F.count("*").alias("n_tools"), *(F.sum(n).alias(n) for n in counts), F.bool_or("threat").alias("threat"), F.flatten(F.collect_set("own")).alias("tags")
    )
    return rows.withColumn("aars", scoring.agentic_risk("tags"))


def leaderboard(spark, d):
    """One row per server: counts, capabilities, terms, score and grade; D-type findings are those of rule R107 here."""
    counts = ["n_tools", *stats.SEVERITIES, "dep_critical", "dep_high", "dep_medium"]
    rows = (
        A.table(spark, d, "supplier")
        .select(F.col("s_suppkey").cast("string").alias("server"), F.col("s_name").alias("name"))
        .join(_server_rows(spark, d, "R107"), "server", "left")
        .withColumn("scanned", F.col("n_tools").isNotNull())
        .fillna(0, [*counts, "aars"])
        .fillna(False, ["threat"])
    )
    return scoring.leaderboard_score(rows).drop("tags", "base")


@query("leaderboard_rank", f"""{with_views("findings", "tools")}, {_TAGS},
own AS (SELECT server, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
          count(*) FILTER (severity = 'medium') AS medium FROM findings WHERE rule_id <> 'R107' GROUP BY server),
dep AS (SELECT server, count(*) FILTER (severity = 'critical') AS dc, count(*) FILTER (severity = 'high') AS dh,
          count(*) FILTER (severity = 'medium') AS dm FROM findings WHERE rule_id = 'R107' GROUP BY server),
threat AS (SELECT server, bool_or(rule_id = 'R106') AS threat FROM findings GROUP BY server),
sizes AS (SELECT server, count(*) AS n_tools FROM tools GROUP BY server),
joined AS (
  SELECT s_name AS name, n_tools IS NOT NULL AS scanned, coalesce(n_tools, 0) AS n_tools, coalesce(critical, 0) AS c,
         coalesce(high, 0) AS h, coalesce(medium, 0) AS m, coalesce(dc, 0) AS dc, coalesce(dh, 0) AS dh, coalesce(dm, 0) AS dm,
         CASE WHEN coalesce(threat, false) THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END AS f, coalesce(aars, 0.0::DOUBLE) AS aars
  FROM supplier LEFT JOIN sizes ON server = CAST(s_suppkey AS VARCHAR) LEFT JOIN own USING (server)
  LEFT JOIN dep USING (server) LEFT JOIN threat USING (server) LEFT JOIN agentic USING (server)),
based AS (
  SELECT *, greatest((c * 10 + h * 7 + m * 4) / greatest(n_tools, 3)::DOUBLE,
                     CASE WHEN c > 0 THEN 5.0::DOUBLE WHEN h > 0 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END) AS base FROM joined),
terms AS (
  SELECT name, scanned, n_tools, round(base, 2) AS term_findings, round((base + aars) / 2 * f, 2) AS term_capability,
         round(least(4.9::DOUBLE, dc + dh * 0.4::DOUBLE + dm * 0.15::DOUBLE), 2) AS term_dependencies FROM based),
scored AS (
  SELECT *, least(10.0::DOUBLE, round(greatest(term_findings, term_capability, term_dependencies), 1)) AS score,
         CASE WHEN term_findings >= greatest(term_capability, term_dependencies) THEN 'findings'
              WHEN term_capability >= term_dependencies THEN 'capability' ELSE 'dependencies' END AS driver FROM terms)
SELECT name, n_tools, term_findings, term_capability, term_dependencies, score, driver, {_GRADE} AS grade FROM scored""")
def leaderboard_rank(spark, d):
    """The flagship: servers from the safest to the riskiest, with what drives their score."""
    ranked = scoring.ranking(leaderboard(spark, d))
    return ranked.select("name", "n_tools", "term_findings", "term_capability", "term_dependencies", "score", "driver", "grade")


@query("ref109_capability_scores", f"""{with_views("findings", "tools")}, {_COUNTS}, {_TAGS}, based AS (
  SELECT server, n_tools, aars, CASE WHEN threat THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END AS f,
         greatest((critical * 10 + high * 7 + medium * 4) / greatest(n_tools, 3)::DOUBLE,
                  CASE WHEN critical > 0 THEN 5.0::DOUBLE WHEN high > 0 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END) AS base
  FROM sizes JOIN counts USING (server) LEFT JOIN agentic USING (server)), scored AS (
  SELECT server, n_tools, coalesce(aars, 0.0::DOUBLE) AS aars, least(10.0::DOUBLE, round(greatest(base, (base + coalesce(aars, 0.0::DOUBLE)) / 2 * f), 1)) AS score FROM based)
SELECT *, {_GRADE} AS grade FROM scored""")
def capability_scores(spark, d):
    return scoring.capability_score(_server_rows(spark, d), F.col("threat")).select("server", "n_tools", "aars", "score", "grade")


@query("ref070_findings_with_scans", f"""{with_views("findings", "scans")}
SELECT target, rule_id, count(*) AS n, count(DISTINCT scan_id) AS scans FROM findings JOIN scans USING (scan_id) GROUP BY 1, 2""")
def findings_with_scans(spark, d):
    return stats.findings_by_target(A.findings(spark, d), A.scans(spark, d))


@query("ref071_findings_of_incomplete", f"""{with_views("findings", "scans")}
SELECT rule_id, severity, count(*) AS n FROM findings WHERE scan_id IN (SELECT scan_id FROM scans WHERE incomplete) GROUP BY 1, 2""")
def findings_of_incomplete(spark, d):
    part = A.scans(spark, d).where("incomplete").select("scan_id")
    return A.findings(spark, d).join(part, "scan_id", "left_semi").groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


_HALVES = """old AS (SELECT l_suppkey AS server, l_partkey AS part, max_by(l_tax, (l_orderkey, l_linenumber)) AS tax,
    max_by(l_returnflag, (l_orderkey, l_linenumber)) AS flag FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01' GROUP BY 1, 2),
new AS (SELECT l_suppkey AS server, l_partkey AS part, max_by(l_tax, (l_orderkey, l_linenumber)) AS tax,
    max_by(l_returnflag, (l_orderkey, l_linenumber)) AS flag FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' GROUP BY 1, 2)"""


def _snapshots(spark, d):
    rows = A.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("server"),
        F.col("l_partkey").alias("part"),
        F.struct("l_orderkey", "l_linenumber").alias("ord"),
        F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("flag"),
        "l_shipdate",
    )
    cut = F.lit(datetime(1998, 6, 1))
    return rows.where(F.col("l_shipdate") < cut), rows.where(F.col("l_shipdate") >= cut)


@query("ref072_snapshot_diff", f"""WITH {_HALVES}
SELECT server, count(*) FILTER (o.part IS NULL) AS added, count(*) FILTER (n.part IS NULL) AS removed,
       count(*) FILTER (o.tax <> n.tax) AS tax_changed, count(*) FILTER (o.flag <> n.flag) AS flag_changed
FROM old o FULL JOIN new n USING (server, part)
WHERE o.part IS NULL OR n.part IS NULL OR o.tax <> n.tax OR o.flag <> n.flag GROUP BY server""")
def snapshot_diff(spark, d):
    old, new = _snapshots(spark, d)
    changes = diff.snapshot_diff(old, new, ["server", "part"], ["tax", "flag"])
    return changes.groupBy("server").agg(
        F.count_if(F.col("op") == "added").alias("added"),
        F.count_if(F.col("op") == "removed").alias("removed"),
        F.count_if(F.col("field") == "tax").alias("tax_changed"),
        F.count_if(F.col("field") == "flag").alias("flag_changed"),
    )


@query("ref121_change_counts", f"""WITH {_HALVES}
SELECT count(*) FILTER (o.part IS NULL) AS added, count(*) FILTER (n.part IS NULL) AS removed,
       count(*) FILTER (o.part IS NOT NULL AND n.part IS NOT NULL AND (o.tax <> n.tax OR o.flag <> n.flag)) AS changed,
       CAST(0 AS BIGINT) AS security FROM old o FULL JOIN new n USING (server, part)""")
def change_counts(spark, d):
    old, new = _snapshots(spark, d)
    return diff.change_counts(diff.snapshot_diff(old, new, ["server", "part"], ["tax", "flag"]), ["server", "part"])


@query("ref073_finding_delta", f"""{with_views("findings", "scans")},
a AS (SELECT DISTINCT rule_id, tool FROM findings JOIN scans USING (scan_id) WHERE scanned_at < TIMESTAMP '1998-01-01'),
b AS (SELECT DISTINCT rule_id, tool FROM findings JOIN scans USING (scan_id) WHERE scanned_at >= TIMESTAMP '1998-01-01')
SELECT rule_id, tool, 'new' AS state FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
UNION ALL SELECT rule_id, tool, 'resolved' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def finding_delta(spark, d):
    joined = A.findings(spark, d).join(A.scans(spark, d).select("scan_id", "scanned_at"), "scan_id")
    return diff.finding_delta(joined.where(F.col("scanned_at") < SINCE), joined.where(F.col("scanned_at") >= SINCE), ["rule_id", "tool"])


@query("ref150_set_differences", f"""{with_views("findings", "scans")},
a AS (SELECT DISTINCT target FROM scans WHERE scanned_at < TIMESTAMP '1997-01-01'),
b AS (SELECT DISTINCT target FROM scans WHERE scanned_at >= TIMESTAMP '2000-01-01')
SELECT coalesce(a.target, b.target) AS target, CASE WHEN b.target IS NULL THEN 'old' WHEN a.target IS NULL THEN 'new' ELSE 'both' END AS side
FROM a FULL JOIN b ON a.target = b.target""")
def set_differences(spark, d):
    s = A.scans(spark, d)
    return diff.set_differences(s.where(F.col("scanned_at") < CUTOFF).select("target"), s.where(F.col("scanned_at") >= datetime(2000, 1, 1)).select("target"))


@query("ref089_merge_findings", f"""{with_views("findings")},
a AS (SELECT rule_id, tool, scan_id FROM findings WHERE severity = 'critical'),
b AS (SELECT rule_id, tool, scan_id FROM findings WHERE severity = 'high')
SELECT rule_id, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b
  WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.rule_id = b.rule_id AND a.tool = b.tool)) GROUP BY rule_id""")
def merge_findings(spark, d):
    f = A.findings(spark, d).select("rule_id", "tool", "scan_id", "severity")
    merged = diff.merge_findings(f.where("severity = 'critical'"), f.where("severity = 'high'"), ["rule_id", "tool"])
    return merged.groupBy("rule_id").agg(F.count("*").alias("n"))


@query("ref130_latest_scans", f"""{with_views("scans")}
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY scanned_at DESC, scan_id DESC) AS INT) AS recency FROM scans)
WHERE recency <= 2""")
def latest_scans(spark, d):
    return stats.latest(A.scans(spark, d))


@query("ref131_scans_since", f"""{with_views("scans")},
marks AS (SELECT target, min(scanned_at) AS mark FROM scans GROUP BY target)
SELECT s.scan_id, s.target, s.scanned_at, s.incomplete FROM scans s JOIN marks m ON s.target = m.target AND s.scanned_at > m.mark""")
def scans_since(spark, d):
    s = A.scans(spark, d)
    first = s.groupBy("target").agg(F.min_by("scan_id", F.struct("scanned_at", "scan_id")).alias("scan_id"))
    return stats.since_scan(s, first).select("scan_id", "target", "scanned_at", "incomplete")


@query("ref132_targets", f"""{with_views("scans")} SELECT DISTINCT target FROM scans ORDER BY target""")
def targets(spark, d):
    return A.scans(spark, d).select("target").distinct().orderBy("target")


@query("ref133_older_than", f"""{with_views("scans")} SELECT scan_id FROM scans WHERE scanned_at < TIMESTAMP '1997-01-01'""")
def older_than(spark, d):
    return stats.older_than(A.scans(spark, d), CUTOFF).select("scan_id")


@query("ref134_beyond_keep", f"""{with_views("scans")}
SELECT scan_id FROM (SELECT scan_id, row_number() OVER (ORDER BY scanned_at DESC, scan_id DESC) AS i FROM scans) WHERE i > 100""")
def beyond_keep(spark, d):
    return stats.beyond_keep(A.scans(spark, d), 100).select("scan_id")


@query("ref134_beyond_keep_each", f"""{with_views("scans")}
SELECT scan_id FROM (SELECT scan_id, row_number() OVER (PARTITION BY target ORDER BY scanned_at DESC, scan_id DESC) AS i FROM scans) WHERE i > 3""")
def beyond_keep_each(spark, d):
    return stats.beyond_keep_each(A.scans(spark, d), 3).select("scan_id")


@query("ref135_consecutive", f"""{with_views("scans")}
SELECT target, before, after FROM (SELECT target, lag(scan_id) OVER (PARTITION BY target ORDER BY scanned_at, scan_id) AS before,
  scan_id AS after FROM scans) WHERE before IS NOT NULL""")
def consecutive(spark, d):
    return stats.consecutive(A.scans(spark, d))


@query("ref127_snapshot_list", f"""{with_views("scans")}
SELECT target, count(*) AS scans, max_by(scan_id, (scanned_at, scan_id)) AS latest FROM scans GROUP BY target""")
def snapshot_list(spark, d):
    return stats.snapshot_list(A.scans(spark, d))


@query("ref090_latest_fingerprint", """SELECT l_suppkey AS server, l_returnflag AS transport, max_by(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS scan_id,
  max(l_shipdate) AS seen FROM lineitem GROUP BY 1, 2""")
def latest_fingerprint(spark, d):
    rows = A.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("server"), F.col("l_returnflag").alias("transport"), F.col("l_orderkey").alias("scan_id"), F.col("l_shipdate").alias("seen"), "l_linenumber"
    )
    return stats.latest_row(rows, ["server", "transport"], ["seen", "scan_id", "l_linenumber"]).drop("l_linenumber")


@query("ref122_tool_summary", f"""{with_views("findings", "tools")}, n AS (SELECT server, tool, count(*) AS n FROM findings WHERE severity = 'critical' GROUP BY 1, 2)
SELECT t.server, count(*) AS tools, count(*) FILTER (n IS NULL) AS clean, CAST(coalesce(sum(n), 0) AS BIGINT) AS findings
FROM tools t LEFT JOIN n ON n.server = t.server AND n.tool = CAST(t.ord AS VARCHAR) GROUP BY t.server""")
def tool_summary(spark, d):
    return stats.tool_summary(A.tools(spark, d), A.findings(spark, d).where("severity = 'critical'"))


@query("ref004_audit_query", f"""{with_views("audit")}
SELECT event_id, event_type, target FROM audit WHERE timestamp >= TIMESTAMP '2024-01-08' AND event_type = 'error'
ORDER BY timestamp DESC, event_id DESC LIMIT 50""")
def audit_query(spark, d):
    return stats.audit_query(A.audit(spark, d), since=AUDIT_SINCE, event_type="error").select("event_id", "event_type", "target")


@query("ref050_threshold", f"""{with_views("findings")}
SELECT rule_id, count(*) AS n FROM findings WHERE severity IN ('high', 'critical') AND rule_id NOT IN ('R103') GROUP BY rule_id""")
def threshold(spark, d):
    kept = stats.without_rules(stats.at_least(A.findings(spark, d), "high"), ["R103"])
    return kept.groupBy("rule_id").agg(F.count("*").alias("n"))


POLICY = policy.Policy(
    fail_on="high",
    deny_rules=("R105",),
    max_risk=None,
    require_complete=True,
    suppressions=(("R101", "1*", date(2030, 1, 1)), ("R102", "[2-4]?", date(2020, 1, 1))),
)


@query("ref236_policy", f"""{with_views("findings", "scans")}, kept AS (
  SELECT * FROM findings WHERE NOT (rule_id = 'R101' AND tool LIKE '1%')),
kinds AS (SELECT scan_id, CASE WHEN rule_id = 'R105' THEN 'denied_rule' WHEN severity IN ('high', 'critical') THEN 'threshold' END AS kind FROM kept)
SELECT scan_id, kind, count(*) AS n FROM kinds WHERE kind IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT scan_id, 'incomplete', 1 FROM scans WHERE incomplete
UNION ALL SELECT scan_id, 'expired', 1 FROM scans""")
def policy_decisions(spark, d):
    return policy.decide(A.scans(spark, d), A.findings(spark, d), POLICY, date(2024, 1, 1))


@query("ref119_accuracy", """WITH e AS (SELECT l_returnflag AS rule, l_partkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2),
f AS (SELECT l_returnflag AS rule, l_partkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber >= 4 GROUP BY 1, 2),
c AS (SELECT rule, least(coalesce(e.n, 0), coalesce(f.n, 0)) AS tp, greatest(coalesce(f.n, 0) - coalesce(e.n, 0), 0) AS fp,
  greatest(coalesce(e.n, 0) - coalesce(f.n, 0), 0) AS fn FROM e FULL JOIN f USING (rule, k)),
s AS (SELECT rule, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c GROUP BY rule),
p AS (SELECT *, tp / (tp + fp)::DOUBLE AS p, tp / (tp + fn)::DOUBLE AS r FROM s)
SELECT rule, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1 FROM p""")
def accuracy(spark, d):
    rows = A.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("rule"), F.col("l_partkey").alias("k"), "l_linenumber")
    counts = policy.pair_up(rows.where("l_linenumber <= 4"), rows.where("l_linenumber >= 4"), ["rule", "k"])
    return policy.accuracy(counts, ["rule"]).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("ref123_popularity", """SELECT c_custkey AS id, round(CASE WHEN c_acctbal > 0 THEN log10(c_acctbal + 1) ELSE 0 END
  + CASE WHEN c_nationkey > 0 THEN log10(c_nationkey + 1) ELSE 0 END, 4) AS score FROM customer""")
def popularity(spark, d):
    return A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), scoring.popularity("c_acctbal", "c_nationkey").alias("score"))


@query("ref143_two_phase_rank", """WITH p AS (SELECT c_custkey AS id, c_acctbal AS a FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 30),
s AS (SELECT o_custkey AS id, count(*) AS stars FROM orders GROUP BY 1)
SELECT id, round(CASE WHEN a > 0 THEN log10(a + 1) ELSE 0 END + CASE WHEN stars > 0 THEN log10(stars + 1) ELSE 0 END, 4) AS score
FROM p LEFT JOIN s USING (id) ORDER BY score DESC, id LIMIT 10""")
def two_phase(spark, d):
    rows = A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("downloads"))
    stars = A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("stars"))
    return scoring.two_phase_rank(rows, "downloads", stars, "id", ["downloads", "stars"]).select("id", "score")


@query("ref137_entities", """WITH rows AS (SELECT c_custkey AS id, c_mktsegment || '-' || CAST(c_custkey % 97 AS VARCHAR) AS name, c_acctbal > 0 AS scanned,
  c_nationkey AS n_tools, c_custkey % 11 = 0 AS trending, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS popularity,
  'h' || CAST(c_custkey % 53 AS VARCHAR) AS tool_hash FROM customer),
one AS (SELECT * EXCLUDE (trending, popularity), bool_or(trending) OVER (PARTITION BY name) AS trending,
  first_value(popularity IGNORE NULLS) OVER (PARTITION BY name ORDER BY scanned DESC, n_tools DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS popularity,
  row_number() OVER (PARTITION BY name ORDER BY scanned DESC, n_tools DESC, id) AS i FROM rows),
two AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN scanned THEN tool_hash ELSE 'name:' || name END ORDER BY length(name), name) AS j FROM one WHERE i = 1)
SELECT id, name, scanned, n_tools, trending, popularity, tool_hash FROM two WHERE j = 1""")
def entities(spark, d):
    k = F.col("c_custkey")
    rows = A.table(spark, d, "customer").select(
        k.alias("id"),
        F.concat("c_mktsegment", F.lit("-"), (k % 97).cast("string")).alias("name"),
        (F.col("c_acctbal") > 0).alias("scanned"),
        F.col("c_nationkey").alias("n_tools"),
        (k % 11 == 0).alias("trending"),
        F.when(k % 3 == 0, k).alias("popularity"),
        F.concat(F.lit("h"), (k % 53).cast("string")).alias("tool_hash"),
    )
    return scoring.resolve_entities(rows)


@query("ref124_name_hashes", f"""{with_views("tools")}
SELECT server, sha256(string_agg(name, ',' ORDER BY name)) AS tool_hash, count(*) AS tools FROM tools GROUP BY server""")
def name_hashes(spark, d):
    return A.tools(spark, d).groupBy("server").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("name")), ","), 256).alias("tool_hash"), F.count("*").alias("tools")
    )
