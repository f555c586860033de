"""Risk scores, grades, confidence and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import severity_counts

#: Points of a finding by severity, confidence by rule and its default.
WEIGHTS = {"critical": 10, "high": 7, "medium": 4, "low": 1}
CONFIDENCE = {
    0.9: ("R001", "R101", "R106", "R107"),
    0.7: ("R102", "R104", "R108", "R109", "R111", "C001", "C003", "C006", "C007"),
    0.5: ("R103", "R105", "R110", "C002", "C004", "C005"),
}
#: Blast radius of a capability.
CAPABILITY_WEIGHTS = {
    "code_exec": 8.0,
    "browser_control": 6.0,
    "db_write": 5.0,
    "fs_write": 4.0,
    "secret_access": 3.0,
    "net_egress": 2.0,
    "fs_read": 1.0,
    "pure_compute": 0.0,
}


def grade(score: str | Column) -> Column:
    """A to F by the upper bounds 0.9, 2.9, 4.9 and 6.9."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s <= 0.9, "A").when(s <= 2.9, "B").when(s <= 4.9, "C").when(s <= 6.9, "D").otherwise("F")


def finding_score(n: Column, weighted: Column, tools: Column) -> Column:
    """Weighted findings a tool, times a density factor held between 0.5 and 2; at most 10."""
    tools = F.greatest(tools, F.lit(1))
    factor = F.greatest(F.lit(0.5), F.least(F.lit(2.0), n / tools * 5))
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(10.0), F.round(weighted / tools * factor, 1)))


def weighted(columns: dict[str, int] = WEIGHTS) -> Column:
    """The sum of severity columns times their points."""
    return sum((F.col(s) * w for s, w in columns.items()), F.lit(0))


def confidence(rule_id: str = "rule_id") -> Column:
    """Confidence of a rule; 0.5 for unknown ones."""
    out = F.lit(None)
    for value, rules in CONFIDENCE.items():
        out = F.when(F.col(rule_id).isin(*rules), value).otherwise(out)
    return F.coalesce(out, F.lit(0.5))


def finding_scores(findings: DataFrame, tools: DataFrame, key: str = "server") -> DataFrame:
    """Score, grade, mean confidence and counts of every key of ``tools`` (key, n_tools); no finding scores 0, A, 1."""
    counts = severity_counts(findings, key)
    means = findings.groupBy(key).agg(F.avg(confidence()).alias("confidence"))
    joined = tools.join(counts, key, "left").join(means, key, "left").fillna(0, list(WEIGHTS))
    n = sum((F.col(s) for s in WEIGHTS), F.lit(0))
    return joined.select(
        key,
        "n_tools",
        *WEIGHTS,
        n.alias("n_findings"),
        finding_score(n, weighted(), F.col("n_tools")).alias("score"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
    ).withColumn("grade", grade("score"))


def base_load(tools: Column) -> Column:
    """Medium and worse findings a tool (three tools at least), not below 5 with a critical and 3 with a high one."""
    base = (F.col("critical") * 10 + F.col("high") * 7 + F.col("medium") * 4) / F.greatest(tools, F.lit(3))
    return F.when(F.col("critical") > 0, F.greatest(base, F.lit(5.0))).when(
        F.col("high") > 0, F.greatest(base, F.lit(3.0))
    ).otherwise(base)


def agentic_risk(capabilities: str | Column) -> Column:
    """From an array of capabilities: the greatest weight, and half a point for each other of 2 or more; at most 10."""
    column = F.col(capabilities) if isinstance(capabilities, str) else capabilities
    known = F.create_map(*[F.lit(x) for pair in CAPABILITY_WEIGHTS.items() for x in pair])
    w = F.array_sort(F.transform(F.array_distinct(column), lambda c: F.coalesce(known[c], F.lit(0.0))))
    highest = F.coalesce(F.get(w, F.size(w) - 1), F.lit(0.0))
    others = F.size(F.filter(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x: x >= 2))
    return F.when(highest == 0, 0.0).otherwise(F.least(F.lit(10.0), highest + 0.5 * others))


def dominant(capabilities: str) -> Column:
    """The capability of the greatest weight; pure_compute for none."""
    out = F.lit("pure_compute")
    for name, _ in sorted(CAPABILITY_WEIGHTS.items(), key=lambda x: x[1]):
        out = F.when(F.array_contains(capabilities, name), name).otherwise(out)
    return out


def capability_score(rows: DataFrame, threat: Column) -> DataFrame:
    """Adds score and grade from severity counts, n_tools, aars and whether a transport finding (threat) exists."""
    base = base_load(F.col("n_tools"))
    factor = F.when(threat, 1.15).otherwise(1.0)
    score = F.least(F.lit(10.0), F.round(F.greatest(base, (base + F.col("aars")) / 2 * factor), 1))
    return rows.withColumn("score", score).withColumn("grade", grade("score"))


def leaderboard_score(rows: DataFrame) -> DataFrame:
    """Three terms (findings, capability, dependencies), the driver among them and the score.

    Takes severity counts of findings, dep_critical, dep_high and dep_medium of
    vulnerable dependencies, n_tools, aars and threat. The first of equal terms drives.
    """
    factor = F.when(F.col("threat"), 1.15).otherwise(1.0)
    rows = rows.withColumn("base", base_load(F.col("n_tools")))
    rows = rows.select(
        "*",
        F.round("base", 2).alias("term_findings"),
        F.round((F.col("base") + F.col("aars")) / 2 * factor, 2).alias("term_capability"),
        F.round(
            F.least(F.lit(4.9), F.col("dep_critical") + F.col("dep_high") * 0.4 + F.col("dep_medium") * 0.15), 2
        ).alias("term_dependencies"),
    )
    most = F.greatest("term_findings", "term_capability", "term_dependencies")
    driver = F.when(F.col("term_findings") == most, "findings").when(F.col("term_capability") == most, "capability")
    score = F.least(F.lit(10.0), F.round(most, 1))
    return rows.withColumn("score", score).withColumn("driver", driver.otherwise("dependencies")).withColumn("grade", grade("score"))


def ranking(rows: DataFrame) -> DataFrame:
    """Leaderboard order: scanned first, least score first (unscored as 11), more tools, then the name."""
    return rows.orderBy(F.desc("scanned"), F.coalesce("score", F.lit(11.0)), F.desc("n_tools"), "name")


def resolve_entities(rows: DataFrame) -> DataFrame:
    """One row per server, and one per set of tools.

    Of equal names the scanned one with most tools (then the least id) wins; it is
    trending if any was, and has the first popularity that is not null. Of scanned
    rows with equal tool_hash the shortest name (then the least) wins.
    """
    better = Window.partitionBy("name").orderBy(F.desc("scanned"), F.desc("n_tools"), "id")
    every = Window.partitionBy("name")
    named = (
        rows.withColumn("trending", F.bool_or("trending").over(every))
        .withColumn("popularity", F.first("popularity", ignorenulls=True).over(better.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("_at", F.row_number().over(better))
        .where("_at = 1")
    )
    # Rows that were not scanned pass: each is a group of its own.
    group = F.when(F.col("scanned"), F.col("tool_hash")).otherwise(F.concat(F.lit("name:"), F.col("name")))
    canonical = Window.partitionBy(group).orderBy(F.length("name"), "name")
    return named.withColumn("_at", F.row_number().over(canonical)).where("_at = 1").drop("_at")


def popularity(*signals: str) -> Column:
    """Sum of log10(v + 1) of the positive signals, to four decimals."""
    parts = [F.when(F.col(s) > 0, F.log10(F.col(s) + 1)).otherwise(0.0) for s in signals]
    return F.round(sum(parts, F.lit(0.0)), 4)


def two_phase_rank(rows: DataFrame, prelim: str, extra: DataFrame, key: str, signals: list[str], n: int = 10) -> DataFrame:
    """Top n by all signals of the top max(3n, 30) by the preliminary one; ``extra`` (key, signal) is only joined to those."""
    first = rows.orderBy(F.desc(prelim), key).limit(max(3 * n, 30))
    scored = first.join(extra, key, "left").withColumn("score", popularity(*signals))
    return scored.orderBy(F.desc("score"), key).limit(n)


def cross_risk(findings: DataFrame, servers: int, tools: int) -> DataFrame:
    """0 to 100 from cross-server findings: 25, 15, 8 or 3 points each, more for many servers and crowded ones."""
    points = {"critical": 25, "high": 15, "medium": 8, "low": 3}
    value = F.lit(None)
    for name, p in points.items():
        value = F.when(F.col("severity") == name, p).otherwise(value)
    crowd = tools / max(servers, 1)
    more = int(10 * min(servers / 5.0, 1.0)) + (10 if crowd > 20 else 5 if crowd > 10 else 0)
    return findings.agg(F.least(F.lit(100), F.coalesce(F.sum(value), F.lit(0)) + more).cast("long").alias("risk"))
