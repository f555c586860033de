"""Counts, trends, retention and pairing over scans, findings and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import dealt

SEVERITIES = ("low", "medium", "high", "critical")


def rank_of(severity: str | Column) -> Column:
    """Position of a severity, 0 to 3; null for any other text."""
    column = F.col(severity) if isinstance(severity, str) else severity
    out = F.when(column == SEVERITIES[0], 0)
    for i, name in enumerate(SEVERITIES[1:], 1):
        out = out.when(column == name, i)
    return out


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """Findings of this severity or above."""
    return findings.where(rank_of("severity") >= SEVERITIES.index(severity))


def without_rules(findings: DataFrame, disabled: list[str]) -> DataFrame:
    return findings.where(~F.col("rule_id").isin(disabled)) if disabled else findings


def scan_counts(scans: DataFrame) -> DataFrame:
    return scans.groupBy("target").agg(
        F.count("*").alias("scans"), F.min("scanned_at").alias("first_scan"), F.max("scanned_at").alias("last_scan")
    )


def severity_counts(findings: DataFrame, *by: str) -> DataFrame:
    """One column per severity in one pass; 0 where a severity is missing."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    return findings.groupBy(*by).agg(*counts) if by else findings.agg(*counts)


def overview(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Number of scans, of different targets and of findings."""
    a = scans.agg(F.count("*").alias("scans"), F.count_distinct("target").alias("targets"))
    return a.crossJoin(findings.agg(F.count("*").alias("findings")))  # one row by one row


def findings_by_target(findings: DataFrame, scans: DataFrame, per_task: int = 1_000_000) -> DataFrame:
    """target, rule_id, n (findings with their scans), scans (different ones). A task takes ``per_task`` rows at about.

    Findings are counted scan by scan before they meet the scans, so that what is left are sums: no scan is told apart again.
    """
    each = dealt(findings.select("scan_id", "rule_id").where("scan_id is not null"), "scan_id", per_task=per_task).groupBy("scan_id", "rule_id").agg(F.count("*").alias("a"))
    known = scans.where("scan_id is not null").groupBy("scan_id", "target").agg(F.count("*").alias("b"))
    return each.join(known, "scan_id").groupBy("target", "rule_id").agg(F.sum(F.col("a") * F.col("b")).alias("n"), F.count("*").alias("scans"))


def top(rows: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The n commonest values; ties go to the lesser value."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(n)


def daily(scans: DataFrame, findings: DataFrame, since, until) -> DataFrame:
    """Scans and findings by day; days without scans are left out."""
    day = F.to_date("scanned_at")
    kept = scans.where((F.col("scanned_at") >= since) & (F.col("scanned_at") < until))
    found = findings.groupBy("scan_id").agg(F.count("*").alias("found"))
    return kept.join(found, "scan_id", "left").groupBy(day.alias("day")).agg(
        F.count("*").alias("scans"), F.coalesce(F.sum("found"), F.lit(0)).alias("findings")
    )


def trend(daily_counts: DataFrame, by: list[str], day: str, n: str, rising: str, falling: str) -> DataFrame:
    """Compare the mean of the earlier half of the days (rounded down) with that of the others.

    A change of more than 20 % is ``rising`` or ``falling``; from zero to anything
    is rising. One day, or none, is stable.
    """
    order = Window.partitionBy(*by).orderBy(day)
    every = Window.partitionBy(*by)
    halves = daily_counts.withColumn("_at", F.row_number().over(order)).withColumn("_days", F.count("*").over(every))
    early = F.col("_at") <= F.floor(F.col("_days") / 2)
    means = halves.groupBy(*by).agg(
        F.max("_days").alias("days"), F.avg(F.when(early, F.col(n))).alias("before"), F.avg(F.when(~early, F.col(n))).alias("after")
    )
    change = F.when(F.col("before") > 0, (F.col("after") - F.col("before")) / F.col("before")).otherwise(
        F.when(F.col("after") > 0, 1.0).otherwise(0.0)
    )
    change = F.when(F.col("days") < 2, 0.0).otherwise(change)
    named = F.when(change > 0.2, rising).when(change < -0.2, falling).otherwise("stable")
    return means.select(*by, "days", named.alias("trend"))


def audit_counts(audit: DataFrame, key: str, since, until) -> DataFrame:
    """Events in the window, and those whose JSON number ``key`` is positive, by target."""
    number = F.get_json_object("detail", f"$.{key}").try_cast("int")
    recent = audit.where((F.col("timestamp") >= since) & (F.col("timestamp") < until))
    return recent.groupBy("target").agg(F.count("*").alias("events"), F.count_if(number > 0).alias("positive"))


def audit_query(audit: DataFrame, since=None, event_type: str | None = None, target: str | None = None, limit: int = 50) -> DataFrame:
    """Newest events first, with the filters that are given; no limit if it is not positive."""
    if since is not None:
        audit = audit.where(F.col("timestamp") >= since)
    if event_type is not None:
        audit = audit.where(F.col("event_type") == event_type)
    if target is not None:
        audit = audit.where(F.col("target") == target)
    audit = audit.orderBy(F.desc("timestamp"), F.desc("event_id"))
    return audit.limit(limit) if limit > 0 else audit


def latest(scans: DataFrame, n: int = 2) -> DataFrame:
    """The n newest scans of every target."""
    order = Window.partitionBy("target").orderBy(F.desc("scanned_at"), F.desc("scan_id"))
    return scans.withColumn("recency", F.row_number().over(order)).where(F.col("recency") <= n)


def since_scan(scans: DataFrame, since: DataFrame) -> DataFrame:
    """Scans strictly later than the scan that ``since`` (target, scan_id) names for their target."""
    named = since.withColumnRenamed("scan_id", "since_id")
    marks = named.join(scans.select(F.col("scan_id").alias("since_id"), F.col("scanned_at").alias("mark")), "since_id")
    return scans.join(marks.select("target", "mark"), "target").where(F.col("scanned_at") > F.col("mark")).drop("mark")


def older_than(scans: DataFrame, cutoff, target: str | None = None) -> DataFrame:
    scans = scans.where(F.col("scanned_at") < cutoff)
    return scans if target is None else scans.where(F.col("target") == target)


def beyond_keep(scans: DataFrame, keep: int) -> DataFrame:
    """All but the ``keep`` newest scans of all targets together.

    The cut is the keep-th newest scan, found by a top-k that each task computes
    first; no task ranks all scans.
    """
    order = [F.desc("scanned_at"), F.desc("scan_id")]
    newest = scans.orderBy(*order).limit(keep)
    return scans.join(newest.select("scan_id"), "scan_id", "left_anti")


def beyond_keep_each(scans: DataFrame, keep: int) -> DataFrame:
    """All but the ``keep`` newest scans of each target."""
    order = Window.partitionBy("target").orderBy(F.desc("scanned_at"), F.desc("scan_id"))
    return scans.withColumn("_at", F.row_number().over(order)).where(F.col("_at") > keep).drop("_at")


def consecutive(scans: DataFrame) -> DataFrame:
    """Every scan with the one before it of the same target."""
    order = Window.partitionBy("target").orderBy("scanned_at", "scan_id")
    return scans.select("target", F.lag("scan_id").over(order).alias("before"), F.col("scan_id").alias("after")).where(
        F.col("before").isNotNull()
    )


def snapshot_list(scans: DataFrame) -> DataFrame:
    """Number of scans and latest scan of every target."""
    return scans.groupBy("target").agg(
        F.count("*").alias("scans"), F.max_by("scan_id", F.struct("scanned_at", "scan_id")).alias("latest")
    )


def latest_row(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The row of each key whose ``order`` columns are greatest (a lookup as of now; an upsert keyed by ``by``)."""
    rest = [c for c in rows.columns if c not in by]
    found = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return found.select(*by, "_row.*")


def tool_summary(tools: DataFrame, findings: DataFrame) -> DataFrame:
    """Tools, clean tools (no finding) and findings of each server; findings carry server and tool."""
    counts = findings.groupBy("server", "tool").agg(F.count("*").alias("n"))
    joined = tools.select("server", F.col("ord").cast("string").alias("tool")).distinct().join(counts, ["server", "tool"], "left")
    return joined.groupBy("server").agg(
        F.count("*").alias("tools"), F.count_if(F.col("n").isNull()).alias("clean"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings")
    )
