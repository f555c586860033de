"""Policy decisions and accuracy metrics."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import glob_pattern
from .stats import SEVERITIES, rank_of


@dataclass(frozen=True)
class Policy:
    fail_on: str = "high"
    deny_rules: tuple[str, ...] = ()
    max_risk: float | None = None
    require_complete: bool = False
    #: (rule_id, target glob, expiry date)
    suppressions: tuple[tuple[str, str, date], ...] = field(default=())

    def __post_init__(self):
        if self.fail_on not in SEVERITIES:
            raise ValueError(f"fail_on is none of {SEVERITIES}: {self.fail_on}")
        for rule, glob, expires in self.suppressions:
            if not rule or not glob or not isinstance(expires, date):
                raise ValueError(f"a suppression needs a rule, a target and a date: {(rule, glob, expires)}")


def suppressed(findings: DataFrame, policy: Policy, today: date):
    """Condition: a suppression that has not expired covers the finding (rule_id, tool)."""
    out = F.lit(False)
    for rule, glob, expires in policy.suppressions:
        if expires >= today:
            out = out | ((F.col("rule_id") == rule) & F.col("tool").rlike(glob_pattern(glob)))
    return out


def decide(scans: DataFrame, findings: DataFrame, policy: Policy, today: date, risk: DataFrame | None = None) -> DataFrame:
    """Violations of each scan: scan_id, kind and count; a scan without any passed.

    A finding of a denied rule is counted as such and not by its severity. Expired
    suppressions are a violation of every scan.
    """
    open_findings = findings.where(~suppressed(findings, policy, today))
    denied = F.col("rule_id").isin(*policy.deny_rules) if policy.deny_rules else F.lit(False)
    above = rank_of("severity") >= SEVERITIES.index(policy.fail_on)
    kind = F.when(denied, "denied_rule").when(above, "threshold")
    found = open_findings.select("scan_id", kind.alias("kind")).where("kind is not null").groupBy("scan_id", "kind").agg(F.count("*").alias("n"))
    parts = [found]
    one = F.lit(1).cast("bigint").alias("n")
    if policy.require_complete:
        parts.append(scans.where("incomplete").select("scan_id", F.lit("incomplete").alias("kind"), one))
    if policy.max_risk is not None and risk is not None:
        parts.append(risk.where(F.col("score") > policy.max_risk).select("scan_id", F.lit("risk").alias("kind"), one))
    expired = sum(expires < today for _, _, expires in policy.suppressions)
    if expired:
        parts.append(scans.select("scan_id", F.lit("expired").alias("kind"), F.lit(expired).cast("bigint").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pair_up(expected: DataFrame, detected: DataFrame, key: list[str]) -> DataFrame:
    """Counts of true and false positives and false negatives by ``key``, every detection used once.

    Equal keys are interchangeable, so matching one to one leaves the lesser of both counts matched.
    """
    a = expected.groupBy(*key).agg(F.count("*").alias("e"))
    b = detected.groupBy(*key).agg(F.count("*").alias("d"))
    both = a.join(b, key, "full_outer").fillna(0, ["e", "d"])
    return both.select(
        *key, F.least("e", "d").alias("tp"), F.greatest(F.col("d") - F.col("e"), F.lit(0)).alias("fp"), F.greatest(F.col("e") - F.col("d"), F.lit(0)).alias("fn")
    )


def greedy_pairs(expected: DataFrame, detected: DataFrame, target: str = "target_name") -> DataFrame:
    """One-to-one pairs of expectations (ord, rule_id, target_glob) with detections (ord, rule_id, tool), within a target.

    Expectations choose in their order, each the first detection left that fits.
    A target's labels are a short list that people wrote.
    """
    import fnmatch

    import pandas as pd

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        free = list(right.sort_values("ord").itertuples(index=False))
        out = []
        for e in left.sort_values("ord").itertuples(index=False):
            hit = next((d for d in free if d.rule_id == e.rule_id and fnmatch.fnmatchcase(d.tool, e.target_glob)), None)
            if hit is not None:
                free.remove(hit)
            out.append((getattr(e, target), e.ord, None if hit is None else hit.ord))
        return pd.DataFrame(out, columns=[target, "expected", "detected"]).astype({"expected": "Int64", "detected": "Int64"})

    kind = dict(expected.dtypes)[target]
    return expected.groupBy(target).cogroup(detected.groupBy(target)).applyInPandas(match, f"`{target}` {kind}, expected long, detected long")


def accuracy(counts: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall and F1 from tp, fp and fn; null where there is nothing to divide by."""
    sums = counts.groupBy(*by).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    p = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.try_divide(2 * p * r, p + r))


def evidence_gaps(counts: DataFrame, by: str, need: int = 3) -> DataFrame:
    """How many more positive and negative cases each value of ``by`` needs; rows with enough of both are left out."""
    gaps = counts.select(
        by,
        F.greatest(F.lit(0), need - F.col("positive")).alias("more_positive"),
        F.greatest(F.lit(0), need - F.col("negative")).alias("more_negative"),
    )
    return gaps.where("more_positive > 0 or more_negative > 0")


def pending(rows: DataFrame, now, retry_days: int = 7) -> DataFrame:
    """name, file of the servers still to scan, from result files (name, file, incomplete, scanned_at, status).

    A server with a complete result is done. One that was tried within ``retry_days`` waits, a try without a time does not count.
    The file of a registry's stub goes first, then the least name of a file.
    """
    stub = F.coalesce(F.col("status") == "registry-pending", F.lit(False))
    by = rows.groupBy("name").agg(
        F.bool_or(~F.coalesce("incomplete", F.lit(False)) & ~stub).alias("done"),
        F.max(F.when(F.col("incomplete"), F.col("scanned_at"))).alias("last"),
        F.min_by("file", F.struct(~stub, "file")).alias("file"),
    )
    due = F.coalesce(F.col("last") <= F.lit(now) - F.make_dt_interval(days=F.lit(retry_days)), F.lit(True))
    return by.where(~F.col("done") & (due if retry_days > 0 else F.lit(True))).select("name", "file")


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of every key: deduplication that keeps an order."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_at = 1").drop("_at")
