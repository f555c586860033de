"""Differences between two snapshots, as one long table of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import unicode_pattern
from .rules import HIDDEN_MARKUP, INJECTIONS
from .stats import latest_row

UNSAFE = unicode_pattern("|".join(f"(?:{p})" for _, _, p in (*INJECTIONS, *HIDDEN_MARKUP)))


def snapshot_diff(old: DataFrame, new: DataFrame, key: list[str], fields: list[str], order: str = "ord") -> DataFrame:
    """key, op (added, removed, changed), field, old, new and change_severity.

    Of rows that repeat a key the last by ``order`` counts, on either side. A new
    value that reads like an injection or hides markup is a security change, any
    other a cosmetic one; added and removed rows are structural.
    """
    a = latest_row(old.select(*key, order, *fields), key, [order]).select(*key, F.struct(*fields).alias("old_row"))
    b = latest_row(new.select(*key, order, *fields), key, [order]).select(*key, F.struct(*fields).alias("new_row"))
    both = a.join(b, key, "full_outer")
    whole = lambda op: F.array(
        F.struct(F.lit(op).alias("op"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"))
    )
    changed = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit("changed").alias("op"),
                    F.lit(f).alias("field"),
                    F.col(f"old_row.{f}").cast("string").alias("old"),
                    F.col(f"new_row.{f}").cast("string").alias("new"),
                )
                for f in fields
            ]
        ),
        lambda c: ~c["old"].eqNullSafe(c["new"]),
    )
    ops = F.when(F.col("old_row").isNull(), whole("added")).when(F.col("new_row").isNull(), whole("removed")).otherwise(changed)
    flat = both.select(*key, F.explode(ops).alias("c")).select(*key, "c.*")
    severity = F.when(F.col("op") != "changed", "structural").when(F.coalesce(F.col("new"), F.lit("")).rlike(UNSAFE), "security")
    return flat.withColumn("change_severity", severity.otherwise("cosmetic"))


def change_counts(changes: DataFrame, key: list[str]) -> DataFrame:
    """Added, removed and changed keys, and those with a security change."""
    per = changes.groupBy(*key).agg(F.first("op").alias("op"), F.bool_or(F.col("change_severity") == "security").alias("security"))
    return per.agg(
        *[F.count_if(F.col("op") == op).alias(op) for op in ("added", "removed", "changed")], F.count_if("security").alias("security")
    )


def finding_delta(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New and resolved findings by ``key``, each once."""
    a, b = old.select(*key).distinct(), new.select(*key).distinct()
    return b.join(a, key, "left_anti").withColumn("state", F.lit("new")).unionByName(
        a.join(b, key, "left_anti").withColumn("state", F.lit("resolved"))
    )


def set_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Every row of two sets of the same columns, with the side that has it: old, new or both."""
    left = old.distinct().withColumn("_old", F.lit(True))
    right = new.distinct().withColumn("_new", F.lit(True))
    names = [c for c in old.columns]
    joined = left.join(right, names, "full_outer")
    side = F.when(F.col("_old") & F.col("_new"), "both").when(F.col("_old"), "old").otherwise("new")
    return joined.select(*names, side.alias("side"))


def merge_findings(kept: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """``kept`` and those of ``more`` whose key it does not have."""
    return kept.unionByName(more.join(kept.select(*key).distinct(), key, "left_anti"))


STATES = ("complete", "partial", "unavailable")


def surface_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Surfaces (target, surface, state) whose state differs; a worse one is a security change."""
    position = F.lit(None)
    rank = lambda c: F.when(c == STATES[0], 0).when(c == STATES[1], 1).when(c == STATES[2], 2).otherwise(position)
    both = old.withColumnRenamed("state", "old").join(new.withColumnRenamed("state", "new"), ["target", "surface"], "full_outer")
    worse = F.coalesce(rank(F.col("new")) > rank(F.col("old")), F.lit(False))
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).withColumn("change_severity", F.when(worse, "security").otherwise("cosmetic"))
