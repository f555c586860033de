"""Filtered lists, lookups and small set operations over advisories, registries, labels and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def advisory_list(advisories: DataFrame, severity: str | None = None, contains: str | None = None, limit: int = 0) -> DataFrame:
    """Advisories by severity and part of the description, in any case; ordered by id and limited if asked for."""
    if severity:
        advisories = advisories.where(F.lower("severity") == severity.lower())
    if contains:
        advisories = advisories.where(F.lower("description").contains(contains.lower()))
    return advisories.orderBy("cve_id").limit(limit) if limit > 0 else advisories


def registry_list(entries: DataFrame, category: str | None = None, keyword: str | None = None, with_packages: bool = False) -> DataFrame:
    """Registry entries of which some category contains, and some keyword equals, the given text."""
    if category:
        entries = entries.where(F.exists("categories", lambda c: F.contains(F.lower(c), F.lit(category.lower()))))
    if keyword:
        entries = entries.where(F.exists("keywords", lambda k: F.lower(k) == keyword.lower()))
    return entries.where(F.size("packages") > 0) if with_packages else entries


def popular_packages(entries: DataFrame, popular: DataFrame) -> DataFrame:
    """The first popular package (identifier, position) of each registry entry (name, packages: array of identifiers)."""
    named = entries.select("name", F.explode("packages").alias("identifier"))
    return named.join(popular, "identifier").groupBy("name").agg(F.min_by("identifier", F.struct("position", "identifier")).alias("identifier"))


#: The kind of weakness that a family of rules stands for.
FAMILIES = {"R": "tool metadata", "C": "cross-server", "S": "source code", "M": "configuration", "D": "dependency", "T": "typosquatting"}


def weakness_types(findings: DataFrame, by: str, named: dict[str, str]) -> DataFrame:
    """The sorted kinds of weakness of each server: by rule, else by its family, else other."""
    own = F.lit(None).cast("string")
    for rule, kind in named.items():
        own = F.when(F.col("rule_id") == rule, kind).otherwise(own)
    family = F.lit(None).cast("string")
    for letter, kind in FAMILIES.items():
        family = F.when(F.left("rule_id", F.lit(1)) == letter, kind).otherwise(family)
    return findings.groupBy(by).agg(F.array_sort(F.collect_set(F.coalesce(own, family, F.lit("other")))).alias("types"))


def best_matches(matches: DataFrame, key: list[str], score: str) -> DataFrame:
    """The row of the best score of each key; ties go to the least of the other columns."""
    rest = [c for c in matches.columns if c not in (*key, score)]
    order = F.struct((-F.col(score)).alias("s"), *rest)
    return matches.groupBy(*key).agg(F.min(order).alias("m")).select(*key, *[f"m.{c}" for c in rest], (-F.col("m.s")).alias(score))


def retire(rows: DataFrame, ranked: DataFrame, key: str = "name") -> DataFrame:
    """``rows`` with trending taken from those that ``ranked`` no longer has."""
    now = ranked.select(key).distinct().withColumn("_in", F.lit(True))
    return rows.join(now, key, "left").withColumn("trending", F.col("trending") & F.col("_in").isNotNull()).drop("_in")


def label_errors(labels: DataFrame, catalog: DataFrame) -> DataFrame:
    """Expected rules of labels (target_name, rule_id) that the catalog does not know."""
    return labels.join(catalog.select("rule_id").distinct(), "rule_id", "left_anti")


def below_threshold(coverage: DataFrame, thresholds: DataFrame, default: float) -> DataFrame:
    """Modules (module, covered, total) whose share is below their own or the default threshold."""
    share = F.coalesce(F.try_divide(F.col("covered") * 100.0, F.col("total")), F.lit(100.0))
    joined = coverage.join(thresholds, "module", "left").withColumn("share", share)
    return joined.where(F.col("share") < F.coalesce("threshold", F.lit(default))).select("module", "share")


def hex_digest(integrity: str = "integrity") -> Column:
    """algorithm:hex of a subresource integrity value such as sha512-<base64>; null if it is none."""
    c = F.col(integrity)
    kind = F.regexp_extract(c, r"^(sha1|sha256|sha384|sha512)-", 1)
    raw = F.try_to_binary(F.regexp_extract(c, r"^sha\d+-(.*)$", 1), F.lit("base64"))
    return F.when((kind != "") & raw.isNotNull(), F.concat(kind, F.lit(":"), F.lower(F.hex(raw))))
