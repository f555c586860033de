"""Vulnerable dependencies: dependencies whose version lies in a range of an advisory.

Versions and the ends of ranges are sorted together by their keys, package by package, so that an end learns how many
of the package's versions lie below it. A range then is a run of ranks, and meets its versions by an equi-join on
(package, rank): no version is compared with a range that does not hold it. Only different versions of a package are
sorted, however many dependencies have them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import written_copy
from ..functions.text import cvss_base_score, cvss_severity
from ..functions.versions import HIGHEST, LOWEST, version_key
from ..sources.readers import ADVISORY

PACKAGE = ["ecosystem", "package"]
VERSION = ["ecosystem", "name", "version"]


def package_name(name: Column, ecosystem: Column) -> Column:
    """Names are compared in lower case; on PyPI runs of ``-_.`` are one hyphen."""
    low = F.lower(F.trim(name))
    return F.when(F.lower(ecosystem) == "pypi", F.regexp_replace(low, r"[-_.]+", "-")).otherwise(low)


def advisory_ranges(raw: DataFrame, column: str = "text") -> DataFrame:
    """Ranges of advisories in JSON text: id, ecosystem, package, low, high, closed, fixed.

    Each ``introduced`` of a range of type SEMVER or ECOSYSTEM opens a range at ``low`` (its version key), closed by the
    least ``fixed`` above it, which is outside, or ``last_affected`` from it on, which is inside (``closed``); one that nothing
    closes reaches up to all versions. Listed versions are ranges of one version. Ends that are no
    versions are passed over, other texts give no rows.
    """
    a = raw.select(F.from_json(column, ADVISORY).alias("a")).where("a.id is not null").select("a.id", F.explode("a.affected").alias("x"))
    ecosystem = F.lower(F.col("x.package.ecosystem"))
    a = a.select("id", ecosystem.alias("ecosystem"), package_name(F.col("x.package.name"), ecosystem).alias("package"), "x.ranges", "x.versions")
    a = a.where("ecosystem is not null and package is not null")
    key = lambda text: F.when(text == "0", LOWEST).otherwise(version_key(text, F.col("ecosystem")))

    ranges = a.select("id", *PACKAGE, F.explode("ranges").alias("r")).where("r.type in ('SEMVER', 'ECOSYSTEM')")
    end = lambda e, name, closed: F.struct(key(e[name]).alias("high"), F.lit(closed).alias("closed"), F.when(F.lit(not closed), e[name]).alias("fixed"))
    ends = F.flatten(F.transform("r.events", lambda e: F.array(end(e, "fixed", False), end(e, "last_affected", True))))
    ranges = ranges.select(
        "id", *PACKAGE, F.transform("r.events", lambda e: key(e["introduced"])).alias("lows"), F.filter(ends, lambda e: e["high"].isNotNull()).alias("ends")
    )
    ranges = ranges.select("id", *PACKAGE, F.explode(F.array_distinct("lows")).alias("low"), "ends").where("low is not null")
    close = F.array_min(F.filter("ends", lambda e: (e["high"] > F.col("low")) | (e["closed"] & (e["high"] == F.col("low")))))
    ranges = ranges.withColumn("end", close).select(
        "id", *PACKAGE, "low", F.coalesce("end.high", F.lit(HIGHEST)).alias("high"), F.coalesce("end.closed", F.lit(True)).alias("closed"), "end.fixed"
    )
    listed = a.select("id", *PACKAGE, F.explode("versions").alias("v")).select("id", *PACKAGE, version_key(F.col("v"), F.col("ecosystem")).alias("low"))
    listed = listed.where("low is not null").select("*", F.col("low").alias("high"), F.lit(True).alias("closed"), F.lit(None).cast("string").alias("fixed"))
    return ranges.unionByName(listed).distinct()


def versions_in_ranges(versions: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ecosystem, package, key, id, fixed) of each different version key and each advisory with a range that holds it.

    ``fixed`` is the least of the fixes of those ranges. Rows of ``versions`` (ecosystem, package, key) repeat or not.
    """
    known = versions.where("key is not null").select(*PACKAGE, "key").distinct().join(ranges.select(*PACKAGE).distinct(), PACKAGE, "left_semi")
    span = F.struct("id", "low", "high", "closed", "fixed")
    none = F.lit(None).cast("struct<id:string,low:string,high:string,closed:boolean,fixed:string>").alias("span")
    # Among equal keys: ends that lie before the version, the version, ends that lie behind it.
    points = known.select(*PACKAGE, "key", F.lit(1).alias("place"), F.lit("version").alias("kind"), none)
    points = points.unionByName(ranges.select(*PACKAGE, F.col("low").alias("key"), F.lit(0).alias("place"), F.lit("low").alias("kind"), span.alias("span")))
    behind = F.when(F.col("closed"), 2).otherwise(0)
    points = points.unionByName(ranges.select(*PACKAGE, F.col("high").alias("key"), behind.alias("place"), F.lit("high").alias("kind"), span.alias("span")))
    sorted_ = Window.partitionBy(*PACKAGE).orderBy("key", "place").rowsBetween(Window.unboundedPreceding, 0)
    ranked = points.withColumn("rank", F.sum((F.col("kind") == "version").cast("long")).over(sorted_))
    ends = ranked.where("kind <> 'version'").groupBy(*PACKAGE, "span")
    runs = ends.agg(F.max(F.when(F.col("kind") == "low", F.col("rank"))).alias("first"), F.max(F.when(F.col("kind") == "high", F.col("rank"))).alias("last"))
    runs = runs.where("first < last").select(*PACKAGE, "span.id", "span.fixed", F.explode(F.sequence(F.col("first") + 1, F.col("last"))).alias("rank"))
    found = ranked.where("kind = 'version'").select(*PACKAGE, "key", "rank").join(runs, [*PACKAGE, "rank"])
    return found.groupBy(*PACKAGE, "key", "id").agg(F.min("fixed").alias("fixed"))


def vulnerable_dependencies(dependencies: DataFrame, ranges: DataFrame) -> DataFrame:
    """``dependencies`` (ecosystem, name, version, and others) with the id of each advisory that holds their version, and its fix.

    A dependency without a name, or whose version is no version, meets nothing. Repeated dependencies are kept.
    """
    hits = vulnerable_versions(dependencies, ranges)
    return dependencies.join(hits, VERSION)


def vulnerable_versions(dependencies: DataFrame, ranges: DataFrame) -> DataFrame:
    """ecosystem, name and version as ``dependencies`` write them, with the id of each advisory that holds the version, and its fix. Each once.

    A version's key is made once, however many packages have the version, and so are the ranges.
    """
    ecosystem = F.lower(F.col("ecosystem"))
    ranges = written_copy(ranges)
    own = dependencies.select(*VERSION).distinct()
    own = own.withColumns({"_e": ecosystem, "_p": package_name(F.col("name"), ecosystem)}).join(
        ranges.select(F.col("ecosystem").alias("_e"), F.col("package").alias("_p")).distinct(), ["_e", "_p"], "left_semi"
    )
    keys = own.select("_e", "version").distinct().withColumn("_k", version_key(F.col("version"), F.col("_e"))).where("_k is not null")
    own = written_copy(own.join(keys, ["_e", "version"]))
    hits = versions_in_ranges(own.select(F.col("_e").alias("ecosystem"), F.col("_p").alias("package"), F.col("_k").alias("key")), ranges)
    hits = hits.select(F.col("ecosystem").alias("_e"), F.col("package").alias("_p"), F.col("key").alias("_k"), "id", F.col("fixed").alias("fix"))
    return own.join(hits, ["_e", "_p", "_k"]).select(*VERSION, "id", "fix")


def dependency_findings(hits: DataFrame, advisories: DataFrame) -> DataFrame:
    """D001 for each of ``hits`` of ``vulnerable_dependencies``, with what ``readers.advisory_rows`` tells of the advisory.

    The finding names the first alias that is a CVE, else the advisory; its severity follows the CVSS score of the vector, medium
    without one; the fix is that of the range, else the last that the advisory names.
    """
    cve = F.get(F.filter("aliases", lambda a: a.startswith("CVE-")), F.lit(0))
    told = advisories.select("id", F.coalesce(cve, "id").alias("cve"), F.coalesce("summary", "id").alias("summary"), cvss_base_score("vector").alias("score"), "cwe_ids", "fixed_version")
    at = F.concat("name", F.lit("@"), "version")
    rows = hits.join(told, "id").withColumn("fix", F.coalesce("fix", "fixed_version"))
    said = F.concat(at, F.lit(" ("), "ecosystem", F.lit(") is affected by "), "cve", F.lit(": "), "summary", F.coalesce(F.concat(F.lit("; fixed in "), "fix"), F.lit("")))
    return rows.select(
        *[c for c in hits.columns if c not in ("id", "fix")],
        F.lit("D001").alias("rule_id"),
        F.lit("Known-vulnerable dependency").alias("title"),
        said.alias("description"),
        cvss_severity("score").alias("severity"),
        at.alias("target"),
        F.struct("id", "cve", "score", "cwe_ids", F.col("fix").alias("fixed_version")).alias("detail"),
    )
