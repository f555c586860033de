"""Readers: snapshots, result files, advisories, registries and source files as tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = (
    "name string, target string, version string, scanned_at string, incomplete boolean, "
    "tools array<struct<name:string,description:string>>, "
    "findings array<struct<rule_id:string,severity:string,title:string,description:string>>, trending boolean"
)
ADVISORY = (
    "id string, summary string, details string, aliases array<string>, severity array<struct<type:string,score:string>>, "
    "database_specific struct<severity:string,cwe_ids:array<string>>, affected array<struct<package:struct<name:string,ecosystem:string>,"
    "ranges:array<struct<type:string,events:array<map<string,string>>>>,versions:array<string>>>"
)
NVD = (
    "id string, published string, descriptions array<struct<lang:string,value:string>>, "
    "metrics struct<cvssMetricV31:array<struct<cvssData:struct<baseSeverity:string>>>,cvssMetricV30:array<struct<cvssData:struct<baseSeverity:string>>>>, "
    "references array<struct<url:string>>"
)
REGISTRY = (
    "name string, description string, packages array<struct<registry_type:string,identifier:string,version:string,transport:string>>, "
    "categories array<string>, is_latest boolean"
)


def results(spark: SparkSession, path: str) -> DataFrame:
    """Result files of a folder, one JSON object each; corrupt files and those of another shape are left out."""
    read = spark.read.schema(f"{RESULT}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt")
    rows = read.json(path, pathGlobFilter="*.json").withColumn("file", F.col("_metadata.file_name"))
    shaped = F.coalesce("target", "name").isNotNull()
    return rows.where(F.col("_corrupt").isNull() & shaped).withColumn("name", F.coalesce("name", F.regexp_replace("file", r"\.json$", ""))).drop("_corrupt")


SEVERITIES = ("low", "medium", "high", "critical")
#: Fields of a report and of its tools and findings, each with the kinds of JSON values that it may have.
REPORT_FIELDS = {"target": "text", "transport": "text", "incomplete": "flag", "incomplete_reason": "text"}
TOOL_FIELDS = {"name": "text", "description": "text", "input_schema": "object", "output_schema": "object"}
FINDING_FIELDS = {f: "text" for f in ("rule_id", "title", "description", "severity", "target", "location", "evidence")} | {"detail": "object"}
KINDS = {
    "text": r"^(STRING|BIGINT|DECIMAL|DOUBLE|FLOAT)",
    "flag": r"^BOOLEAN",
    "object": r"^OBJECT",
    "list": r"^ARRAY",
}


def _guarded(value: Column, name: str, kind: str, place: Column) -> tuple[Column, Column]:
    """A field of a variant, with what stands for it where it is absent or of another kind, and the fault of the latter (null if there is none)."""
    field = F.try_variant_get(value, f"$.{name}", "variant")
    known = F.coalesce(F.schema_of_variant(field).rlike(KINDS[kind]), F.lit(False))
    empty = {"text": "", "flag": False, "object": "{}"}[kind]
    found = field.cast("boolean") if kind == "flag" else F.to_json(field) if kind == "object" else field.cast("string")
    other = field.isNotNull() & ~known
    fault = F.when(other, F.struct(F.concat(place, F.lit(name)).alias("field"), F.concat(F.lit(f"no {kind}: "), F.to_json(field)).alias("problem")))
    return F.coalesce(F.when(known, found), F.lit(empty)).alias(name), fault


def report_rows(raw: DataFrame, key: str = "source", column: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Reports in JSON text, field by field: reports, tools, findings, and errors (key, field, problem) that name each field refused.

    A field that is absent has its empty value; one of another kind too, and an error row (numbers count as text). Tools and findings
    carry their number (``ord``); one that is no object is left out, with an error. A finding whose severity is none is refused. Text that is no JSON
    object gives an error for the whole report and no rows.
    """
    held = raw.select(key, F.try_parse_json(column).alias("v"), F.col(column).alias("t"))
    is_object = F.coalesce(F.schema_of_variant("v").rlike(KINDS["object"]), F.lit(False))
    rows = held.where(is_object).select(key, "v")
    none = F.lit("")
    fields = [_guarded(F.col("v"), n, k, none) for n, k in REPORT_FIELDS.items()]
    faults = F.array_compact(F.array(*(f for _, f in fields), *(_no_list(n) for n in ("tools", "findings"))))
    errors = held.where(~is_object).select(key, F.lit("").alias("field"), F.lit("no report").alias("problem"))
    errors = errors.unionByName(rows.select(key, F.explode(faults).alias("e")).select(key, "e.*"))
    parts = []
    for name, inner in (("tools", TOOL_FIELDS), ("findings", FINDING_FIELDS)):
        each = rows.select(key, F.posexplode(F.try_variant_get("v", f"$.{name}", "array<variant>")).alias("ord", "x"))
        place = F.concat(F.lit(f"{name}["), F.col("ord").cast("string"), F.lit("]"))
        known = F.coalesce(F.schema_of_variant("x").rlike(KINDS["object"]), F.lit(False))
        guarded = [_guarded(F.col("x"), n, k, F.concat(place, F.lit("."))) for n, k in inner.items()]
        found = each.where(known).select(key, "ord", *(c for c, _ in guarded), F.array_compact(F.array(*(f for _, f in guarded))).alias("faults"))
        errors = errors.unionByName(each.where(~known).select(key, place.alias("field"), F.concat(F.lit("no object: "), F.coalesce(F.to_json("x"), F.lit("null"))).alias("problem")))
        errors = errors.unionByName(found.select(key, F.explode("faults").alias("e")).select(key, "e.*"))
        found = found.drop("faults")
        if name == "findings":
            good = F.lower("severity").isin(*SEVERITIES)
            refused = found.where(~good).select(key, F.concat(place, F.lit(".severity")).alias("field"), F.concat(F.lit("no severity: "), "severity").alias("problem"))
            errors, found = errors.unionByName(refused), found.where(good).withColumn("severity", F.lower("severity"))
        parts.append(found)
    return rows.select(key, *(c for c, _ in fields)), parts[0], parts[1], errors


def _no_list(name: str) -> Column:
    field = F.try_variant_get("v", f"$.{name}", "variant")
    other = field.isNotNull() & ~F.coalesce(F.schema_of_variant(field).rlike(KINDS["list"]), F.lit(False))
    return F.when(other, F.struct(F.lit(name).alias("field"), F.concat(F.lit("no list: "), F.to_json(field)).alias("problem")))


def advisory_rows(raw: DataFrame, column: str = "text") -> DataFrame:
    """Advisories from JSON text: severity label, weakness classes, last fixed version and affected versions."""
    a = raw.select(F.from_json(column, ADVISORY).alias("a")).where("a.id is not null").select("a.*")
    ranges = F.flatten(F.transform("affected", lambda x: F.coalesce(x["ranges"], F.array())))
    events = F.flatten(F.transform(F.filter(ranges, lambda r: r["type"] == "SEMVER"), lambda r: r["events"]))
    fixed = F.filter(F.transform(events, lambda e: e["fixed"]), lambda v: v.isNotNull())
    return a.select(
        "id",
        "summary",
        "aliases",
        F.get(F.transform("severity", lambda s: s["score"]), F.lit(0)).alias("vector"),
        F.lower("database_specific.severity").alias("label"),
        F.coalesce("database_specific.cwe_ids", F.array()).alias("cwe_ids"),
        F.try_element_at(fixed, F.lit(-1)).alias("fixed_version"),
        F.array_distinct(F.flatten(F.transform("affected", lambda x: F.coalesce(x["versions"], F.array())))).alias("affected_versions"),
    )


def nvd_rows(raw: DataFrame, column: str = "text") -> DataFrame:
    """CVE items from JSON text: the first English description, and the severity of v3.1, else v3.0, else unknown."""
    a = raw.select(F.from_json(column, NVD).alias("a")).where("a.id is not null").select("a.*")
    english = F.get(F.filter("descriptions", lambda d: d["lang"] == "en"), F.lit(0))
    severity = lambda c: F.get(F.col(f"metrics.{c}"), F.lit(0))["cvssData"]["baseSeverity"]
    return a.select(
        F.col("id").alias("cve_id"),
        F.coalesce(english["value"], F.lit("")).alias("description"),
        F.lower(F.coalesce(severity("cvssMetricV31"), severity("cvssMetricV30"), F.lit("unknown"))).alias("severity"),
        "published",
        F.transform("references", lambda r: r["url"]).alias("references"),
    )


def feed_union(seed: DataFrame, feed: DataFrame, key: str = "cve_id", order: str = "published") -> DataFrame:
    """Both feeds, the newest row of each id."""
    rows = feed.unionByName(seed)
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, "_r.*")


def registry_packages(raw: DataFrame, column: str = "text", latest_only: bool = True) -> DataFrame:
    """Scannable packages of registry entries in JSON text; entries without packages have none."""
    a = raw.select(F.from_json(column, REGISTRY).alias("a")).where("a.name is not null").select("a.*")
    a = a.where("is_latest") if latest_only else a
    return a.select("name", F.explode("packages").alias("p")).select("name", "p.*")


def launch_command(kind: Column, identifier: Column, version: Column) -> Column:
    """The pinned command that launches a package; null for other kinds and for names that no registry allows."""
    pinned = F.concat(identifier, F.when(version.isNotNull() & (version != ""), F.concat(F.lit("@"), version)).otherwise(""))
    npm = identifier.rlike(r"^(?:@[a-z0-9~-][a-z0-9._~-]*/)?[a-z0-9~-][a-z0-9._~-]*$")
    pypi = identifier.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?$")
    return F.when((kind == "npm") & npm, F.concat(F.lit("npx -y "), pinned)).when((kind == "pypi") & pypi, F.concat(F.lit("uvx "), pinned))


def source_files(spark: SparkSession, path: str, suffixes: tuple[str, ...], skip: tuple[str, ...] = (), most: int = 500) -> DataFrame:
    """path, content of the first ``most`` files by name with these suffixes, outside of the folders to skip."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    rows = rows.where(F.col("path").rlike(r"\.(?:" + "|".join(suffixes) + r")$"))
    if skip:
        rows = rows.where(~F.col("path").rlike("/(?:" + "|".join(re.escape(s) for s in skip) + ")/"))
    return rows.orderBy("path").limit(most)
