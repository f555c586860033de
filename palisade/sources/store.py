"""Snapshot store: bucketed Parquet tables under one manifest, so that all tables of a commit change at once.

A commit writes the buckets that it touches to folders of its own and then creates the next manifest, a small file that says
which folder holds each bucket of each table. Readers follow the newest manifest. A commit that fails before that
leaves the old version as it was, whatever it wrote; of two commits at once the second finds its manifest's name taken and fails, and
can be run again. The name is taken by creating a file that must not exist, as HDFS and local folders can.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHILDREN = ("tools", "prompts", "resources", "resource_templates", "findings")
BUCKETS = 64
#: How keys are dealt to buckets, as the manifest says of each table: as Spark deals rows to tasks.
DEALT = "hash"


class Conflict(RuntimeError):
    """Another commit made the version that this one was to make."""


def bucket(key: str, buckets: int = BUCKETS):
    return F.pmod(F.hash(key), F.lit(buckets)).cast("int")


def _placed(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt to one task for each bucket; joins by the key and the writing by buckets need no other shuffle."""
    return rows.repartition(BUCKETS, key)


def _touched(ids: DataFrame, key: str) -> set[int]:
    return {r[0] for r in ids.select(bucket(key)).distinct().collect()}  # BUCKETS of them at most


def _folder(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions of a store, oldest first."""
    return sorted(int(n.removesuffix(".json")) for n in _names(spark, f"{root}/manifests") if n.endswith(".json"))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """What a version (the newest by default) holds; nothing before the first commit."""
    if version is None:
        version = max(versions(spark, root), default=0)
    if not version:
        return {"version": 0, "tables": {}}
    return json.loads(spark.read.text(f"{root}/manifests/{version:010d}.json", wholetext=True).first()[0])


def read(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table of a version, the newest by default; an error if it has no such table."""
    return _table(spark, root, manifest(spark, root, version), name)


def _table(spark: SparkSession, root: str, held: dict, name: str, buckets: set[int] | None = None) -> DataFrame:
    if name not in held["tables"]:
        raise LookupError(f"no table {name}")
    table = held["tables"][name]
    schema = StructType.fromJson(table["schema"])
    paths = [f"{root}/{name}/version={v}/bucket={b}" for b, v in table["buckets"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _publish(spark: SparkSession, root: str, held: dict) -> None:
    fs, at = _folder(spark, f"{root}/manifests/{held['version']:010d}.json")
    try:
        out = fs.create(at, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception):
            raise Conflict(f"version {held['version']} is taken") from e
        raise
    out.write(bytearray(json.dumps(held).encode()))
    out.close()


def _shaped(rows: DataFrame, schema: StructType) -> DataFrame:
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def _rewrite(spark: SparkSession, root: str, old: dict, new: dict, name: str, key: str, rows: DataFrame | None, ids: DataFrame, touched: set[int], resolve=None, parents: DataFrame | None = None) -> None:
    """Write the ``touched`` buckets, those of ``ids``, without these ids, and with ``rows``, to the folder of the new version; rows whose key no row of ``parents`` has are an error."""
    known = old["tables"].get(name)
    if known is None and rows is None:
        return
    if known is not None and known.get("dealt") != DEALT:  # dealt in another way: all of it is dealt anew
        touched = {*range(BUCKETS), *map(int, known["buckets"])}
    schema = rows.schema if rows is not None else StructType.fromJson(known["schema"])
    parts = [] if rows is None else [rows]
    if known is not None:
        here = _table(spark, root, old, name, touched)
        empty = spark.createDataFrame([], schema)
        both = here.unionByName(empty if rows is None else rows, allowMissingColumns=True).select(*(f.name for f in schema), *(c for c in here.columns if c not in schema.names))
        schema = both.schema
        parts = [resolve(both)] if resolve else [*parts, _placed(here, key).join(_placed(ids, key), key, "left_anti")]
    elif resolve:
        parts = [resolve(rows)]
    folder = f"{root}/{name}/version={new['version']}"
    for i, part in enumerate(parts):
        # What stays is in its tasks already; what is new comes first and is held against its parents as it was written.
        placed = _placed(_shaped(part, schema), key) if resolve or (i == 0 and rows is not None) else _shaped(part, schema)
        placed.withColumn("bucket", bucket(key)).write.mode("append" if i else "overwrite").partitionBy("bucket").parquet(folder)
        if i == 0 and rows is not None and parents is not None:
            written = spark.read.schema(schema).parquet(folder).select(key).distinct()
            if not written.join(parents, key, "left_anti").isEmpty():
                raise ValueError(f"rows of {name} without a scan")
    buckets = {b: v for b, v in (known or {"buckets": {}})["buckets"].items() if int(b) not in touched}
    buckets |= {n.removeprefix("bucket="): new["version"] for n in _names(spark, folder) if n.startswith("bucket=")}
    new["tables"][name] = {"key": key, "schema": schema.jsonValue(), "buckets": buckets, "dealt": DEALT}


def commit(spark: SparkSession, root: str, scans: DataFrame | None = None, children: dict[str, DataFrame] | None = None, deleted: DataFrame | None = None) -> int:
    """Put scans with all their children in place of those of the same scan_id, and remove ``deleted`` (scan_id) with theirs: one new version.

    ``children`` are some of ``CHILDREN``; a scan that comes without rows of a child table has none of them afterwards. Rows of
    children whose scan is not in ``scans`` are an error. Returns the version.
    """
    children = children or {}
    if unknown := set(children) - set(CHILDREN):
        raise ValueError(f"no child tables: {sorted(unknown)}")
    parts = [x.select("scan_id") for x in (scans, deleted) if x is not None]
    if not parts:
        raise ValueError("nothing to commit")
    ids = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    ids = ids.where("scan_id is not null")
    parents = spark.createDataFrame([], "scan_id long") if scans is None else scans.select("scan_id")
    old = manifest(spark, root)
    new = {"version": old["version"] + 1, "tables": dict(old["tables"])}
    touched = _touched(ids, "scan_id")
    for name in ("scans", *CHILDREN):
        _rewrite(spark, root, old, new, name, "scan_id", scans if name == "scans" else children.get(name), ids, touched, parents=None if name == "scans" else parents)
    _publish(spark, root, new)
    return new["version"]


def delete_scans(spark: SparkSession, root: str, ids: DataFrame) -> int:
    """Remove scans (scan_id) and their children."""
    return commit(spark, root, deleted=ids)


def purge(spark: SparkSession, root: str, before) -> int:
    """Remove the scans of before a time, with their children."""
    return delete_scans(spark, root, read(spark, root, "scans").where(F.col("scanned_at") < F.lit(before)).select("scan_id"))


def load_scan(spark: SparkSession, root: str, scan_id, version: int | None = None) -> DataFrame:
    """One row: the scan with the rows of every child table in order; an error if there is none."""
    held = manifest(spark, root, version)
    at = spark.range(1).select(bucket_of(scan_id)).first()[0]
    only = lambda name: {at} if held["tables"][name].get("dealt") == DEALT else None
    scan = _table(spark, root, held, "scans", only("scans") if "scans" in held["tables"] else None).where(F.col("scan_id") == scan_id)
    if scan.isEmpty():
        raise LookupError(f"no scan {scan_id}")
    for name in (n for n in CHILDREN if n in held["tables"]):
        rows = _table(spark, root, held, name, only(name)).where(F.col("scan_id") == scan_id)
        rest = [c for c in rows.columns if c != "scan_id"]
        scan = scan.join(rows.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name)), "scan_id", "left")
    return scan


def bucket_of(value):
    """The bucket of one long or text key."""
    return F.pmod(F.hash(F.lit(value).cast("long" if isinstance(value, int) else "string")), F.lit(BUCKETS)).cast("int")


def newest(rows: DataFrame, key: str, sequence: list[str]) -> DataFrame:
    """The row of each key whose ``sequence`` columns are greatest."""
    rest = [c for c in rows.columns if c != key]
    found = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*sequence)).alias("_row"))
    return found.select(key, "_row.*").select(rows.columns)


def merge_fingerprints(spark: SparkSession, root: str, rows: DataFrame, sequence: tuple[str, ...] = ("last_seen",)) -> int:
    """Put fingerprints (server_id and others) in place of older ones of the same server; one with a lesser ``sequence`` than the stored one is passed over."""
    rows = rows.where("server_id is not null")
    old = manifest(spark, root)
    new = {"version": old["version"] + 1, "tables": dict(old["tables"])}
    ids = rows.select("server_id").distinct()
    _rewrite(spark, root, old, new, "fingerprints", "server_id", rows, ids, _touched(ids, "server_id"), lambda x: newest(x, "server_id", list(sequence)))
    _publish(spark, root, new)
    return new["version"]


def fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """All fingerprints, those last seen first."""
    return read(spark, root, "fingerprints").orderBy(F.desc("last_seen"), "server_id")


def delete_fingerprints(spark: SparkSession, root: str, ids: DataFrame) -> int:
    """Remove the fingerprints of servers (server_id); how many there were."""
    ids = ids.select("server_id").where("server_id is not null").distinct()
    n = read(spark, root, "fingerprints").join(ids, "server_id", "left_semi").count()
    if n:
        old = manifest(spark, root)
        new = {"version": old["version"] + 1, "tables": dict(old["tables"])}
        _rewrite(spark, root, old, new, "fingerprints", "server_id", None, ids, _touched(ids, "server_id"))
        _publish(spark, root, new)
    return n
