"""How rows lie in partitions and in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out to as many tasks as a shuffle has, evenly or by keys, for work that costs more than moving them: small files are few tasks otherwise."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def dealt(rows: DataFrame, *keys: str, per_task: int) -> DataFrame:
    """The rows dealt by keys to as many tasks as a shuffle has, and to more where a task would have more than ``per_task`` of them; they are counted for that."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // per_task)), *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see, of spark.checkpoint.dir; a cluster that names none is an error, a local session gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set")
    return folder or tempfile.mkdtemp(prefix="spark-shared-")


def written_copy(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read again."""
    path = f"{shared_folder(rows.sparkSession)}/copy-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def numbered(rows: DataFrame, *order: str, name: str = "id") -> DataFrame:
    """``rows`` with numbers from 0 without gaps, in this order (ties in any), as integers while they last. Written to the shared folder."""
    places = F.monotonically_increasing_id()
    copy = written_copy(rows.orderBy(*order).withColumn("_at", places))
    part = F.shiftright("_at", 33).alias("_part")
    sizes = copy.groupBy(part).agg(F.count("*").alias("n")).orderBy("_part").collect()  # a row for each task of the sort
    total, starts = 0, []
    for size in sizes:
        starts.append((size["_part"], total))
        total += size["n"]
    first = rows.sparkSession.createDataFrame(starts, "_part long, _first long")
    at = (F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("int" if total < 1 << 31 else "long")
    return copy.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn(name, at).drop("_part", "_first", "_at")
