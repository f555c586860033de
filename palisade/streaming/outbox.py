"""Alerts handed over once: an outbox for each batch of a stream, a ledger of batches, and dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "batch long, status string, attempts int, error string, alerts long"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """What became of each batch: delivered, dead or redelivered, after how many attempts."""
    return spark.read.schema(LEDGER).parquet(f"{root}/ledger/*") if _exists(spark, f"{root}/ledger") else spark.createDataFrame([], LEDGER)


def dead_letters(spark: SparkSession, root: str) -> DataFrame:
    """The alerts of the batches that could not be handed over, with their batch."""
    dead = [r["batch"] for r in ledger(spark, root).where("status = 'dead'").select("batch").collect()]  # batches that failed
    found = None
    for batch in sorted(dead):
        rows = spark.read.parquet(f"{root}/outbox/{batch}").withColumn("batch", F.lit(batch))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise LookupError("no dead letters")
    return found


def _record(spark: SparkSession, root: str, batch: int, status: str, attempts: int, error: str | None, alerts: int) -> None:
    spark.createDataFrame([(batch, status, attempts, error, alerts)], LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{root}/ledger/{batch}")


def _hand_over(spark: SparkSession, root: str, batch: int, send: Callable[[DataFrame, int], None], attempts: int, status: str) -> bool:
    alerts = spark.read.parquet(f"{root}/outbox/{batch}")
    n, error = alerts.count(), None
    for attempt in range(1, attempts + 1):
        try:
            if n:
                send(alerts, batch)
        except Exception as e:  # noqa: BLE001 - whatever the receiver raises is told in the ledger
            error = f"{type(e).__name__}: {e}"[:500]
        else:
            _record(spark, root, batch, status, attempt, None, n)
            return True
    _record(spark, root, batch, "dead", attempts, error, n)
    return False


def deliver(batch: DataFrame, number: int, root: str, send: Callable[[DataFrame, int], None], attempts: int = 3) -> bool:
    """Hand the alerts of a stream's batch over, unless the ledger has its number; for ``foreachBatch``.

    The alerts are written to the outbox first, so that each attempt sends the same. A batch whose attempts all fail is dead: its
    alerts stay in the outbox and the stream goes on. A batch is handed over once for each entry of the ledger; only one that
    was sent and whose driver was lost before the entry was made is sent again, under the same number, by which a receiver can tell.
    """
    spark = batch.sparkSession
    if _exists(spark, f"{root}/ledger/{number}/_SUCCESS"):
        return ledger(spark, root).where((F.col("batch") == number) & (F.col("status") != "dead")).count() > 0
    batch.write.mode("overwrite").parquet(f"{root}/outbox/{number}")
    return _hand_over(spark, root, number, send, attempts, "delivered")


def redeliver(spark: SparkSession, root: str, send: Callable[[DataFrame, int], None], attempts: int = 1) -> int:
    """Try the dead batches again, oldest first; how many went through."""
    dead = [r["batch"] for r in ledger(spark, root).where("status = 'dead'").orderBy("batch").collect()]
    return sum(_hand_over(spark, root, batch, send, attempts, "redelivered") for batch in dead)
