"""One ordered document in parts: a JSON array, CSV or Markdown text that no task holds.

Rows are range-partitioned by their order and written part by part; the first row of the first part opens the document, each
other one begins with the separator, and the last one closes it. The parts, put together in the order of their
names, are the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.changes import written_copy

#: The position of a row in its partition, in what monotonically_increasing_id gives.
_POSITION = (1 << 33) - 1


def write_document(rows: DataFrame, text: Column, order: list[str], path: str, opening: str, separator: str, closing: str, parts: int = 32) -> None:
    """Write ``text`` of all rows in the order of ``order`` (ascending, nulls first) as one document in up to ``parts`` parts.

    Ties are in the order of their texts. No rows give the opening and the closing in one part. The folder ``path`` is replaced.
    """
    spark = rows.sparkSession
    keys = [f"_k{i}" for i in range(len(order))]
    held = rows.select(*(F.col(c).alias(k) for c, k in zip(order, keys)), text.alias("_text"))
    held = held.repartitionByRange(parts, *keys, "_text").sortWithinPartitions(*keys, "_text")
    held = written_copy(held.select("_text", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(_POSITION).alias("_at")))
    ends = held.groupBy("_part").agg(F.max("_at").alias("last")).collect()  # one row a part
    if not ends:
        lone = spark.createDataFrame([(0, opening + closing)], "_part int, _line string")
    else:
        first, last = min(r["_part"] for r in ends), max((r["_part"], r["last"]) for r in ends)
        begins = (F.col("_part") == first) & (F.col("_at") == 0)
        ends_here = (F.col("_part") == last[0]) & (F.col("_at") == last[1])
        line = F.concat(F.when(begins, opening).otherwise(separator), "_text", F.when(ends_here, closing).otherwise(""))
        lone = held.select("_part", "_at", line.alias("_line")).repartition(len(ends), "_part").sortWithinPartitions("_part", "_at").drop("_at")
    lone.select(F.format_string("%05d", "_part").alias("part"), F.col("_line").alias("value")).write.mode("overwrite").partitionBy("part").text(path)


def write_json_array(rows: DataFrame, order: list[str], path: str, parts: int = 32) -> None:
    """All rows as one array of JSON objects."""
    write_document(rows, F.to_json(F.struct(*rows.columns)), order, path, "[", ",", "]", parts)


def write_json_lines(rows: DataFrame, order: list[str], path: str, parts: int = 32) -> None:
    """All rows as JSON objects, one a line."""
    write_document(rows, F.to_json(F.struct(*rows.columns)), order, path, "", "", "", parts)


def write_csv_document(rows: DataFrame, order: list[str], path: str, parts: int = 32) -> None:
    """All rows as one CSV text with a header."""
    quote = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    cells = [F.coalesce(quote(F.col(c).cast("string")), F.lit("")) for c in rows.columns]
    write_document(rows, F.concat_ws(",", *cells), order, path, ",".join(rows.columns) + "\n", "", "", parts)


def write_markdown_table(rows: DataFrame, order: list[str], path: str, title: str, parts: int = 32) -> None:
    """A Markdown report: a heading and one table of all rows."""
    cells = [F.coalesce(F.regexp_replace(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " "), F.lit("")) for c in rows.columns]
    head = f"# {title}\n\n| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}\n"
    write_document(rows, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")), order, path, head, "", "", parts)


def export_audit(events: DataFrame, path: str, kind: str) -> None:
    """The audit log in order of time as ``json`` (one array), ``jsonl`` or ``csv``."""
    writers = {"json": write_json_array, "jsonl": write_json_lines, "csv": write_csv_document}
    if kind not in writers:
        raise ValueError(f"no format {kind}")
    writers[kind](events, ["timestamp", "event_id"], path)


def write_leaderboard(rows: DataFrame, path: str, parts: int = 32) -> None:
    """The leaderboard (name, scanned, score, n_tools and others) as one JSON array in its order: scanned first, least score first, more tools, then the name."""
    fields = [c for c in rows.columns if c != "scanned"]
    keyed = rows.select("*", (~F.col("scanned")).alias("_unscanned"), F.coalesce("score", F.lit(11.0)).alias("_score"), (-F.col("n_tools")).alias("_tools"))
    write_document(keyed, F.to_json(F.struct(*fields)), ["_unscanned", "_score", "_tools", "name"], path, "[", ",", "]", parts)
