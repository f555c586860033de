"""Readers for the queries, and the split of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 4 is 2: such rows are never learnt from. False for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_key(text: str = "text") -> Column:
    """Tells apart the texts of one doc_id; a null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


#: A common table expression ``crc`` with the list ``entry`` that ``crc32_sql`` reads.
CRC_SQL = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS entry)"""


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII string, where ``crc`` is joined."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, entry[xor(c & 255, b) + 1])), 4294967295)"
