"""Sequence packing by shortest-pack-first over the length histogram.

Every document's ids (and an end id) are cut into full pieces of
``length`` and one shorter rest. Only the histogram of the rests, at most
``length - 1`` numbers whatever the size of the corpus, goes to the driver; the
packing patterns found there go back and meet the documents by rank.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import checkpointed
from .tables import table
from .tokens import BYTE_BPE, encode

SEQUENCE = 1024

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Patterns (count, lengths) that hold ``histogram`` (count by length), each of at most ``size``.

    Lengths are placed longest first. Those of one length go, as many as
    possible at a time, to the shortest packs so far, that is those with the most
    room left, as long as they fit there; the others open new packs. Packs of one
    pattern are counted, never listed: the work depends on the number of
    different lengths only, and there are at most two patterns for each length.
    """
    open_packs: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)  # by room left
    for length in sorted(histogram, reverse=True):
        left, room = histogram[length], size
        while left and room >= length:
            if not open_packs[room]:
                room -= 1
                continue
            count, lengths = open_packs[room].pop()
            used = min(count, left)
            if used < count:
                open_packs[room].append((count - used, lengths))
            left -= used
            open_packs[room - length].append((used, [*lengths, length]))
        if left:
            open_packs[size - length].append((left, [length]))
    return [pack for room in sorted(open_packs) for pack in open_packs[room]]


def tokenize_pieces(docs: DataFrame, length: int = SEQUENCE, vocabulary: str = BYTE_BPE) -> DataFrame:
    """The pieces of every document: where each starts, its length, and a checksum of its ids."""
    names = [x.split()[0] for x in PIECES.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, out = batch.column("text"), []
            for row in range(len(batch)):
                ids = encode(text[row].as_py(), vocabulary)
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length]
                    out.append((row, start, len(piece), zlib.crc32(piece), len(ids)))
            row, *rest = np.array(out, np.int64).reshape(-1, 5).T
            ids = batch.column("doc_id").cast(pa.int64()).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, rest)], names=names)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


class Slots:
    """Where the nth piece of each length lies: sequence and offset, for the patterns of a packing."""

    def __init__(self, patterns: list[tuple[int, list[int]]]):
        lengths, firsts, sequences, numbers, starts, offsets = [], [], [], [], [0], []
        rank, sequence = defaultdict(int), 0
        for count, pattern in patterns:
            at: dict[int, list[int]] = defaultdict(list)
            offset = 0
            for x in pattern:
                at[x].append(offset)
                offset += x
            for x, found in at.items():
                lengths.append(x)
                firsts.append(rank[x])
                sequences.append(sequence)
                numbers.append(len(found))
                offsets += found
                starts.append(len(offsets))
                rank[x] += count * len(found)
            sequence += count
        order = np.lexsort((firsts, lengths)) if lengths else np.empty(0, int)
        columns = (lengths, firsts, sequences, numbers, starts[:-1])
        self.lengths, self.firsts, self.sequences, self.numbers, self.starts = (np.array(x, np.int64)[order] for x in columns)
        self.offsets = np.array(offsets, np.int64)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence and offset of the pieces of these lengths and ranks, by one sorted search for each length."""
        at = np.empty(len(length), np.int64)
        for x in np.unique(length):
            low, high = np.searchsorted(self.lengths, [x, x + 1])
            own = length == x
            at[own] = low + np.searchsorted(self.firsts[low:high], rank[own], side="right") - 1
        nth = rank - self.firsts[at]
        return self.sequences[at] + nth // self.numbers[at], self.offsets[self.starts[at] + nth % self.numbers[at]]


def pack(pieces: DataFrame, length: int = SEQUENCE, salts: int | None = None) -> DataFrame:
    """Give each of the ``pieces``, a checkpointed or written table, a ``sequence_id`` and its ``offset`` there.

    Full pieces and rests are ranked among those of equal length: ``salts``
    parts (by default two for each shuffle partition) of each length are numbered on their own, and begin where the counts
    of the parts before them end. A part is made of whole input partitions, so that neither a length that very many
    documents share nor the rows that repeat one doc_id are numbered in one task. A rank says in which copy of which
    pattern the piece lies; the patterns are bounded by the sequence length alone.
    """
    spark = pieces.sparkSession
    salts = salts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    counts = pieces.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = Slots(shortest_pack_first(histogram, length))

    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.join(firsts, ["length", "salt"]).withColumn("rank", F.col("first") + F.row_number().over(within) - 1)
    columns = [x.split()[0] for x in PIECES.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = slots.find(*(np.asarray(batch.column(x)) for x in ("length", "rank")))
            kept = batch.select(columns)
            yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, found)], names=[*columns, "sequence_id", "offset"])

    return ranked.select(*columns, "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, length: int = SEQUENCE, vocabulary: str = BYTE_BPE) -> DataFrame:
    """Pack all documents into sequences of at most ``length`` ids.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    A null or empty text is its end id alone. Repeated rows and repeated or
    null ids are packed like any others, once each. An empty table gives no
    rows. Other columns of ``docs`` are ignored.
    """
    return pack(checkpointed(tokenize_pieces(docs, length, vocabulary)), length)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 ids: see ``pack_documents``."""
    return pack_documents(table(spark, sf_dir, "documents"))
