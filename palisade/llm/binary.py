"""Packed token-id matrices by best-fit-decreasing, ready for binary output.

Each task tokenizes its rows and packs them in blocks of ``BLOCK_IDS`` ids, so
ids are never shuffled and memory does not follow the input. Input partitions of
less than ``TASK_BYTES`` of text are read by one task together, so that blocks
are full ones however the table is split. A block's free
capacities stand in a segment tree; the search for the best fit (the least
capacity that takes the piece) and each update take logarithmic time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table
from .tokens import BYTE_BPE, encode

SEQUENCE = 2048
#: Ids that a task holds before it packs them.
BLOCK_IDS = 1 << 21
#: Bytes of text that a task takes at least, on the average, where the table has them: some two blocks.
TASK_BYTES = 16 << 20
PAD_ID = 0

SEQUENCES = (
    "n_ids int, n_docs int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<long>"
)


class CapacityTree:
    """How many open rows have each free capacity 0..size, with a search for the least capacity of at least c."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.tree[at] += by
            at >>= 1

    def push(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def pop_best(self, least: int) -> tuple[int, int] | None:
        """Take a row of the smallest capacity >= least: (capacity, row)."""
        at = least + self.leaves
        if not self.tree[at]:
            # up, until a right neighbour has rows; then down to its first leaf
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        self._add(capacity, -1)
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Indices of the pieces of each row; pieces are placed longest first, ties in the given order."""
    tree, rows = CapacityTree(size), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.pop_best(lengths[i])
        if found is None:
            found = size, len(rows)
            rows.append([])
        rows[found[1]].append(i)
        tree.push(found[0] - lengths[i], found[1])
    return rows


def pack_block(pieces: list[tuple[int | None, int, np.ndarray]], size: int) -> Iterator[tuple]:
    """Rows of SEQUENCES for pieces (doc_id, start, ids)."""
    for row in best_fit_decreasing([len(x[2]) for x in pieces], size):
        parts = [pieces[i] for i in row]
        lengths = np.array([len(x[2]) for x in parts])
        ends = np.cumsum(lengths)
        n = int(ends[-1])
        ids = np.full(size, PAD_ID, "<u4")
        ids[:n] = np.concatenate([x[2] for x in parts])
        positions = np.zeros(size, "<u4")
        positions[:n] = np.arange(n) - np.repeat(ends - lengths, lengths)
        yield (
            n,
            len(parts),
            ids.tobytes(),
            np.concatenate([[0], ends]).astype(np.int32),
            positions.tobytes(),
            [x[0] for x in parts],
            [x[1] for x in parts],
        )


def packed_sequences(
    docs: DataFrame,
    size: int = SEQUENCE,
    vocabulary: str = BYTE_BPE,
    block_ids: int = BLOCK_IDS,
    task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """One row per packed sequence of ``size`` ids, padded at its end.

    ids and position_ids are little-endian unsigned 32-bit numbers, ``size`` of
    each; positions restart at 0 with every piece. cu_seqlens are the bounds of
    the pieces, as attention kernels take them. doc_ids and starts say which ids
    of which documents the pieces are. A document longer than ``size`` is cut
    into full pieces and a rest and loses no id. A null or empty text is its end
    id alone; repeated rows and null ids are packed like others; an empty table
    gives no rows.
    """
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = [x.split()[0] for x in SEQUENCES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            doc_ids, text = batch.column("doc_id").cast(pa.int64()).to_pylist(), batch.column("text")
            for row, doc_id in enumerate(doc_ids):
                ids = encode(text[row].as_py(), vocabulary)
                held += [(doc_id, at, ids[at : at + size]) for at in range(0, len(ids), size)]
                n += len(ids)
                if n >= block_ids:
                    yield from written(held)
                    held, n = [], 0
        yield from written(held)

    def written(held):
        rows = []
        for row in pack_block(held, size):
            rows.append(row)
            if len(rows) == 256:
                yield as_batch(rows)
                rows = []
        if rows:
            yield as_batch(rows)

    def as_batch(rows):
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=names)

    rows = docs.select("doc_id", "text")
    size_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return rows.coalesce(max(1, -(-size_bytes // task_bytes))).mapInArrow(run, SEQUENCES)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write the packed matrices as Parquet, a row per sequence, by Spark's own committer."""
    packed_sequences(docs, **options).write.mode("overwrite").parquet(path)


def unpack(sequences: DataFrame) -> DataFrame:
    """The pieces of packed sequences: doc_id, start, ids (binary). The inverse of the packing."""
    at = F.posexplode("doc_ids").alias("k", "doc_id")
    low, high = F.col("cu_seqlens")[F.col("k")], F.col("cu_seqlens")[F.col("k") + 1]
    return sequences.select("ids", "cu_seqlens", "starts", at).select(
        "doc_id",
        F.col("starts")[F.col("k")].alias("start"),
        F.substring("ids", low * 4 + 1, (high - low) * 4).alias("ids"),
    )


def op10_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each packed sequence: its documents, bounds and the checksums of its two rows."""
    packed = packed_sequences(table(spark, sf_dir, "documents"))
    return packed.select(
        F.col("n_ids").cast("long").alias("n_ids"),
        F.col("n_docs").cast("long").alias("n_docs"),
        "doc_ids",
        "starts",
        "cu_seqlens",
        F.crc32("ids").alias("ids_crc32"),
        F.crc32("position_ids").alias("positions_crc32"),
    )
