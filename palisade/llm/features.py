"""Hashed text features, and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import checkpointed
from .textops import ALNUM, LOWER, Texts, chunks


#: Different labels whose shares are broadcast; more are joined by shuffle.
BROADCAST_LABELS = 100_000


def enough(bound: int) -> float:
    """So many are expected of a draw that gives ``bound`` almost surely."""
    return bound + 5 * bound**0.5 + 5


def bounded_sample(rows: DataFrame, label: Column, bound: int, total: int | None = None) -> DataFrame:
    """label, text: at most ``bound`` different texts of each value of ``label``, chosen by their hashes.

    The share taken follows from one grouped count of different texts, so every
    value keeps up to ``bound`` however rare it is, copies of a text count once
    and ids have no part in it; what the hashes give beyond the bound is cut off in their order. With ``total``,
    the bound is at most an equal part of it for each label (one text at the least). Rows without a label are left out.
    """
    rows = rows.select(label.alias("label"), "text", F.xxhash64("text").alias("h")).where("label is not null")
    counts = checkpointed(rows.groupBy("label").agg(F.approx_count_distinct("h", 0.02).alias("texts")))
    labels = counts.count()
    if total is not None:
        bound = max(1, min(bound, total // max(1, labels)))
    shares = counts.select(F.col("label").alias("of"), (enough(bound) / F.col("texts")).alias("share"))
    shares = F.broadcast(shares) if labels <= BROADCAST_LABELS else shares
    chance = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    some = rows.join(shares, F.col("label") == F.col("of")).where(chance < F.col("share"))
    some = some.groupBy("label", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("label").orderBy(chance, "h")  # little more than the bound
    return some.withColumn("place", F.row_number().over(order)).where(F.col("place") <= bound).select("label", "text")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, bound: int) -> DataFrame:
    """``bounded_sample`` of the texts of ``docs`` by ``labels``, which has each doc_id once; written, as it is read again.

    At most about ``bound`` ids of each label go to the texts.
    """
    ids = labels.select("doc_id", label.alias("label")).where("label is not null and doc_id is not null")
    shares = ids.groupBy(F.col("label").alias("of")).agg((enough(bound) / F.count("*")).alias("share"))
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(20)), F.lit(1 << 30)) / float(1 << 30)
    shares = checkpointed(shares)
    shares = F.broadcast(shares) if shares.count() <= BROADCAST_LABELS else shares
    ids = ids.join(shares, F.col("label") == F.col("of")).where(chance < F.col("share"))
    texts = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id", "label")), "doc_id")
    return checkpointed(bounded_sample(checkpointed(texts.select("label", "text")), F.col("label"), bound))


def letter_gram_counts(texts: Texts, dims: int, sizes: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams of each whole text, other than digits and ASCII signs.

    Runs of other bytes count as one space. (rows, dims), rows without letters are zero.
    """
    data = LOWER[texts.data].astype(np.uint32)
    letter = (data >= 128) | ((data >= 97) & (data <= 122))
    row = np.repeat(np.arange(len(texts)), np.diff(texts.offsets))
    space = ~letter
    # the first of a run of other bytes stays, as the end of a word
    keep = letter.copy()
    keep[1:] |= space[1:] & letter[:-1] & (row[1:] == row[:-1])
    data = np.where(letter, data, 32)[keep]
    row = row[keep]
    out = np.zeros((len(texts), dims), np.float32)
    for k in sizes:
        n = len(data) - k + 1
        if n <= 0:
            continue
        code = np.zeros(n, np.uint32)
        for j in range(k):
            code = code * np.uint32(257) + data[j : j + n]
        code = (code + np.uint32(k)) * np.uint32(2654435761)
        slot = (code >> np.uint32(32 - (dims.bit_length() - 1))).astype(np.int64)
        same = row[:n] == row[k - 1 :]
        slot, at = slot[same], row[:n][same]
        low = np.searchsorted(at, np.arange(len(texts) + 1))
        for i in range(len(texts)):
            if low[i + 1] > low[i]:
                out[i] += np.bincount(slot[low[i] : low[i + 1]], minlength=dims).astype(np.float32)
    out /= np.maximum(out.sum(axis=1, keepdims=True), 1)
    return np.sqrt(out, out=out)


class Known:
    """A sorted vocabulary of hashes, and a table of their leading 20 bits that settles most look-ups."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.leading = np.zeros(1 << 20, bool)
        self.leading[hashes >> np.uint64(44)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``h`` are in the vocabulary, and where there."""
        near = np.flatnonzero(self.leading[h >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.hashes, h[near]), len(self.hashes) - 1)
        right = self.hashes[at] == h[near]
        return near[right], at[right]


def word_features(
    texts: Texts, known: Known | None = None, prefixes: tuple[int, ...] = (4, 5, 6)
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct words and word beginnings of each text; with ``known``, its place there."""
    words = texts.words(ALNUM)
    rows, hashes = [], []
    every = np.arange(len(words)), words.hashes()
    for which, h in (every, *(words.prefix_hashes(size, size + 1) for size in prefixes)):
        if known is not None:
            right, h = known.find(h)
            which = which[right]
        rows.append(words.row[which])
        hashes.append(h)
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    if not len(h):
        return row, h, np.empty(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]))
    return row[new], h[new], np.diff(np.concatenate([new, [len(h)]]))


def has_letter(text: str = "text") -> Column:
    """True for texts with a letter of any script; false for null."""
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def scored(
    docs: DataFrame, columns: list[str], schema: str, score, derived: dict[str, Column] | None = None, results: dict[str, Column] | None = None
) -> DataFrame:
    """``columns`` of ``docs`` with what ``score(Texts)``, a list of arrays, gives for its whole texts.

    ``derived`` are further columns beside those of ``schema``, and ``results`` what is
    returned of both (by default all of ``schema``). A column of ``docs`` that has the name of a result is left out.
    """
    names, derived = [x.split()[0] for x in schema.split(", ")], derived or {}
    results = results or {x: F.col(x) for x in names}
    columns = [x for x in columns if x not in results]
    kinds = dict(docs.dtypes)
    # Inside, columns go by number: none of theirs can clash with ours.
    inner = docs.select(
        *[F.col(f"`{x}`").alias(f"_{i}") for i, x in enumerate(columns)],
        *[c.alias(x) for x, c in derived.items()],
        F.col("text").alias("_text"),
    )
    kept = [f"_{i} {kinds[x]}" for i, x in enumerate(columns)] + [f"{x} {kind}" for x, kind in inner.dtypes if x in derived]
    passed = [x.split()[0] for x in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.select(passed)
            for texts in chunks(batch.column("_text")):
                part = rest.slice(texts.first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, *score(texts)], names=[*passed, *names])

    found = inner.mapInArrow(run, ", ".join([*kept, schema]))
    return found.select(*[F.col(f"_{i}").alias(x) for i, x in enumerate(columns)], *[c.alias(x) for x, c in results.items()])
