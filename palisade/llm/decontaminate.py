"""Benchmark decontamination by spaced-seed hashing.

A mask such as ``1101011001`` is laid on every run of tokens; only the tokens under
a 1 are hashed, so a hit survives substitutions under a 0. Hashes of the test
items and of all training texts are joined; each hit fixes an alignment of item
and text, whose overlap is then compared token by token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import checkpointed
from .tables import table, text_key
from .textops import ALNUM, Texts, chunks, mix, mix_int

#: Masks, and the number of tokens below which items have them (0: all items). Short items have fewer placements, so
#: they need masks that care for fewer tokens. Whatever agrees in ``MIN_SHARE`` of an item's tokens, at places drawn at
#: random, keeps one placement whole in more than nine of ten cases, for every length from 8 on (``tests/llm`` measure it).
MASKS = {
    "111111": 0, "1101011001": 0, "1100101101": 0, "10110010011": 0,
    "1010111": 60, "1101101": 40, "10111": 24, "1100101": 24, "1111": 24,
}
#: The least share of an item's tokens that must agree, and the least number; all tokens of an item that has fewer.
MIN_SHARE, MIN_TOKENS = 0.6, 8
#: Test hashes that are held in each task (8 bytes each); a larger test set is joined by shuffle.
HELD_HASHES = 2_000_000
#: Rows (some 40 bytes each), and bytes of item tokens, that may be broadcast; more are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20
#: Alignments of one text that are laid on it at a time.
ALIGNMENTS = 1000


def masked(hashes: np.ndarray, row: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all placements of ``mask`` within a row, and the first token of each."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(row[:n] == row[len(mask) - 1 :])
    total = np.full(len(at), salt, np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[at + j]
    return mix(total), at


def mask_of(kind: int, masks: dict[str, int]) -> str:
    """The mask of a kind of seed: one of ``masks``, or all of k tokens (from len(masks) + 1 on)."""
    return list(masks)[kind] if kind < len(masks) else "1" * (kind - len(masks))


def kinds_of(n: int, masks: dict[str, int], least: int) -> list[int]:
    """The kinds of seeds of an item of n tokens."""
    if n < least:
        return [len(masks) + n]
    return [kind for kind, below in enumerate(masks.values()) if not below or n < below]


def seeds(hashes: np.ndarray, row: np.ndarray, masks: dict[str, int], kinds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """All masked hashes of these kinds and their places."""
    found = [masked(hashes, row, mask_of(k, masks), mix_int(k + 1)) for k in kinds]
    none = [(np.empty(0, np.uint64), np.empty(0, np.int64))]
    return tuple(np.concatenate(x) for x in zip(*(found or none), strict=True))


def token_hashes(column: pa.Array) -> Iterator[tuple[Texts, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts, hashes of their tokens (runs of letters, digits and non-ASCII bytes; A-Z as a-z), rows, bounds."""
    for texts in chunks(column):
        words = texts.words(ALNUM)
        yield texts, words.hashes(), words.row, words.bounds


ITEMS = "item_id long, item long, n int, tokens binary"


def test_items(items: DataFrame) -> DataFrame:
    """item_id, item (a hash of the tokens), n and the token hashes of every test item that has an id and a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id").cast(pa.int64())
            for texts, hashes, _, bounds in token_hashes(batch.column("text")):
                own = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                item = [mix_int(int(mix(x + np.arange(len(x), dtype=np.uint64)).sum(dtype=np.uint64)) + len(x)) for x in own]
                columns = [
                    ids.slice(texts.first, len(texts)),
                    pa.array(np.array(item, np.uint64).view(np.int64)),
                    pa.array([len(x) for x in own], pa.int32()),
                    pa.array([x.tobytes() for x in own], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "item", "n", "tokens"])

    return items.select("item_id", "text").mapInArrow(run, ITEMS).where("n > 0 and item_id is not null")


ITEM_SEEDS = "hash long, kind int, item long, n int, item_at int"


def item_seeds(tokens: DataFrame, masks: dict[str, int] = MASKS, least: int = MIN_TOKENS) -> DataFrame:
    """hash, kind, item, n, item_at of the seeds of every item; ``tokens`` has item, n, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, n, raw in zip(*(batch.column(x).to_pylist() for x in ("item", "n", "tokens")), strict=True):
                own = np.frombuffer(raw, np.uint64)
                for kind in kinds_of(n, masks, least):
                    found, at = seeds(own, np.zeros(n, np.int64), masks, [kind])
                    many = len(at)
                    columns = [
                        pa.array(found.view(np.int64)),
                        pa.array(np.full(many, kind, np.int32)),
                        pa.array(np.full(many, item, np.int64)),
                        pa.array(np.full(many, n, np.int32)),
                        pa.array(at.astype(np.int32)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["hash", "kind", "item", "n", "item_at"])

    return tokens.select("item", "n", "tokens").mapInArrow(run, ITEM_SEEDS)


HASHES = "doc_id long, text_key long, hash long, at int"


def document_seeds(docs: DataFrame, masks: dict[str, int], kinds: list[int], wanted: np.ndarray | None) -> DataFrame:
    """doc_id, text_key, hash, at of the masked hashes of every text.

    With ``wanted`` (the sorted test hashes) only those leave the task; without
    it all do, and the join drops what has no partner.
    """
    held = docs.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held is not None:
            # A table of the leading bits settles most hashes before the search.
            known = held.value
            shift = np.uint64(64 - max(20, len(known).bit_length() + 4))
            leading = np.zeros(1 << (64 - int(shift)), bool)
            leading[known >> shift] = True
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            keys = batch.column("text_key")
            for texts, hashes, row, bounds in token_hashes(batch.column("text")):
                found, at = seeds(hashes, row, masks, kinds)
                if held is not None:
                    near = np.flatnonzero(leading[found >> shift])
                    place = np.minimum(np.searchsorted(known, found[near]), len(known) - 1)
                    near = near[known[place] == found[near]]
                    found, at = found[near], at[near]
                for part in range(0, len(at), 1 << 16):
                    p = slice(part, part + (1 << 16))
                    rows = pa.array(row[at[p]] + texts.first)
                    columns = [
                        ids.take(rows),
                        keys.take(rows),
                        pa.array(found[p].view(np.int64)),
                        pa.array((at[p] - bounds[row[at[p]]]).astype(np.int32)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "hash", "at"])

    return keyed(docs).mapInArrow(run, HASHES)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_key().alias("text_key"), "text")


WINDOWS = "doc_id long, text_key long, item long, n int, diagonal int, low int, window binary"


def windows(texts: DataFrame) -> DataFrame:
    """The tokens of a text that an item covers where its first token lies on ``diagonal``, from the item's token ``low`` on.

    ``texts`` has doc_id, text_key, text and ``laid``, a list of (item, n, diagonal); each text is tokenized once for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in WINDOWS.split(", ")]
        for batch in batches:
            for texts, hashes, _, bounds in token_hashes(batch.column("text")):
                rows, item, n, diagonal, low, window = [], [], [], [], [], []
                for i in range(len(texts)):
                    text = hashes[bounds[i] : bounds[i + 1]]
                    for x in batch.column("laid")[texts.first + i].as_py():
                        first = max(0, -x["diagonal"])
                        rows.append(texts.first + i)
                        item.append(x["item"])
                        n.append(x["n"])
                        diagonal.append(x["diagonal"])
                        low.append(first)
                        window.append(text[first + x["diagonal"] : x["n"] + x["diagonal"]].tobytes())
                at = pa.array(rows, pa.int64())
                ints = (pa.array(x, pa.int32()) for x in (n, diagonal, low))
                columns = [batch.column("doc_id").take(at), batch.column("text_key").take(at), pa.array(item, pa.int64()), *ints]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(window, pa.binary())], names=names)

    return texts.select("doc_id", "text_key", "text", "laid").mapInArrow(run, WINDOWS)


OVERLAPS = "doc_id long, text_key long, item long, doc_start long, doc_end long, item_tokens int, matched int, substituted int"


def verified(laid: DataFrame, share: float, least: int) -> DataFrame:
    """Those of ``laid`` (windows beside the item's tokens) that agree well enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in OVERLAPS.split(", ")]
        for batch in batches:
            kept, out = [], []
            raw = (batch.column(x).to_pylist() for x in ("tokens", "window", "low", "diagonal"))
            for i, (tokens, window, low, diagonal) in enumerate(zip(*raw, strict=True)):
                item, text = np.frombuffer(tokens, np.uint64), np.frombuffer(window, np.uint64)
                agree = low + np.flatnonzero(item[low : low + len(text)] == text)
                if len(agree) < max(min(least, len(item)), share * len(item)):
                    continue
                start, end = diagonal + int(agree[0]), diagonal + int(agree[-1]) + 1
                kept.append(i)
                out.append((start, end, len(item), len(agree), end - start - len(agree)))
            at = pa.array(kept, pa.int64())
            found = np.ascontiguousarray(np.array(out, np.int64).reshape(-1, 5).T)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            columns = [batch.column(x).take(at) for x in ("doc_id", "text_key", "item")]
            columns += [pa.array(x).cast(kind) for x, kind in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return laid.select("doc_id", "text_key", "item", "tokens", "window", "low", "diagonal").mapInArrow(run, OVERLAPS)


def located(
    docs: DataFrame,
    items: DataFrame,
    masks: dict[str, int] = MASKS,
    share: float = MIN_SHARE,
    least: int = MIN_TOKENS,
    held_hashes: int = HELD_HASHES,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``overlaps`` with the text_key of each text."""
    named = checkpointed(test_items(items))
    tokens = named.select("item", "n", "tokens").dropDuplicates(["item"])
    wanted = checkpointed(item_seeds(tokens, masks, least))
    n, rows = wanted.agg(F.count_distinct("hash"), F.count("*")).first()
    size = tokens.agg(F.sum("n")).first()[0] or 0
    kinds = sorted(r["kind"] for r in wanted.select("kind").distinct().collect())
    held = None
    if n <= held_hashes:
        held = np.sort(wanted.select("hash").distinct().toPandas()["hash"].to_numpy(np.int64).view(np.uint64))
        held = held if n else np.zeros(1, np.uint64)
    # A shuffled join of hashes that very many texts share is split by adaptive execution.
    places = wanted.select("hash", "item", "n", "item_at")
    places = F.broadcast(places) if rows <= broadcast_rows else places.hint("merge")
    hits = document_seeds(docs, masks, kinds, held).join(places, "hash")
    # One alignment of a text and an item is verified once, however many seeds hit on it.
    text = ["doc_id", "text_key"]
    aligned = hits.select(*text, "item", "n", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    aligned = checkpointed(aligned)
    many = checkpointed(aligned.groupBy(*text).count().where(F.col("count") > ALIGNMENTS))
    parts = many.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.ceil(F.col("count") / ALIGNMENTS).alias("parts"))
    parts = F.broadcast(parts) if parts.count() <= broadcast_rows else parts
    of_text = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))
    part = F.pmod(F.xxhash64("item", "diagonal"), F.coalesce("parts", F.lit(1))).alias("part")
    laid = aligned.join(parts, of_text, "left").groupBy(*text, part).agg(F.collect_list(F.struct("item", "n", "diagonal")).alias("laid"))
    laid = checkpointed(laid.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "laid"))
    few = aligned.count() <= broadcast_rows
    texts = keyed(docs).join(F.broadcast(laid) if few else laid.hint("shuffle_hash"), of_text)
    tokens = F.broadcast(tokens) if size * 8 <= BROADCAST_BYTES else tokens
    # Written between, so that no task has two Python workers at once.
    found = verified(checkpointed(windows(texts)).join(tokens.drop("n"), "item"), share, least).distinct()
    ids = named.select("item", "item_id").distinct()
    ids = F.broadcast(ids) if named.count() <= broadcast_rows else ids
    return found.join(ids, "item")


def overlaps(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Where training texts hold test items, substitutions allowed.

    One row per doc_id, item_id and place (doc_start, doc_end in tokens): the
    item's number of tokens, how many agree (``matched``, at least the ``share`` of
    the item's and ``least``) and how many between the first and the last of them
    do not (``substituted``). Tokens are runs of letters, digits and non-ASCII
    bytes, A-Z as a-z. An item with fewer than ``least`` tokens matches where all of
    them stand, unchanged. Items without an id or a token match nothing; null and empty texts hold
    nothing. Repeated rows give their overlaps once; a null doc_id is kept as
    null. Empty tables give no rows. Other columns are ignored.

    Up to ``held_hashes`` different test hashes filter the training hashes inside
    the tasks; beyond that all training hashes are joined by shuffle. In the same
    way tables up to ``broadcast_rows`` are broadcast to the texts, larger ones are shuffled.
    """
    names = ("doc_id", "item_id", "doc_start", "doc_end", "item_tokens", "matched", "substituted")
    return located(docs, items, **options).select(*names).distinct()


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id of each contaminated text with its items, the best share and the number of overlaps."""
    found = overlaps(docs, items, **options)
    return found.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
        F.count("*").alias("n_overlaps"),
        F.max(F.col("matched") / F.col("item_tokens")).alias("share"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose text holds no test item, with or without a doc_id."""
    found = located(docs, items, **options).select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).distinct()
    same = F.col("docs.doc_id").eqNullSafe(F.col("found.d")) & (text_key("docs.text") == F.col("found.k"))
    return docs.alias("docs").join(found.alias("found"), same, "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per overlap of a document and a benchmark item."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
