"""Near-duplicate vectors by cross-polytope hashing.

A vector is rotated three times by a random sign flip and a fast Hadamard
transform; its hash is the axis (and sign) nearest to it, of two such rotations
together. Every table also probes the next best buckets. Only the numbers of the
vectors go to the buckets, with a sketch of the signs that the rotations gave:
vectors of one bucket whose sketches are near enough become candidates. Connected
candidates form a block; each vector goes once to its block, where pairs are
verified by their cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import checkpointed, components
from .tables import table
from .textops import mix

TABLES = 4
#: Buckets of a vector in a table: its own and the next best.
PROBES = 4
#: Rotations that make up one hash (more make more buckets, for more vectors), and alternatives looked at in each.
ROTATIONS, NEAREST = 2, 4
#: Signs of a sketch, in 64-bit words, and how many standard deviations beyond the mean two may differ.
SKETCH, DEVIATIONS = 2, 5.0
#: Vectors of a bucket that one task compares; a larger bucket is dealt into tiles.
BUCKET = 1024
#: Vectors of a tile of a block (by the number of vectors of the block).
TILE_LEAST, TILE_MOST = 256, 4096
#: Rows (16 bytes each) that may be broadcast.
BROADCAST_ROWS = 500_000
SEED = 7


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of rows whose length is a power of two."""
    n, size = x.shape
    half = 1
    while half < size:
        x = x.reshape(n, -1, 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, size)
        half *= 2
    return x / x.dtype.type(math.sqrt(size))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """``x`` after a sign flip and a Hadamard transform for each row of ``signs``."""
    for s in signs:
        x = hadamard(x * s)
    return x


def nearest_axes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``NEAREST`` axes of each rotated row, nearest first, and their coordinates."""
    size, k = np.abs(x), min(NEAREST, x.shape[1])
    at = np.sort(np.argpartition(-size, k - 1, axis=1)[:, :k], axis=1)
    value = np.take_along_axis(size, at, axis=1)
    order = np.argsort(-value, axis=1, kind="stable")
    at, value = np.take_along_axis(at, order, axis=1), np.take_along_axis(value, order, axis=1)
    return 2 * at + (np.take_along_axis(x, at, axis=1) < 0), value


def bucket_codes(
    x: np.ndarray, tables: int = TABLES, probes: int = PROBES, rotations: int = ROTATIONS, seed: int = SEED
) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of unit rows, (rows, tables, probes), the own bucket first, and sketches. Rows are padded to a power of two."""
    size = max(2, 1 << (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - x.shape[1]))).astype(np.float32)
    signs = np.random.default_rng([seed, size]).choice(np.float32([-1, 1]), size=(tables, rotations, 3, size))
    out, told = np.full((len(x), tables, probes), -1, np.int64), []
    for t in range(tables):
        # All ways to move to other axes, by how far the coordinates lie below the best.
        code, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1), np.float32)
        for r in range(rotations):
            turned = rotate(x, signs[t, r])
            if len(told) * size < 64 * SKETCH:
                told.append(turned > 0)
            axis, value = nearest_axes(turned)
            gap = (value[:, :1] - value) ** 2
            code = (code[:, :, None] * (2 * size) + axis[:, None, :]).reshape(len(x), -1)
            cost = (cost[:, :, None] + gap[:, None, :]).reshape(len(x), -1)
            if r and cost.shape[1] > 4 * probes:  # the best of all lie among the best so far
                best = np.argsort(cost, axis=1, kind="stable")[:, : 4 * probes]
                code, cost = np.take_along_axis(code, best, axis=1), np.take_along_axis(cost, best, axis=1)
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        found = np.take_along_axis(code, best, axis=1)
        out[:, t, : found.shape[1]] = found
    bits = np.concatenate(told, axis=1)[:, : 64 * SKETCH]
    bits = np.pad(bits, ((0, 0), (0, 64 * SKETCH - bits.shape[1])))
    return out, np.packbits(bits, axis=1).view("<u8")


def sketch_limit(dim: np.ndarray, threshold: float, tables: int = TABLES, rotations: int = ROTATIONS) -> np.ndarray:
    """How many signs may differ between vectors of this dimension that link."""
    size = 2 ** np.ceil(np.log2(np.maximum(dim, 2)))
    n = np.minimum(64 * SKETCH, np.minimum(tables * rotations, np.ceil(64 * SKETCH / size)) * size)
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return np.ceil(n * p + DEVIATIONS * np.sqrt(n * p * (1 - p))).astype(np.int64)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows, in double precision, of a list column whose lists have ``dim`` components."""
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


ENTRIES = "bucket long, own boolean, cid long, dim int, u long, v long"


def bucket_entries(classes: DataFrame) -> DataFrame:
    """One row for each vector, table and probed bucket; ``classes`` has cid, group (of its label), embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ENTRIES.split(", ")]
        for batch in batches:
            column = batch.column("embedding")
            dims = np.asarray(column.value_lengths())
            cids = np.asarray(batch.column("cid"))
            groups = np.asarray(batch.column("group")).view(np.uint64)
            for dim in np.unique(dims):
                for rows in np.array_split(np.flatnonzero(dims == dim), max(1, int((dims == dim).sum()) // 512)):
                    codes, sketch = bucket_codes(matrix(column.take(pa.array(rows)), int(dim)))
                    n, tables, probes = codes.shape
                    place = mix(groups[rows] ^ mix(np.full(n, dim, np.uint64)))[:, None] + np.arange(tables, dtype=np.uint64)
                    bucket = mix(mix(place)[:, :, None] ^ codes.astype(np.uint64))
                    real = (codes >= 0).reshape(-1)
                    each = lambda a: np.repeat(a, tables * probes)[real]
                    own = np.broadcast_to(np.arange(probes) == 0, codes.shape).reshape(-1)[real]
                    columns = [
                        bucket.reshape(-1)[real].view(np.int64),
                        own,
                        each(cids[rows]),
                        each(np.full(n, dim, np.int32)),
                        *(each(sketch[:, i]).view(np.int64) for i in range(SKETCH)),
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=names)

    return classes.select("cid", "group", "embedding").mapInArrow(run, ENTRIES)


def least_reachable(n: int, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For n nodes the least ``value`` that the pairs (a, b) reach."""
    least = value.copy()
    while True:
        before = least.copy()
        np.minimum.at(least, a, before[b])
        np.minimum.at(least, b, before[a])
        if (least == before).all():
            return least


def by_arrow_group(names: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """For mapInArrow over rows sorted by ``names``: calls ``work`` with whole groups, many small ones at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            keys = [np.asarray(batch.column(x)) for x in names]
            # The last group may go on in the next batch.
            low = len(batch) - 1
            while low and all(k[low - 1] == k[low] for k in keys):
                low -= 1
            last = [k[0] for k in keys] if not held else [held[-1].column(x)[-1].as_py() for x in names]
            if low or any(k[0] != x for k, x in zip(keys, last, strict=True)):
                if low or held:
                    yield from work(pa.Table.from_batches([*held, batch.slice(0, low)]))
                held = [batch.slice(low)]
            else:
                held.append(batch)
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def starts_of(table: pa.Table, names: list[str]) -> np.ndarray:
    """Where groups of equal ``names`` begin, and the number of rows."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for x in names:
        k = table.column(x).to_numpy()
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), len(table))


def near_in_buckets(names: list[str], threshold: float):
    """Work of a task on whole buckets: (a, b) that connect all candidates of each."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        own, cid, dim, u, v, side = (rows.column(x).to_numpy() for x in ("own", "cid", "dim", "u", "v", "side"))
        u, v = u.view(np.uint64), v.view(np.uint64)
        bounds = starts_of(rows, names)
        end = np.repeat(bounds[1:], np.diff(bounds))
        crossed = np.repeat(np.logical_or.reduceat(side == 1, bounds[:-1]), np.diff(bounds))
        limit = sketch_limit(dim, threshold)
        pairs, i, apart = [], np.arange(len(cid)), 1
        while True:
            i = i[i + apart < end[i]]
            if not len(i):
                break
            j = i + apart
            near = np.bitwise_count(u[i] ^ u[j]).astype(np.int64) + np.bitwise_count(v[i] ^ v[j]) <= limit[i]
            near &= (own[i] | own[j]) & (cid[i] != cid[j]) & (dim[i] == dim[j]) & (~crossed[i] | (side[i] != side[j]))
            pairs.append(np.stack([i[near], j[near]]))
            apart += 1
        if not pairs:
            return
        a, b = np.concatenate(pairs, axis=1)
        least = least_reachable(len(cid), a, b, cid)
        linked = np.unique(np.concatenate([a, b]))
        linked = linked[least[linked] != cid[linked]]
        found = np.unique(np.stack([cid[linked], least[linked]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.ascontiguousarray(found)], names=["a", "b"])

    return work


def dealt_to_tiles(rows: DataFrame, keys: list[str], node: str) -> DataFrame:
    """``rows``, whose ``tiles`` says how many tiles their group has, once for each pair of tiles (i, j) that they belong to."""
    own = F.pmod(F.xxhash64(node), F.col("tiles")).cast("int")
    return (
        rows.withColumn("tile", own)
        .withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
        .withColumns(
            {
                "i": F.least("tile", "other"),
                "j": F.greatest("tile", "other"),
                "side": F.when(F.col("tile") > F.col("other"), 1).otherwise(0),
            }
        )
        .drop("tile", "other", "tiles")
    )


def candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) that connect all vectors which meet in a bucket, at least one of them in its own, with near sketches."""
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = bucket_entries(classes).repartition(n, "bucket")
    crowded = entries.groupBy("bucket").agg(F.count("*").alias("count")).where(F.col("count") > BUCKET)
    crowded = checkpointed(crowded.select("bucket", F.ceil(F.col("count") / BUCKET).cast("int").alias("tiles")))
    few = crowded.count()
    held = F.broadcast(crowded) if few <= BROADCAST_ROWS else crowded
    schema = "a long, b long"
    plain = entries.join(held, "bucket", "left_anti") if few else entries
    plain = plain.withColumn("side", F.lit(0)).sortWithinPartitions("bucket", "cid")
    found = plain.mapInArrow(by_arrow_group(["bucket"], near_in_buckets(["bucket"], threshold)), schema)
    if few:
        keys = ["bucket", "i", "j"]
        tiles = dealt_to_tiles(entries.join(held, "bucket"), ["bucket"], "cid")
        tiles = tiles.repartition(n, *keys).sortWithinPartitions(*keys, "cid")
        found = found.union(tiles.mapInArrow(by_arrow_group(keys, near_in_buckets(keys, threshold)), schema))
    return found.distinct()


BLOCK = ["block", "group", "dim", "i", "j"]


def verified_links(members: DataFrame, threshold: float) -> DataFrame:
    """cid, links, other: the links of each vector within one pair of tiles of its block, and the least cid that they reach.

    ``members`` has block, group, dim, cid, copies, embedding, tiles. ``links`` counts copies of the others.
    """

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        bounds = starts_of(rows, BLOCK)
        cids, copies, sides, dims = (rows.column(x).to_numpy() for x in ("cid", "copies", "side", "dim"))
        column = rows.column("embedding")
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        out = []
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            if high - low < 2:
                continue
            x = matrix(column.slice(low, high - low), int(dims[low]))
            cid, own, side = cids[low:high], copies[low:high], sides[low:high]
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            within = not len(right)
            right = left if within else right
            fits = x[left] @ x[right].T >= threshold
            if within:
                fits = np.triu(fits, 1)
            a, b = np.nonzero(fits)
            if not len(a):
                continue
            a, b = left[a], right[b]
            links = np.bincount(a, own[b], len(x)) + np.bincount(b, own[a], len(x))
            least = least_reachable(len(x), a, b, cid)
            some = np.flatnonzero(links)
            out.append(np.stack([cid[some], links[some].astype(np.int64), least[some]]))
        if out:
            columns = np.ascontiguousarray(np.concatenate(out, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cid", "links", "other"])

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt_to_tiles(members, BLOCK[:3], "cid").repartition(n, *BLOCK).sortWithinPartitions(*BLOCK, "cid")
    return dealt.mapInArrow(by_arrow_group(BLOCK, work), "cid long, links long, other long")


def comparable(embedding: str = "embedding", label: str = "label") -> Column:
    """True for vectors that can link: a label, and only finite components, not all zero."""
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    zero = F.forall(embedding, lambda v: v == 0)
    return F.coalesce(F.col(label).isNotNull() & F.col(embedding).isNotNull() & ~bad & ~zero, F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    Vectors of equal, non-null label (of any type) and equal length link when their cosine, in double
    precision, is at least ``threshold``. A vector that is null, empty or zero, or holds a null
    or non-finite component, links with nothing. Equal vectors are one class and
    compared once; each row still counts as a link of the others, repeated rows
    of one vec_id too. component_id is the least vec_id that links reach. A row
    without a vec_id is counted by the others and connects them; its component is the least vec_id that it reaches,
    null if there is none. Different vectors under one vec_id are looked at each for itself. Other columns are ignored.
    """
    rows = vectors.select("vec_id", "embedding", "label").withColumn("fit", comparable())
    fit = rows.where("fit")
    classes = fit.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    # The number of a class is written with it: later stages read it, whatever becomes of the task that made it.
    classes = checkpointed(classes.withColumn("cid", F.monotonically_increasing_id()))
    wide = classes.withColumns({"group": F.xxhash64("label"), "dim": F.size("embedding")})

    joined = components(candidates(wide, threshold))
    roots = joined.select(F.col("component").alias("node"), "component").distinct()
    blocks = joined.union(roots).select(F.col("node").alias("cid"), F.col("component").alias("block"))
    blocks = checkpointed(blocks)
    tile = F.least(F.greatest(F.lit(TILE_LEAST), F.sqrt("count") * 8), F.lit(TILE_MOST))
    sizes = blocks.groupBy("block").count().select("block", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    large = checkpointed(sizes.where("tiles > 1"))
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    blocks = blocks.join(large, "block", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    members = wide.join(blocks, "cid").select("block", "group", "dim", "cid", "copies", "embedding", "tiles")
    found = checkpointed(verified_links(members, threshold))

    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    reached = components(found.where("cid <> other").select("cid", "other"), "cid", "other")
    ends = classes.select("cid", "rep").join(reached, F.col("cid") == F.col("node"), "left")
    ends = ends.select("cid", "rep", F.coalesce("component", "cid").alias("component"))
    least = ends.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = (
        classes.join(links, "cid", "left")
        .join(ends.select("cid", "component"), "cid")
        .join(least, "component")
        .select("label", "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    )
    some = fit.join(named, ["label", "embedding"], "left").select("vec_id", "n_links", "component_id")
    none = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.union(none).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of equal label by a cosine of 0.93: see ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
