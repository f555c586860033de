"""The prefix trie of conversations, from vertical bitmaps.

Conversations are range-partitioned by id and cut into blocks. In a block, each (position, turn) has the bitset of the
conversations that hold this turn there. A depth-first walk intersects the bitset of a node with these postings: the
intersections are its children, their popcounts the numbers of members, and what is left over ends at the node. The
nodes of all blocks are then merged by a hash of their path, so a first turn or a conversation that very many share is
in every block once, and never gathered in one task.

The least member and the depth name a node, and the nodes of one least member form a chain. Sums over subtrees are
sums along chains and over the tree of chains; the latter takes a logarithmic number of rounds (each chain learns
its ancestors 1, 2, 4, ... steps up), however deep the trie is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import written
from .tables import CRC_SQL, crc32_sql, table

#: Conversations of a block, and the turns from which a block takes no further one.
BLOCK_CONVERSATIONS, BLOCK_TURNS = 1024, 1 << 16
#: Conversations whose ids have the same quotient by this share the head of the first of them.
FAMILY = 20

NODES = "path binary, parent binary, depth long, words long, conv_id long, n_convs long, ends string"
NODE_SCHEMA = pa.schema([
    ("path", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()),
    ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("ends", pa.string()),
])


def ordered(conversations: DataFrame) -> DataFrame:
    """Turns as (conv_id, pos, key, words): pos from 1 by turn (null first), key a hash of role and text.

    A null role or text counts as empty. Rows of one turn stand in the order of their keys, repeated rows stay. Rows
    without conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "key", "words")


def share_heads(turns: DataFrame) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c % 20 in place of its own first h; h is crc32(c) % 4.

    A row of position 0 without a key stands for each conversation, so that those without turns are kept.
    """
    conv = F.col("conv_id")
    h = F.crc32(conv.cast("string").cast("binary")) % 4
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("last")).select("conv_id", (conv - conv % FAMILY).alias("base"), h.alias("h"))
    heads = turns.where((conv % FAMILY == 0) & (F.col("pos") <= 3)).select(conv.alias("base"), "pos", "key", "words")
    head = convs.join(heads, "base").where(F.col("pos") <= F.col("h")).select("conv_id", "pos", "key", "words")
    own = turns.where(F.col("pos") > h).select("conv_id", (F.col("pos") + 3).alias("pos"), "key", "words")
    bare = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("words"))
    return head.unionByName(own).unionByName(bare)


def block_nodes(ids: list[int], turns: list[list[tuple[bytes, int]]]) -> Iterator[tuple]:
    """The trie of one block: (path, parent, depth, words, least id, members, ids that end there or None); ids ascend."""
    postings: list[dict[bytes, int]] = []
    ending: dict[int, int] = {}
    for i, own in enumerate(turns):
        ending[len(own)] = ending.get(len(own), 0) | 1 << i
        while len(postings) < len(own):
            postings.append({})
        for at, (key, _) in enumerate(own):
            postings[at][key] = postings[at].get(key, 0) | 1 << i
    stack = [(b"", None, 0, 0, (1 << len(ids)) - 1)]
    while stack:
        path, parent, depth, words, members = stack.pop()
        here = members & ending.get(depth, 0)
        names, rest = [], here
        while rest:
            low = rest & -rest
            names.append(str(ids[low.bit_length() - 1]))
            rest ^= low
        least = (members & -members).bit_length() - 1
        yield path, parent, depth, words, ids[least], members.bit_count(), ",".join(names) if names else None
        rest = members ^ here
        while rest:
            key, n = turns[(rest & -rest).bit_length() - 1][depth]
            child = rest & postings[depth][key]
            stack.append((hashlib.sha256(path + key).digest(), path, depth + 1, n, child))
            rest ^= child


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[int], list[list[tuple[bytes, int]]]]]:
    """Blocks of whole conversations from rows sorted by conv_id and pos."""
    ids: list[int] = []
    turns: list[list[tuple[bytes, int]]] = []
    held = 0
    for batch in batches:
        for conv, key, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "key", "words"))):
            if not ids or ids[-1] != conv:
                if len(ids) >= BLOCK_CONVERSATIONS or held >= BLOCK_TURNS:
                    yield ids, turns
                    ids, turns, held = [], [], 0
                ids.append(conv)
                turns.append([])
            if key is not None:
                turns[-1].append((key, words))
                held += 1
    if ids:
        yield ids, turns


def _block_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), NODE_SCHEMA)], schema=NODE_SCHEMA)

    rows: list[tuple] = []
    for ids, turns in _blocks(batches):
        for node in block_nodes(ids, turns):
            rows.append(node)
            if len(rows) == 4096:
                yield batch(rows)
                rows = []
    if rows:
        yield batch(rows)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each path's lists, which come sorted by path and least id, joined by commas; holds one list at a time."""
    path, state = None, None
    for batch in batches:
        found = []
        for now, ends in zip(batch.column("path").to_pylist(), batch.column("ends").to_pylist()):
            if state is None or now != path:
                if state is not None:
                    found.append((path, state.hexdigest()))
                path, state = now, hashlib.sha256(ends.encode())
            else:
                state.update(b",")
                state.update(ends.encode())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.binary(), pa.string()))], ["path", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([state.hexdigest()])], ["path", "ends_sha256"])


def chain_totals(chains: DataFrame) -> DataFrame:
    """(conv_id, up, top, leaves, saved) of every chain: the sums over its own subtree, from those of its own nodes.

    In round k, ``jump`` is the chain 2^k steps up, and the sums are those of the chains less than 2^k steps below.
    """
    now = written(chains.withColumn("jump", F.col("up")))
    while now.where(F.col("jump").isNotNull()).limit(1).count():
        below = now.where(F.col("jump").isNotNull()).groupBy(F.col("jump").alias("conv_id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        above = now.where(F.col("jump").isNotNull()).select(F.col("conv_id").alias("jump"), F.col("jump").alias("next"))
        now = now.join(below, "conv_id", "left").join(above, "jump", "left")
        added = lambda total, more: (F.col(total) + F.coalesce(F.col(more), F.lit(0))).alias(total)
        now = written(now.select("conv_id", "up", "top", added("leaves", "l"), added("saved", "s"), F.col("next").alias("jump")))
    return now.drop("jump")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, pos, key, words), the root included.

    Columns: conv_id (least member), depth, parent_conv_id (the parent's; null at the root), n_convs, n_children,
    n_leaves and saved_tokens over the subtree with its top, and ends_sha256 over the ids of the conversations that end
    there. Positions give the order only. A row without key counts as no turn. No rows give no nodes.
    """
    held = written(turns.select("conv_id", "pos", "key", "words"))
    parts = written(held.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_block_nodes, NODES))
    nodes = parts.groupBy("path", "parent", "depth", "words").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    nodes = written(nodes)
    ends = parts.where(F.col("ends").isNotNull()).select("path", "conv_id", "ends")
    ends = ends.repartition("path").sortWithinPartitions("path", "conv_id").mapInArrow(_hash_ends, "path binary, ends_sha256 string")
    above = nodes.select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = nodes.join(above, "parent", "left").join(ends, "path", "left")
    named = written(named.select("conv_id", "depth", "parent_conv_id", "n_convs", "words", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))

    children = named.where(F.col("depth") > 0).groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    named = named.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    named = named.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saving", (F.col("n_convs") - 1) * F.col("words"))
    named = written(named)
    up = F.when(F.col("parent_conv_id") != F.col("conv_id"), F.col("parent_conv_id"))
    chains = named.groupBy("conv_id").agg(F.max(up).alias("up"), F.min("depth").alias("top"), F.sum("leaf").alias("leaves"), F.sum("saving").alias("saved"))
    hung = chain_totals(chains).where(F.col("up").isNotNull())
    hung = hung.groupBy(F.col("up").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)

    def total(own: str, more: str) -> Column:
        return F.sum(F.col(own) + F.coalesce(F.col(more), F.lit(0))).over(below)

    return named.join(hung, ["conv_id", "depth"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        total("leaf", "leaves").alias("n_leaves"),
        total("saving", "saved").alias("saved_tokens"),
        "ends_sha256",
    )


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt so that families share heads: see ``ordered``, ``share_heads`` and ``prefix_trie``."""
    return prefix_trie(share_heads(written(ordered(table(spark, sf_dir, "conversations")))))


ORACLE = rf"""
WITH {CRC_SQL},
rows AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words
  FROM conversations WHERE conv_id IS NOT NULL
),
turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos FROM rows),
convs AS (SELECT conv_id, {crc32_sql("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc),
parts AS (
  SELECT c.conv_id, t.pos, t.key, t.words FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, t.pos + 3, t.key, t.words FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
),
members AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(key, '') OVER w AS path, words FROM parts
  WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs
),
nodes AS (
  SELECT path, depth, left(path, 64 * (depth - 1)) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saving
  FROM members GROUP BY path, depth
),
children AS (SELECT parent AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent),
sized AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (path)),
below AS (
  SELECT left(path, 64 * up) AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saving) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM sized) GROUP BY 1
),
ends AS (
  SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS names FROM (SELECT conv_id, max(path) AS path FROM members GROUP BY conv_id) GROUP BY path
)
SELECT s.conv_id, s.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children::BIGINT AS n_children,
  b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.names, '')) AS ends_sha256
FROM sized s LEFT JOIN nodes p ON s.depth > 0 AND p.path = s.parent JOIN below b ON b.path = s.path LEFT JOIN ends e ON e.path = s.path"""
