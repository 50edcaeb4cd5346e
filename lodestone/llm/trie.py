"""The prefix trie of conversations, with subtree totals by parallel tree contraction.

1. Turns get their place in their conversation, and every conversation is rebuilt: the first turns of the conversation that
   it was forked from, then its own. Only hashes and sizes of the turns move.
2. The running xor of two 64-bit hashes of (place, role, text) names every prefix, so a node is a group of equal prefixes:
   its least conversation and its number of members come from one grouped aggregation with partial sums. A turn's hashes
   taken off again name the parent. A conversation of very many turns is cut by range into parts of their own windows, and
   the parts' sums are added.
3. Numbers of leaves and saved tokens are summed over subtrees by :func:`lodestone.llm.contract.subtree_totals`.
4. The ids of the conversations that end in a node are joined in runs of bounded length, sorted by range over all tasks, and
   the runs are digested one after another; so a node where very many end moves as few, long rows, and none holds them all.

Cases: turns are ordered by turn (null first), then by role and the hashes of their texts; repeated rows are turns of their
own. A null role or text is the same as an empty one. Rows without a conv_id belong to no conversation and are left out. An
empty table gives no rows, not even a root. Texts of any length are hashed whole. Other columns are ignored, whatever their
names. Texts aren't compared: two different prefixes of as many turns meet with a chance of about 2^-128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestone.llm.common import column, load, materialize
from lodestone.llm.contract import subtree_totals

#: Bytes of joined ids in one row.
RUN = 1 << 16
NODE = ["depth", "h1", "h2"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role_text hashes a and b, bytes, part): turns at their places from 1; parts ascend with pos."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    role, text = blank("role"), blank("text")
    narrow = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"),
        F.octet_length(text).cast("long").alias("bytes"), F.xxhash64(role).alias("role"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("a"), F.col("b")]
    put = materialize(narrow.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    sizes = put.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"))
    local = F.row_number().over(W.partitionBy("conv_id", "part").orderBy(*order))
    placed = put.withColumn("pos", local).join(starts, ["conv_id", "part"])
    return placed.select("conv_id", (F.col("pos") + F.col("at")).alias("pos"), "a", "b", "bytes", "part")


def rebuilt(turns: DataFrame, source: Column, taken: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Each conversation's first `taken` turns (at most `most`) from conversation `source`, then its own after as many.

    Returns the turns (as given, part -1 for those of the source) and (conv_id, length) of every conversation.
    """
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("own")).withColumns({"source": source, "h": taken.cast("long")})
    head = turns.filter(F.col("pos") <= most).select(F.col("conv_id").alias("source"), "pos", "a", "b", "bytes")
    had = convs.select(F.col("conv_id").alias("source"), F.col("own").alias("there"))
    convs = materialize(convs.join(had, "source", "left").withColumn("given", F.least("h", F.coalesce("there", F.lit(0)))), "convs")
    given = convs.select("conv_id", "source", "given").join(head, "source").filter("pos <= given").select("conv_id", "pos", "a", "b", "bytes", F.lit(-1).alias("part"))
    kept = turns.join(convs.select("conv_id", "h", "given"), "conv_id").filter("pos > h")
    kept = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "a", "b", "bytes", "part")
    return given.union(kept), convs.select("conv_id", (F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, h1, h2, p1, p2, bytes): the hashes of each prefix and of the one before it."""
    at = turns.withColumns({"t1": F.xxhash64("pos", "a", "b"), "t2": F.xxhash64("b", "a", "pos", F.lit(2))})
    sums = at.groupBy("conv_id", "part").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("conv_id", "part", *[F.coalesce(F.bit_xor(f"s{i}").over(before), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    local = W.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    rolled = at.withColumns({"r1": F.bit_xor("t1").over(local), "r2": F.bit_xor("t2").over(local)}).join(starts, ["conv_id", "part"])
    own = [F.col(f"r{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"h{i}") for i in (1, 2)]
    return rolled.select("conv_id", F.col("pos").cast("long").alias("depth"), *own, "t1", "t2", "bytes").select(
        "conv_id", *NODE, F.col("h1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("h2").bitwiseXOR(F.col("t2")).alias("p2"), "bytes"
    )


def id_digests(ends: DataFrame) -> DataFrame:
    """(*NODE, ends_sha256): of the conv_ids of each node, in numerical order, as decimals joined by commas."""
    keys = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    joined = StructType.fromDDL("depth long, h1 long, h2 long, first long, ids string")
    digest = StructType.fromDDL("depth long, h1 long, h2 long, ends_sha256 string")

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, node, first, ids, size = to_arrow_schema(joined), None, 0, [], 0
        for batch in batches:
            done = []
            for *key, conv in zip(*(column(batch, c).to_pylist() for c in (*NODE, "conv_id")), strict=True):
                if key != node or size >= RUN:
                    if ids:
                        done.append((*node, first, ",".join(ids)))
                    node, first, ids, size = key, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*node, first, ",".join(ids)), schema, strict=True)], schema=schema)

    def hash_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, node, state = to_arrow_schema(digest), None, None
        for batch in batches:
            done = []
            for *key, text in zip(*(column(batch, c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if key != node:
                    if state:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*node, state.hexdigest()), schema, strict=True)], schema=schema)

    rows = keys.mapInArrow(join, joined)
    return rows.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hash_runs, digest)


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie over the conversations in `lengths` (conv_id, length), whose turns are as :func:`rebuilt` gives them."""
    pre = materialize(prefixes(turns), "prefixes")
    nodes = pre.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.max(c).alias(c) for c in ("p1", "p2", "bytes")])
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(*[zero.alias(c) for c in NODE], "conv_id", "n_convs", F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("bytes"))
    nodes = materialize(nodes.union(root).withColumn("id", F.monotonically_increasing_id()), "nodes")
    # The root may have a third of all nodes as its children: they meet it by a broadcast of its one row.
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    top = F.broadcast(up.filter("depth = 1").select("depth", "parent", "parent_conv_id"))
    first = nodes.filter("depth <= 1").join(top, "depth", "left")
    later = nodes.filter("depth > 1").join(up, ["depth", "p1", "p2"], "left")
    shape = ["id", *NODE, "conv_id", "n_convs", "bytes", "parent", "parent_conv_id"]
    linked = materialize(first.select(*shape).union(later.select(*shape)), "linked")
    kids = linked.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    made = materialize(linked.join(kids, "id", "left").withColumn("n_children", F.coalesce("n_children", zero)), "made")
    weights = made.select("id", "parent", F.col("depth").alias("level"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = subtree_totals(weights, ["n_leaves", "saved_tokens"])
    last = pre.join(lengths, "conv_id").filter("depth = length").select(*NODE, "conv_id")
    ends = materialize(last.union(lengths.filter("length = 0").select(*[zero.alias(c) for c in NODE], "conv_id")), "ends")
    none = hashlib.sha256().hexdigest()
    out = made.join(totals, "id").join(id_digests(ends), NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, a row a node.

    Conversation c takes the first crc32(c) % 9 turns from conversation c - c % 5.
    """
    c = F.col("conv_id")
    turns = materialize(ordered_turns(conversations), "ordered")
    return trie(*rebuilt(turns, c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9, 8))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(load(spark, sf_dir, "conversations"))


#: Whole prefixes instead of hashes, and all ancestors of every node instead of a contraction.
OP13_SQL = r"""
WITH o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    strlen(coalesce(text, '')) AS bytes, '[' || to_json(coalesce(role, '')) || to_json(coalesce(text, '')) || ']' AS said
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (
  SELECT conv_id, conv_id - conv_id % 5 AS source, count(*) AS own,
    xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda a, b: list_reduce(list_concat([xor(a, b)], CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295) % 9 AS h
  FROM o GROUP BY conv_id),
r AS (
  SELECT k.conv_id, o.pos, 0 AS mine, bytes, said FROM k JOIN o ON o.conv_id = k.source AND o.pos <= k.h
  UNION ALL SELECT k.conv_id, o.pos, 1, bytes, said FROM k JOIN o ON o.conv_id = k.conv_id AND o.pos > k.h),
p AS (
  SELECT conv_id, row_number() OVER w AS depth, bytes, string_agg(said, '') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY mine, pos)
  UNION ALL SELECT conv_id, 0, 0, '' FROM k),
z AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ended FROM p),
n AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256
  FROM z GROUP BY depth, prefix),
u AS (SELECT n.*, a.conv_id AS parent_conv_id, a.prefix AS up FROM n LEFT JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN n a ON a.depth = n.depth - 1 AND a.prefix = p.prefix),
c AS (SELECT depth - 1 AS depth, up AS prefix, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY ALL),
v AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN c USING (depth, prefix)),
t AS (
  SELECT p.depth, p.prefix, CAST(sum(v.saved) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves
  FROM v JOIN p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM v JOIN t USING (depth, prefix)
"""
