"""Cumulative-snapshot collapse of logged conversations, with DataFrame functions only.

A chat client that logs the whole conversation after each turn leaves snapshots that prefix one another. A rolling hash
over (position, role, text) gives every conversation the hashes of all its turn prefixes; a conversation whose whole
hash is a proper prefix of another is dropped by an anti-join, and of equal conversations the least conv_id stays.
What is left is rendered.

The rolling hash is the running xor of two 64-bit hashes of each turn with its position, so it takes one window over
each conversation and needs no sequential state; prefix hashes are made distinct with partial aggregation before the
anti-join, so that a first turn that very many conversations share is one row.

Cases: turns are ordered by turn, then role, then text; repeated rows are turns of their own. Null roles and texts are
hashed as such and rendered empty. Rows without a conv_id are one conversation without id. An empty table gives no rows.
Texts of any length are hashed and rendered whole. Other columns are ignored, whatever their names. Texts aren't compared:
two different prefixes of as many turns have equal hashes with a chance of about 2^-128.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import load

#: How a turn is rendered: the role's line, the text, the end mark.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, pos, h1, h2): each turn with its position from 1 and the hash of the prefix it ends."""
    own = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.select("conv_id", "turn", "role", "text", F.row_number().over(own).alias("pos"))
    rolling = W.partitionBy("conv_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    blank = lambda c: [F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(c).isNull()]
    key = [F.col("pos"), *blank("role"), *blank("text")]
    h1, h2 = F.xxhash64(F.lit(1), *key), F.xxhash64(F.lit(2), *key[::-1])
    return placed.withColumn("t1", h1).withColumn("t2", h2).withColumn("h1", F.bit_xor("t1").over(rolling)).withColumn("h2", F.bit_xor("t2").over(rolling)).drop("t1", "t2")


def collapse(turns: DataFrame) -> DataFrame:
    """The maximal conversations: conv_id, n_turns, n_copies (conversations that equal it, itself included), rendered."""
    pre = turn_prefixes(turns).withColumn("n", F.max("pos").over(W.partitionBy("conv_id")))
    whole = pre.filter("pos = n").select("conv_id", "n", "h1", "h2")
    proper = pre.filter("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    same = ["n", "h1", "h2"]
    least = F.min("conv_id").alias("conv_id")
    kept = whole.groupBy(*same).agg(least, F.count("*").alias("n_copies")).join(proper, same, "left_anti")
    said = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit(MIDDLE), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    marked = kept.select(F.col("conv_id").alias("_id"), "n_copies")
    lines = pre.select("conv_id", "pos", said.alias("said")).join(marked, F.col("conv_id").eqNullSafe(F.col("_id")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"])
    return lines.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_join(ordered, "").alias("rendered"))


def op8_chat_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(load(spark, sf_dir, "conversations"))


#: Whole prefixes instead of hashes.
OP8_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
    '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS said
  FROM conversations),
p AS (
  SELECT conv_id, pos, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS prefix,
    count(*) OVER (PARTITION BY conv_id) AS n FROM t),
w AS (SELECT n, prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE pos = n GROUP BY n, prefix)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, CAST(n_copies AS BIGINT) AS n_copies, prefix AS rendered
FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = w.n AND p.prefix = w.prefix)
"""
