"""Connected components by alternating large and small stars, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, release


def _min_neighbour(edges: DataFrame, small: bool) -> DataFrame:
    """Link each node's neighbours (small star: only the smaller ones, and itself) to the least of them.

    The least neighbour comes from a grouped aggregation with partial sums, then joins back, so that a node with
    very many neighbours is never one group in memory.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if not small:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(low, "u")
    if small:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for every node of the edge table (a long, b long); the component is its smallest node.

    Null ends and self loops are ignored. Each round is written to the shared folder and the previous one deleted.
    The rounds grow with the logarithm of the longest chain; `most` only guards against a defect and raises.
    """
    cur = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    seen = None
    for _ in range(most):
        nxt = materialize(_min_neighbour(_min_neighbour(cur, False), True), "stars")
        stat = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        release(cur)
        cur = nxt
        if seen == (stat.n, stat.s):
            break
        seen = (stat.n, stat.s)
    else:
        raise RuntimeError("components did not settle")
    star = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.union(cur.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component")))
