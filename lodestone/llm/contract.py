"""Subtree totals of a forest by parallel tree contraction, as DataFrame jobs.

Each round rakes and compresses. Rake: a node without children has its total; it is recorded, and its parent takes the sum
over such children. Compress: of the nodes with one child an independent set is spliced out, each leaving its child, with what it
held as a load on the way up, to its parent, and a record (node, child, what it held and what the child already carried). When
nothing is left, the records are expanded from the last round to the first: a node's total is its record's and its child's.

A node keeps the number of its children and the xor of their ids, so that the one child of an unary node is known without a
look. All joins are on ids that are unique on both sides or were grouped before, so a parent of very many nodes is never a
hot key. Rounds grow with the logarithm of the nodes. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, release


def subtree_totals(nodes: DataFrame, values: list[str], most: int = 200) -> DataFrame:
    """(id, *values): for every node the sums over its subtree, itself included.

    nodes: id long (unique), parent long (null: a root), level long (a child's is one more than its parent's), and the
    values, whole numbers, null counting as 0. `most` rounds only guard against a defect (or a cycle, which has no leaf) and raise.
    """
    own = [F.coalesce(F.col(v).cast("long"), F.lit(0)).alias(v) for v in values]
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"), F.bit_xor("id").alias("kid"))
    start = nodes.select("id", "parent", "level", *own).join(kids, "id", "left")
    fresh = {"n": zero("n"), "kid": zero("kid"), "age": F.lit(0), "awaited": F.lit(False), "over": F.lit(None).cast("long")}
    live = materialize(start.withColumns(fresh | {f"{k}_{v}": F.lit(0).cast("long") for k in ("up", "over") for v in values}), "live")
    rounds = []
    for _ in range(most):
        if live.isEmpty():
            break
        rounds.append(live)
        leaves = live.filter("n = 0 and parent is not null")
        given = leaves.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("_n"), F.bit_xor("id").alias("_kid"), *[F.sum(F.col(v) + F.col(f"up_{v}")).alias(f"_{v}") for v in values])
        rest = live.filter("n > 0").join(given, "id", "left").withColumns({"n": F.col("n") - zero("_n"), "kid": F.col("kid").bitwiseXOR(zero("_kid")), **{v: F.col(v) + zero(f"_{v}") for v in values}})
        # A chain's neighbours differ in a bit of their level: first in the lowest, then, every other one gone, in the next.
        rest = rest.withColumn("age", F.when(F.col("n") == 1, F.col("age") + 1).otherwise(0))
        rest = materialize(rest.select("id", "parent", "level", *values, "n", "kid", "age", "awaited", *[f"up_{v}" for v in values]), "rest")
        picks = rest.filter("n = 1").filter(F.getbit("level", F.pmod(F.col("age") - 1, F.lit(63)).cast("int")) == 1)
        picks = materialize(picks.join(picks.select(F.col("kid").alias("id")), "id", "left_anti"), "picks")
        heirs = picks.select(F.col("kid").alias("id"), F.col("id").alias("over"), F.col("parent").alias("_parent"), *[F.col(c).alias(f"_{c}") for v in values for c in (v, f"up_{v}")])
        swaps = picks.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.bit_xor(F.col("id").bitwiseXOR(F.col("kid"))).alias("_swap"))
        left = rest.join(picks.select("id"), "id", "left_anti").join(heirs, "id", "left").join(swaps, "id", "left")
        heir = F.col("over").isNotNull()
        live = materialize(
            left.select(
                "id", F.when(heir, F.col("_parent")).otherwise(F.col("parent")).alias("parent"), "level", *values, "n", F.col("kid").bitwiseXOR(zero("_swap")).alias("kid"), "age", (F.col("awaited") | heir).alias("awaited"),
                "over", *[(F.col(f"up_{v}") + zero(f"_{v}") + zero(f"_up_{v}")).alias(f"up_{v}") for v in values], *[(F.col(f"_{v}") + F.col(f"up_{v}")).alias(f"over_{v}") for v in values],
            ),
            "live",
        )
        release(rest, picks)
    else:
        raise RuntimeError("the forest did not contract: does it have a cycle?")

    total = nodes.select("id", *own).limit(0)
    waited = total
    for r in rounds:
        total = total.union(r.filter("n = 0").select("id", *values))
        waited = waited.union(r.filter("n = 0 and awaited").select("id", *values))
    for r in reversed(rounds):
        out = r.filter("over is not null")
        if out.isEmpty():
            continue
        below = waited.select("id", *[F.col(v).alias(f"_{v}") for v in values])
        grown = materialize(out.join(below, "id").select(F.col("over").alias("id"), *[(F.col(f"over_{v}") + F.col(f"_{v}")).alias(v) for v in values]), "grown")
        total, waited = total.union(grown), waited.union(grown)
    return total
