"""Sharding in Hilbert-curve order, with DataFrame functions only.

Each row's metadata is quantised to a small integer for each of three dimensions, and the cell's index on the
three-dimensional Hilbert curve orders the rows: neighbours on the curve are neighbours in all dimensions, so a file
of consecutive rows spans a narrow range of each, and min/max statistics prune it for filters on any of them. Runs of
the order are cut into shards by the law `rows`: shard counts are at most one apart.

The exact rank needs no global sort. Rows are counted by (cell, tie bucket), tie being a hash of the row; offsets come
from running sums over cells and over the buckets of each cell, both bounded by parameters, not by the data; within a
bucket rows are numbered by hash, then id, then checksum. A cell that holds a third of all rows is spread over all of
its tie buckets.

Cases: a null text has no bytes (size 8, checksum 0). Null metadata is quantised as the least value. Equal rows are
interchangeable: each gets a slot of its own. An empty table gives no rows. Other columns may have any names. Texts of any
length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import load, materialize

#: Bits for each dimension (three), and tie buckets for each cell.
BITS, TIES = 4, 256


def hilbert3(x: Column, y: Column, z: Column, bits: int = BITS) -> Column:
    """Index on the 3-dimensional Hilbert curve of a cell whose coordinates are below 2**bits.

    From the top bit down, the corner in which the cell lies is turned into the frame of the current sub-cube (entry
    corner e, direction d), its place along the Gray code is the next octal digit, and the frame follows.
    """
    at = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i + 1)
    gray_place = [0, 1, 3, 2, 7, 6, 4, 5]  # place of a corner along the Gray code
    entry = [0, 0, 0, 3, 3, 6, 6, 5]  # corner at which each place's sub-cube is entered
    turn = [0, 1, 1, 2, 2, 1, 1, 0]  # direction in which it is crossed
    rotate = lambda v, k: F.shiftrightunsigned(v, k).bitwiseOR(F.shiftleft(v, (3 - k) % 3)).bitwiseAND(F.lit(7))
    by_d = lambda d, f: F.when(d == 0, f(0)).when(d == 1, f(1)).otherwise(f(2))

    def step(s: Column, i: Column) -> Column:
        bit = lambda c: F.getbit(c, i).cast("int")
        corner = F.shiftleft(bit(x), 2).bitwiseOR(F.shiftleft(bit(y), 1)).bitwiseOR(bit(z))
        local = corner.bitwiseXOR(s["e"])
        place = at(gray_place, by_d(s["d"], lambda d: rotate(local, (d + 1) % 3)))
        enter = at(entry, place)
        e = s["e"].bitwiseXOR(by_d(s["d"], lambda d: rotate(enter, (2 - d) % 3)))
        d = F.pmod(s["d"] + at(turn, place) + 1, F.lit(3)).cast("int")
        return F.struct((s["h"] * 8 + place).cast("int").alias("h"), e.cast("int").alias("e"), d.alias("d"))

    start = F.struct(F.lit(0).alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(bits - 1, -1, -1)]), start, step)["h"]


def _edges(rows: DataFrame, keys: dict[str, Column], bins: int) -> dict[str, list]:
    """Cut points of each dimension: approximate quantiles over all rows (one aggregate row, `bins` - 1 numbers each)."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    got = rows.agg(*[F.percentile_approx(c, shares, F.lit(10_000)).alias(name) for name, c in keys.items()]).first()
    return {name: sorted(got[name] or []) for name in keys}  # repeats kept: a frequent value spans several bins


def prefix_number(c: Column, chars: int = 6) -> Column:
    """A number that orders strings as their first bytes do."""
    return F.conv(F.rpad(F.substring(F.hex(F.encode(c, "utf-8")), 1, 2 * chars), 2 * chars, "0"), 16, 10).cast("bigint")


def hilbert_shards(rows: DataFrame, dimensions: dict[str, Column], shards: int, unique: list[str]) -> DataFrame:
    """`rows` with hilbert, shard and slot. dimensions: three names and numeric columns; unique: columns that break ties."""
    if len(dimensions) != 3:
        raise ValueError("three dimensions")
    names = list(dimensions)
    bins = 1 << BITS
    edges = _edges(rows, dimensions, bins)
    place = lambda c, cut: F.coalesce(sum((F.when(c > v, 1).otherwise(0) for v in cut), F.lit(0)), F.lit(0)).cast("int")
    own = rows.columns
    put = rows.withColumns({f"_{n}": place(dimensions[n], edges[n]) for n in names})
    put = put.withColumn("hilbert", hilbert3(*[F.col(f"_{n}") for n in names])).withColumn("_tie", F.xxhash64(*unique))
    put = materialize(put.withColumn("_bucket", F.pmod("_tie", F.lit(TIES)).cast("int")).select(*own, "hilbert", "_tie", "_bucket"), "cells")

    buckets = materialize(put.groupBy("hilbert", "_bucket").agg(F.count("*").alias("n")), "buckets")
    cells = buckets.groupBy("hilbert").agg(F.sum("n").alias("n"))
    upto = W.orderBy("hilbert").rowsBetween(W.unboundedPreceding, -1)  # at most 8**BITS rows
    cells = cells.withColumn("cell_at", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("total", F.sum("n").over(W.partitionBy()))
    within = W.partitionBy("hilbert").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)  # at most TIES rows
    starts = buckets.withColumn("bucket_at", F.coalesce(F.sum("n").over(within), F.lit(0))).drop("n")
    starts = starts.join(F.broadcast(cells.drop("n")), "hilbert").select("hilbert", "_bucket", (F.col("cell_at") + F.col("bucket_at")).alias("at"), "total")

    number = F.row_number().over(W.partitionBy("hilbert", "_bucket").orderBy("_tie", *unique)) - 1
    ranked = put.withColumn("_n", number).join(starts, ["hilbert", "_bucket"]).withColumn("rank", F.col("at") + F.col("_n"))
    shard = F.floor(F.col("rank") * shards / F.col("total")).cast("int")
    # Guard the division's rounding with whole numbers: shard s holds ranks from ceil(s * total / shards) on.
    first = lambda s: F.expr(f"({s} * total + {shards - 1}) div {shards}")
    cut = ranked.withColumn("_s", shard)
    cut = cut.withColumn("shard", (F.col("_s") + F.when(F.col("rank") < first("_s"), -1).when(F.col("rank") >= first("(_s + 1)"), 1).otherwise(0)).cast("int"))
    return cut.select(*own, "hilbert", "shard", (F.col("rank") - first("cast(shard as bigint)")).cast("long").alias("slot"))


def _metadata(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = lambda c: prefix_number(F.col(c).cast("string"))
    return docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), key("lang").alias("_l"), key("source").alias("_s0"), *more)


def _placed(rows: DataFrame, shards: int) -> DataFrame:
    return hilbert_shards(rows, {"lang": F.col("_l"), "source": F.col("_s0"), "length": F.col("size")}, shards, ["doc_id", "text_crc32", "size"])


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert, by the dimensions lang, source and text length."""
    out = _placed(materialize(_metadata(docs), "metadata"), shards)  # narrow rows: the texts are read once
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def write_shards(docs: DataFrame, path: str, shards: int = 24, files: int = 1) -> None:
    """Write `docs` as one Parquet folder for each shard, a row for each row, each file sorted by slot.

    A shard is cut into `files` runs of its slots or a few more, dealt by ranges of (shard, slot), so that a shard of any
    size is written by as many tasks. The folders are those of the partition column `shard`, and `slot` is a column; columns
    of `docs` with these names, in any case, are written as `own_shard` and `own_slot`.
    """
    own = [F.col(f"`{c}`").alias(f"own_{c}" if c.lower() in ("shard", "slot") else c) for c in docs.columns]
    put = _placed(_metadata(docs, F.struct(*own).alias("_own")), shards)
    put.select("_own.*", "shard", "slot").repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(load(spark, sf_dir, "documents"))
