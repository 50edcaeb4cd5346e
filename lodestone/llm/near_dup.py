"""MinHash near-duplicates by a signature-coordinate inverted join.

Every distinct shingle set gets a MinHash signature of `k` coordinates and is posted under each (coordinate, value)
pair. Two sets of similarity `j` agree on Binomial(k, j) coordinates, so a pair at the threshold agrees on at least
`t` of them but for a chance of `miss`. From that follows the prefix rule: with postings in one global order, rarest
first, two sets that agree on `t` coordinates share one of the first `c - t + 1` postings of either (`c`: its postings
that anyone shares). Lists outside the prefixes are never merged; a candidate's other coordinates are looked up in its
signature. What passes `t` matches is confirmed on the full shingle sets.

A frequent posting's list is not expanded to pairs. Its members are linked to a hub first; only members that stay in
another component than most of their group are then compared to the group, block by block, and each block returns a
forest of its confirmed links. No pair that could join two components is left out.

Cases: a null text or one without words has an empty set and is linked with nothing. Equal sets (copies, and rows
that repeat a doc_id) are one node. Rows without a doc_id can't name a component: component_id null, kept.
An empty table gives an empty result. Other columns of `docs` are ignored, whatever their names. Texts of any length are
read whole, in ranges of bounded size. Sets hold 64-bit hashes of shingles: two that differ coincide with a chance of 2^-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import SPACED, column, give_back, load, materialize, release, runs, shingles, small, utf8, words
from lodestone.llm.components import components

#: Lists of at most so many members are expanded to pairs; the sides of a block comparison.
PAIRED, BLOCK_R, BLOCK_A = 24, 256, 1024


def least_matches(k: int, j: float, miss: float = 1e-6) -> int:
    """The largest t with P(Binomial(k, j) < t) <= miss."""
    below, t = 0.0, 0
    while t < k and below + comb(k, t) * j**t * (1 - j) ** (k - t) <= miss:
        below += comb(k, t) * j**t * (1 - j) ** (k - t)
        t += 1
    return max(1, t)


def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.Generator(np.random.PCG64(k))
    return g.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), g.integers(0, 2**63, k, dtype=np.uint64)


def _row() -> Column:
    """What tells rows of one doc_id apart: a digest of the text."""
    return F.xxhash64(F.col("text").cast("string"))


def signatures(docs: DataFrame, width: int, k: int, sets: bool = False) -> DataFrame:
    """(doc_id, row, n_shingles, fp, sig) of each row; row digests the text, fp the set. With `sets`, `shingles` instead of sig."""
    mul, add = _coefficients(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(column(batch, "text"))
            ids, texts, row = column(batch, "doc_id"), column(batch, "row"), 0
            for a, b in runs(offs):
                h, at = words(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a], SPACED)
                u, at = shingles(h, at, width)
                size = np.diff(at)
                whole = u.tobytes()
                fp = [hashlib.blake2b(whole[8 * x : 8 * y], digest_size=16).digest() for x, y in zip(at[:-1], at[1:], strict=True)]
                cols = [ids.slice(row, b - a), texts.slice(row, b - a), pa.array(size), pa.array(fp, pa.binary())]
                if sets:
                    cols.append(pa.array([whole[8 * x : 8 * y] for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary()))
                else:
                    full = np.flatnonzero(size)
                    sig = np.zeros((b - a, k), np.int32)
                    if len(full):
                        for i in range(k):
                            v = ((u * mul[i] + add[i]) >> np.uint64(32)).astype(np.uint32)
                            sig[full, i] = np.minimum.reduceat(v, at[full]).view(np.int32)
                    lengths = np.where(size > 0, k, 0)
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(sig[full].ravel())))
                row += b - a
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "n_shingles", "fp", "shingles" if sets else "sig"])
        give_back()

    kind = "shingles binary" if sets else "sig array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row().alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, row long, n_shingles long, fp binary, {kind}")


def _prefixes(nodes: DataFrame, t: int) -> DataFrame:
    """(key, node, c): the postings of each node's prefix, of lists that more than one node's prefix has."""
    key = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("col").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    posts = nodes.select("node", F.posexplode("sig")).select("node", key.alias("key"))
    shared = posts.withColumn("cnt", F.count("*").over(W.partitionBy("key"))).filter("cnt > 1")
    own = W.partitionBy("node")
    ranked = shared.withColumn("c", F.count("*").over(own)).filter(F.col("c") >= t).withColumn("rn", F.row_number().over(own.orderBy("cnt", "key")))
    first = ranked.filter(F.col("rn") <= F.col("c") - t + 1).select("key", "node", "c")
    return first.withColumn("m", F.count("*").over(W.partitionBy("key"))).filter("m > 1")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, held = [], None, np.zeros(0, np.uint64)
            for i, (x, y) in enumerate(zip(column(batch, "sa").to_pylist(), column(batch, "sb").to_pylist(), strict=True)):
                if x is not last and x != last:
                    last, held = x, np.frombuffer(x, np.uint64)
                other = np.frombuffer(y, np.uint64)
                small_, large = (held, other) if len(held) < len(other) else (other, held)
                if 100 * len(small_) < percent * len(large):
                    continue
                at = np.searchsorted(large, small_)
                both = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small_))
                if 100 * both >= percent * (len(small_) + len(large) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
        give_back()

    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _forest(percent: int, t: int):
    """Compare block sides: rows of side 0 to all of side 1 in other components; the confirmed links, as a forest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        root = {c: c for c in pdf.comp}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        rs = np.stack([np.asarray(x, np.int32) for x in right.sig]) if len(right) else None
        rsets = [frozenset(np.frombuffer(x, np.uint64).tolist()) for x in right.shingles]
        rn, links = np.array([len(x) for x in rsets]), []
        rnode, rcomp = right.node.to_numpy(), right.comp.to_numpy()
        for node, comp, sig, s in zip(left.node, left.comp, left.sig, left.shingles, strict=True):
            own = frozenset(np.frombuffer(s, np.uint64).tolist())
            n = len(own)
            close = (rs == np.asarray(sig, np.int32)).sum(1) >= t
            close &= (100 * np.minimum(rn, n) >= percent * np.maximum(rn, n)) & (rcomp != comp)
            for i in np.flatnonzero(close):
                if find(comp) == find(rcomp[i]):
                    continue
                both = len(own & rsets[i])
                if 100 * both >= percent * (n + int(rn[i]) - both):
                    root[find(comp)] = find(rcomp[i])
                    links.append((int(node), int(rnode[i])))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _labelled(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, comp) for every row of `nodes`, and the star table to release."""
    stars = materialize(components(links), "comp")
    return nodes.join(stars, "node", "left").select(*nodes.columns, F.coalesce("component", "node").alias("comp")), stars


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = 64, miss: float = 1e-6, rows: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs` (doc_id, text); see the module. With `rows` also
    `row`, a digest of the text that tells rows of one doc_id apart."""
    t = least_matches(k, percent / 100, miss)
    signed = materialize(signatures(docs, width, k), "signatures")
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    # A set is named by its least doc_id, or by its digest where rows of one doc_id have different sets.
    torn = materialize(full.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select(F.col("doc_id").alias("doc"), F.lit(True).alias("torn")), "torn")
    own_name = -1 - F.pmod(F.xxhash64("fp"), F.lit(1 << 62))
    nodes = full.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.any_value("sig").alias("sig")).join(small(torn), "doc", "left")
    nodes = materialize(nodes.select("fp", "doc", F.when(F.col("torn"), own_name).otherwise(F.col("doc")).alias("node"), "sig"), "nodes")
    sigs = nodes.select("node", "sig")
    posts = materialize(_prefixes(sigs, t), "postings")

    hub = F.max(F.struct("c", (-F.col("node")).alias("neg"))).over(W.partitionBy("key"))
    star = posts.withColumn("hub", -hub["neg"]).filter("hub <> node").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    few = posts.filter(F.col("m") <= PAIRED)
    full = few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")), "key").filter("a < b").select("a", "b")
    met = star.union(full).groupBy("a", "b").agg(F.count("*").alias("met"))
    met = met.join(sigs.toDF("a", "x"), "a").join(sigs.toDF("b", "y"), "b")
    agree = F.aggregate(F.zip_with("x", "y", lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    pairs = materialize(met.withColumn("agree", agree).filter(F.col("agree") >= t).select("a", "b", "agree"), "pairs")

    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(posts.filter(F.col("m") > PAIRED).select("node")).distinct()
    ends_ = materialize(ends, "ends")
    wanted = materialize(small(ends_).join(nodes.select("node", "fp", "doc"), "node"), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(wanted.select(F.col("doc").alias("doc_id")).distinct()), "doc_id")
    whole = signatures(texts, width, k, sets=True).filter("n_shingles > 0").select("doc_id", "fp", "shingles")
    # Rows that repeat both the doc_id and the text would come twice.
    sets = materialize(whole.join(small(wanted.withColumnRenamed("doc", "doc_id")), ["doc_id", "fp"]).select("node", "shingles"), "sets")

    # First each node with the partner it agrees with most, then every other pair across components.
    either = pairs.select(F.col("a").alias("node"), "a", "b", "agree").union(pairs.select(F.col("b").alias("node"), "a", "b", "agree"))
    best = either.groupBy("node").agg(F.max(F.struct("agree", (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"))).alias("p")).select((-F.col("p.na")).alias("a"), (-F.col("p.nb")).alias("b")).distinct()
    links = [materialize(_confirm(best, sets, percent), "links")]
    stars = materialize(components(links[0]), "comp")
    rest = pairs.join(stars.toDF("a", "ca"), "a", "left").join(stars.toDF("b", "cb"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).join(best, ["a", "b"], "left_anti")
    links.append(materialize(_confirm(rest, sets, percent), "links"))
    release(stars, pairs)

    hot = materialize(posts.filter(F.col("m") > PAIRED).select("key", "node"), "hot")
    if not hot.isEmpty():
        first = hot.withColumn("root", F.min("node").over(W.partitionBy("key"))).select(F.col("node").alias("a"), F.col("root").alias("b"))
        loose = materialize(components(first), "loose").withColumnRenamed("component", "family")
        of, stars = _labelled(loose, links[0].union(links[1]))
        share = of.groupBy("family", "comp").agg(F.count("*").alias("n"))
        most = share.groupBy("family").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("m")).filter(F.col("m") > F.col("top.n"))
        most = most.select("family", F.col("top.comp").alias("top"), F.ceil((F.col("m") - F.col("top.n")) / BLOCK_R).cast("int").alias("nr"), F.ceil(F.col("m") / BLOCK_A).cast("int").alias("na"))
        member = of.join(most, "family").join(sigs, "node").join(sets, "node")
        where = F.xxhash64("node")
        shape = ["family", "node", "comp", "sig", "shingles"]
        left = member.filter(F.col("comp") != F.col("top")).select(*shape, F.lit(0).alias("side"), F.pmod(where, "nr").cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("ab"))
        right = member.select(*shape, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("rb"), F.pmod(where, "na").cast("int").alias("ab"))
        links.append(materialize(left.union(right).groupBy("family", "rb", "ab").applyInPandas(_forest(percent, t), "a long, b long"), "links"))
        release(stars)

    every = links[0].union(links[1])
    for more in links[2:]:
        every = every.union(more)
    named, _ = _labelled(nodes.select("fp", "node", "doc"), every)
    if not torn.isEmpty():
        least = named.groupBy("comp").agg(F.min("doc").alias("least"))
        named = named.join(least, "comp").select("fp", F.col("least").alias("comp"))
    release(posts, hot, sets, wanted, ends_)
    out = signed.select("doc_id", "row", "n_shingles", "fp").join(named.select("fp", "comp"), "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    own = ["doc_id", "row"] if rows else ["doc_id"]
    return out.select(*own, "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that are the first of their near-duplicates, with all their columns.

    Each row of a doc_id that repeats is decided on its own text; rows that repeat both are one document and stay or go together.
    """
    gone = materialize(near_duplicates(docs, width, percent, rows=True).filter("not kept").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct(), "gone")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col("doc_id").cast("long").alias("i"), _row().alias("r"))
    return own.join(small(gone), (F.col("i") == F.col("_id")) & F.col("r").eqNullSafe(F.col("_row")), "left_anti").select("d.*")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), width=3, percent=85)


#: All pairs that share a shingle, and the least id reachable.
OP9_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + 2), ' ')) AS g FROM w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id, coalesce(m.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON w.doc_id = m.a
"""
