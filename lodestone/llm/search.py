"""Exact ranked lexical search: best-first descent of sparse ball trees, whole numbers at the leaves.

1. One pass over the texts keeps, of each document, its number of terms and the terms that any item has, with their
   frequencies. Document counts and frequencies are grouped aggregations over all rows.
2. Each task gathers its documents into blocks, and each block into a tree of balls: a node has a centre and, for each of
   several hundred groups of terms, a radius, the greatest distance of its documents from the centre within the group. A term
   that only one item has is in the item's group, others are dealt over groups of their own, so an item meets few radii.
   By Cauchy and Schwarz no document of the node scores above q.c + sum(|q_g| * r_g). Radii and bounds are rounded up by
   more than the error of their doubles.
3. An item descends from the node of the highest bound on, and stops where no bound reaches its k-th best document so far.
   Documents of a leaf are scored in 64-bit integers. The k-th best starts from the best of a sample of about 32*sqrt(N)
   documents: the sample prunes and decides nothing. So about sqrt(N)/3 documents an item leave the tasks, and are ranked.

Terms meet as 64-bit hashes: two differ but meet with a chance of about 1e-19 for each pair. Items are taken in parts of
at most TERMS terms, which tasks hold; each part reads the documents again.

Cases: a null or empty text has no terms; such a document is in no count, such an item has no rows. Rows that repeat a
doc_id are documents of their own (null ids rank first among equal scores), rows that repeat an item_id are items of their
own. An empty table gives no rows. Texts of any length are read whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestone.llm.common import ALNUM, column, give_back, load, runs, utf8, words
from lodestone.storage import materialize

#: Terms of the items of one part.
TERMS = 4_000_000
#: A block of a tree: documents and terms at most (one document may have more); documents of a leaf; coordinates of a centre.
DOCS, ENTRIES, LEAF, CENTRE = 8_192, 4_000_000, 32, 256
#: Groups of terms that one item has, and of terms that several have.
OWN, SHARED = 256, 512
#: Scale of weights, and of a term's saturated frequency.
SCALE, SATURATED = 1_000, 1_000_000_000


def _terms(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, terms, times): each text's number of terms, its distinct terms and how often each occurs."""
    rows = rows.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    out = StructType([rows.schema["key"], *StructType.fromDDL("n long, terms array<long>").fields])
    arrow = to_arrow_schema(out)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(column(batch, "text"))
            for a, b in runs(at):
                h, ends = words(raw[at[a] : at[b]], at[a : b + 1] - at[a], ALNUM)
                got = [np.unique(h[x:y].view(np.int64)) for x, y in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([column(batch, "key").slice(a, b - a), pa.array(np.diff(ends)), pa.array(got, pa.list_(pa.int64()))], schema=arrow)

    return rows.mapInArrow(cut, out)


def _known(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(key, n, terms, times): of each document the terms of the vocabulary (sorted hashes), as places in it."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").alias("key"), F.col("text").cast("string").alias("text"))
    out = StructType([rows.schema["key"], *StructType.fromDDL("n long, terms array<int>, times array<int>").fields])
    arrow, held = to_arrow_schema(out), spark.sparkContext.broadcast(vocabulary)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        top = np.uint64(44)
        maybe = np.zeros(1 << 20, bool)
        maybe[known >> top] = True
        for batch in batches:
            raw, at = utf8(column(batch, "text"))
            for a, b in runs(at):
                h, ends = words(raw[at[a] : at[b]], at[a : b + 1] - at[a], ALNUM)
                hit = np.flatnonzero(maybe[h >> top])
                place = np.minimum(np.searchsorted(known, h[hit]), len(known) - 1)
                hit, place = hit[(same := known[place] == h[hit])], place[same]
                row = np.searchsorted(ends, hit, "right") - 1
                pair, times = np.unique(row * len(known) + place, return_counts=True)
                row, place = np.divmod(pair, len(known))
                offsets = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (place, times)]
                yield pa.RecordBatch.from_arrays([column(batch, "key").slice(a, b - a), pa.array(np.diff(ends)), *lists], schema=arrow)
        give_back()

    return rows.mapInArrow(cut, out)


class Items:
    """The items of one part: terms as places in the vocabulary, the terms' weights and groups."""

    def __init__(self, terms: list[np.ndarray], weights: np.ndarray):
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
        self.terms = np.concatenate(terms) if terms else np.zeros(0, np.int64)
        self.weights = weights
        of = np.repeat(np.arange(len(terms)), np.diff(self.at))
        shared = np.bincount(self.terms, minlength=len(weights)) > 1
        self.group = OWN + np.arange(len(weights)) % SHARED
        alone = ~shared[self.terms]
        self.group[self.terms[alone]] = of[alone] % OWN
        self.of, self.root = of, np.sqrt(weights)
        # Norms of each item's query in each group that it meets.
        pair, inverse = np.unique(of * (OWN + SHARED) + self.group[self.terms], return_inverse=True)
        self.norm_of, self.norm_group = np.divmod(pair, OWN + SHARED)
        self.norm = np.sqrt(np.bincount(inverse, weights[self.terms].astype(float), minlength=len(pair)))

    def __len__(self) -> int:
        return len(self.at) - 1


class Tree:
    """A tree of balls over documents, given as rows of sorted terms with exact values. Coordinates are root of weight times value."""

    def __init__(self, ends: np.ndarray, terms: np.ndarray, values: np.ndarray, items: Items):
        self.items, self.nodes, self.rows = items, [], []
        self.local, self.compact = np.unique(terms, return_inverse=True)
        self.groups, self.group = np.unique(items.group[self.local], return_inverse=True)
        self.ends, self.terms, self.values = ends, terms, values
        self.x = values * items.root[terms]
        self.scratch = np.zeros(len(self.local))
        self._grow(np.arange(len(ends) - 1))

    def _take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows' entries, and where each row begins among them."""
        size = self.ends[rows + 1] - self.ends[rows]
        begin = np.concatenate([[0], np.cumsum(size)])
        return np.repeat(self.ends[rows] - begin[:-1], size) + np.arange(begin[-1]), begin

    def _grow(self, rows: np.ndarray) -> int:
        """Add the node of these rows and those below it; its number."""
        at, begin = self._take(rows)
        t, x, n, g = self.compact[at], self.x[at], len(rows), len(self.groups)
        if len(t) < len(self.local):
            own, t = np.unique(t, return_inverse=True)
        else:
            own = np.arange(len(self.local))
        centre = np.bincount(t, x, minlength=len(own)) / n
        if len(own) > CENTRE:
            centre[np.argpartition(centre, -CENTRE)[:-CENTRE]] = 0
        group = self.group[own]
        square = np.bincount(group, centre**2, minlength=g)
        row = np.repeat(np.arange(n), np.diff(begin))
        near = centre[t]
        away = np.bincount(row * g + group[t], (x - near) ** 2 - near**2, minlength=n * g).reshape(n, g) + square
        size = np.sqrt(np.maximum(away.max(0), 0) + 1e-10 * (square + np.bincount(group[t], x**2, minlength=g))) * (1 + 1e-9)
        far = away.sum(1)
        number = len(self.nodes)
        kept = np.flatnonzero(centre)
        self.nodes.append([self.local[own[kept]], centre[kept], size, -1, -1])
        self.rows.append(rows)
        if n > LEAF and far.max() > 1e-9 * (x**2).sum() / n:

            def from_pivot(i: int) -> np.ndarray:
                dense = np.zeros(len(own))
                dense[t[begin[i] : begin[i + 1]]] = x[begin[i] : begin[i + 1]]
                return np.add.reduceat((x - dense[t]) ** 2 - dense[t] ** 2, begin[:-1]) + (dense**2).sum()

            one = from_pivot(int(far.argmax()))
            other = from_pivot(int(one.argmax()))
            order = np.argsort(other - one, kind="stable")  # halves, so that depth is the logarithm
            self.nodes[number][3:] = [self._grow(rows[order[: n // 2]]), self._grow(rows[order[n // 2 :]])]
            self.rows[number] = None
        return number

    def bounds(self, node: int) -> np.ndarray:
        """For every item, a number that no document of the node scores above."""
        items, (terms, centre, size, *_) = self.items, self.nodes[node]
        dense = np.zeros(len(items.weights)) if len(items.weights) < 50_000 else self.__dict__.setdefault("wide", np.zeros(len(items.weights)))
        dense[terms] = centre * items.root[terms]
        radius = np.zeros(OWN + SHARED)
        radius[self.groups] = size
        out = np.bincount(items.of, dense[items.terms], minlength=len(items)) + np.bincount(items.norm_of, items.norm * radius[items.norm_group], minlength=len(items))
        dense[terms] = 0
        return out * (1 + 1e-9) + 1

    def leaf(self, node: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The node's rows and their scores, exactly."""
        at, begin = self._take(self.rows[node])
        return self.rows[node], np.add.reduceat(weight[self.terms[at]] * self.values[at], begin[:-1])


def descend(tree: Tree, best: list[list[tuple]], k: int, keys: list[tuple]) -> int:
    """Better an item's k best (heaps of (score, key, 1)) by the tree's documents; keys: the higher, the better among equals. Number of leaves met."""
    items, known, met = tree.items, {0: tree.bounds(0)}, 0
    weight = np.zeros(len(items.weights), np.int64)
    for i in np.flatnonzero(known[0] > 1):  # a bound is at least 1 above
        top, own = best[i], items.terms[items.at[i] : items.at[i + 1]]
        weight[own] = items.weights[own]
        heap = [(-known[0][i], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if len(top) == k and -bound < top[0][0]:
                break
            left, right = tree.nodes[node][3:]
            if left < 0:
                met += 1
                rows, scores = tree.leaf(node, weight)
                least = max(top[0][0], 1) if len(top) == k else 1
                for j in np.flatnonzero(scores >= least):
                    one = (int(scores[j]), keys[rows[j]], 1)
                    if len(top) < k:
                        heapq.heappush(top, one)
                    elif one > top[0]:
                        heapq.heapreplace(top, one)
                continue
            for child in (left, right):
                if child not in known:
                    known[child] = tree.bounds(child)
                heapq.heappush(heap, (-known[child][i], child))
        weight[own] = 0
    return met


def _search(rows: DataFrame, items: Items, n_docs: int, n_terms: int, k: int, floor: list[tuple] | None) -> DataFrame:
    """(item, score, doc_id): of each task the k best of every item that reach its floor."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast((items, floor))
    out = StructType([*StructType.fromDDL("item int, score long").fields, rows.schema["key"]])
    arrow = to_arrow_schema(out)

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, floor = held.value
        # The floor is the sample's k-th best: what is below it isn't among the k best. Its marks give way to the document itself.
        top: list[list[tuple]] = [[(*f, 0)] * k if f else [] for f in floor] if floor else [[] for _ in range(len(items))]
        for batch in batches:
            n, (terms, times) = column(batch, "n").to_numpy(), (column(batch, c) for c in ("terms", "times"))
            ends = terms.offsets.to_numpy().astype(np.int64)
            terms, times = (c.values.to_numpy() for c in (terms, times))
            ids = column(batch, "key")
            a = 0
            while a < batch.num_rows:
                b = min(batch.num_rows, a + DOCS, max(a + 1, int(np.searchsorted(ends, ends[a] + ENTRIES, "right")) - 1))
                own = np.arange(ends[a], ends[b])
                own = own[items.weights[terms[own]] > 0]
                row = np.searchsorted(ends, own, "right") - 1
                used, first = np.unique(row, return_index=True)
                if len(used):
                    tf, m = times[own].astype(np.int64), 100 - 90 + (90 * n[row] * n_docs) // n_terms
                    value = (SATURATED * tf) // (1_000 * tf + 8 * m)
                    keys = [(v is None, 0 if v is None else -v) for v in ids.take(pa.array(used)).to_pylist()]
                    descend(Tree(np.append(first, len(own)), terms[own].astype(np.int64), value, items), top, k, keys)
                a = b
        found = [(i, e[0], None if e[1][0] else -e[1][1]) for i, heap in enumerate(top) for e in heap if e[2]]
        made = [[f[c] for f in found] for c in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(made, arrow, strict=True)], schema=arrow)
        give_back()

    return rows.mapInArrow(best, out)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest score above 0 of each item."""
    spark = docs.sparkSession
    asked = materialize(_terms(items, "item_id").filter("n > 0"), "items")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    parts = -(-total // TERMS)
    part = F.pmod(F.xxhash64("terms"), F.lit(max(parts, 1)))
    out = None
    for p in range(parts):
        got = asked.filter(part == p).select("key", "terms").toArrow()  # at most about TERMS terms
        ids, each = got.column("key"), [np.asarray(t, np.int64).view(np.uint64) for t in got.column("terms").to_pylist()]
        vocabulary = np.unique(np.concatenate(each))
        known = materialize(_known(docs, vocabulary), "known")
        sums = known.filter("n > 0").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_terms")).first()
        if not sums.n_docs:
            continue
        frequency = dict(known.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect())  # at most TERMS rows
        weights = np.array([math.floor(SCALE * math.log((2 * sums.n_docs + 2) / (2 * frequency.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
        own = Items([np.searchsorted(vocabulary, t) for t in each], weights)
        held = known.filter(F.size("terms") > 0)
        share = int(sums.n_docs**0.5 / 32)
        floor = None
        order = [F.desc("score"), F.col("key").asc_nulls_first()]
        place = F.row_number().over(W.partitionBy("item").orderBy(*order))
        if share > 1:
            sample = held.filter(F.pmod(F.xxhash64("key", "n"), F.lit(share)) == 0)
            last = _search(sample, own, sums.n_docs, sums.n_terms, k, None).withColumn("rank", place).filter(F.col("rank") == k).collect()  # a row an item
            floor = [None] * len(own)
            for r in last:
                floor[r.item] = (r.score, (r.key is None, 0 if r.key is None else -r.key))
        found = _search(held, own, sums.n_docs, sums.n_terms, k, floor).withColumn("rank", place).filter(F.col("rank") <= k)
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(own)), pa.int32()), "item_id": ids}))
        ranked = found.join(F.broadcast(names), "item").select("item_id", "rank", F.col("key").alias("doc_id"), "score")
        out = ranked if out is None else out.union(ranked)
    if out is None:
        out = spark.createDataFrame([], StructType([items.schema["item_id"], *StructType.fromDDL("rank int").fields, docs.schema["doc_id"], *StructType.fromDDL("score long").fields]))
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
q AS (
  SELECT DISTINCT i, item_id, t FROM (
    SELECT i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM (SELECT row_number() OVER () AS i, * FROM benchmark))),
c AS (
  SELECT q.i, q.item_id, d.doc_id, d.r,
    CAST(sum(CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * len(d.w) * n_docs) // n_terms))))) AS BIGINT) AS score
  FROM q JOIN p USING (t) JOIN f USING (t) JOIN d ON d.r = p.r CROSS JOIN s GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
