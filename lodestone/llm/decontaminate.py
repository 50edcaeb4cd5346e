"""Benchmark decontamination on a distributed positional inverted index.

Words are lower-cased (A-Z) runs of letters and digits, held as 64-bit hashes. A window is `size` consecutive words of
an item; an item of fewer words, but not none, is one window.

1. One pass over all documents counts, in each task, how often every test term occurs; the sums order the terms.
2. Each window is keyed by its two rarest terms. A second pass stores the postings of those terms: (term, row, positions).
3. The two lists of a window are intersected by row, and their positions by the distance of the two terms in the window.
   What is left, less the item position, is the alignment of a candidate; every occurrence of a window gives one. Windows
   of different items that have the same two terms at the same distance share that work.
4. The words of a candidate's row are held against the item's at that alignment, so the matches returned are exact.

`phrase_matches` returns those matches. `proximity_matches` relaxes step 3: terms of a window within `slack` words.

Cases: null and empty texts have no words. Items with equal texts each count, and items that share an id are one item in
the result. Rows that repeat a doc_id are decided each on its own text. A null item_id is named by an empty string. Empty
tables give no hits. Texts of any length are read whole, in ranges of bounded size. Other columns may have any names but
those that are added, which give way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import ALNUM, column, give_back, load, materialize, release, runs, small, utf8, words

#: Distinct test terms that tasks hold as a sorted array (8 bytes each); beyond that the call raises, and the items have
#: to be given in parts, whose results unite.
HELD_TERMS = 4_000_000
#: What phrase_matches adds.
NAMED = ("n_words", "n_hit", "item_ids")
#: Between an item's id and the digest of its text.
_MARK = "\x1f"


def _rows(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`row`, a digest of doc_id and text that postings point to; text; and `columns` under a prefix."""
    text = F.col("text").cast("string")
    return docs.select(F.xxhash64("doc_id", text).alias("row"), text.alias("text"), *[F.col(f"`{c}`").alias(f"_{c}") for c in columns])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, n, pos, term): every word of every item; item_id is followed by a digest of the text, so that items
    that share an id stay apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(column(batch, "text"))
            for a, b in runs(offs):
                h, at = words(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a], ALNUM)
                n = np.diff(at)
                own = np.repeat(np.arange(a, b), n)
                pos = np.arange(len(h)) - np.repeat(at[:-1], n)
                yield pa.RecordBatch.from_arrays([column(batch, "item_id").take(pa.array(own)), pa.array(np.repeat(n, n)), pa.array(pos), pa.array(h.view(np.int64))], names=["item_id", "n", "pos", "term"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    known = items.select(F.concat(name, F.lit(_MARK), F.md5(F.encode(text, "utf-8"))).alias("item_id"), text.alias("text")).distinct()
    return known.mapInArrow(run, "item_id string, n long, pos long, term long")


def _spread(terms: np.ndarray, offs: np.ndarray, raw: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows a to b: hits (row, position, index into the sorted `terms`), and the rows' word counts."""
    h, at = words(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a], ALNUM)
    i = np.minimum(np.searchsorted(terms, h), max(len(terms) - 1, 0))
    hit = np.flatnonzero(terms[i] == h) if len(terms) else np.zeros(0, np.int64)
    row = np.searchsorted(at, hit, "right") - 1
    return row + a, hit - at[row], i[hit], np.diff(at)


def term_counts(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(term, n): occurrences of each test term in all documents; each task sends one row for each term it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            raw, offs = utf8(column(batch, "text"))
            for a, b in runs(offs):
                total += np.bincount(_spread(terms, offs, raw, a, b)[2], minlength=len(terms))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms[met].view(np.int64)), pa.array(total[met])], names=["term", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def postings(rows: DataFrame, terms: np.ndarray) -> DataFrame:
    """(term, row, positions): the stored index of `terms` over `rows` (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(column(batch, "text"))
            ids = column(batch, "row").to_numpy()
            for a, b in runs(offs):
                row, pos, term, _ = _spread(terms, offs, raw, a, b)
                order = np.lexsort((pos, term, row))
                row, pos, term = row[order], pos[order], term[order]
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])])) if len(row) else np.zeros(0, np.int64)
                places = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32)), pa.array(pos.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(terms[term[new]].view(np.int64)), pa.array(ids[row[new]]), places], names=["term", "row", "positions"])

    return rows.select("row", "text").mapInArrow(run, "term long, row long, positions array<int>")


def _sorted_terms(df: DataFrame) -> np.ndarray:
    got = df.select("term").distinct().limit(HELD_TERMS + 1).toPandas()["term"].to_numpy(np.int64)
    if len(got) > HELD_TERMS:
        raise ValueError(f"over {HELD_TERMS} distinct test terms: split the items and unite the results")
    return np.sort(got.view(np.uint64))


def window_keys(terms: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """(item_id, start, p1, p2, t1, t2) of each window: places and terms of its two rarest words (one word: twice)."""
    ranked = terms.join(counts, "term", "left").withColumn("n_seen", F.coalesce(F.col("n_seen"), F.lit(0)))
    start = F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - (size - 1)), F.greatest(F.lit(0), F.least("pos", F.col("n") - size))))
    spread = ranked.select("item_id", "pos", "term", "n_seen", start.alias("start"))
    by = W.partitionBy("item_id", "start").orderBy("n_seen", "pos")
    two = spread.withColumn("rn", F.row_number().over(by)).filter("rn <= 2").groupBy("item_id", "start")
    pick = lambda c, i: F.max(F.when(F.col("rn") == i, F.col(c)))
    two = two.agg(*[pick(c, i).alias(f"{c[0]}{i}") for c in ("pos", "term") for i in (1, 2)], F.min("n_seen").alias("least"))
    return two.filter("least > 0").select("item_id", "start", "p1", F.coalesce("p2", "p1").alias("p2"), "t1", F.coalesce("t2", "t1").alias("t2"))


def _candidates(index: DataFrame, keys: DataFrame) -> DataFrame:
    """(row, item_id, shift): alignments at which both key terms of some window stand."""
    named = materialize(keys.select("t1", "t2", (F.col("p2") - F.col("p1")).cast("int").alias("gap"), "item_id", "p1").distinct(), "named")
    pairs = materialize(named.select("t1", "t2", "gap").distinct(), "pairs")
    lists = lambda t, x: index.select(F.col("term").alias(t), "row", F.col("positions").alias(x))
    by_row = lists("t1", "x").join(small(pairs), "t1").join(lists("t2", "y"), ["t2", "row"])
    starts = F.array_intersect("x", F.transform("y", lambda v: v - F.col("gap")))
    placed = by_row.select("t1", "t2", "gap", "row", F.explode(starts).alias("at"))
    return placed.join(small(named), ["t1", "t2", "gap"]).select("row", "item_id", (F.col("at") - F.col("p1")).cast("long").alias("shift")).distinct()


def phrase_matches(docs: DataFrame, items: DataFrame, size: int = 10, columns: list[str] | None = None) -> DataFrame:
    """Every row of `docs`: doc_id (or `columns`), n_words, n_hit, item_ids (sorted; items with windows that occur in it)."""
    columns = columns or ["doc_id"]
    terms = materialize(item_terms(items), "terms")
    vocabulary = _sorted_terms(terms)
    rows = _rows(docs, columns)
    counts = term_counts(docs, vocabulary).withColumnRenamed("n", "n_seen")
    keys = materialize(window_keys(terms, counts, size), "keys")
    anchors = _sorted_terms(keys.select(F.col("t1").alias("term")).union(keys.select("t2")))
    index = materialize(postings(rows, anchors), "postings")
    found = materialize(_candidates(index, keys), "aligned")
    release(index)
    whole = terms.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("words"))
    if terms.limit(HELD_TERMS + 1).count() <= HELD_TERMS:  # 32 MB of hashes: an item that very many rows meet is no key of a shuffle then
        whole = F.broadcast(whole)
    # An item's words go to a row once, with all its alignments there; a row's list is as long as the items that it may hold.
    met = found.groupBy("row", "item_id").agg(F.collect_list("shift").alias("shifts")).join(whole, "item_id")
    held = met.groupBy("row").agg(F.collect_list(F.struct("item_id", "shifts", "words")).alias("found"))
    own = [f"_{c}" for c in columns if c != "text"]
    joined = rows.join(held, "row", "left").select("text", "found", *[f"`{c}`" for c in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(column(batch, "text"))
            found = column(batch, "found")
            some = np.asarray(found.is_valid())
            n_words, n_hit = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
            named: list[list[str]] = [[]] * len(found)
            for a, b in runs(offs):
                h, at = words(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a], ALNUM)
                n_words[a:b] = np.diff(at)
                for i in np.flatnonzero(some[a:b]):
                    n_hit[a + i], named[a + i] = _hits(h[at[i] : at[i + 1]].view(np.int64), found[int(a + i)].as_py(), size)
            kept = [column(batch, "text" if c == "text" else f"_{c}") for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_words), pa.array(n_hit), pa.array(named, pa.list_(pa.string()))], names=[*columns, *NAMED])
        give_back()

    kinds = [f"`{c}` {'string' if c == 'text' else docs.schema[c].dataType.simpleString()}" for c in columns]
    return joined.mapInArrow(run, ", ".join([*kinds, "n_words long, n_hit long, item_ids array<string>"]))


def _hits(text: np.ndarray, found: list[dict], size: int) -> tuple[int, list[str]]:
    """Words inside an occurring window, and the items that have one, by exact comparison at each alignment."""
    cover = np.zeros(len(text) + 1, np.int64)
    items = set()
    for x in found:
        item = np.asarray(x["words"], np.int64)
        width = min(size, len(item))
        for shift in map(int, x["shifts"]):
            lo, hi = max(0, -shift), min(len(item), len(text) - shift)
            if hi - lo < width:
                continue
            same = np.concatenate([[0], np.cumsum(text[lo + shift : hi + shift] == item[lo:hi])])
            at = np.flatnonzero(same[width:] - same[:-width] == width) + lo + shift
            if len(at):
                np.add.at(cover, at, 1)
                np.add.at(cover, at + width, -1)
                items.add(x["item_id"].rpartition(_MARK)[0])
    return int(np.count_nonzero(np.cumsum(cover[:-1]))), sorted(items)


def proximity_matches(docs: DataFrame, items: DataFrame, size: int = 10, slack: int = 20) -> DataFrame:
    """(doc_id, item_id, start): windows whose two rarest terms stand within `slack` words of each other in a document.

    It reads the same stored postings; order and distance inside the window don't matter.
    """
    terms = materialize(item_terms(items), "terms")
    rows = _rows(docs, ["doc_id"])
    keys = materialize(window_keys(terms, term_counts(docs, _sorted_terms(terms)).withColumnRenamed("n", "n_seen"), size), "keys")
    index = materialize(postings(rows, _sorted_terms(keys.select(F.col("t1").alias("term")).union(keys.select("t2")))), "postings")
    # Each pair of terms meets its lists once, however many windows share it.
    pairs = materialize(keys.select("t1", "t2").distinct(), "pairs")
    lists = lambda t, x: index.select(F.col("term").alias(t), "row", F.col("positions").alias(x))
    met = lists("t1", "x").join(small(pairs), "t1").join(lists("t2", "y"), ["t2", "row"])
    # Of two lists the nearest places are neighbours in their merged order.
    marked = lambda c, side: F.transform(c, lambda p: F.struct(p.alias("p"), F.lit(side).alias("side")))
    merged = met.select("t1", "t2", "row", F.array_sort(F.concat(marked("x", 0), marked("y", 1))).alias("m"))
    beside = F.zip_with("m", F.slice("m", F.lit(2), F.size("m")), lambda a, b: F.coalesce((a["side"] != b["side"]) & (b["p"] - a["p"] <= slack), F.lit(False)))
    near = merged.filter(F.exists(beside, lambda v: v)).select("t1", "t2", "row").join(small(keys.select("t1", "t2", "item_id", "start")), ["t1", "t2"])
    return near.select("row", "item_id", "start").distinct().join(rows.select("row", F.col("_doc_id").alias("doc_id")).distinct(), "row").select("doc_id", F.regexp_extract("item_id", f"(?s)^(.*){_MARK}", 1).alias("item_id"), "start")


def digest(matches: DataFrame) -> DataFrame:
    """The matches with n_items, items_sha256 and contaminated in place of the list."""
    return matches.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The rows of `docs` in which no window of any item occurs, with all their columns (those named as in NAMED give way)."""
    own = [c for c in docs.columns if c not in NAMED]
    return phrase_matches(docs, items, size, own).filter("n_hit = 0").select(*[f"`{c}`" for c in own])


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(phrase_matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: Every window of every document against every window of every item.
OP4_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM b, unnest(generate_series(1, len(w) - n + 1)) AS t(i)),
dw AS (SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM d, (SELECT DISTINCT n FROM bw) AS lengths, unnest(generate_series(1, len(w) - n + 1)) AS t(i)),
h AS (SELECT DISTINCT rid, i, n, item_id FROM dw JOIN bw USING (n, g)),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY rid),
k AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN k USING (rid)
"""
