"""Language identification of pages by Bayesian evidence fusion.

Four kinds of evidence meet in each page's posterior, as sums of log odds:

- the text: character trigrams of the main text under one multinomial model for each language, tempered, since the
  trigrams of a page are far from independent;
- the declared markup language, and the address suffix (country domain or language folder): P(value | language) comes
  from grouped aggregation over all pages, so a declaration that is often wrong counts for little;
- the host: P(language | host) is a Dirichlet posterior that shrinks toward its domain's, and that toward the global
  distribution.

The page itself is left out of the counts of its own declaration, suffix and host.

The text models are fitted to a bounded sample of the documents of each language, and every language that a document
has can be answered; everything else uses all pages.

Cases: null or empty html has no text evidence, a null url no host or suffix evidence; a page without any evidence gets
the global distribution. Ties go to the first language in alphabetical order. Rows with equal ids are each classified.
An empty table gives an empty result; without documents of known language the result has null languages. Pages and texts of
any length are read whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import column, load, materialize, small
from lodestone.llm.html_text import main_text

#: Documents that the text models are fitted to (shared equally by the languages, of each the first by a hash of their
#: id, LEAST at least), trigram buckets, and the number of trigrams beyond which more of them add no certainty.
SAMPLE, BUCKETS, CERTAIN = 4_000, 1 << 14, 150
LEAST = 50
#: Strength with which a host shrinks toward its domain and a domain toward all pages, in pages.
HOST_PAGES, DOMAIN_PAGES, SMOOTH = 5.0, 20.0, 1.0


def buckets(text: str) -> np.ndarray:
    """The trigram buckets of a text, lower-cased, white space as one blank."""
    c = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B1) ^ c[1:-1] * np.uint64(0x85EBCA77) ^ c[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - 14)).astype(np.int64)


@dataclass
class TextModels:
    languages: list[str]
    log_p: np.ndarray  # BUCKETS x languages

    def evidence(self, text: str) -> np.ndarray:
        b = buckets(text)
        if not len(b):
            return np.zeros(len(self.languages))
        return self.log_p[b].mean(0) * (len(b) / (1 + len(b) / CERTAIN))


def train(docs: DataFrame, sample: int = SAMPLE) -> TextModels | None:
    """Trigram models of all languages, each from at most max(LEAST, sample / languages) documents."""
    lang = F.lower(F.col("lang").cast("string"))
    known = docs.filter("lang is not null and text is not null and doc_id is not null")
    ids = materialize(known.select("doc_id", lang.alias("lang")).distinct(), "known")
    counts = materialize(ids.groupBy("lang").agg(F.count("*").alias("n")), "counts")
    each = max(LEAST, sample // max(1, counts.count()))
    # A hash below the cutoff leaves about twice as many as are taken, so no task ranks a whole language.
    place = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5
    few = ids.join(small(counts), "lang").filter(place < (2.0 * each + LEAST) / F.col("n"))
    chosen = few.withColumn("rn", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).filter(F.col("rn") <= each).select("doc_id", "lang")
    chosen = materialize(chosen, "chosen")
    rows = known.select("doc_id", lang.alias("lang"), "text").join(small(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(column(batch, "lang").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total[lang] += np.bincount(buckets(text), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], names=["lang", "counts"])

    sums: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(run, "lang string, counts array<bigint>").collect():
        sums[r.lang] = sums.get(r.lang, 0) + np.array(r.counts)
    if not sums:
        return None
    languages = sorted(sums)
    p = np.stack([(sums[x] + 0.5) / (sums[x].sum() + 0.5 * BUCKETS) for x in languages], 1)
    return TextModels(languages, np.log(p))


def _declared(page: str | None) -> str | None:
    m = re.search(r"<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", page or "", re.I)
    return m[1].lower() if m else None


def _address(c: Column) -> tuple[Column, Column, Column]:
    """Host, registered domain (its last two labels) and suffix (language folder, else country domain) of a url."""
    host = F.nullif(F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    domain = F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit(""))
    folder = F.nullif(F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[/?#]|$)", 1)), F.lit(""))
    country = F.nullif(F.regexp_extract(host, r"\.([a-z]{2})$", 1), F.lit(""))
    return host, F.coalesce(domain, host), F.coalesce(folder, country)


def text_evidence(pages: DataFrame, models: TextModels) -> DataFrame:
    """(page_id, url, host, domain, suffix, declared, ll): what each page shows, ll by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = column(batch, "html").to_pylist()
            ll = np.array([models.evidence(main_text(x)) for x in html]).reshape(len(html), len(models.languages))
            cols = [column(batch, "page_id"), column(batch, "url"), pa.array([_declared(x) for x in html], pa.string()), pa.array([x.tolist() for x in ll - ll.max(1, keepdims=True)] if len(html) else [], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "declared", "ll"])

    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    seen = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, declared string, ll array<double>")
    host, domain, suffix = _address(F.col("url").cast("string"))
    return seen.withColumns({"host": host, "domain": domain, "suffix": suffix})


def _log_sum(values: list[Column]) -> Column:
    most = F.greatest(*values) if len(values) > 1 else values[0]
    return most + F.log(sum((F.exp(v - most) for v in values[1:]), F.exp(values[0] - most)))


def identify(pages: DataFrame, models: TextModels | None) -> DataFrame:
    """page_id, url, lang, probability, text_lang, declared, suffix, host for each row of `pages`."""
    if models is None:
        null = F.lit(None).cast("string")
        return pages.select("page_id", "url", null.alias("lang"), F.lit(None).cast("double").alias("probability"), null.alias("text_lang"), null.alias("declared"), null.alias("suffix"), null.alias("host"))
    names = models.languages
    span = range(len(names))
    seen = materialize(text_evidence(pages, models), "seen")
    ll = [F.get("ll", F.lit(i)) for i in span]
    total = _log_sum(ll)
    seen = seen.withColumns({f"q{i}": F.exp(ll[i] - total) for i in span})
    sums = [F.sum(f"q{i}").alias(f"s{i}") for i in span]
    every = seen.agg(F.count("*").alias("n"), *sums).first()
    base = [((every[f"s{i}"] or 0.0) + 1) / ((every.n or 0) + len(names)) for i in span]

    every_value: dict[str, list[float]] = {}

    def likelihood(by: str) -> DataFrame:
        """The pages of each value of a column by language; the values are few (codes of 2 or 3 letters)."""
        t = seen.filter(f"{by} is not null").groupBy(by).agg(*sums)
        whole = t.agg(*[F.sum(f"s{i}").alias(f"w{i}") for i in span], F.count("*").alias("v")).first()
        every_value[by] = [float((whole[f"w{i}"] or 0) + SMOOTH * (whole.v or 1)) for i in span]
        return t.select(F.col(by).alias(f"_{by}"), *[F.col(f"s{i}").alias(f"{by}{i}") for i in span])

    def log_p(by: str, i: int) -> Column:
        """log P(value | language i), smoothed, the page itself left out; 0 without a value."""
        own = F.col(f"q{i}")
        return F.coalesce(F.log((F.col(f"{by}{i}") - own + SMOOTH) / (every_value[by][i] - own)), F.lit(0.0))

    host = materialize(seen.filter("host is not null").groupBy("host", "domain").agg(F.count("*").alias("n"), *sums), "hosts")
    up = host.groupBy("domain").agg(F.sum("n").alias("dn"), *[F.sum(f"s{i}").alias(f"d{i}") for i in span])
    up = up.select(F.col("domain").alias("_domain"), *[((F.col(f"d{i}") + DOMAIN_PAGES * base[i]) / (F.col("dn") + DOMAIN_PAGES)).alias(f"d{i}") for i in span])
    host = materialize(host.join(up, F.col("domain") == F.col("_domain")).drop("domain", "_domain").withColumnRenamed("host", "_host"), "rates")

    out = seen.join(small(host, 100_000), F.col("host") == F.col("_host"), "left")
    for by in ("declared", "suffix"):
        out = out.join(F.broadcast(likelihood(by)), F.col(by) == F.col(f"_{by}"), "left")  # at most 26**2 + 26**3 rows
    score = []
    for i in span:
        prior = F.coalesce((F.col(f"s{i}") - F.col(f"q{i}") + HOST_PAGES * F.col(f"d{i}")) / (F.col("n") - 1 + HOST_PAGES), F.lit(base[i]))
        score.append(F.log(F.greatest(prior, F.lit(1e-6))) + ll[i] + log_p("declared", i) + log_p("suffix", i))
    out = out.withColumns({f"p{i}": s for i, s in enumerate(score)})
    p = [F.col(f"p{i}") for i in span]
    best = lambda cols: F.get(F.array(*[F.lit(x) for x in names]), F.array_position(F.array(*cols), F.array_max(F.array(*cols))).cast("int") - 1)
    top = F.array_max(F.array(*p))
    return out.select("page_id", "url", best(p).alias("lang"), F.round(F.exp(top - _log_sum(p)), 4).alias("probability"), F.when(F.size("ll") > 0, best(ll)).alias("text_lang"), "declared", "suffix", "host")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(load(spark, sf_dir, "pages"), train(load(spark, sf_dir, "documents")))
