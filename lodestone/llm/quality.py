"""Quality classifier with hierarchical empirical Bayes over sites.

1. A logistic model over binned text statistics is fitted to a bounded sample of labelled rows. It gives every document
   its evidence: the log odds of low quality, from the whole text.
2. Grouped aggregation sums the evidence by path (host and section) and by host. Host and path rates of low quality
   are posterior means under Beta priors: paths shrink toward their host, hosts toward the global rate, each with a
   strength estimated from how far the groups' rates scatter beyond chance (method of moments).
3. A document's posterior odds are its evidence times its path's prior odds, the path's rate being taken without the
   document itself. Rows with a posterior of at least `reject` are rejected.

Cases: a null or empty text has statistics of an empty text. A null host or section is a group of its own. Rows that
repeat a doc_id are scored each on its own text; the model takes the one with the least statistics. Without labelled
rows of both classes nothing is known and everything is kept with the rate one half. An empty table gives an empty
result. Texts of any length are read whole, in ranges of bounded size. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import SPACED, column, give_back, load, materialize, runs, small, utf8, words

#: Labelled rows that the model is fitted to (the first by a hash of their id), bins of each statistic.
SAMPLE, BINS = 12_000, 12

_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t\r\x0b\x0c", b"\n", range(128, 256)), 1):
    _CLASS[list(_chars)] = _i
NAMES = ("upper", "digit", "newline", "wide", "mark", "length", "words", "word_len", "distinct", "top", "pairs", "lines", "longest", "marked", "plain")


def statistics(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of len(NAMES) numbers for each text, from vector operations over the bytes."""
    n = len(offs) - 1
    size = np.diff(offs)
    safe = np.maximum(size, 1)
    cls = _CLASS[raw]

    def share(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return (c[offs[1:]] - c[offs[:-1]]) / safe

    upper, lower, digit, space, newline, wide = (share(cls == i) for i in range(1, 7))
    out = np.zeros((n, len(NAMES)))
    out[:, :5] = np.stack([upper / np.maximum(upper + lower, 1e-9), digit, newline, wide, np.maximum(0, 1 - upper - lower - digit - space - newline - wide)], 1)
    h, at = words(raw, offs, SPACED)
    count = np.diff(at)
    out[:, 5], out[:, 6] = np.log1p(size), np.log1p(count)
    out[:, 7] = size * (1 - space - newline) / np.maximum(count, 1)
    inside = SPACED[raw]
    last = np.flatnonzero(inside & np.append(~inside[1:], True)) if len(raw) else np.zeros(0, np.int64)
    edge = offs[1:][(offs[1:] > 0) & (offs[1:] < len(raw))] - 1
    ends = np.union1d(last, edge[inside[edge]]) if len(edge) else last
    plain = np.concatenate([[0], np.cumsum(np.isin(cls[ends], (1, 2)))])
    starts_at = np.searchsorted(ends, offs)
    whole = np.maximum(np.diff(starts_at), 1)
    out[:, 13] = np.diff(plain[starts_at]) / whole
    for i in range(n):
        w = h[at[i] : at[i + 1]]
        if len(w):
            _, c = np.unique(w, return_counts=True)
            out[i, 8], out[i, 9] = len(c) / len(w), c.max() / len(w)
            p = w[1:] + w[:-1] * np.uint64(3)
            out[i, 10] = len(np.unique(p)) / max(1, len(p)) if len(p) else 1
        text = raw[offs[i] : offs[i + 1]]
        breaks = np.flatnonzero(text == 10)
        if len(breaks):
            lines = bytes(text).split(b"\n")
            out[i, 11] = len(set(lines)) / len(lines)
            out[i, 12] = np.log1p(max(map(len, lines)))
        else:
            out[i, 11], out[i, 12] = 1, np.log1p(len(text))
    out[:, 14] = np.log1p(size) * out[:, 8]
    return out


def text_statistics(batch: pa.RecordBatch) -> np.ndarray:
    raw, offs = utf8(column(batch, "text"))
    parts = [statistics(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in runs(offs)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


@dataclass
class Model:
    """Additive log odds over binned statistics."""

    edges: np.ndarray  # statistics x (BINS - 1)
    weights: np.ndarray  # statistics x BINS
    bias: float
    rate: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.bias)
        for j in range(x.shape[1]):
            s += self.weights[j, np.searchsorted(self.edges[j], x[:, j], "right")]
        return np.clip(s, -12, 12)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> Model:
    """Ridge logistic regression on one-hot bins, by Newton steps."""
    edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T
    # Tails tell most: cut them finer than even shares would.
    edges[:, 0], edges[:, -1] = np.quantile(x, 0.02, axis=0), np.quantile(x, 0.98, axis=0)
    edges.sort(axis=1)
    onehot = np.zeros((len(x), x.shape[1], BINS))
    for j in range(x.shape[1]):
        onehot[np.arange(len(x)), j, np.searchsorted(edges[j], x[:, j], "right")] = 1
    z = np.concatenate([np.ones((len(x), 1)), onehot.reshape(len(x), -1)], 1)
    w = np.zeros(z.shape[1])
    rate = y.mean()
    w[0] = np.log(rate / (1 - rate))
    keep = np.full(len(w), ridge)
    keep[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * np.concatenate([[0], w[1:]]))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(edges, w[1:].reshape(x.shape[1], BINS), float(w[0]), float(rate))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on at most `sample` labelled rows; None where they don't show both classes."""
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")  # at most `sample` narrow rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_statistics(batch)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), column(batch, "quality").cast(pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    one = rows.mapInArrow(run, "doc_id long, quality int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("r"))
    got = one.select("doc_id", "r.quality", "r.x").toPandas().sort_values("doc_id")
    if got.quality.nunique() < 2:
        return None
    return fit(np.stack(got.x), (1 - got.quality).to_numpy(float))


def evidence(docs: DataFrame, model: Model | None, name: str = "evidence") -> DataFrame:
    """`docs` (with text) and `evidence`: log odds of low quality relative to the sample's rate."""
    prior = np.log(model.rate / (1 - model.rate)) if model else 0.0
    kept = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.log_odds(text_statistics(batch)) - prior if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, name])
        give_back()

    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"{name} double"]))


def _strength(groups: DataFrame, by: str) -> float:
    """The Beta prior's strength: from the variance of the groups' mean rates beyond that of chance."""
    g = groups.filter("n >= 2").select("n", (F.col("s") / F.col("n")).alias("m"), by)
    r = g.agg(F.sum(F.col("n") * (F.col("m") - F.col(by)) ** 2).alias("q"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col(by) * (1 - F.col(by))).alias("v")).first()
    if not r.k or r.k < 2:
        return 20.0
    chance = r.v / r.n
    between = (r.q - r.k * chance) / max(r.n - r.n2 / r.n, 1e-9)
    return float(np.clip(chance / between - 1, 1, 1000)) if between > 0 else 1000.0


def site_rates(scored: DataFrame, rate: float) -> DataFrame:
    """(host, section, n, s, prior, k): sums of each path, its host's rate and the strength with which it shrinks.

    scored: host, section, p (posterior under the global rate).
    """
    path = scored.groupBy("host", "section").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    path = materialize(path, "paths")
    host = path.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("base", F.lit(rate))
    k = _strength(host, "base")
    host = host.select(F.col("host").alias("_h"), ((F.col("s") + k * rate) / (F.col("n") + k)).alias("prior"))
    own = path.join(host, F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    return own.withColumn("k", F.lit(_strength(own, "prior")))


def posterior(scored: DataFrame, rates: DataFrame) -> Column:
    """The posterior of low quality of a row that has evidence, p, and its path's n, s, prior and k."""
    rest = (F.col("s") - F.col("p") + F.col("k") * F.col("prior")) / (F.col("n") - 1 + F.col("k"))
    m = F.least(F.greatest(rest, F.lit(0.001)), F.lit(0.999))
    return 1 / (1 + F.exp(-(F.col("evidence") + F.log(m / (1 - m)))))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", section: str = "lang", reject: float = 0.5, sample: int = SAMPLE, columns: list[str] | None = None, only_kept: bool = False) -> DataFrame:
    """Every row of `docs`: its doc_id (or `columns`), doc_score, site_rate, low_quality (posterior) and kept; or, with
    `only_kept`, the `columns` of those that stay."""
    model = train(docs, labels, sample)
    rate = model.rate if model else 0.5
    start = float(np.log(rate / (1 - rate)))

    def scored(own: list[str]) -> DataFrame:
        d = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(own)], F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("host"), F.col(section).cast("string").alias("section"))
        return evidence(d, model).withColumn("p", 1 / (1 + F.exp(-(F.col("evidence") + start))))

    columns = columns or ["doc_id"]
    if "text" in columns:  # the texts are read twice rather than written out
        first, second = scored([]), scored(columns)
    else:
        first = second = materialize(scored(columns).drop("text"), "scored")
    rates = materialize(site_rates(first.select("host", "section", "p"), rate), "rates")
    place = [F.col("host").alias("_ph"), F.col("section").alias("_ps"), "n", "s", "prior", "k"]
    joined = second.join(small(rates, 100_000).select(*place), F.col("host").eqNullSafe(F.col("_ph")) & F.col("section").eqNullSafe(F.col("_ps")))
    out = joined.withColumn("low_quality", posterior(joined, rates))
    own = [F.col(f"_{i}").alias(c) for i, c in enumerate(columns)]
    stays = F.col("low_quality") < reject if model else F.lit(True)
    if only_kept:
        return out.filter(stays).select(*own)
    site = (F.col("s") + F.col("k") * F.col("prior")) / (F.col("n") + F.col("k"))
    return out.select(*own, F.col("p").alias("doc_score"), site.alias("site_rate"), "low_quality", stays.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, reject: float = 0.5) -> DataFrame:
    """The rows of `docs` that the classifier keeps, with all their columns."""
    return classify(docs, labels, reject=reject, columns=docs.columns, only_kept=True)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), columns=["doc_id", "source", "lang"])
