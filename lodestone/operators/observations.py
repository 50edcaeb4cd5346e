"""Provenance-weighted observations: best values, agreement, confidence, publishability, views, round trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rank of a claim's confidence cap, steps of the lineage, freshness and place terms.
CAP_RANK = {"VRF": 4, "SRC": 3, "INF": 2, "EST": 1}
LINEAGE_POINTS = {1: 18, 2: 30, 3: 40, 4: 45}
FRESH_DAYS = ((180, 10), (365, 6), (730, 3))
PLACE_POINTS = {"verified": 15, "parcel": 15, "address": 10, "centroid": 5, "municipality": 2}
AGREED = ("name", "operator", "coordinates", "capacity")
CLEARED = ("cleared", "attribution_required")
#: The layer of each stage of life; a stage that isn't here (decommissioned) has none.
LAYERS = {"operational": "L1", "commissioning": "L1", "expansion": "L1", "construction": "L2", "permitted": "L3", "entitled": "L3", "announced": "L4", "rumored": "L4"}


def steps(c: Column, table: dict, default: object = None) -> Column:
    """A literal mapping of values."""
    out = F.lit(default)
    for k, v in reversed(list(table.items())):
        out = F.when(c == k, v).otherwise(out)
    return out


def live(obs: DataFrame) -> DataFrame:
    """Rows that count: neither retracted nor superseded, with a known subject."""
    return obs.filter(~F.col("retracted") & ~F.col("superseded") & F.col("entity_id").isNotNull())


def stamp_redistributable(obs: DataFrame, registry: DataFrame) -> DataFrame:
    """The licence flag as of writing; a source that isn't registered isn't cleared. The registry has a row per source."""
    known = registry.select("source_id", F.col("license_status").isin(*CLEARED).alias("_cleared"))
    return obs.drop("redistributable").join(known, "source_id", "left").withColumn("redistributable", F.coalesce("_cleared", F.lit(False))).drop("_cleared")


def value_key(c: str = "value_text", num: str = "value_num") -> Column:
    return F.coalesce(F.col(c), F.col(num).cast("string"), F.concat_ws("|", F.col("lat").cast("string"), F.col("lng").cast("string")))


def _bucket() -> Column:
    """What two claims must share to agree; null where the claim is empty."""
    text = F.nullif(F.lower(F.regexp_replace("value_text", r"\s+", " ")), F.lit(""))
    place = F.concat(F.round("lat", 3).cast("string"), F.lit("|"), F.round("lng", 3).cast("string"))
    return F.when(F.col("attribute") == "coordinates", place).when(F.col("attribute") == "capacity", F.round("value_num", 1).cast("string")).otherwise(text)


def agreement_points(obs: DataFrame, include_news: bool = False) -> DataFrame:
    """(entity_id, points): 15 times the share of comparable attributes on which two lineages agree, rounded down."""
    o = obs.filter(~F.col("retracted") & F.col("attribute").isin(*AGREED))
    if not include_news:
        o = o.filter(F.col("source_class") != "news")
    o = o.select("entity_id", "attribute", "lineage", F.coalesce("capacity_basis", F.lit("-")).alias("basis"), _bucket().alias("bucket")).filter("bucket is not null")
    same = o.groupBy("entity_id", "attribute", "basis", "bucket").agg(F.collect_set("lineage").alias("who"))
    per = same.groupBy("entity_id", "attribute", "basis").agg(F.size(F.array_distinct(F.flatten(F.collect_list("who")))).alias("n"), F.max(F.size("who")).alias("most"))
    both = per.groupBy("entity_id").agg(F.countDistinct(F.when(F.col("n") >= 2, F.col("attribute"))).alias("c"), F.countDistinct(F.when(F.col("most") >= 2, F.col("attribute"))).alias("a"))
    return both.select("entity_id", F.when(F.col("c") > 0, F.floor(15.0 * F.col("a") / F.col("c"))).otherwise(0).cast("bigint").alias("points"))


def publishable(obs: DataFrame, lineages: int = 3) -> DataFrame:
    """(entity_id, n_lineages, has_official, publishable): enough independent open lineages, one of them official."""
    o = obs.filter(~F.col("retracted") & F.col("redistributable") & (F.col("source_class") != "news"))
    out = o.groupBy("entity_id").agg(F.countDistinct("lineage").alias("n_lineages"), F.bool_or(F.col("source_class") == "official_record").alias("has_official"))
    return out.withColumn("publishable", (F.col("n_lineages") >= lineages) & F.col("has_official"))


def band_lookup(df: DataFrame, bands: DataFrame, score: str, key: str) -> DataFrame:
    """The band whose [lo, hi] holds the score; where bands overlap the lowest sort_order wins. Bands are configuration."""
    b = F.broadcast(bands.select("band", "lo", "hi", "sort_order"))
    hit = df.join(b, F.col(score).between(F.col("lo"), F.col("hi")), "left")
    names = [c for c in df.columns if c != key]
    return hit.groupBy(key, *names).agg(F.min(F.struct("sort_order", "band"))["band"].alias("band"))


def _evidence(obs: DataFrame) -> DataFrame:
    """(entity_id, n, official, latest, c, c2): what the score takes from the observations, in one shuffle of them.

    Rows are dealt by entity once; claims are grouped within it, to attributes, to the entity.
    """
    real = F.col("source_class") != "news"
    known = F.col("attribute").isin(*AGREED) & _bucket().isNotNull()
    o = obs.filter(~F.col("retracted") & F.col("entity_id").isNotNull()).select(
        "entity_id", "lineage", F.when(real, F.col("lineage")).alias("own"), F.when(real, F.col("observed_at")).alias("at"), (F.col("source_class") == "official_record").alias("official"),
        F.when(known, F.col("attribute")).alias("attribute"), F.when(known, F.coalesce("capacity_basis", F.lit("-"))).alias("basis"), F.when(known, _bucket()).alias("bucket"),
    )
    common = [F.bool_or("official").alias("official"), F.max("at").alias("at")]
    same = o.repartition("entity_id").groupBy("entity_id", "attribute", "basis", "bucket").agg(F.collect_set("own").alias("own"), F.collect_set("lineage").alias("all"), *common)
    joined = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    per = same.groupBy("entity_id", "attribute", "basis").agg(joined("own").alias("own"), joined("all").alias("all"), F.max(F.size("own")).alias("most"), F.max(F.size("all")).alias("most2"), *common)
    met = lambda c: F.size(F.collect_set(F.when(c >= 2, F.col("attribute"))))
    points = lambda a, c: F.when(c > 0, F.floor(15.0 * a / c)).otherwise(0).cast("bigint")
    whole = per.groupBy("entity_id").agg(
        F.size(joined("own")).alias("n"), *common, met(F.size("own")).alias("_c"), met(F.col("most")).alias("_a"), met(F.size("all")).alias("_c2"), met(F.col("most2")).alias("_a2"),
    )
    return whole.select("entity_id", "n", "official", F.col("at").alias("latest"), points(F.col("_a"), F.col("_c")).alias("c"), points(F.col("_a2"), F.col("_c2")).alias("c2"))


def confidence(entities: DataFrame, obs: DataFrame, bands: DataFrame, as_of: str) -> DataFrame:
    """(entity_id, lineage_pts, official_pts, agree_pts, agree_all_pts, fresh_pts, place_pts, score, band)."""
    e = entities.select("entity_id", "geo_precision").join(_evidence(obs), "entity_id", "left")
    age = F.datediff(F.lit(as_of).cast("date"), F.col("latest"))
    fresh = F.lit(0)
    for days, points in reversed(FRESH_DAYS):
        fresh = F.when(age <= days, points).otherwise(fresh)
    whole = lambda c: c.cast("bigint")
    e = e.select(
        "entity_id",
        whole(F.when(F.col("n").isNull(), 0).otherwise(steps(F.least("n", F.lit(4)), LINEAGE_POINTS, 0))).alias("lineage_pts"),
        whole(F.when(F.col("official"), 15).otherwise(0)).alias("official_pts"),
        F.coalesce("c", F.lit(0)).alias("agree_pts"),
        F.coalesce("c2", F.lit(0)).alias("agree_all_pts"),
        whole(fresh).alias("fresh_pts"),
        whole(F.coalesce(steps(F.col("geo_precision"), PLACE_POINTS, 0), F.lit(0))).alias("place_pts"),
    )
    rest = F.col("lineage_pts") + F.col("official_pts") + F.col("fresh_pts") + F.col("place_pts")
    base, full = rest + F.col("agree_pts"), rest + F.col("agree_all_pts")
    score = F.greatest(F.lit(0), F.least(F.lit(100), base + F.least(F.lit(5), F.greatest(F.lit(0), full - base))))
    return band_lookup(e.withColumn("score", whole(score)), bands, "score", "entity_id")


def best_claims(obs: DataFrame) -> DataFrame:
    """The best live claim of each entity and attribute: cap, recency, number of lineages that make the same claim, time of ingest, id."""
    same = ["entity_id", "attribute"]
    o = live(obs).withColumn("value_key", value_key()).repartition(*same)  # one shuffle serves both windows
    o = o.withColumn("lineages", F.size(F.collect_set("lineage").over(W.partitionBy(*same, "value_key"))).cast("bigint"))
    order = [steps(F.col("cap"), CAP_RANK, 0).desc(), F.col("observed_at").desc_nulls_last(), F.col("lineages").desc(), *[F.col(c).desc_nulls_last() for c in ("ingested_at",) if c in obs.columns], F.col("obs_id").asc()]
    return o.withColumn("rn", F.row_number().over(W.partitionBy(*same).orderBy(*order))).filter("rn = 1").drop("rn")


def pivot_attributes(best: DataFrame, spec: dict[str, tuple[str, str]], by: str = "entity_id") -> DataFrame:
    """One row per entity: output column -> (attribute, value column). One shuffle and a fixed schema."""
    return best.groupBy(by).agg(*_pivot(spec))


def _pivot(spec: dict[str, tuple[str, str]]) -> list[Column]:
    return [F.max(F.when(F.col("attribute") == a, F.col(c))).alias(out) for out, (a, c) in spec.items()]


SPEC = {"name": ("name", "value_text"), "operator": ("operator", "value_text"), "lat": ("coordinates", "lat"), "lng": ("coordinates", "lng"), "capacity": ("capacity", "value_num"), "capacity_basis": ("capacity", "capacity_basis")}


def current_view(entities: DataFrame, obs: DataFrame) -> DataFrame:
    """Every entity with its best value of each attribute, the lineages behind them, and whether a restricted source is among them."""
    more = [F.sum("lineages").alias("resolved_lineages"), F.bool_or(~F.col("redistributable")).alias("has_restricted_input")]
    return entities.select("entity_id").join(best_claims(obs).groupBy("entity_id").agg(*_pivot(SPEC), *more), "entity_id", "left")


def public_view(entities: DataFrame, obs: DataFrame) -> DataFrame:
    """Publishable entities, resolved from redistributable claims only, with their citations."""
    free = obs.filter("redistributable")
    gate = publishable(obs).filter("publishable").select("entity_id")
    cites = live(free).groupBy("entity_id").agg(F.to_json(F.array_sort(F.collect_set(F.struct("source_id", "source_class")))).alias("citations"))
    return entities.select("entity_id").join(gate, "entity_id", "left_semi").join(pivot_attributes(best_claims(free), SPEC), "entity_id", "left").join(cites, "entity_id", "left")


def verdicts(entities: DataFrame, obs: DataFrame, bands: DataFrame, as_of: str) -> DataFrame:
    """(entity_id, layer, score, band, publishable): what the observations say of every entity."""
    new = confidence(entities, obs, bands, as_of).select("entity_id", "score", "band")
    gate = publishable(obs).select("entity_id", F.col("publishable").alias("_p"))
    e = entities.select("entity_id", "lifecycle").join(new, "entity_id").join(gate, "entity_id", "left")
    return e.select("entity_id", steps(F.col("lifecycle"), LAYERS).alias("layer"), "score", "band", F.coalesce("_p", F.lit(False)).alias("publishable"))


def recompute(entities: DataFrame, obs: DataFrame, bands: DataFrame, as_of: str, new: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows whose layer, score, band or publishable flag changes, run statistics). A second run over its result changes none.

    entities: entity_id, geo_precision, lifecycle, and the stored old_layer, old_score, old_band, old_publishable. new: the
    :func:`verdicts` of these entities, if they are at hand.
    """
    new = verdicts(entities, obs, bands, as_of) if new is None else new
    old = ["layer", "score", "band", "publishable"]
    e = entities.select("entity_id", *[f"old_{c}" for c in old]).join(new, "entity_id")
    moved = F.lit(False)
    for c in old:
        moved = moved | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    stats = e.agg(F.count("*").alias("seen"), F.count_if(moved).alias("changed"), F.count_if("publishable").alias("publishable"))
    return e.filter(moved).select("entity_id", *old, "old_score"), stats


def unpivot_attrs(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Wide to (key..., attribute, value): one pass over the rows however many columns; nulls give no row."""
    pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(*key, F.explode(pairs).alias("_p")).select(*key, "_p.attribute", "_p.value").filter("value is not null")


def from_observations(obs: DataFrame, key: list[str], schema: dict[str, str]) -> DataFrame:
    """(key..., attribute, value) back to wide, with types."""
    return obs.groupBy(*key).agg(*[F.max(F.when(F.col("attribute") == c, F.col("value"))).cast(t).alias(c) for c, t in schema.items()])


def coverage_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(attribute, n): rows that have each column, in one pass."""
    one = df.agg(*[F.count(c).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).alias("n")) for c in columns])).alias("p")).select("p.*")


def validate_append_only(before: DataFrame, after: DataFrame, key: str, frozen: list[str], subject: str) -> DataFrame:
    """(key, violation): rows deleted, frozen columns changed, or a known subject changed to another."""
    digest = lambda: F.sha2(F.to_json(F.struct(*frozen)), 256)
    b = before.select(F.col(key), digest().alias("h0"), F.col(subject).alias("s0"), F.lit(True).alias("in0"))
    a = after.select(F.col(key), digest().alias("h1"), F.col(subject).alias("s1"), F.lit(True).alias("in1"))
    j = b.join(a, key, "full")
    what = F.filter(
        F.array(
            F.when(F.col("in0") & F.col("in1").isNull(), "deleted"),
            F.when(F.col("in0") & F.col("in1") & (F.col("h0") != F.col("h1")), "frozen_changed"),
            F.when(F.col("in0") & F.col("in1") & F.col("s0").isNotNull() & ~F.col("s0").eqNullSafe(F.col("s1")), "subject_changed"),
        ),
        lambda x: x.isNotNull(),
    )
    return j.select(key, F.explode(what).alias("violation"))


def diff_both_ways(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, n): rows of one that the other lacks, duplicates counted; no rows of either kind means cell-exact equality."""
    if a.columns != b.columns:
        raise ValueError(f"columns differ: {a.columns} and {b.columns}")
    count = lambda d, side: d.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(a.exceptAll(b), "only_left").unionByName(count(b.exceptAll(a), "only_right"))
