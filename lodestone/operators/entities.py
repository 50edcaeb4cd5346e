"""Entity matching, merging, hierarchy, mention resolution, incentive scoring, grouping."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.geo import arc_m, haversine_m
from lodestone.functions.text import blank_to_null, campus_stem, json_build, normalize_company, normalize_operator, normalize_station, set_similarity, stable_id, trigram_codes
from lodestone.operators.ingest import best_per_key
from lodestone.operators.joins import block_pairs, geo_pairs, held, joined_names, large, small, trigram_pairs
from lodestone.storage import materialize, release


#: Kinds of names of which every two are told before sites meet.
KINDS = 1_000


@dataclass(frozen=True)
class MatchConfig:
    """Weights, thresholds and distances of the matcher."""

    weights: dict[str, float] = field(default_factory=lambda: {"name": 0.35, "geo": 0.30, "operator": 0.20, "external": 0.10, "lifecycle": 0.05})
    auto: float = 0.92
    queue: float = 0.70
    auto_distance_m: float = 250.0
    block_distance_m: float = 2000.0
    block_similarity: float = 0.45
    decay_m: float = 500.0
    same_operator: float = 0.80
    share_rail: float = 0.25


def qualifiers(name: Column) -> Column:
    """Sorted digit, roman and single-letter words of a name."""
    words = F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: w.rlike(r"^(\d+|[ivx]+|[a-z])$"))
    return F.array_join(F.array_sort(words), " ")


def _or_null(df: DataFrame, column: str, kind: str = "string") -> Column:
    return F.col(column) if column in df.columns else F.lit(None).cast(kind)


def match_facts(sites: DataFrame) -> DataFrame:
    """What the matcher compares, once a site, of those that aren't superseded.

    norm_name is the name's words, site_name these without the operator's (all of them, if none is left); norm_parent is the
    parent company of the operator, else the operator. Grams are whole numbers.
    """
    live = sites.filter("superseded_by is null") if "superseded_by" in sites.columns else sites
    words = blank_to_null(F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]+", " "))
    f = live.select(
        "site_id", "country", "subdivision", "lat", "lng", _or_null(live, "parent_id", "bigint").alias("parent_id"), "name", words.alias("norm_name"), normalize_operator(F.col("operator")).alias("norm_operator"),
        normalize_operator(F.coalesce(_or_null(live, "operator_parent"), F.col("operator"))).alias("norm_parent"),
    )
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    bare = blank_to_null(F.replace(padded(F.col("norm_name")), padded(F.col("norm_operator")), F.lit(" ")))
    f = f.withColumns({"site_name": F.coalesce(bare, F.col("norm_name")), "quals": F.when(F.col("name").isNotNull(), qualifiers(F.col("name")))})
    return f.withColumns({"grams": trigram_codes(F.col("site_name")), "op_grams": trigram_codes(F.col("norm_operator"))})


def block(facts: DataFrame, cfg: MatchConfig) -> dict[str, DataFrame]:
    """rule -> (a, b): pairs of sites by distance and by name, of one country (null is one), and by operator with subdivision.

    facts: as :func:`match_facts` has them, with a struct `site` (site_id first) of what pairs are told by and the id `u` of
    their names; a and b are these structs, so that no pair has to be brought to its sites' facts or to its
    other rules: the caller keeps a pair under the first rule that holds.
    """
    geo = geo_pairs(facts, cfg.block_distance_m, key="site", group="country")
    name = trigram_pairs(facts, cfg.block_similarity, "site", "norm_name", "country")
    op = block_pairs(facts.filter("norm_operator is not null and subdivision is not null"), ["norm_operator", "subdivision"], "site")
    return {"geo_2km": geo.select("a", "b"), "name_trgm": name.select("a", "b"), "operator_subdivision": op.select("a", "b")}


def _told(pairs: DataFrame, cfg: MatchConfig) -> DataFrame:
    """What the names x and y of `pairs` say, instead of them: alike, same_op, score_name, score_operator and qualifier_conflict."""
    no = lambda c: F.coalesce(c, F.lit(False))
    alike = (F.size("x.n") > 0) & (F.size("y.n") > 0) & (set_similarity(F.col("x.n"), F.col("y.n")) >= cfg.block_similarity)
    same = F.col("x.norm_operator") == F.col("y.norm_operator")
    return pairs.select("*", no(alike).alias("alike"), no(same).alias("same_op"), *fact_scores(cfg), (~F.col("x.quals").eqNullSafe(F.col("y.quals"))).alias("qualifier_conflict")).drop("x", "y")


def _identifiers(identifiers: DataFrame) -> DataFrame:
    """(site_id, ids, bits): the identifiers (site_id, source_key, external_id) that a site shares with others."""
    ids = identifiers.select("site_id", "source_key", "external_id").dropna().distinct()
    ids = ids.join(large(ids.groupBy("source_key", "external_id").agg(F.count("*").alias("_n")).filter("_n > 1")), ["source_key", "external_id"], "left_semi")
    key = F.concat(F.length(F.col("source_key").cast("string")), F.lit(":"), "source_key", "external_id")
    # Sites whose ids have no bit in common share none: few pairs have to look at the ids.
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("_key"), F.lit(64)).cast("int")))
    return ids.select("site_id", key.alias("_key")).groupBy("site_id").agg(F.sort_array(F.collect_set("_key")).alias("ids"), bits.alias("bits"))


def shared_ids(pairs: DataFrame, identifiers: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sites share an identifier (site_id, source_key, external_id), each once.

    Only pairs meet the identifiers, and only identifiers that several sites have: one that very many have adds no pair.
    """
    ids = identifiers.select("site_id", F.xxhash64("source_key", "external_id").alias("h"), "source_key", "external_id").dropna().distinct()
    ids = ids.join(large(ids.groupBy("source_key", "external_id").agg(F.count("*").alias("_n")).filter("_n > 1")), ["source_key", "external_id"], "left_semi")
    # The long way round is the pairs' own: with the ids of the first site, then those that the second has as well.
    met = pairs.select("a", "b").join(large(ids.withColumnRenamed("site_id", "a")), "a")
    return met.join(large(ids.withColumnRenamed("site_id", "b")), ["b", "h", "source_key", "external_id"], "left_semi").select("a", "b").distinct()


def fact_scores(cfg: MatchConfig) -> list[Column]:
    """score_name and score_operator of the facts x and y."""
    x, y = F.col("x.norm_operator"), F.col("y.norm_operator")
    operator = F.when(x.isNull() | y.isNull(), F.lit(None)).when(x == y, 1.0).when(F.col("x.norm_parent") == F.col("y.norm_parent"), 0.75).when(set_similarity(F.col("x.op_grams"), F.col("y.op_grams")) >= cfg.same_operator, 0.6).otherwise(0.0)
    return [F.round(set_similarity(F.col("x.grams"), F.col("y.grams")), 4).alias("score_name"), operator.alias("score_operator")]


def match_score(scores: dict[str, Column], cfg: MatchConfig) -> Column:
    """The weighted mean of the scores that there are."""
    top = sum((F.coalesce(scores[k] * w, F.lit(0.0)) for k, w in cfg.weights.items()), F.lit(0.0))
    below = sum((F.when(scores[k].isNotNull(), w).otherwise(0.0) for k, w in cfg.weights.items()), F.lit(0.0))
    return F.when(below == 0, 0.0).otherwise(rounded(top / below + 1e-9, 4))


def rounded(c: Column, digits: int) -> Column:
    """A number that isn't negative, rounded in doubles (`round` makes a decimal of each)."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


def match_entities(sites: DataFrame, cfg: MatchConfig | None = None, identifiers: DataFrame | None = None) -> DataFrame:
    """(a, b, reasons, distance_m, score_*, match, external_id_match, qualifier_conflict, decision, why) of every blocked pair outside a family.

    sites: site_id, name, operator, country, subdivision, lat, lng, and if there are any parent_id, operator_parent and
    superseded_by. identifiers: (site_id, source_key, external_id), many a site. A score that a pair has no facts for is null
    and its weight is left out. Pairs of parent and child and of siblings are none. Superseded sites take no part.
    """
    cfg = cfg or MatchConfig()
    names = ["norm_name", "site_name", "norm_operator", "norm_parent", "quals"]
    facts = materialize(match_facts(sites).withColumn("h", F.sha2(F.to_json(F.struct(*names)), 256)), "facts")
    # What names say is told once for every two kinds of names, or by pair if there are too many kinds.
    k = F.first(F.struct(*names, "grams", "op_grams", trigram_codes(F.col("norm_name")).alias("n"))).alias("k")
    kinds = materialize(facts.groupBy("h").agg(F.min("site_id").alias("u"), k), "kinds")
    few = kinds.count() <= KINDS
    if few:  # numbered, so that two are one number
        kinds = materialize(kinds.withColumn("u", F.row_number().over(W.orderBy("h")).cast("long")), "kinds")
    facts = facts.join(F.broadcast(kinds.select("h", "u")) if few else large(kinds.select("h", "u")), "h")
    facts = facts.withColumns({"ids": F.lit(None).cast("array<string>"), "bits": F.lit(None).cast("long")}) if identifiers is None else facts.join(large(_identifiers(identifiers)), "site_id", "left")
    y = F.radians(F.col("lat").cast("double"))
    site = F.struct("site_id", "u", y.alias("y"), F.cos(y).alias("cos"), F.radians(F.col("lng").cast("double")).alias("x"), "parent_id", F.coalesce(F.col("country").cast("string"), F.lit("\x00")).alias("country"), "subdivision", "ids", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    blocked = block(materialize(facts.withColumn("site", site), "facts"), cfg)
    x, y = kinds.select(F.col("u").alias("ua"), F.col("k").alias("x")), kinds.select(F.col("u").alias("ub"), F.col("k").alias("y"))
    two = lambda a, b: F.col(a) * (KINDS + 1) + F.col(b)
    told = F.broadcast(materialize(_told(x.crossJoin(y), cfg).withColumn("uu", two("ua", "ub")).drop("ua", "ub"), "told")) if few else None
    no = lambda c: F.coalesce(c, F.lit(False))
    country = F.col("a.country") == F.col("b.country")
    placed = F.col("a.y").isNotNull() & F.col("a.x").isNotNull() & F.col("b.y").isNotNull() & F.col("b.x").isNotNull()
    rules = {"geo_2km": no(country & placed & (F.col("_m") <= cfg.block_distance_m)), "name_trgm": country & F.col("alike"), "operator_subdivision": F.col("same_op") & no(F.col("a.subdivision") == F.col("b.subdivision"))}
    shared = F.when(F.col("a.bits").bitwiseAND(F.col("b.bits")) != 0, no(F.arrays_overlap("a.ids", "b.ids"))).otherwise(False)
    out, earlier = None, []
    # Rule by rule to the end: only what a pair ends as leaves the step that makes it.
    for rule, j in blocked.items():
        j = j.filter(~_kin(F.col("a.parent_id"), F.col("b.parent_id"), F.col("a.site_id"), F.col("b.site_id")))
        if few:
            j = j.withColumn("uu", two("a.u", "b.u")).join(told, "uu")
        else:
            j = _told(j.withColumns({"ua": F.col("a.u"), "ub": F.col("b.u")}).join(small(x), "ua").join(small(y), "ub"), cfg)
        j = j.withColumn("_m", arc_m(*[F.col(f"a.{c}") for c in ("y", "cos", "x")], *[F.col(f"b.{c}") for c in ("y", "cos", "x")])).filter(rules[rule])
        for r in earlier:
            j = j.filter(~rules[r])
        j = j.withColumn("reasons", joined_names({r: True if r == rule else rules[r] for r in rules if r not in earlier}))
        scored = _scored(j.withColumn("external_id_match", shared).withColumns({"a": F.col("a.site_id"), "b": F.col("b.site_id")}), cfg)
        out = scored if out is None else out.union(scored)
        earlier.append(rule)
    return out


def _kin(pa: Column, pb: Column, a: Column, b: Column) -> Column:
    """Whether sites are parent and child, or siblings."""
    return F.coalesce((pa == b) | (pb == a) | (pa == pb), F.lit(False))


def score_pairs(pairs: DataFrame, facts: DataFrame, cfg: MatchConfig, identifiers: DataFrame | None, families: bool = False) -> DataFrame:
    """The pairs (a, b, reasons; a stored table, if there are identifiers) scored; those of a family only on demand."""
    side = facts.select("site_id", F.struct("grams", "op_grams", "norm_operator", "norm_parent", "lat", "lng", "parent_id", "quals").alias("s"))
    if identifiers is not None:
        pairs = pairs.join(large(shared_ids(pairs, identifiers).withColumn("external_id_match", F.lit(True))), ["a", "b"], "left")
    else:
        pairs = pairs.withColumn("external_id_match", F.lit(None).cast("boolean"))
    j = pairs.join(large(side.toDF("a", "x")), "a").join(large(side.toDF("b", "y")), "b")
    if not families:
        j = j.filter(~_kin(F.col("x.parent_id"), F.col("y.parent_id"), F.col("a"), F.col("b")))
    j = j.select("*", *fact_scores(cfg), (~F.col("x.quals").eqNullSafe(F.col("y.quals"))).alias("qualifier_conflict"))
    return _scored(j.withColumns({"_m": haversine_m("x.lat", "x.lng", "y.lat", "y.lng"), "external_id_match": F.coalesce("external_id_match", F.lit(False))}), cfg)


def _scored(j: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Pairs (a, b, reasons, external_id_match, _m: metres) with what their names say, scored and decided."""
    j = j.withColumns({"score_geo": rounded(F.exp(-F.col("_m") / cfg.decay_m), 4), "score_external": F.when(F.col("external_id_match"), 1.0), "score_lifecycle": F.lit(1.0)})
    scores = ("name", "geo", "operator", "external", "lifecycle")
    match = match_score({k: F.col(f"score_{k}") for k in scores}, cfg)
    j = j.withColumns({"match": match, "distance_m": rounded(F.col("_m"), 1)})
    auto = F.col("match") >= cfg.auto
    near = F.col("external_id_match") | F.coalesce(F.col("distance_m") <= cfg.auto_distance_m, F.lit(False))
    decision = F.when(auto & ~F.col("qualifier_conflict") & near, "auto_merged").when(F.col("match") >= cfg.queue, "queued").otherwise("rejected")
    over = f"score>={cfg.auto:g}"
    agreed = F.when(F.col("external_id_match"), "external-ID match").otherwise(F.concat(F.lit("coordinate agreement "), F.col("distance_m").cast("string"), F.lit("m")))
    why = (
        F.when(auto & ~F.col("qualifier_conflict") & near, F.concat(F.lit(f"{over} with "), agreed))
        .when(auto & F.col("qualifier_conflict"), f"{over} but site-qualifier conflict - demoted to review")
        .when(auto, f"{over} but no coordinate agreement or external-ID match - demoted to review")
        .when(F.col("match") >= cfg.queue, "score in queue band - human review")
        .otherwise("score below queue threshold")
    )
    return j.select("a", "b", "reasons", "distance_m", *[f"score_{k}" for k in scores], "match", "external_id_match", "qualifier_conflict", decision.alias("decision"), why.alias("why"))


def check_share(decisions: DataFrame, flag: Column, most: float) -> DataFrame:
    """(n, flagged, share, ok): whether the flagged share stays within the rail."""
    return share_of(decisions.agg(F.count("*").alias("n"), F.count_if(flag).alias("flagged")), most)


def share_of(counted: DataFrame, most: float) -> DataFrame:
    """(n, flagged, share, ok) of (n, flagged)."""
    share = F.coalesce(F.try_divide("flagged", "n"), F.lit(0.0))
    return counted.select("n", "flagged", share.alias("share"), (share <= most).alias("ok"))


def merge_rail(sites: DataFrame, identifiers: DataFrame | None = None, cfg: MatchConfig | None = None) -> DataFrame:
    """:func:`check_share` of the automatic merges among the pairs of :func:`match_entities`, without making the pairs."""
    from lodestone.operators import merging as mg

    cfg = cfg or MatchConfig()
    if mg.merge_reach(cfg) is None:
        return check_share(match_entities(sites, cfg, identifiers), F.col("decision") == "auto_merged", cfg.share_rail)
    k = mg.Classes(sites, identifiers, cfg)
    return share_of(mg.merge_share(k, *k.edges()), cfg.share_rail)


def _within(share: DataFrame, cfg: MatchConfig) -> None:
    g = share.first()
    if not g.ok:
        raise ValueError(f"automatic merges on {g.flagged} of {g.n} pairs, above the share of {cfg.share_rail:g}: the thresholds are wrong, nothing is merged")


def within_rail(decisions: DataFrame, cfg: MatchConfig) -> DataFrame:
    """`decisions` (a stored table) if their share of automatic merges stays within the rail; else this raises."""
    _within(check_share(decisions, F.col("decision") == "auto_merged", cfg.share_rail), cfg)
    return decisions


def merge_order(entities: DataFrame, key: str = "site_id", score: str = "score", *more: str) -> DataFrame:
    """(key, v, *more): the survivor of two is the one of greater v."""
    found = _or_null(entities, "discovered_at", "timestamp").cast("timestamp")
    v = F.struct(F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))).alias("s"), (-F.unix_micros(F.coalesce(found, F.lit("9999-01-01").cast("timestamp")))).alias("t"))
    return entities.select(key, v.alias("v"), *more)


def apply_merges(entities: DataFrame, decisions: DataFrame, key: str = "site_id", score: str = "score", actor: str = "matcher") -> tuple[DataFrame, DataFrame]:
    """(entities with superseded_by, merges). An auto-merged pair's survivor is the one of higher score, then the one
    discovered earlier (`discovered_at`, if there is one; null last), then of lower id.

    A row that loses to several points to the best of them; where that one loses too, resolve_superseded follows the
    chain. merges, one row a loser, are the audit: surviving, merged, merged_public_id (`public_id`, if there is one: it is
    kept as it is and never given again), match_score, method, reason, actor, reversed_at (null). No row goes, and rows that
    were superseded before stay so.
    """
    auto = decisions.filter("decision = 'auto_merged'").select("a", "b", "match", "why")
    s = merge_order(entities.withColumn("_p", _or_null(entities, "public_id").cast("string")), key, score, "_p")
    j = auto.join(large(s.toDF("a", "va", "pa")), "a").join(large(s.toDF("b", "vb", "pb")), "b")
    a_wins = (F.col("va") > F.col("vb")) | ((F.col("va") == F.col("vb")) & (F.col("a") < F.col("b")))
    pairs = j.select(*[F.when(a_wins, F.col(x)).otherwise(F.col(y)).alias(n) for n, x, y in (("merged", "b", "a"), ("surviving", "a", "b"), ("v", "va", "vb"), ("merged_public_id", "pb", "pa"))], "match", "why")
    best = best_per_key(pairs, ["merged"], [F.desc("v"), F.asc("surviving")])
    merges = best.select("surviving", "merged", "merged_public_id", F.col("match").alias("match_score"), F.lit("auto").alias("method"), F.col("why").alias("reason"), F.lit(actor).alias("actor"), F.lit(None).cast("timestamp").alias("reversed_at"))
    pointer = merges.select(F.col("merged").alias(key), F.col("surviving").alias("_into"))
    out = entities.join(large(pointer), key, "left").withColumn("superseded_by", F.coalesce(_or_null(entities, "superseded_by", "bigint"), F.col("_into"))).drop("_into")
    return out, merges


def reverse_merges(entities: DataFrame, merges: DataFrame, merged: DataFrame, at: Column, key: str = "site_id") -> tuple[DataFrame, DataFrame]:
    """(entities, merges) after the merges of the rows in `merged` (a column `merged`) are taken back.

    The audit keeps its rows, with the time of reversal; a merge reversed before keeps its own. A pointer goes only where it
    is the one that the merge has set.
    """
    back = held(merged.select("merged").distinct())
    back = back.withColumn("_back", F.lit(True))
    marked = merges.join(back, "merged", "left")
    open_ = marked.filter("_back and reversed_at is null").select(F.col("merged").alias(key), F.col("surviving").alias("_from"))
    audit = marked.withColumn("reversed_at", F.coalesce("reversed_at", F.when(F.col("_back"), at))).select(*merges.columns)
    freed = entities.join(large(open_), key, "left").withColumn("superseded_by", F.when(F.col("superseded_by") == F.col("_from"), F.lit(None)).otherwise(F.col("superseded_by"))).drop("_from")
    return freed, audit


def match_and_merge(sites: DataFrame, identifiers: DataFrame | None = None, cfg: MatchConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """Matching, the share rail (which raises) and the merges: (entities, merges).

    Only the pairs that are merged are made (:mod:`lodestone.operators.merging`), unless the weights leave sites at any
    distance to be merged: then all blocked pairs are.
    """
    from lodestone.operators import merging as mg

    cfg = cfg or MatchConfig()
    if mg.merge_reach(cfg) is None:
        return apply_merges(sites, within_rail(materialize(match_entities(sites, cfg, identifiers), "decisions"), cfg))
    k = mg.Classes(sites, identifiers, cfg)
    edges, near = k.edges()
    _within(share_of(mg.merge_share(k, edges, near), cfg.share_rail), cfg)
    return apply_merges(sites, materialize(mg.best_merges(k, edges, merge_order(sites)), "decisions"))


def resolve_tree(df: DataFrame, key: str, parent: str, superseded: str = "superseded_by", grain: str = "grain", depth: int = 3) -> DataFrame:
    """(key, root, depth, root_grain) of live rows, down from those without a parent, at most `depth` levels.

    Superseded rows, and what stands below one, below a missing row or in a cycle, have no root and no row.
    """
    live = df.filter(F.col(superseded).isNull())
    level = live.filter(F.col(parent).isNull()).select(F.col(key), F.col(key).alias("root"), F.lit(0).alias("depth"), F.col(grain).alias("root_grain"))
    out, below = level, live.filter(F.col(parent).isNotNull()).select(F.col(key), F.col(parent).alias("_p"))
    for i in range(1, depth + 1):
        above = level.select(F.col(key).alias("_p"), "root", "root_grain")
        level = below.join(above, "_p").select(key, "root", F.lit(i).alias("depth"), "root_grain")
        out = out.unionByName(level)
    return out


def inventory_counts(entities: DataFrame) -> DataFrame:
    """Roots-only counts."""
    live, root = F.col("superseded_by").isNull(), F.col("parent_id").isNull()
    return entities.agg(
        F.count_if(live & root).alias("roots"), F.count_if(live).alias("live"), F.count_if(~live).alias("superseded"),
        F.count_if(live & root & F.col("publishable")).alias("public_roots"), F.count_if(live & (F.col("grain") == "building")).alias("buildings"),
    )


def resolve_superseded(df: DataFrame, key: str, pointer: str) -> DataFrame:
    """(key, survivor): the end of each pointer chain, by pointer doubling: rounds are the logarithm of the rows at most.

    Rounds see only the rows that point to another.

    A cycle has no end: it raises, with some of the rows in it. A pointer to a missing row ends there.
    """
    every = df.select(F.col(key).alias("k"), F.coalesce(pointer, key).alias("to"))
    bent = ~F.col("k").eqNullSafe(F.col("to"))
    first = cur = materialize(every.filter(bent), "pointers")
    for _ in range(max(1, cur.count()).bit_length() + 1):
        # A merge: files are compressed, so a table that looks small enough for every task's memory may not be.
        nxt = cur.join(cur.select(F.col("k").alias("_k"), F.col("to").alias("_t")).hint("merge"), F.col("to") == F.col("_k"), "left")
        nxt = materialize(nxt.select("k", F.coalesce("_t", "to").alias("to"), F.col("_t").isNotNull().alias("moved")), "pointers")
        moved = nxt.filter("moved").limit(1).count()
        if cur is not first:
            release(cur)
        cur = nxt
        if not moved:
            break
    # Doubling along a cycle never leaves it: an end that points on is in one.
    ring = [r.to for r in cur.join(first.select(F.col("k").alias("to")).hint("merge"), "to", "left_semi").select("to").distinct().orderBy("to").limit(5).collect()]
    release(first)
    if ring:
        raise ValueError(f"{pointer} has a cycle, among its rows {', '.join(map(str, ring))}")
    return every.filter(~bent).union(cur.select("k", "to")).toDF(key, "survivor")


def validate_hierarchy(df: DataFrame, ranks: dict[str, int], depth: int = 3) -> DataFrame:
    """(id, code): DCH01 own parent, DCH02 missing parent, DCH03 parent's grain doesn't outrank, DCH04 cycle, DCH05 too deep.

    A row's ancestors are followed for one level more than `depth` allows. A cycle is one that comes back to the row in
    these steps; a chain that goes on beyond them, a longer cycle among it, is too deep.
    """
    rank = F.lit(None).cast("int")
    for g, r in ranks.items():
        rank = F.when(F.col("grain") == g, r).otherwise(rank)
    n = df.select("id", "parent_id", rank.alias("r"))
    up = n.select(F.col("id").alias("_i"), F.col("parent_id").alias("_up"), F.col("r").alias("_r"))
    j = n.join(up, F.col("parent_id") == F.col("_i"), "left").withColumnsRenamed({"_i": "p1", "_r": "pr", "_up": "a2"})
    for k in range(2, depth + 1):
        j = j.join(up.drop("_r"), F.col(f"a{k}") == F.col("_i"), "left").drop("_i").withColumnRenamed("_up", f"a{k + 1}")
    own = F.col("parent_id") == F.col("id")
    back = F.lit(False)
    for k in range(2, depth + 2):
        back = back | F.coalesce(F.col(f"a{k}") == F.col("id"), F.lit(False))
    codes = F.array(
        F.when(own, "DCH01"),
        F.when(F.col("parent_id").isNotNull() & F.col("p1").isNull(), "DCH02"),
        F.when(~own & (F.col("pr") <= F.col("r")), "DCH03"),
        F.when(~own & back, "DCH04"),
        F.when(~own & ~back & F.col(f"a{depth + 1}").isNotNull(), "DCH05"),
    )
    return j.select("id", F.explode(F.filter(codes, lambda x: x.isNotNull())).alias("code"))


def resolve_mentions(mentions: DataFrame, anchors: DataFrame, min_conf: float = 0.90) -> DataFrame:
    """(mention_id, anchor_id, confidence, status, year) by normal name, narrowed by county, state and voltage."""
    m = mentions.withColumn("_n", normalize_station(F.col("name_frag"))).filter("_n is not null")
    a = anchors.withColumn("_n", normalize_station(F.col("anchor_name"))).select("_n", "anchor_id", "county", "state", F.col("kv").alias("akv"))
    j = m.join(a, "_n", "left")
    in_county, in_state = F.col("county") == F.col("county_hint"), F.col("state") == F.col("state_hint")
    close = F.abs(F.col("akv") - F.col("kv")) <= 1
    pick = lambda c: F.min(F.when(c, F.col("anchor_id")))
    g = j.groupBy("mention_id").agg(
        F.count_if(in_county).alias("nc"), F.count_if(in_state).alias("ns"), pick(in_county).alias("ac"), pick(in_county & close).alias("acv"), pick(in_state).alias("as_"),
        F.max("county_hint").alias("hint"), F.max("date_type").alias("date_type"), F.max("inservice_date").alias("date"),
    )
    conf = F.when((F.col("nc") == 1) & F.col("acv").isNotNull(), 0.97).when(F.col("nc") == 1, 0.95).when(F.col("nc") > 1, 0.85).when(F.col("hint").isNull() & (F.col("ns") == 1), 0.70).when(F.col("ns") >= 1, 0.60).otherwise(0.0)
    anchor = F.when(F.col("nc") >= 1, F.coalesce("acv", "ac")).otherwise(F.col("as_"))
    g = g.select("mention_id", anchor.alias("anchor_id"), conf.alias("confidence"), "date_type", "date")
    sure = F.col("anchor_id").isNotNull() & (F.col("confidence") >= min_conf)
    status = F.when(sure & (F.col("date_type") == "actual") & F.col("date").isNotNull(), "resolved").when(sure, "resolved_no_grade").otherwise("unresolved")
    return g.select("mention_id", "anchor_id", "confidence", status.alias("status"), F.when(status == "resolved", F.year("date")).alias("year"))


def anchor_years(resolved: DataFrame) -> DataFrame:
    """(anchor_id, year): of several mentions the most confident, then the latest year, then the least id."""
    r = resolved.filter("status = 'resolved'")
    return best_per_key(r, ["anchor_id"], [F.desc("confidence"), F.desc("year"), F.asc("mention_id")]).select("anchor_id", "year")


#: Multipliers of a source's confidence, best first; the last is for all others.
TIER_MULTIPLIER = (("VRF", 0.95), ("SRC", 0.85), ("INF", 0.60), ("EST", 0.40))


def _bare_county(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\s+county$", "")


def resolve_awards(awards: DataFrame, counties: DataFrame) -> DataFrame:
    """`awards` with jurisdiction_id, resolution_method, resolution_status, candidate_count: the county of its state by name.

    counties: jurisdiction_id, state, county, and active if some aren't. An award with a jurisdiction_id keeps it. An award
    without a county, or with one that isn't known, stays as unresolved, without candidates; of several counties of one name
    the least id is taken.
    """
    own = awards if "jurisdiction_id" in awards.columns else awards.withColumn("jurisdiction_id", F.lit(None).cast(counties.schema["jurisdiction_id"].dataType))
    live = counties.filter("active") if "active" in counties.columns else counties
    known = live.groupBy(F.col("state").alias("_s"), _bare_county(F.col("county")).alias("_k")).agg(F.min("jurisdiction_id").alias("_j"))
    j = own.join(known, (F.col("state") == F.col("_s")) & (_bare_county(F.col("county")) == F.col("_k")) & F.col("jurisdiction_id").isNull(), "left")
    new = F.col("_j").isNotNull()
    added = {
        "jurisdiction_id": F.coalesce("jurisdiction_id", "_j"),
        "resolution_method": F.when(new, "county_name"),
        "resolution_status": F.when(new | F.col("jurisdiction_id").isNotNull(), "resolved").otherwise("unresolved"),
        "candidate_count": F.when(new, 1).otherwise(F.when(F.col("jurisdiction_id").isNull(), 0)),
    }
    return j.select(*[c for c in own.columns if c not in added], *[v.alias(k) for k, v in added.items()])


def incentive_attributes(awards: DataFrame, counties: DataFrame, registry: DataFrame) -> DataFrame:
    """(county, attribute, value, confidence_tier, multiplier, source_level): five attributes of each county's awards, as JSON.

    awards: state, county, source_key, incentive_type, amount, term_years, term_start, term_end, program_name,
    statute_citation. counties: state, county. INC-01 presence and count, INC-02 types, INC-03 amounts, INC-04 terms,
    INC-05 programs and statutes. All carry the best tier among the sources, and primary if any source is. An
    unregistered source counts as estimated and primary.
    """
    a = awards.filter("county is not null").withColumn("_c", _bare_county(F.col("county")))
    c = counties.select(F.col("state").alias("_s"), _bare_county(F.col("county")).alias("_k"), F.col("county").alias("_name"))
    known = registry.select("source_key", "confidence", "source_kind")
    j = a.join(c, (F.col("state") == F.col("_s")) & (F.col("_c") == F.col("_k"))).join(known, "source_key", "left")
    mult = F.lit(TIER_MULTIPLIER[-1][1])
    for k, v in TIER_MULTIPLIER[:-1]:
        mult = F.when(F.col("confidence") == k, v).otherwise(mult)
    listed = lambda c: F.array_sort(F.collect_set(c))
    usd = F.col("amount").cast("decimal(18,2)")
    g = j.groupBy(F.col("_s").alias("state"), F.col("_name").alias("county")).agg(
        F.count("*").alias("n"), listed("incentive_type").alias("types"), F.sum(usd).cast("decimal(28,2)").alias("total"), F.max(usd).alias("top"), F.max("term_years").alias("years"), F.min("term_start").alias("first"),
        F.max("term_end").alias("last"), listed("program_name").alias("programs"), listed("statute_citation").alias("statutes"), F.max(mult).alias("multiplier"), F.bool_or(F.coalesce("source_kind", F.lit("primary")) == "primary").alias("primary"),
    )
    col, lit = F.col, F.lit
    values = {
        "INC-01": {"present": lit(True), "disclosure_count": col("n"), "state": col("state")},
        "INC-02": {"types": col("types"), "disclosure_count": col("n")},
        "INC-03": {"total_award_usd": col("total"), "max_award_usd": col("top"), "currency": lit("USD"), "record_count": col("n")},
        "INC-04": {"max_term_years": col("years"), "earliest_start": col("first"), "latest_end": col("last")},
        "INC-05": {"programs": col("programs"), "statutes": col("statutes")},
    }
    rows = F.explode(F.array(*[F.struct(lit(k).alias("attribute"), json_build(**v).alias("value")) for k, v in values.items()])).alias("r")
    tier = lit(TIER_MULTIPLIER[-1][0])
    for k, v in reversed(TIER_MULTIPLIER[:-1]):
        tier = F.when(col("multiplier") >= v, k).otherwise(tier)
    level = F.when(col("primary"), "primary").otherwise("aggregator")
    return g.select("county", rows, tier.alias("confidence_tier"), "multiplier", level.alias("source_level")).select("county", "r.attribute", "r.value", "confidence_tier", "multiplier", "source_level")


def merge_roster(curated: DataFrame, roster: DataFrame) -> DataFrame:
    """(company_id, norm, name, origin): curated companies first, then one roster company for each new normal name."""
    c = curated.select(normalize_company(F.col("name")).alias("norm"), "name", F.lit("curated").alias("origin"), F.lit(0).alias("rank"))
    r = roster.select(normalize_company(F.col("name")).alias("norm"), "name", F.lit("roster").alias("origin"), F.lit(1).alias("rank"))
    best = best_per_key(c.unionByName(r).filter("norm is not null"), ["norm"], [F.col("rank"), F.col("name")])
    return best.select(stable_id(F.col("norm"), "co_").alias("company_id"), "norm", "name", "origin")


def roster_aliases(companies: DataFrame, names: DataFrame, proposed: float = 0.92) -> DataFrame:
    """(name, company_id, how, approved): normal-name equality approved; trigram similarity proposed for what is left."""
    n = names.select("name", normalize_company(F.col("name")).alias("norm")).distinct()
    exact = n.join(companies.select("norm", "company_id"), "norm").select("name", "company_id", F.lit("normalized").alias("how"), F.lit(True).alias("approved"))
    rest = n.join(exact.select("name"), "name", "left_anti").filter("norm is not null")
    both = companies.select(F.concat(F.lit("c:"), "norm").alias("k"), "norm").unionByName(rest.select(F.concat(F.lit("n:"), "norm").alias("k"), "norm").distinct())
    near = trigram_pairs(both, proposed, "k", "norm").filter("a like 'c:%' and b like 'n:%'").select(F.expr("substr(a, 3)").alias("cn"), F.expr("substr(b, 3)").alias("norm"))
    hit = rest.join(near, "norm").join(companies.select(F.col("norm").alias("cn"), "company_id"), "cn")
    return exact.unionByName(hit.select("name", "company_id", F.lit("trigram").alias("how"), F.lit(False).alias("approved")))


def campus_keys(cands: DataFrame) -> DataFrame:
    """(id, campus_key, basis): by name stem, else by a street that one operator's candidates share; single keys go."""
    c = cands.withColumn("stem", campus_stem(F.col("name"))).withColumn("op", normalize_operator(F.col("operator")))
    key = F.when(F.col("stem").isNotNull(), F.concat_ws("|", F.lit("stem"), F.lower("stem"))).when(F.col("street").isNotNull() & F.col("op").isNotNull(), F.concat_ws("|", F.lit("addr"), F.lower("street"), "op"))
    k = c.select("id", key.alias("campus_key"), F.when(F.col("stem").isNotNull(), "name_stem").otherwise("shared_address").alias("basis")).filter("campus_key is not null")
    n = k.groupBy("campus_key").agg(F.count("*").alias("n"))
    return k.join(n, "campus_key").filter("basis = 'name_stem' or n >= 2").select("id", "campus_key", "basis")


def grain_from_name(df: DataFrame, name: str) -> DataFrame:
    n = F.col(name)
    return df.withColumn("declared_grain", F.when(n.rlike(r"(?i)\bcampus\b"), "campus").when(n.rlike(r"(?i)\b(building|bldg)\b"), "building").otherwise(F.lit(None)))


def is_identified(name: Column, operator: Column, lat: Column, street: Column) -> Column:
    """Whether a subject is known well enough to mint an entity."""
    return name.isNotNull() & (F.length(F.trim(name)) > 2) & (operator.isNotNull() | lat.isNotNull() | street.isNotNull())


def group_buildings(cands: DataFrame, existing: DataFrame, radius_m: float = 100) -> DataFrame:
    """(building, n, attached_to): candidates by resolved id, else street and zip; each group attached to an existing site within the radius."""
    key = F.coalesce(F.concat(F.lit("id:"), F.col("resolved_id").cast("string")), F.concat_ws("|", F.lower("street"), "zip"))
    g = cands.withColumn("building", key).groupBy("building").agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))
    pts = g.select(F.concat(F.lit("b:"), "building").alias("site_id"), "lat", "lng").unionByName(existing.select(F.concat(F.lit("e:"), F.col("site_id").cast("string")).alias("site_id"), "lat", "lng"))
    near = geo_pairs(pts, radius_m).filter("a like 'b:%' and b like 'e:%'")
    best = best_per_key(near, ["a"], [F.asc("distance_m"), F.asc("b")]).select(F.expr("substr(a, 3)").alias("building"), F.expr("substr(b, 3)").alias("attached_to"))
    return g.join(best, "building", "left").select("building", "n", "attached_to")


def link_operators(fac: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facility-company links by normal name, facilities without)."""
    f = fac.withColumn("_n", normalize_operator(F.col("operator")))
    c = companies.select(normalize_operator(F.col("name")).alias("_n"), "company_id").filter("_n is not null").groupBy("_n").agg(F.min("company_id").alias("company_id"))
    return f.join(c, "_n").drop("_n"), f.join(c.select("_n"), "_n", "left_anti").drop("_n")


#: The form of a postcode after the country's name, by the country's code.
POSTCODES = {"SG": r"[0-9]{6}", "TW": r"[0-9]{3}", "DE": r"[0-9]{5}"}


def resolve_country(df: DataFrame, column: str, names: DataFrame, postcodes: dict[str, str] | None = None) -> DataFrame:
    """`iso2` from country text: the code of its name, or of its name before a postcode of this country's form; else null.

    names: (name, code), a table of names in any language, which the caller gives; case and blanks around don't count, accents
    do. A name with several codes has none.
    """
    known = names.select(F.lower(F.trim("name")).alias("_n"), F.col("code").alias("_c")).groupBy("_n").agg(F.when(F.countDistinct("_c") == 1, F.min("_c")).alias("_c"))
    forms = F.create_map(*[F.lit(v) for pair in (postcodes or POSTCODES).items() for v in pair])
    text = F.lower(F.trim(F.col(column)))
    head, tail = F.regexp_extract(text, r"^(.*\S)\s+([0-9][0-9a-z -]*)$", 1), F.regexp_extract(text, r"^(.*\S)\s+([0-9][0-9a-z -]*)$", 2)
    known = small(materialize(known, "names"), 10_000)
    j = df.withColumns({"_text": text, "_head": head}).join(known.withColumnsRenamed({"_n": "_text", "_c": "_whole"}), "_text", "left").join(known.withColumnsRenamed({"_n": "_head", "_c": "_part"}), "_head", "left")
    fits = F.rlike(tail, F.concat(F.lit("^("), F.try_element_at(forms, F.col("_part")), F.lit(")$")))
    return j.select(*df.columns, F.coalesce("_whole", F.when(fits, F.col("_part"))).alias("iso2"))


def normalize_plan_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(projects, mentions) of plan rows (id, title, section, status)."""
    from lodestone.functions import values as vl

    t = F.col("title")
    p = df.select("id", t.alias("title"), vl.extract_kv(t).alias("kv"), vl.extract_county(t).alias("county"), vl.classify_driver(t).alias("driver"), vl.is_large_load(t).alias("large_load"), vl.classify_date_type(F.col("section"), F.col("status")).alias("date_type"), vl.extract_station_names(t).alias("names"))
    return p.drop("names"), p.select("id", F.posexplode("names").alias("pos", "name_frag"), "kv", "county", "date_type")


def normalize_dockets(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(projects, mentions) of the dockets (id, title, state, county_fips) that screening keeps; the title's date never grades.

    A project's content_hash is over its id, names, voltage and kind of date; a mention's over its id and name. The dates
    stay null until a document gives them.
    """
    from lodestone.functions import dockets as dk
    from lodestone.functions import values as vl

    t = F.coalesce(F.trim(F.regexp_replace("title", "&#9;", " ")), F.lit(""))
    p = df.select("id", "title", "state", "county_fips", dk.screen_docket(F.col("title")).alias("s")).filter("s.is_candidate")
    p = p.select("id", "title", "state", "county_fips", "s.names", "s.is_siting", vl.extract_kv(t).alias("kv"), dk.docket_county(t).alias("county_raw"), dk.docket_date_type(t).alias("date_type"), t.alias("_t"))
    ident = F.col("id").cast("string")
    digest = F.sha2(F.concat_ws("|", ident, F.array_join("names", "|"), F.coalesce(F.col("kv").cast("string"), F.lit("")), "date_type"), 256)
    projects = p.select(
        "id", F.col("title").alias("project_name"), "state", "county_fips", "county_raw", "kv", F.array_join("names", "|").alias("names"), F.when(F.col("is_siting"), "reliability").alias("driver"),
        F.col("_t").rlike("(?i)data center|large load").alias("large_load"), F.col("_t").rlike("(?i)tariff|rate class|large load").alias("tariff"), "date_type",
        F.when(F.col("is_siting"), "approved").alias("status"), F.when(F.col("date_type") == "actual", "SRC").otherwise("EST").alias("tier"), digest.alias("content_hash"),
    )
    m = p.select("id", F.posexplode("names").alias("pos", "name_frag"), "kv", "state", "county_fips", "date_type")
    sure = F.when(F.col("date_type") == "actual", 0.85).otherwise(0.30)
    return projects, m.withColumns({"inservice_date": F.lit(None).cast("date"), "confidence": sure, "content_hash": F.sha2(F.concat_ws("|", F.lit("puc"), ident, "name_frag"), 256)})


def link_entities(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(doc_id, entity_id): distinct entities whose name or alias a document mentions."""
    a = aliases.select(F.lower("alias").alias("_a"), "entity_id").distinct()
    return mentions.join(a, F.lower(F.trim("name")) == F.col("_a")).select("doc_id", "entity_id").distinct()
