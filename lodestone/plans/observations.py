"""Queries over observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import observations as ob
from lodestone.plans.base import VIEWS, query, view
from lodestone.plans.fixtures import AS_OF
from lodestone.plans.functions import LAYER
from lodestone.storage import materialize

view("agree_in", """
SELECT entity_id, attribute, lineage, source_class, coalesce(capacity_basis, '-') AS basis,
  CASE attribute WHEN 'coordinates' THEN concat(CAST(round(lat, 3) AS STRING), '|', CAST(round(lng, 3) AS STRING))
    WHEN 'capacity' THEN CAST(round(value_num, 1) AS STRING) ELSE lower(value_text) END AS bucket
FROM v1 WHERE NOT retracted""", "v1")


def _points(name: str, news: bool) -> None:
    where = "" if news else "AND source_class <> 'news'"
    view(name, f"""
SELECT entity_id, CAST(CASE WHEN count(DISTINCT CASE WHEN n >= 2 THEN attribute END) = 0 THEN 0 ELSE
  floor(15.0 * count(DISTINCT CASE WHEN most >= 2 THEN attribute END) / count(DISTINCT CASE WHEN n >= 2 THEN attribute END)) END AS BIGINT) AS points
FROM (SELECT g.entity_id, g.attribute, g.basis, g.n, m.most FROM
  (SELECT entity_id, attribute, basis, count(DISTINCT lineage) AS n FROM agree_in WHERE bucket IS NOT NULL {where} GROUP BY 1, 2, 3) g
  JOIN (SELECT entity_id, attribute, basis, max(k) AS most FROM (SELECT entity_id, attribute, basis, bucket, count(DISTINCT lineage) AS k
    FROM agree_in WHERE bucket IS NOT NULL {where} GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) m
  ON g.entity_id = m.entity_id AND g.attribute = m.attribute AND g.basis = m.basis)
GROUP BY entity_id""", "agree_in")


_points("points_real", False)
_points("points_all", True)

view("gate", """
SELECT entity_id, count(DISTINCT lineage) AS n_lineages, bool_or(source_class = 'official_record') AS has_official,
  count(DISTINCT lineage) >= 3 AND bool_or(source_class = 'official_record') AS publishable
FROM v1 WHERE NOT retracted AND redistributable AND source_class <> 'news' GROUP BY entity_id""", "v1")

view("parts", f"""
SELECT e.entity_id, CAST(CASE WHEN coalesce(n, 0) >= 4 THEN 45 WHEN n = 3 THEN 40 WHEN n = 2 THEN 30 WHEN n = 1 THEN 18 ELSE 0 END AS BIGINT) AS lineage_pts,
  CAST(CASE WHEN official THEN 15 ELSE 0 END AS BIGINT) AS official_pts, coalesce(r.points, 0) AS agree_pts, coalesce(w.points, 0) AS agree_all_pts,
  CAST(CASE WHEN DATE '{AS_OF}' - latest <= 180 THEN 10 WHEN DATE '{AS_OF}' - latest <= 365 THEN 6 WHEN DATE '{AS_OF}' - latest <= 730 THEN 3 ELSE 0 END AS BIGINT) AS fresh_pts,
  CAST(CASE geo_precision WHEN 'parcel' THEN 15 WHEN 'address' THEN 10 WHEN 'centroid' THEN 5 WHEN 'municipality' THEN 2 ELSE 0 END AS BIGINT) AS place_pts
FROM entities e LEFT JOIN (SELECT entity_id, count(DISTINCT CASE WHEN source_class <> 'news' THEN lineage END) AS n,
    bool_or(source_class = 'official_record') AS official, max(CASE WHEN source_class <> 'news' THEN observed_at END) AS latest
  FROM v1 WHERE NOT retracted GROUP BY entity_id) o ON e.entity_id = o.entity_id
LEFT JOIN points_real r ON e.entity_id = r.entity_id LEFT JOIN points_all w ON e.entity_id = w.entity_id""", "entities", "points_real", "points_all")

view("scored", """
SELECT *, CAST(greatest(0, least(100, lineage_pts + official_pts + fresh_pts + place_pts + agree_pts + least(5, greatest(0, agree_all_pts - agree_pts)))) AS BIGINT) AS score
FROM parts""", "parts")

view("best", """
SELECT * FROM (SELECT o.*, k.lineages, row_number() OVER (PARTITION BY o.entity_id, o.attribute ORDER BY
    CASE cap WHEN 'VRF' THEN 4 WHEN 'SRC' THEN 3 WHEN 'INF' THEN 2 ELSE 1 END DESC, observed_at DESC, k.lineages DESC, ingested_at DESC, obs_id) AS rn
  FROM v1 o JOIN (SELECT entity_id, attribute, value_text, value_num, lat, lng, count(DISTINCT lineage) AS lineages
    FROM v1 WHERE NOT retracted AND NOT superseded GROUP BY 1, 2, 3, 4, 5, 6) k
  ON o.entity_id = k.entity_id AND o.attribute = k.attribute AND o.value_text IS NOT DISTINCT FROM k.value_text AND o.value_num IS NOT DISTINCT FROM k.value_num
    AND o.lat IS NOT DISTINCT FROM k.lat AND o.lng IS NOT DISTINCT FROM k.lng
  WHERE NOT retracted AND NOT superseded) WHERE rn = 1""", "v1")

view("v1free", "SELECT * FROM v1 WHERE redistributable", "v1")
view("bestfree", VIEWS["best"][0].replace("FROM v1", "FROM v1free"), "v1free")

PIVOT = """max(CASE WHEN attribute = 'name' THEN value_text END) AS name, max(CASE WHEN attribute = 'operator' THEN value_text END) AS operator,
  max(CASE WHEN attribute = 'coordinates' THEN lat END) AS lat, max(CASE WHEN attribute = 'coordinates' THEN lng END) AS lng,
  max(CASE WHEN attribute = 'capacity' THEN value_num END) AS capacity, max(CASE WHEN attribute = 'capacity' THEN capacity_basis END) AS capacity_basis"""


@query("SELECT s.*, b.band FROM scored s LEFT JOIN bands b ON s.score BETWEEN b.lo AND b.hi", "scored", "bands")
def e1_confidence(d):
    return ob.confidence(d.entities, d.v1, d.bands, AS_OF)


@query("SELECT * FROM points_real", "points_real")
def e2_agreement_points(d):
    return ob.agreement_points(d.v1)


@query("SELECT * FROM gate", "gate")
def e3_publishable(d):
    return ob.publishable(d.v1)


@query(f"SELECT e.entity_id, {PIVOT}, CAST(sum(lineages) AS BIGINT) AS resolved_lineages, bool_or(NOT redistributable) AS has_restricted_input FROM entities e LEFT JOIN best b ON e.entity_id = b.entity_id GROUP BY e.entity_id", "entities", "best")
def e5_current_view(d):
    return ob.current_view(d.entities, d.v1)


@query(f"""SELECT e.entity_id, {PIVOT}, any_value(c.citations) AS citations FROM entities e JOIN gate g ON e.entity_id = g.entity_id AND g.publishable LEFT JOIN bestfree b ON e.entity_id = b.entity_id
LEFT JOIN (SELECT entity_id, concat('[', string_agg(concat('{{"source_id":', CAST(source_id AS STRING), ',"source_class":"', source_class, '"}}'), ',' ORDER BY source_id, source_class), ']') AS citations
  FROM (SELECT DISTINCT entity_id, source_id, source_class FROM v1free WHERE NOT retracted AND NOT superseded) GROUP BY entity_id) c ON e.entity_id = c.entity_id GROUP BY e.entity_id""", "entities", "gate", "bestfree")
def e5_public_view(d):
    return ob.public_view(d.entities, d.v1)


view("recomputed", f"""SELECT e.*, {LAYER} AS layer, s.score, b.band, coalesce(g.publishable, false) AS publishable FROM entities e JOIN scored s ON e.entity_id = s.entity_id LEFT JOIN bands b ON s.score BETWEEN b.lo AND b.hi LEFT JOIN gate g ON e.entity_id = g.entity_id""", "entities", "scored", "bands", "gate")
MOVED = "(layer IS DISTINCT FROM old_layer OR score IS DISTINCT FROM old_score OR band IS DISTINCT FROM old_band OR publishable IS DISTINCT FROM old_publishable)"


def _stored(d, new):
    """The entities, a third of them with the values that they should have."""
    keep = new.filter("entity_id % 3 = 0").select("entity_id", F.lit(True).alias("_same"), *[F.col(c).alias(f"_{c}") for c in ("layer", "score", "band", "publishable")])
    e = d.entities.join(keep, "entity_id", "left")
    return e.select("entity_id", "geo_precision", "lifecycle", *[F.when(F.col("_same"), F.col(f"_{c}")).otherwise(F.col(f"old_{c}")).alias(f"old_{c}") for c in ("layer", "score", "band", "publishable")])


@query(f"SELECT count(*) AS seen, count(*) FILTER (entity_id % 3 <> 0 AND {MOVED}) AS changed, count(*) FILTER (publishable) AS publishable FROM recomputed", "recomputed")
def e6_recompute_stats(d):
    new = materialize(ob.verdicts(d.entities, d.v1, d.bands, AS_OF), "verdicts")  # once, for both uses
    return ob.recompute(_stored(d, new), d.v1, d.bands, AS_OF, new)[1]


@query(f"SELECT entity_id, layer, old_score, score, band, publishable FROM recomputed WHERE {MOVED}", "recomputed")
def e6_recompute(d):
    return ob.recompute(d.entities, d.v1, d.bands, AS_OF)[0]


@query("SELECT entity_id, attribute, obs_id, CAST(lineages AS BIGINT) AS lineages FROM best", "best")
def w1_best_claims(d):
    return ob.best_claims(d.v1).select("entity_id", "attribute", "obs_id", "lineages")


@query(f"SELECT entity_id, {PIVOT} FROM best GROUP BY entity_id", "best")
def a3_pivot_attributes(d):
    return ob.pivot_attributes(ob.best_claims(d.v1), ob.SPEC)


@query("SELECT count(*) AS n, count(DISTINCT obs_id) AS ids FROM v1 WHERE NOT retracted AND NOT superseded AND entity_id IS NOT NULL", "v1")
def p12_live(d):
    return ob.live(d.v1).agg(F.count("*").alias("n"), F.countDistinct("obs_id").alias("ids"))


@query("SELECT source_id, bool_or(license_status IN ('cleared', 'attribution_required')) AS redistributable, count(*) AS n FROM v1 JOIN registry USING (source_id) GROUP BY source_id", "v1", "registry")
def p13_stamp_redistributable(d):
    return ob.stamp_redistributable(d.v1, d.registry).groupBy("source_id").agg(F.bool_or("redistributable").alias("redistributable"), F.count("*").alias("n"))


@query("""SELECT c_custkey, 'c_name' AS attribute, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer
UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS STRING) FROM customer""")
def j9_unpivot_attrs(d):
    return ob.unpivot_attrs(d.customer, ["c_custkey"], ["c_name", "c_mktsegment", "c_nationkey"])


@query("SELECT 'name' AS attribute, count(name) AS n FROM w UNION ALL SELECT 'operator', count(operator) FROM w UNION ALL SELECT 'capacity', count(capacity) FROM w".replace("FROM w", f"FROM (SELECT entity_id, {PIVOT} FROM best GROUP BY entity_id)"), "best")
def a15_coverage_counts(d):
    return ob.coverage_counts(ob.pivot_attributes(ob.best_claims(d.v1), ob.SPEC), ["name", "operator", "capacity"])


@query("SELECT entity_id, string_agg(DISTINCT concat(lineage, ':', source_class), ',' ORDER BY concat(lineage, ':', source_class)) AS citations FROM v1 WHERE NOT retracted AND NOT superseded GROUP BY entity_id", "v1")
def a10_citations(d):
    cite = F.concat_ws(":", "lineage", "source_class")
    return ob.live(d.v1).groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set(cite)), ",").alias("citations"))


@query("""SELECT obs_id, 'deleted' AS violation FROM v1 WHERE source_id % 50 = 1 UNION ALL SELECT obs_id, 'frozen_changed' FROM v1 WHERE source_id % 50 = 2
UNION ALL SELECT obs_id, 'subject_changed' FROM v1 WHERE source_id % 50 = 3""", "v1")
def e13_validate_append_only(d):
    k = F.col("source_id") % 50
    after = d.v1.filter(k != 1).withColumn("lineage", F.when(k == 2, "changed").otherwise(F.col("lineage"))).withColumn("entity_id", F.when(k == 3, -1 - F.col("entity_id")).otherwise(F.col("entity_id")))
    return ob.validate_append_only(d.v1, after, "obs_id", ["lineage", "attribute", "value_text", "value_num"], "entity_id")


@query("SELECT 'only_left' AS side, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'only_right', CAST(0 AS BIGINT)")
def e22_round_trip(d):
    kinds = {"c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}
    wide = d.customer.select("c_custkey", *kinds)
    return ob.diff_both_ways(wide, ob.from_observations(ob.unpivot_attrs(wide, ["c_custkey"], list(kinds)), ["c_custkey"], kinds))


@query("""SELECT 'only_left' AS side, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem EXCEPT ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 25)
UNION ALL SELECT 'only_right', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 25 EXCEPT ALL SELECT l_orderkey, l_linenumber FROM lineitem)""")
def u3_diff_both_ways(d):
    key = d.lineitem.select("l_orderkey", "l_linenumber")
    return ob.diff_both_ways(key, d.lineitem.filter("l_quantity < 25").select("l_orderkey", "l_linenumber"))
