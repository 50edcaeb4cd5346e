"""Queries over matching, hierarchy and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import dockets as dk
from lodestone.operators import entities as en
from lodestone.operators.joins import large
from lodestone.plans.base import query, view
from lodestone.plans.joins import HAV
from lodestone.storage import materialize

GR = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^\\pL\\pN]+'), lambda w: w <> ''), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3)))))"
SIM = "(len(list_intersect({a}, {b})) * 1.0 / (len({a}) + len({b}) - len(list_intersect({a}, {b}))))"

#: Sites with operators' parents and two spellings of an operator, without a name or operator here and there, some superseded; ids that agree modulo 300 are near.
view("msites", """SELECT site_id, CASE WHEN site_id % 11 <> 0 THEN concat('Site ', coalesce(operator, ''), ' ', CAST(site_id % 3 AS STRING)) END AS name, operator,
 CASE operator WHEN 'AUTOMOBILE' THEN 'Motor Works, Inc.' WHEN 'MACHINERY' THEN 'Motor Works' END AS operator_parent, country, subdivision, lat, lng, parent_id, superseded_by, score, discovered_at, public_id
 FROM (SELECT site_id, CASE WHEN site_id % 13 <> 0 THEN CASE site_id % 7 WHEN 1 THEN concat(operator, ' regional distribution centers') WHEN 2 THEN concat(operator, ' regional distribution center') ELSE operator END END AS operator,
  CASE WHEN site_id % 19 <> 0 THEN country END AS country, subdivision, CASE WHEN site_id % 9 <> 0 THEN 30 + (site_id % 300) * 0.03 END AS lat, -100 + (site_id % 7) * 0.001 AS lng, parent_id, CASE WHEN site_id % 17 = 0 THEN site_id - 1 END AS superseded_by,
  site_id % 7 AS score, CAST(CASE WHEN site_id % 3 <> 0 THEN concat('2024-01-0', CAST(1 + site_id % 5 AS STRING)) END AS DATE) AS discovered_at, concat('P-', CAST(site_id AS STRING)) AS public_id FROM v3)""", "v3")
#: Two identifiers a site, one of them frequent.
view("site_ids", """SELECT site_id, 's1' AS source_key, CAST(external_id AS STRING) AS external_id FROM v3 WHERE external_id IS NOT NULL
 UNION ALL SELECT site_id, 's2', concat('F', CAST(site_id % 11 AS STRING)) FROM v3 WHERE site_id % 4 = 0 UNION ALL SELECT site_id, 's1', concat('F', CAST(site_id % 3 AS STRING)) FROM v3 WHERE site_id % 50 = 1""", "v3")

#: What the matcher compares: names' words, names without their operators, operators' parents.
FACTS = f"""(SELECT *, lower(operator) AS op, coalesce(CASE WHEN operator_parent IS NOT NULL THEN 'motor works' END, lower(operator)) AS par, {GR.format(c='norm_name')} AS g, {GR.format(c='site_name')} AS sg, {GR.format(c='operator')} AS og, regexp_extract(name, '[0-9]*$') AS q FROM
 (SELECT *, coalesce(nullif(trim(replace(concat(' ', norm_name, ' '), concat(' ', lower(operator), ' '), ' ')), ''), norm_name) AS site_name FROM (SELECT *, nullif(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), '') AS norm_name FROM msites WHERE superseded_by IS NULL)))"""


def _matched(auto: float, queue: float, near: int) -> str:
    """Every pair of sites that a blocking rule finds outside a family, scored: scores without facts are left out with their weights."""
    return f"""(SELECT *, CASE WHEN match >= {auto} AND NOT qualifier_conflict AND close THEN 'auto_merged' WHEN match >= {queue} THEN 'queued' ELSE 'rejected' END AS decision,
  CASE WHEN match >= {auto} THEN CASE WHEN qualifier_conflict THEN 'score>={auto} but site-qualifier conflict - demoted to review' WHEN NOT close THEN 'score>={auto} but no coordinate agreement or external-ID match - demoted to review'
   WHEN external_id_match THEN 'score>={auto} with external-ID match' ELSE 'score>={auto} with coordinate agreement ' || CAST(distance_m AS VARCHAR) || 'm' END WHEN match >= {queue} THEN 'score in queue band - human review' ELSE 'score below queue threshold' END AS why FROM
 (SELECT *, round((coalesce(0.35 * score_name, 0) + coalesce(0.30 * score_geo, 0) + coalesce(0.20 * score_operator, 0) + coalesce(0.10 * score_external, 0) + 0.05)
    / (CASE WHEN score_name IS NULL THEN 0 ELSE 0.35 END + CASE WHEN score_geo IS NULL THEN 0 ELSE 0.30 END + CASE WHEN score_operator IS NULL THEN 0 ELSE 0.20 END + CASE WHEN score_external IS NULL THEN 0 ELSE 0.10 END + 0.05) + 1e-9, 4) AS match,
   external_id_match OR coalesce(distance_m <= {near}, false) AS close FROM
  (SELECT *, round(dist, 1) AS distance_m, round(exp(-dist / 500), 4) AS score_geo, CASE WHEN external_id_match THEN 1.0::DOUBLE END AS score_external, 1.0::DOUBLE AS score_lifecycle,
    array_to_string(list_filter([CASE WHEN same_country AND dist <= 2000 THEN 'geo_2km' END, CASE WHEN same_country AND sim >= 0.45 THEN 'name_trgm' END, CASE WHEN same_op AND same_sub THEN 'operator_subdivision' END], lambda x: x IS NOT NULL), ',') AS reasons FROM
   (SELECT a.site_id AS a, b.site_id AS b, {SIM.format(a='a.g', b='b.g')} AS sim, round({SIM.format(a='a.sg', b='b.sg')}, 4) AS score_name, {HAV.format(a='a', b='b')} AS dist, a.country IS NOT DISTINCT FROM b.country AS same_country, a.op = b.op AS same_op, a.subdivision = b.subdivision AS same_sub,
     CASE WHEN a.op IS NULL OR b.op IS NULL THEN NULL WHEN a.op = b.op THEN 1.0::DOUBLE WHEN a.par = b.par THEN 0.75::DOUBLE WHEN {SIM.format(a='a.og', b='b.og')} >= 0.8 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS score_operator,
     a.q IS DISTINCT FROM b.q AS qualifier_conflict, coalesce(list_has_any(a.ids, b.ids), false) AS external_id_match
    FROM (SELECT * FROM {FACTS} LEFT JOIN (SELECT site_id, list(source_key || ':' || external_id) AS ids FROM site_ids GROUP BY site_id) USING (site_id)) a JOIN (SELECT * FROM {FACTS} LEFT JOIN (SELECT site_id, list(source_key || ':' || external_id) AS ids FROM site_ids GROUP BY site_id) USING (site_id)) b ON a.site_id < b.site_id
    WHERE NOT (coalesce(a.parent_id = b.site_id, false) OR coalesce(b.parent_id = a.site_id, false) OR coalesce(a.parent_id = b.parent_id, false)))) WHERE reasons <> ''))"""


@query(f"SELECT a, b, reasons, distance_m, score_name, score_geo, score_operator, score_external, score_lifecycle, match, external_id_match, qualifier_conflict, decision, why FROM {_matched(0.92, 0.70, 250)}", "msites", "site_ids")
def e7_match_entities(d):
    return en.match_entities(d.msites, identifiers=d.site_ids)


MERGED = f"""(SELECT surviving, merged, 'P-' || CAST(merged AS VARCHAR) AS merged_public_id, match AS match_score, 'auto' AS method, why AS reason, 'matcher' AS actor, CAST(NULL AS TIMESTAMP) AS reversed_at FROM (SELECT *, row_number() OVER (PARTITION BY merged ORDER BY s DESC, f NULLS LAST, surviving) AS rn FROM
 (SELECT CASE WHEN a_wins THEN b ELSE a END AS merged, CASE WHEN a_wins THEN a ELSE b END AS surviving, CASE WHEN a_wins THEN sa ELSE sb END AS s, CASE WHEN a_wins THEN fa ELSE fb END AS f, match, why FROM
  (SELECT m.*, x.score AS sa, y.score AS sb, x.discovered_at AS fa, y.discovered_at AS fb, x.score > y.score OR (x.score = y.score AND (coalesce(x.discovered_at, DATE '9999-01-01') < coalesce(y.discovered_at, DATE '9999-01-01') OR (x.discovered_at IS NOT DISTINCT FROM y.discovered_at AND m.a < m.b))) AS a_wins
   FROM {_matched(0.8, 0.6, 500)} m JOIN msites x ON m.a = x.site_id JOIN msites y ON m.b = y.site_id WHERE decision = 'auto_merged'))) WHERE rn = 1)"""


def _applied(d):
    return en.match_and_merge(d.msites, d.site_ids, en.MatchConfig(auto=0.8, queue=0.6, auto_distance_m=500))


@query(f"SELECT * FROM {MERGED}", "msites", "site_ids")
def e8_apply_merges(d):
    """The audit of the merges."""
    return _applied(d)[1]


@query(f"SELECT s.site_id, s.name, coalesce(s.superseded_by, m.surviving) AS superseded_by FROM msites s LEFT JOIN {MERGED} m ON s.site_id = m.merged", "msites", "site_ids")
def e8_merged_entities(d):
    """The entities with their pointers."""
    return _applied(d)[0].select("site_id", "name", "superseded_by")


@query(f"SELECT surviving, merged, CASE WHEN merged % 2 = 0 THEN TIMESTAMP '2024-06-01' END AS reversed_at, CASE WHEN merged % 2 = 1 THEN surviving END AS superseded_by FROM {MERGED}", "msites", "site_ids")
def e8_reversed_merges(d):
    """Merges of even ids taken back: the audit, beside what the entities point to."""
    entities, merges = _applied(d)
    merges = materialize(merges, "merges")
    entities, audit = en.reverse_merges(entities, merges, merges.filter("merged % 2 = 0"), F.lit("2024-06-01").cast("timestamp_ntz").cast("timestamp"))
    return audit.select("surviving", "merged", "reversed_at").join(large(entities.select(F.col("site_id").alias("merged"), "superseded_by")), "merged")


@query(f"SELECT n, flagged, CASE WHEN n > 0 THEN flagged / n ELSE 0.0::DOUBLE END AS share, CASE WHEN n > 0 THEN flagged / n ELSE 0 END <= 0.25 AS ok FROM (SELECT count(*) AS n, count(*) FILTER (decision = 'auto_merged') AS flagged FROM {_matched(0.8, 0.6, 500)})", "msites", "site_ids")
def q6_check_share(d):
    return en.merge_rail(d.msites, d.site_ids, en.MatchConfig(auto=0.8, queue=0.6, auto_distance_m=500))


@query("""WITH RECURSIVE walk AS (SELECT id, id AS root, 0 AS depth, grain AS root_grain FROM v7 WHERE parent_id IS NULL AND superseded_by IS NULL
 UNION ALL SELECT f.id, w.root, w.depth + 1, w.root_grain FROM v7 f JOIN walk w ON f.parent_id = w.id WHERE w.depth < 3 AND f.superseded_by IS NULL) SELECT * FROM walk""", "v7")
def e9_resolve_tree(d):
    return en.resolve_tree(d.v7, "id", "parent_id")


@query("SELECT count(*) FILTER (superseded_by IS NULL AND parent_id IS NULL) AS roots, count(*) FILTER (superseded_by IS NULL) AS live, count(*) FILTER (superseded_by IS NOT NULL) AS superseded, count(*) FILTER (superseded_by IS NULL AND parent_id IS NULL AND publishable) AS public_roots, count(*) FILTER (superseded_by IS NULL AND grain = 'building') AS buildings FROM v7", "v7")
def e10_inventory_counts(d):
    return en.inventory_counts(d.v7)


@query("SELECT id, CASE WHEN id % 97 = 0 AND id > 97 THEN CAST(97 AS BIGINT) ELSE id END AS survivor FROM v7", "v7")
def e11_resolve_superseded(d):
    return en.resolve_superseded(d.v7, "id", "superseded_by")


RANK = "CASE {g} WHEN 'campus' THEN 3 WHEN 'site' THEN 2 ELSE 1 END"
#: v7bad with rings of three to six and chains of five hung onto it.
view("rings", """SELECT * FROM v7bad UNION ALL SELECT -10 * (10 * p_partkey + i) - n AS id, CASE i % 3 WHEN 0 THEN 'campus' WHEN 1 THEN 'site' ELSE 'building' END AS grain, CASE WHEN i < n THEN -10 * (10 * p_partkey + i + 1) - n WHEN n < 7 THEN -10 * (10 * p_partkey + 1) - n END AS parent_id
 FROM (SELECT p_partkey, 3 + p_partkey % 5 AS n FROM part WHERE p_partkey % 20 = 0) r JOIN (VALUES (1), (2), (3), (4), (5), (6), (7)) AS s(i) ON i <= n""", "v7bad")


@query(f"""WITH w AS (SELECT n.id, n.parent_id, n.grain, p.id AS pid, p.grain AS pgrain, p.parent_id AS a2, q.parent_id AS a3, r.parent_id AS a4 FROM rings n LEFT JOIN rings p ON n.parent_id = p.id LEFT JOIN rings q ON p.parent_id = q.id LEFT JOIN rings r ON q.parent_id = r.id),
 c AS (SELECT *, parent_id = id AS own, coalesce(a2 = id, false) OR coalesce(a3 = id, false) OR coalesce(a4 = id, false) AS back FROM w)
SELECT id, 'DCH01' AS code FROM c WHERE own UNION ALL SELECT id, 'DCH02' FROM c WHERE parent_id IS NOT NULL AND pid IS NULL
UNION ALL SELECT id, 'DCH03' FROM c WHERE NOT own AND pid IS NOT NULL AND {RANK.format(g='pgrain')} <= {RANK.format(g='grain')}
UNION ALL SELECT id, 'DCH04' FROM c WHERE NOT own AND back UNION ALL SELECT id, 'DCH05' FROM c WHERE NOT own AND NOT back AND a4 IS NOT NULL""", "rings")
def e12_validate_hierarchy(d):
    return en.validate_hierarchy(d.rings, {"campus": 3, "site": 2, "building": 1})


MENTIONS = """SELECT mention_id, CASE WHEN nc >= 1 THEN coalesce(acv, ac) ELSE as_ END AS anchor_id, CAST(CASE WHEN nc = 1 AND acv IS NOT NULL THEN 0.97 WHEN nc = 1 THEN 0.95 WHEN nc > 1 THEN 0.85 WHEN hint IS NULL AND ns = 1 THEN 0.70 WHEN ns >= 1 THEN 0.60 ELSE 0 END AS DOUBLE) AS confidence, date_type, d FROM
 (SELECT mention_id, count(*) FILTER (a.county = m.county_hint) AS nc, count(*) FILTER (a.state = m.state_hint) AS ns, min(anchor_id) FILTER (a.county = m.county_hint) AS ac,
  min(anchor_id) FILTER (a.county = m.county_hint AND abs(a.kv - m.kv) <= 1) AS acv, min(anchor_id) FILTER (a.state = m.state_hint) AS as_, max(county_hint) AS hint, max(date_type) AS date_type, max(inservice_date) AS d
 FROM v6 m LEFT JOIN anchors a ON lower(m.name_frag) = lower(a.anchor_name) GROUP BY mention_id)"""


@query(f"SELECT mention_id, anchor_id, confidence, CASE WHEN anchor_id IS NOT NULL AND confidence >= 0.9 THEN CASE WHEN date_type = 'actual' AND d IS NOT NULL THEN 'resolved' ELSE 'resolved_no_grade' END ELSE 'unresolved' END AS status FROM ({MENTIONS})", "v6", "anchors")
def e14_resolve_mentions(d):
    return en.resolve_mentions(d.v6, d.anchors).drop("year")


@query(f"SELECT anchor_id, CAST(year(d) AS INTEGER) AS year FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY confidence DESC, year(d) DESC, mention_id) AS rn FROM ({MENTIONS}) WHERE anchor_id IS NOT NULL AND confidence >= 0.9 AND date_type = 'actual' AND d IS NOT NULL) WHERE rn = 1", "v6", "anchors")
def e14_anchor_years(d):
    return en.anchor_years(en.resolve_mentions(d.v6, d.anchors))


TIER = "CASE confidence WHEN 'VRF' THEN 0.95::DOUBLE WHEN 'SRC' THEN 0.85::DOUBLE WHEN 'INF' THEN 0.60::DOUBLE ELSE 0.40::DOUBLE END"
AWARDS = f"""(SELECT n_name AS county, count(*) AS cnt, state, concat('[', coalesce(string_agg(DISTINCT '"' || incentive_type || '"', ',' ORDER BY '"' || incentive_type || '"'), ''), ']') AS types, sum(CAST(amount AS DECIMAL(18, 2))) AS total, max(CAST(amount AS DECIMAL(18, 2))) AS top, max(term_years) AS years, min(term_start) AS first, max(term_end) AS last,
  concat('[', coalesce(string_agg(DISTINCT '"' || program_name || '"', ',' ORDER BY '"' || program_name || '"'), ''), ']') AS programs, concat('[', coalesce(string_agg(DISTINCT '"' || statute_citation || '"', ',' ORDER BY '"' || statute_citation || '"'), ''), ']') AS statutes, max({TIER}) AS multiplier, bool_or(coalesce(source_kind, 'primary') = 'primary') AS prim
 FROM v2 JOIN nation ON state = n_name AND regexp_replace(lower(county), '\\s+county$', '') = lower(n_name) LEFT JOIN award_registry USING (source_key) GROUP BY n_name, state)"""


@query(f"""WITH s AS (SELECT *, CASE WHEN multiplier >= 0.95 THEN 'VRF' WHEN multiplier >= 0.85 THEN 'SRC' WHEN multiplier >= 0.60 THEN 'INF' ELSE 'EST' END AS confidence_tier, CASE WHEN prim THEN 'primary' ELSE 'aggregator' END AS source_level FROM {AWARDS}),
 r AS (SELECT *, 'INC-01' AS attribute, format('{{{{"present":true,"disclosure_count":{{}},"state":"{{}}"}}}}', cnt, state) AS value FROM s UNION ALL SELECT *, 'INC-02', format('{{{{"types":{{}},"disclosure_count":{{}}}}}}', types, cnt) FROM s
  UNION ALL SELECT *, 'INC-03', format('{{{{"total_award_usd":{{}},"max_award_usd":{{}},"currency":"USD","record_count":{{}}}}}}', total::VARCHAR, top::VARCHAR, cnt) FROM s
  UNION ALL SELECT *, 'INC-04', format('{{{{"max_term_years":{{}},"earliest_start":"{{}}","latest_end":{{}}}}}}', coalesce(years::VARCHAR, 'null'), first::VARCHAR, coalesce('"' || last::VARCHAR || '"', 'null')) FROM s UNION ALL SELECT *, 'INC-05', format('{{{{"programs":{{}},"statutes":{{}}}}}}', programs, statutes) FROM s)
SELECT county, attribute, value, confidence_tier, multiplier, source_level FROM r""", "v2", "award_registry")
def e4_incentive_attributes(d):
    c = d.nation.select(F.col("n_name").alias("state"), F.col("n_name").alias("county"))
    return en.incentive_attributes(d.v2, c, d.award_registry)


@query("SELECT record_id, n_nationkey AS jurisdiction_id, CASE WHEN n_nationkey IS NOT NULL THEN 'county_name' END AS resolution_method, CASE WHEN n_nationkey IS NULL THEN 'unresolved' ELSE 'resolved' END AS resolution_status, CASE WHEN n_nationkey IS NULL THEN 0 ELSE 1 END AS candidate_count FROM v2 LEFT JOIN nation ON state = n_name AND n_nationkey % 4 <> 0 AND regexp_replace(lower(county), '\\s+county$', '') = lower(n_name)", "v2")
def e4_resolved_awards(d):
    """Every award, those without a known county as unresolved."""
    c = d.nation.select(F.col("n_nationkey").alias("jurisdiction_id"), F.col("n_name").alias("state"), F.concat("n_name", F.lit(" COUNTY")).alias("county"), (F.col("n_nationkey") % 4 != 0).alias("active"))
    return en.resolve_awards(d.v2, c).select("record_id", "jurisdiction_id", "resolution_method", "resolution_status", "candidate_count")


NORM = "nullif(trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(trim(raw_name)), '^the\\s+', ''), '[^a-z0-9]+', ' ', 'g')), ' (inc|llc|ltd|holdings|group)$', ''), ' (inc|llc|ltd|holdings|group)$', ''), ' +', ' ', 'g')), '')"


@query(f"""SELECT concat('co_', substr(md5(norm), 1, 16)) AS company_id, norm, raw_name AS name, origin FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY rk, raw_name) AS rn FROM
 (SELECT {NORM} AS norm, raw_name, CASE WHEN active THEN 'roster' ELSE 'curated' END AS origin, CASE WHEN active THEN 1 ELSE 0 END AS rk FROM v4)) WHERE rn = 1""", "v4")
def e18_merge_roster(d):
    v = d.v4.select(F.col("raw_name").alias("name"), "active")
    return en.merge_roster(v.filter("not active"), v.filter("active"))


COMP = f"(SELECT norm, concat('co_', substr(md5(norm), 1, 16)) AS company_id FROM (SELECT DISTINCT {NORM} AS norm FROM v4 WHERE NOT active) WHERE norm IS NOT NULL)"
NAMES = f"(SELECT DISTINCT raw_name AS name, {NORM} AS norm FROM v4 WHERE active)"


@query(f"""SELECT name, company_id, 'normalized' AS how, true AS approved FROM {NAMES} JOIN {COMP} USING (norm) UNION ALL
SELECT DISTINCT n.name, c.company_id, 'trigram', false FROM (SELECT *, {GR.format(c='norm')} AS g FROM {NAMES} WHERE norm NOT IN (SELECT norm FROM {COMP})) n JOIN (SELECT *, {GR.format(c='norm')} AS g FROM {COMP}) c ON {SIM.format(a='n.g', b='c.g')} >= 0.92""", "v4")
def e18_roster_aliases(d):
    v = d.v4.select(F.col("raw_name").alias("name"), "active")
    return en.roster_aliases(en.merge_roster(v.filter("not active"), v.filter("not active")), v.filter("active"))


view("cands", """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN concat('Park ', CAST(c_custkey % 30 AS STRING), ' - Building ', CAST(c_custkey % 5 AS STRING)) ELSE concat('Lone ', CAST(c_custkey AS STRING)) END AS name, c_mktsegment AS operator,
 CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat(CAST(c_custkey % 90 AS STRING), ' Main St') END AS street FROM customer""")


@query("""SELECT id, k AS campus_key, CASE WHEN id % 3 = 0 THEN 'name_stem' ELSE 'shared_address' END AS basis FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM (SELECT id, CASE WHEN id % 3 = 0 THEN concat('stem|park ', CAST(id % 30 AS STRING)) WHEN street IS NOT NULL THEN concat('addr|', lower(street), '|', lower(operator)) END AS k FROM cands) WHERE k IS NOT NULL) WHERE id % 3 = 0 OR n >= 2""", "cands")
def e19_campus_keys(d):
    return en.campus_keys(d.cands)


@query("SELECT id, CASE WHEN name LIKE '%Building%' THEN 'building' END AS declared_grain, street IS NOT NULL OR operator IS NOT NULL AS known FROM cands", "cands")
def e20_grain_from_name(d):
    """E20 and E23."""
    c = en.grain_from_name(d.cands, "name")
    return c.select("id", "declared_grain", en.is_identified(F.col("name"), F.col("operator"), F.lit(None).cast("double"), F.col("street")).alias("known"))


GROUPS = """(SELECT building, count(*) AS n, avg(lat) AS lat, avg(lng) AS lng FROM (SELECT CASE WHEN site_id % 4 = 0 THEN concat('id:', CAST(site_id % 50 AS STRING)) ELSE concat(CAST(site_id % 30 AS STRING), ' main st|', '787') END AS building, lat, lng FROM v3) GROUP BY 1)"""
ATTACHED = f"""SELECT g.building, CAST(any_value(g.n) AS BIGINT) AS n, substr(arg_min(m.e, (m.dist, m.e)), 3) AS attached_to FROM {GROUPS} g LEFT JOIN (SELECT building, concat('e:', CAST(s.site_id AS STRING)) AS e, {HAV.format(a='g', b='s')} AS dist FROM {GROUPS} g, v3 s) m ON g.building = m.building AND m.dist <= 100 GROUP BY g.building"""


@query(ATTACHED, "v3")
def e21_group_buildings(d):
    s = d.v3
    c = s.select(F.when(F.col("site_id") % 4 == 0, F.col("site_id") % 50).alias("resolved_id"), F.concat((F.col("site_id") % 30).cast("string"), F.lit(" Main St")).alias("street"), F.lit("787").alias("zip"), "lat", "lng")
    return en.group_buildings(c, s)


@query(f"SELECT attached_to, count(*) AS buildings FROM ({ATTACHED}) WHERE attached_to IS NOT NULL GROUP BY attached_to", "v3")
def e21_attached_sites(d):
    """The sites that groups are attached to."""
    return e21_group_buildings(d).filter("attached_to is not null").groupBy("attached_to").agg(F.count("*").alias("buildings"))


@query("SELECT id, min(company_id) AS company_id FROM (SELECT c.id, p.company_id FROM cands c JOIN v4 p ON lower(c.operator) = lower(p.kind)) GROUP BY id", "cands", "v4")
def e24_link_operators(d):
    linked, _ = en.link_operators(d.cands, d.v4.select(F.col("kind").alias("name"), "company_id"))
    return linked.select("id", "company_id")


#: Country texts: names of `nation` and a few in other languages, in other cases, with postcodes that fit and that don't.
view("country_texts", """SELECT c_custkey AS id, n_nationkey AS nation, CASE c_custkey % 8 WHEN 0 THEN n_name WHEN 1 THEN concat(' ', upper(n_name), ' ') WHEN 2 THEN concat(n_name, ' 10115') WHEN 3 THEN concat(n_name, ' 1011') WHEN 4 THEN 'Türkiye' WHEN 5 THEN 'Россия' WHEN 6 THEN concat(n_name, ' region') END AS text, CAST(c_custkey % 8 AS INT) AS k
 FROM customer JOIN nation ON c_nationkey = n_nationkey""")


@query("SELECT id, CASE WHEN k <= 1 THEN 'N' || CAST(nation AS VARCHAR) WHEN k = 2 AND nation % 2 = 0 THEN 'N' || CAST(nation AS VARCHAR) WHEN k = 4 THEN 'TR' WHEN k = 5 THEN 'RU' END AS iso2 FROM country_texts", "country_texts")
def f35_resolve_country(d):
    names = d.nation.select(F.col("n_name").alias("name"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"))
    more = d.spark.createDataFrame([("türkiye", "TR"), ("россия", "RU"), ("twice", "AA"), ("twice", "BB")], "name string, code string")
    return en.resolve_country(d.country_texts, "text", names.union(more), {f"N{i}": "[0-9]{5}" for i in range(0, 25, 2)}).select("id", "iso2")


@query("SELECT id, CAST(pos - 1 AS INTEGER) AS pos, string_split(names, '|')[pos] AS name_frag, kv, county, date_type FROM plans, generate_series(1, 2) AS g(pos) WHERE names <> '' AND pos <= len(string_split(names, '|'))", "plans")
def e15_normalize_plan_rows(d):
    _, m = en.normalize_plan_rows(d.plans)
    return m


#: Nations' names without digits.
view("towns", """SELECT x.n_nationkey AS town, translate(upper(x.n_name), '_0123456789', ' ABCDEFGHIJ') AS a, translate(upper(y.n_name), '_0123456789', ' ABCDEFGHIJ') AS b FROM nation x JOIN nation y ON y.n_nationkey = (x.n_nationkey + 1) % 25""")
view("dockets", """SELECT o_orderkey AS id, CAST(o_custkey % 8 AS INT) AS k, a, b, substr(a, 1, 2) AS state, CASE WHEN o_custkey % 3 > 0 THEN CAST(o_custkey AS STRING) END AS county_fips,
 CASE o_custkey % 8 WHEN 0 THEN concat('APPLICATION OF ', b, ' POWER TO AMEND ITS CERTIFICATE OF CONVENIENCE AND NECESSITY FOR THE ', a, ' SWITCH-TO-', b, ' SWITCH 345-KV TRANSMISSION LINE IN ', a, ' COUNTY')
  WHEN 1 THEN concat('FOR THE PROPOSED ', a, ' SWITCH TO ', a, '  138-KV TRANSMISSION LINE, DATA CENTER TARIFF') WHEN 2 THEN concat('FINAL ORDER FOR THE ', a, ' SUBSTATION - ', b, ' TAP TRANSMISSION LINE REBUILD')
  WHEN 3 THEN concat('PETITION FOR THE NEW&#9;', a, ' SWITCHING STATION') WHEN 4 THEN concat('MONTHLY RATE UPDATE FOR THE ', a, ' SWITCH TO ', b, ' SWITCH 69 KV TRANSMISSION LINE')
  WHEN 5 THEN concat('SALE OF ', a, ' COMPANY') WHEN 6 THEN concat('UPGRADE FOR THE ', a, ' TO ', b, ' 500 KV LINE') END AS title
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN towns ON c_nationkey = town""", "towns")
TITLED = "array_to_string(list_transform(string_split(lower({c}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
DOCKETS = f"""(SELECT *, CASE k WHEN 0 THEN [ta, tb] WHEN 2 THEN [ta, tb] ELSE [ta] END AS names, CASE k WHEN 0 THEN 345 WHEN 1 THEN 138 END AS kv, CASE k WHEN 1 THEN 'projected' WHEN 2 THEN 'actual' ELSE 'approved' END AS date_type
 FROM (SELECT *, {TITLED.format(c='a')} AS ta, {TITLED.format(c='b')} AS tb FROM dockets WHERE k <= 3))"""


@query(f"SELECT id, CASE WHEN k = 4 OR k = 6 THEN CASE k WHEN 4 THEN {TITLED.format(c='a')} || '|' || {TITLED.format(c='b')} ELSE '' END WHEN k IN (0, 2) THEN {TITLED.format(c='a')} || '|' || {TITLED.format(c='b')} WHEN k IN (1, 3) THEN {TITLED.format(c='a')} ELSE '' END AS names, CASE k WHEN 4 THEN 'excluded:rate/procedural' WHEN 6 THEN 'candidate:keyword' WHEN 5 THEN 'no-match' WHEN 7 THEN 'no-match' ELSE 'candidate:endpoints' END AS reason, k <= 3 AS is_candidate, CASE k WHEN 2 THEN 'actual' WHEN 0 THEN 'approved' WHEN 3 THEN 'approved' ELSE 'projected' END AS date_type FROM dockets", "dockets")
def f17_screen_dockets(d):
    """F17 and F18 of docket titles."""
    s = d.dockets.select("id", dk.screen_docket(F.col("title")).alias("s"), dk.docket_date_type(F.col("title")).alias("date_type"))
    return s.select("id", F.array_join("s.names", "|").alias("names"), "s.reason", "s.is_candidate", "date_type")


@query(f"SELECT id, title AS project_name, state, county_fips, CASE k WHEN 0 THEN ta END AS county_raw, CAST(kv AS INTEGER) AS kv, array_to_string(names, '|') AS names, 'reliability' AS driver, k = 1 AS large_load, k = 1 AS tariff, date_type, 'approved' AS status, CASE k WHEN 2 THEN 'SRC' ELSE 'EST' END AS tier, sha256(CAST(id AS VARCHAR) || '|' || array_to_string(names, '|') || '|' || coalesce(CAST(kv AS VARCHAR), '') || '|' || date_type) AS content_hash FROM {DOCKETS}", "dockets")
def e15_docket_projects(d):
    return en.normalize_dockets(d.dockets)[0]


@query(f"SELECT id, CAST(pos - 1 AS INTEGER) AS pos, names[pos] AS name_frag, CAST(kv AS INTEGER) AS kv, state, county_fips, date_type, CAST(NULL AS DATE) AS inservice_date, CASE k WHEN 2 THEN 0.85 ELSE 0.3 END::DOUBLE AS confidence, sha256('puc|' || CAST(id AS VARCHAR) || '|' || names[pos]) AS content_hash FROM {DOCKETS}, generate_series(1, 2) AS g(pos) WHERE pos <= len(names)", "dockets")
def e15_docket_mentions(d):
    return en.normalize_dockets(d.dockets)[1]


@query("SELECT DISTINCT o_orderkey AS doc_id, n_nationkey AS entity_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def e34_link_entities(d):
    m = d.orders.join(d.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(d.nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    names = m.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit(" "), F.lower("n_name")).alias("name"))
    return en.link_entities(names.unionByName(names), d.nation.select(F.col("n_name").alias("alias"), F.col("n_nationkey").alias("entity_id")))
