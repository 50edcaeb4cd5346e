"""Queries over aggregates, windows, rankings and composite measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import normalize_company
from lodestone.operators import analytics as an
from lodestone.plans.base import query, view
from lodestone.plans.fixtures import AS_OF

NORM = "nullif(trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(trim(raw_name)), '^the\\s+', ''), '[^a-z0-9]+', ' ', 'g')), ' (inc|llc|ltd|holdings|group)$', ''), ' (inc|llc|ltd|holdings|group)$', ''), ' +', ' ', 'g')), '')"


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (value > 50) AS large FROM events GROUP BY user_id")
def a1_count_if(d):
    return an.count_if(d.events, {"clicks": F.col("event_type") == "click", "large": F.col("value") > 50}, ["user_id"])


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) FILTER (l_quantity > 40) AS big, count(DISTINCT l_suppkey) AS every FROM lineitem GROUP BY 1")
def a2_count_distinct_if(d):
    return an.count_distinct_if(d.lineitem, "l_suppkey", {"big": F.col("l_quantity") > 40, "every": F.lit(True)}, ["l_returnflag"])


@query("SELECT entity_id, obs_id, attribute, coalesce(value_text, CAST(value_num AS STRING), concat_ws('|', CAST(lat AS STRING), CAST(lng AS STRING))) AS value FROM v1", "v1")
def a4_to_observations(d):
    from lodestone.operators.observations import unpivot_attrs

    place = F.concat_ws("|", F.col("lat").cast("string"), F.col("lng").cast("string"))
    wide = d.v1.select("entity_id", "obs_id", *[F.when(F.col("attribute") == a, v).alias(a) for a, v in (("name", F.col("value_text")), ("operator", F.col("value_text")), ("coordinates", place), ("capacity", F.col("value_num").cast("string")))])
    return unpivot_attrs(wide, ["entity_id", "obs_id"], ["name", "operator", "coordinates", "capacity"])


@query(f"SELECT norm, count(DISTINCT company_id) AS n, string_agg(DISTINCT CAST(company_id AS STRING), ',' ORDER BY CAST(company_id AS STRING)) AS ids FROM (SELECT company_id, {NORM} AS norm FROM v4) WHERE norm IS NOT NULL GROUP BY norm HAVING count(DISTINCT company_id) > 1", "v4")
def a5_merge_candidates(d):
    m = an.merge_candidates(d.v4.withColumn("norm", normalize_company(F.col("raw_name"))), "norm", "company_id", "raw_name")
    return m.select("norm", "n", F.array_join(F.array_sort(F.split("keys", ",")), ",").alias("ids"))


@query("SELECT kind, company_id, raw_name FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY active DESC, price DESC, company_id) AS rn FROM v4) WHERE rn = 1", "v4")
def a6_best_per_key(d):
    from lodestone.operators.ingest import best_per_key

    return best_per_key(d.v4, ["kind"], [F.desc("active"), F.desc("price"), F.asc("company_id")]).select("kind", "company_id", "raw_name")


@query("SELECT company, count(*) AS n, round(avg(score), 6) AS mean, round(sum(score * capacity) FILTER (score IS NOT NULL) / nullif(sum(capacity) FILTER (score IS NOT NULL), 0), 6) AS weighted_mean FROM v8 GROUP BY company", "v8")
def a7_exposure(d):
    return an.exposure(d.v8, "company", "score", "capacity").select("company", "n", F.round("mean", 6).alias("mean"), F.round("weighted_mean", 6).alias("weighted_mean"))


@query("""SELECT o_custkey, '{' || string_agg(concat('"', p, '":', CAST(n AS STRING)), ',' ORDER BY p) || '}' AS distribution FROM (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def a8_distribution_map(d):
    return an.distribution_map(d.orders, "o_custkey", "o_orderpriority")


@query("SELECT company, string_agg(DISTINCT x, ',' ORDER BY x) AS elements FROM (SELECT company, tenant_a AS x FROM v8 UNION ALL SELECT company, tenant_b FROM v8) GROUP BY company", "v8")
def a9_distinct_elements(d):
    return an.distinct_elements(d.v8, "company", ["tenant_a", "tenant_b"])


@query("SELECT state, bool_or(award_type = 'cash grant') AS any_grant, max(amount) AS top, min(term_start) AS first_start, max(term_start) AS last_start FROM v2 GROUP BY state", "v2")
def a11_bundle(d):
    return d.v2.groupBy("state").agg(F.bool_or(F.col("award_type") == "cash grant").alias("any_grant"), F.max("amount").alias("top"), F.min("term_start").alias("first_start"), F.max("term_start").alias("last_start"))


@query("SELECT l_returnflag, median(l_extendedprice) AS m FROM lineitem GROUP BY 1")
def a12_median(d):
    return d.lineitem.groupBy("l_returnflag").agg(F.median("l_extendedprice").alias("m"))


LAGS = f"""(SELECT l_suppkey AS county, CAST(l_quantity AS DOUBLE) - 2 AS lag, date_diff('day', CAST(l_shipdate AS DATE), DATE '{AS_OF}') AS age, CASE l_linenumber % 3 WHEN 0 THEN 'electrical' ELSE 'building' END AS kind FROM lineitem)"""
USABLE = f"(SELECT *, pow(0.5, age / 730.0) AS w FROM {LAGS} WHERE lag >= 0 AND NOT (kind = 'electrical' AND lag < 4))"
MEDIAN = f"SELECT county, max(n) AS n, min(lag) FILTER (cum >= total / 2) AS weighted_lag FROM (SELECT county, lag, sum(w) OVER (PARTITION BY county ORDER BY lag) AS cum, sum(w) OVER (PARTITION BY county) AS total, count(*) OVER (PARTITION BY county) AS n FROM {USABLE}) GROUP BY county"


def _lags(d):
    return d.lineitem.select(F.col("l_suppkey").alias("county"), (F.col("l_quantity") - 2).alias("lag"), F.datediff(F.lit(AS_OF).cast("date"), F.col("l_shipdate").cast("date")).alias("age"), F.when(F.col("l_linenumber") % 3 == 0, "electrical").otherwise("building").alias("kind"))


@query(f"SELECT county, n, CASE WHEN n >= 300 THEN weighted_lag END AS weighted_median FROM ({MEDIAN})")
def a13_weighted_median(d):
    """A13, A14 and W7."""
    u = _lags(d).filter("lag >= 0 and not (kind = 'electrical' and lag < 4)").withColumn("w", F.pow(F.lit(0.5), F.col("age") / 730.0))
    return an.weighted_median(u, "county", "lag", "w", [], 300)


@query(f"SELECT m.county, m.n, median_lag, weighted_lag FROM ({MEDIAN}) m JOIN (SELECT county, median(lag) AS median_lag FROM {USABLE} GROUP BY county) k ON m.county = k.county")
def e25_permit_velocity(d):
    return an.permit_velocity(_lags(d), "county", "lag", "age", "kind")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20")
def a16_top_groups(d):
    return an.top_groups(d.lineitem, "l_partkey", 20)


view("labelled", "SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")


@query("""SELECT lang, n, hits, round(hits / n, 6) AS rate, round(hits / n - bh / bn, 6) AS delta, round((hits / n - bh / bn) / nullif(sqrt((hits + bh) / (n + bn) * (1 - (hits + bh) / (n + bn)) * (1 / n + 1 / bn)), 0), 6) AS z
FROM (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS hits FROM labelled GROUP BY lang) CROSS JOIN (SELECT count(*) AS bn, count(*) FILTER (quality = 1) AS bh FROM labelled WHERE lang = 'en')""", "labelled")
def a17_arm_stats(d):
    return an.arm_stats(d.labelled, "lang", F.col("quality") == 1, "en").select("lang", "n", "hits", *[F.round(c, 6).alias(c) for c in ("rate", "delta", "z")])


@query("SELECT quality = 1 AS a, n_chars > 1000 AS b, count(*) AS n FROM labelled GROUP BY 1, 2", "labelled")
def a18_contingency(d):
    return an.contingency(d.labelled, F.col("quality") == 1, F.col("n_chars") > 1000)


@query("""SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM (SELECT lang, count(*) FILTER (n_chars > 300 AND quality = 1) AS tp, count(*) FILTER (n_chars > 300 AND quality = 0) AS fp,
 count(*) FILTER (n_chars <= 300 AND quality = 0) AS tn, count(*) FILTER (n_chars <= 300 AND quality = 1) AS fn FROM labelled GROUP BY lang)""", "labelled")
def a19_confusion(d):
    return an.confusion(d.labelled, "lang", F.col("n_chars") > 300, F.col("quality") == 1)


@query("""SELECT coalesce(s_suppkey, c_custkey) AS k, s_nationkey AS a, c_nationkey AS b, CASE WHEN s_suppkey IS NULL THEN 'only_b' WHEN c_custkey IS NULL THEN 'only_a' WHEN s_nationkey = c_nationkey THEN 'agree' ELSE 'conflict' END AS state,
 coalesce(s_nationkey, c_nationkey) AS value FROM supplier FULL JOIN customer ON s_suppkey = c_custkey""")
def a20_reconcile_crosswalks(d):
    a = d.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v"))
    return an.reconcile_crosswalks(a, d.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v")), "k", "v")


REV = "SELECT source_id, jurisdiction, scenario, published, value, round(value - lag(value) OVER w, 4) AS delta, CAST(date_diff('day', lag(published) OVER w, published) AS INTEGER) AS gap_days FROM v10 WINDOW w AS (PARTITION BY source_id, jurisdiction, scenario ORDER BY published)"
KEYS = ["source_id", "jurisdiction", "attribute", "target_year", "metric", "scenario"]


@query(REV, "v10")
def w2_revisions(d):
    return an.revisions(d.v10, KEYS, "published", "value").select("source_id", "jurisdiction", "scenario", "published", "value", F.round("delta", 4).alias("delta"), "gap_days")


view("forecasts", "SELECT *, CASE WHEN source_id = '1-URGENT' THEN 'ghost' ELSE attribute END AS attr, CASE WHEN jurisdiction % 3 = 0 THEN NULL ELSE jurisdiction END AS jur, CASE WHEN source_id = '2-HIGH' THEN '' ELSE unit END AS u FROM v10", "v10")


def _pack(d):
    obs = d.forecasts.drop("attribute", "jurisdiction", "unit").withColumnsRenamed({"attr": "attribute", "jur": "jurisdiction", "u": "unit"})
    registry = d.spark.createDataFrame([("load",)], "attribute string")
    story = (F.col("source_id") == "3-MEDIUM") & (F.col("metric") == "mw") & (F.col("scenario") == "base")
    return an.forecast_pack(obs, KEYS, registry, {"base": story})


@query("SELECT source_id, count(*) AS n FROM forecasts WHERE value IS NOT NULL AND (unit IS NULL OR u = '') GROUP BY 1", "forecasts")
def e29_forecast_pack(d):
    """E29 and Q4."""
    return _pack(d)["no_unit"]


@query("SELECT source_id, count(*) FILTER (jur IS NULL) AS unmapped, count(*) FILTER (jur IS NOT NULL) AS mapped FROM forecasts GROUP BY 1", "forecasts")
def e29_unmapped(d):
    return _pack(d)["unmapped"]


@query("SELECT DISTINCT attr AS attribute FROM forecasts WHERE attr IS NOT NULL AND attr NOT IN ('load')", "forecasts")
def e29_soft_keys(d):
    return _pack(d)["soft_keys"]


@query("SELECT jur AS jurisdiction, count(*) AS n, round(sum(delta), 2) AS moved FROM (SELECT jur, value - lag(value) OVER (PARTITION BY jur ORDER BY published) AS delta FROM forecasts WHERE source_id = '3-MEDIUM' AND scenario = 'base' AND jur IS NOT NULL) GROUP BY 1", "forecasts")
def e29_story(d):
    return _pack(d)["story_base"].filter("jurisdiction is not null").groupBy("jurisdiction").agg(F.count("*").alias("n"), F.round(F.sum("delta"), 2).alias("moved"))


@query("SELECT company_id, kind, concat('C-', lpad(CAST(row_number() OVER (ORDER BY kind, company_id) AS STRING), 6, '0')) AS public_id FROM v4", "v4")
def w3_number_rows(d):
    return an.number_rows(d.v4.select("company_id", "kind"), ["kind", "company_id"], "C-", 6)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def w4_latest_per_key(d):
    return an.latest_per_key(d.events, ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT o_custkey, CAST(max(y) AS INTEGER) AS last_year, CAST(2001 - max(y) AS INTEGER) AS years_silent, CAST(max(g) AS INTEGER) AS longest_gap FROM (SELECT o_custkey, y, y - lag(y) OVER (PARTITION BY o_custkey ORDER BY y) AS g FROM (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders)) GROUP BY o_custkey")
def w6_last_seen_gap(d):
    return an.last_seen_gap(d.orders, "o_custkey", F.year("o_orderdate"), 2001)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 200")
def r1_ordered(d):
    """R1 and R2."""
    return an.ordered(d.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").limit(an.clamp_limit(1000))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey > 5) ORDER BY o_totalprice DESC, o_orderkey LIMIT 48")
def r3_keyset_page(d):
    """R3, IO12 and P4's facets."""
    return an.keyset_page(an.facet_filter(d.orders, o_orderstatus=None), "o_totalprice", "o_orderkey", (200000.0, 5), None).select("o_orderkey", "o_totalprice")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3")
def r4_newest_per_group(d):
    return an.newest_per_group(d.events, "user_id", "ts", "event_id", 3).select("user_id", "event_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def p4_facet_filter(d):
    """P3 and P4."""
    return an.facet_filter(d.customer, c_mktsegment="BUILDING", c_nationkey=3, c_name=None).select("c_custkey", "c_name")


@query("""SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(least(0.99::DOUBLE, own * 0.6::DOUBLE + hits / n * 0.4::DOUBLE + CASE WHEN source = qd THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END + boost), 6) AS score
 FROM (SELECT q.query_id, any_value(q.n) AS n, any_value(q.qd) AS qd, d.doc_id, any_value(d.source) AS source, any_value(d.own) AS own, any_value(d.boost) AS boost, count(*) AS hits FROM (SELECT item_id AS query_id, concat('src', CAST(item_id % 20 AS STRING)) AS qd, unnest(w) AS word, len(w) AS n FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 3) AS w FROM benchmark)) q
  JOIN (SELECT doc_id, source, lower(text) AS t, 0.5::DOUBLE + doc_id % 50 / 100.0::DOUBLE AS own, CASE doc_id % 10 WHEN 3 THEN 0.03::DOUBLE WHEN 2 THEN 0.02::DOUBLE WHEN 1 THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END AS boost FROM documents) d ON contains(d.t, q.word) GROUP BY q.query_id, d.doc_id)) WHERE score >= 0.72) WHERE rank <= 5""")
def r6_lexical_topk(d):
    k = F.col("doc_id") % 10
    docs = d.documents.select("doc_id", "text", F.col("source").alias("domain"), (F.col("doc_id") % 50 / 100.0 + 0.5).alias("score"), F.when(k == 3, 0.03).when(k == 2, 0.02).when(k == 1, 0.01).otherwise(0.0).alias("boost"))
    return an.lexical_topk(d.benchmark.select(F.col("item_id").alias("query_id"), "text", F.concat(F.lit("src"), F.col("item_id") % 20).alias("domain")), docs)


view("country_attrs", """SELECT c_custkey % 40 AS country, CASE (c_custkey + c_custkey % 40 * 3) % 12 WHEN 0 THEN 'CTY-PWR-CAP-PC' WHEN 1 THEN 'CTY-PWR-MIX' WHEN 2 THEN 'CTY-REG-WGI' WHEN 3 THEN 'CTY-REG-LAW' WHEN 4 THEN 'CTY-PRM-DB2020' WHEN 5 THEN 'CTY-COM-CAPACITY' WHEN 6 THEN 'CTY-INC-FDI-RRI' WHEN 7 THEN 'CTY-PRM-DB2021' WHEN 8 THEN 'PWR' WHEN 9 THEN 'CTY-REG-OPEN' ELSE 'CTY-PWR-ACCESS' END AS attribute_code
 FROM customer WHERE c_custkey % 40 < 30 OR c_custkey % 3 = 0""")


@query("""WITH n AS (SELECT country, least(count(*) FILTER (attribute_code LIKE 'CTY-PWR-%'), 4) AS p, least(count(*) FILTER (attribute_code LIKE 'CTY-REG-%'), 3) AS r, count(*) FILTER (attribute_code = 'CTY-PRM-DB2020') > 0 AS m, count(*) FILTER (attribute_code = 'CTY-COM-CAPACITY') > 0 AS c, least(count(*) FILTER (attribute_code LIKE 'CTY-INC-%'), 2) AS i FROM country_attrs GROUP BY 1),
 t AS (SELECT *, CASE WHEN p > 0 THEN 18 ELSE 0 END + CASE WHEN r > 0 THEN 12 ELSE 0 END + CASE WHEN m THEN 5 ELSE 0 END + CASE WHEN c THEN 8 ELSE 0 END + CASE WHEN i > 0 THEN 12 ELSE 0 END AS possible, p * 0.25 * 18 * 0.3 + r / 3 * 12 * 0.3 + CASE WHEN m THEN 5 * 0.3 ELSE 0 END + CASE WHEN c THEN 8 * 0.6 ELSE 0 END + i * 0.5 * 12 * 0.3 AS total FROM n),
 s AS (SELECT *, CASE WHEN possible >= 40 THEN least(100.0::DOUBLE, round(CAST(total / possible * 100 AS DOUBLE), 2)) END AS composite FROM t)
SELECT country, composite, CAST(possible AS DOUBLE) AS coverage, CASE WHEN composite >= 80 THEN CASE WHEN possible >= 80 THEN 'Verified' WHEN possible >= 60 THEN 'Estimated' ELSE 'Inferred' END WHEN composite >= 60 THEN CASE WHEN possible >= 60 THEN 'Estimated' ELSE 'Inferred' END WHEN composite >= 40 THEN 'Inferred' ELSE 'Unscored' END AS label,
 CASE WHEN p > 0 THEN 'EST' ELSE 'ABS' END AS power_flag, CASE WHEN c THEN 'INF' ELSE 'ABS' END AS community_flag, 'ABS' AS labor_flag, CASE WHEN r > 0 THEN round(CAST(r / 3 * 100 AS DOUBLE), 2) END AS regulatory_raw, i > 0 AS incentives_counted FROM s""", "country_attrs")
def e16_country_composite(d):
    s = an.country_composite(d.country_attrs)
    get = lambda c, path: F.get_json_object(c, path)
    return s.select(
        "country", "composite", "coverage", "label", get("flags", "$.T2_power").alias("power_flag"), get("flags", "$.T8_community").alias("community_flag"), get("flags", "$.T4_labor").alias("labor_flag"),
        get("breakdown", "$.T3_regulatory.raw_score").cast("double").alias("regulatory_raw"), get("breakdown", "$.T7_incentives.counted").cast("boolean").alias("incentives_counted"),
    )


_FACTS = {
    "facilities": "CAST(count(*) AS STRING)", "operational": "CAST(count(*) FILTER (status = 'operational') AS STRING)", "announced": "CAST(count(*) FILTER (status = 'announced') AS STRING)",
    "capacity": "CAST(CAST(floor(sum(capacity)) AS BIGINT) AS STRING)", "operational_capacity": "CAST(CAST(floor(sum(capacity) FILTER (status = 'operational')) AS BIGINT) AS STRING)", "with_acres": "CAST(count(acres) AS STRING)",
    "states": "CAST(count(DISTINCT state) AS STRING)", "tiers": "string_agg(DISTINCT tier, ',' ORDER BY tier)", "scored": "CAST(count(score) AS STRING)",
    "exposure": "printf('%.2f', round(sum(score * capacity) / sum(capacity) FILTER (score IS NOT NULL), 2))",
}


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT company, '{k}' AS attribute, {v} AS value FROM v8 GROUP BY company" for k, v in _FACTS.items()) + " UNION ALL SELECT company, 'tenants', string_agg(DISTINCT t, ',' ORDER BY t) FROM (SELECT company, tenant_a AS t FROM v8 UNION ALL SELECT company, tenant_b FROM v8) GROUP BY company) WHERE value IS NOT NULL", "v8")
def e17_company_footprint(d):
    return an.company_footprint(d.v8)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def e26_target_counties(d):
    gen = d.supplier.filter("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return an.target_counties(d.nation, gen, "n_nationkey", "n_regionkey", "n_nationkey").select("n_nationkey", "n_name")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN p_retailprice WHEN (p_partkey - p_partkey % 10) % 4 = 0 THEN up END AS fraction, CASE WHEN p_partkey % 4 = 0 THEN 'direct' WHEN (p_partkey - p_partkey % 10) % 4 = 0 AND up IS NOT NULL THEN 'inherited' ELSE 'none' END AS join_method
FROM part p LEFT JOIN (SELECT p_partkey AS k, p_retailprice AS up FROM part WHERE p_partkey % 4 = 0) u ON u.k = p.p_partkey - p.p_partkey % 10""")
def e27_inherit_coverage(d):
    j = d.part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") - F.col("p_partkey") % 10).alias("parent"))
    return an.inherit_coverage(j, d.part.filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("county"), F.col("p_retailprice").alias("fraction")))


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 'covered' WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'partial' ELSE 'uncovered' END AS coverage FROM customer")
def e28_coverage_status(d):
    o = d.orders.withColumnRenamed("o_custkey", "c_custkey")
    return an.coverage_status(d.customer, o.filter("o_totalprice > 400000"), o, "c_custkey")


@query(None)
def e33_seasonal_deltas(d):
    e = d.events.select("event_type", (F.unix_timestamp("ts") / 3600.0).alias("hour"), "value", "event_id")
    return an.seasonal_deltas(e, "event_type", "hour", "value", 24.0).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("flagged").alias("flagged"), F.round(F.sum("delta_sigma"), 3).alias("sum_sigma"))
