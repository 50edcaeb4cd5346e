"""Queries over joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import controls
from lodestone.operators import joins as jo
from lodestone.plans.base import query, view

HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2))))"
GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^\\pL\\pN]+'), lambda w: w <> ''), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("SELECT l_orderkey, l_linenumber, o_totalprice, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity > 45")
def j1_inner_join(d):
    return d.lineitem.filter("l_quantity > 45").join(d.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(d.customer, F.col("o_custkey") == F.col("c_custkey")).select("l_orderkey", "l_linenumber", "o_totalprice", "c_name")


@query("SELECT n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def j2_broadcast_dimension(d):
    dims = d.nation.join(F.broadcast(d.region), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows
    return d.customer.join(F.broadcast(dims), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "r_name").agg(F.count("*").alias("n"))


@query("SELECT record_id, coalesce(confidence, 'EST') AS confidence, coalesce(source_kind, 'primary') AS source_kind FROM v2 LEFT JOIN award_registry USING (source_key)", "v2", "award_registry")
def j3_enrich_defaults(d):
    return jo.enrich(d.v2.select("record_id", "source_key"), d.award_registry, "source_key", {"confidence": "EST", "source_kind": "primary"}).drop("source_key")


view("price_bands", "SELECT * FROM (VALUES ('low', 0.0, 100000.0, 1), ('mid', 90000.0, 250000.0, 2), ('high', 240000.0, 1e12, 3)) AS b(band, lo, hi, sort_order)")


@query("SELECT o_orderkey, o_totalprice, (SELECT arg_min(band, sort_order) FROM price_bands WHERE o_totalprice BETWEEN lo AND hi) AS band FROM orders", "price_bands")
def j4_band_lookup(d):
    from lodestone.operators.observations import band_lookup

    return band_lookup(d.orders.select("o_orderkey", "o_totalprice"), d.price_bands, "o_totalprice", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def j5_semi_join(d):
    return d.orders.join(d.lineitem.filter("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j6_anti_join(d):
    return d.customer.join(d.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""SELECT parent_id, string_agg(CAST(id AS STRING), ',' ORDER BY id) AS missing FROM v7 WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM v7) GROUP BY parent_id""", "v7")
def j7_split_links(d):
    links = d.v7.filter("parent_id is not null").select("id", "parent_id")
    _, misses = jo.split_links(links, d.v7.select(F.col("id").alias("parent_id")), "parent_id")
    return misses.groupBy("parent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("missing"))


@query("SELECT n_name, r_name, concat(r_name, '/', n_name) AS label FROM nation CROSS JOIN region")
def j8_cross_expand(d):
    return jo.cross_expand(d.nation.select("n_name"), d.region.select("r_name")).withColumn("label", F.concat_ws("/", "r_name", "n_name"))


@query(f"SELECT a.site_id AS a, b.site_id AS b, round({HAV.format(a='a', b='b')}, 3) AS distance_m FROM v3 a JOIN v3 b ON a.site_id < b.site_id AND a.country = b.country AND {HAV.format(a='a', b='b')} <= 2000", "v3")
def j11_geo_pairs(d):
    return jo.geo_pairs(d.v3, 2000, group="country").withColumn("distance_m", F.round("distance_m", 3))


view("names", "SELECT company_id, lower(raw_name) AS nm, kind FROM v4", "v4")


@query(f"""SELECT a, b, round(similarity, 6) AS similarity FROM (SELECT a.company_id AS a, b.company_id AS b,
  len(list_intersect(a.g, b.g)) * 1.0 / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS similarity
FROM (SELECT company_id, kind, {GRAMS.format(c='nm')} AS g FROM names) a JOIN (SELECT company_id, kind, {GRAMS.format(c='nm')} AS g FROM names) b ON a.company_id < b.company_id AND a.kind = b.kind) WHERE similarity >= 0.6""", "names")
def j12_trigram_pairs(d):
    names = d.v4.select("company_id", F.lower("raw_name").alias("nm"), "kind")
    return jo.trigram_pairs(names, 0.6, "company_id", "nm", "kind").withColumn("similarity", F.round("similarity", 6))


#: Names of few distinct words, so that many rows share one.
view("roster", "SELECT company_id, concat(kind, CASE company_id % 3 WHEN 0 THEN ' Works' WHEN 1 THEN ' Works Nr. 1' ELSE '' END) AS nm FROM v4", "v4")


@query(f"""WITH m AS (SELECT company_id, min(company_id) OVER (PARTITION BY g) AS r, count(*) OVER (PARTITION BY g) AS n, g FROM (SELECT company_id, list_sort({GRAMS.format(c='nm')}) AS g FROM roster)),
 c AS (SELECT r, any_value(n) AS n, any_value(g) AS g FROM m GROUP BY r)
SELECT * FROM (SELECT a.r AS ra, b.r AS rb, len(list_intersect(a.g, b.g)) * 1.0 / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS similarity, a.n AS na, b.n AS nb FROM c a JOIN c b ON a.r < b.r) WHERE similarity >= 0.6""", "roster")
def j12_trigram_classes(d):
    """Pairs of classes of equal names with their numbers of rows."""
    return jo.trigram_classes(d.roster, 0.6, "company_id", "nm")[0]


@query(f"SELECT company_id, min(company_id) OVER (PARTITION BY g) AS r, count(*) OVER (PARTITION BY g) AS n FROM (SELECT company_id, list_sort({GRAMS.format(c='nm')}) AS g FROM roster)", "roster")
def j12_trigram_members(d):
    return jo.trigram_classes(d.roster, 0.6, "company_id", "nm")[1]


@query("SELECT min(site_id) AS class, count(*) AS n, count(*) * (count(*) - 1) // 2 AS n_pairs FROM v3 GROUP BY operator, subdivision, country HAVING count(*) > 1", "v3")
def j13_block_classes(d):
    """The blocks of j13_block_pairs, each once."""
    return jo.block_classes(d.v3, ["operator", "subdivision", "country"], "site_id")[0]


@query("SELECT * FROM (SELECT site_id, min(site_id) OVER w AS class FROM v3 WINDOW w AS (PARTITION BY operator, subdivision, country) QUALIFY count(*) OVER w > 1)", "v3")
def j13_block_members(d):
    return jo.block_classes(d.v3, ["operator", "subdivision", "country"], "site_id")[1]


@query("SELECT a.site_id AS a, b.site_id AS b FROM v3 a JOIN v3 b ON a.operator = b.operator AND a.subdivision = b.subdivision AND a.country = b.country AND a.site_id < b.site_id", "v3")
def j13_block_pairs(d):
    return jo.block_pairs(d.v3, ["operator", "subdivision", "country"], "site_id")


@query("""SELECT site_id, poly_id FROM (SELECT s.site_id, e.poly_id, count(*) FILTER ((e.y > s.lat) <> (e.v > s.lat) AND s.lng < (e.u - e.x) * (s.lat - e.y) / (e.v - e.y) + e.x) AS n
FROM v3 s CROSS JOIN (SELECT p.poly_id, p.x, p.y, q.x AS u, q.y AS v FROM polygons p JOIN polygons q ON p.poly_id = q.poly_id AND q.seq = (p.seq + 1) % 5) e GROUP BY 1, 2) WHERE n % 2 = 1""", "v3", "polygons")
def j14_point_in_polygon(d):
    return jo.pip_join(d.v3, d.polygons, "site_id")


@query(f"""WITH RECURSIVE near AS (SELECT site, control, round(distance_m, 3) AS distance_m FROM (SELECT a.site_id AS site, b.site_id AS control, {HAV.format(a='a', b='b')} AS distance_m
    FROM v3 a JOIN v3 b ON a.country IS NOT DISTINCT FROM b.country AND a.site_id % 10 = 0 AND b.site_id % 10 <> 0 AND abs(a.lat - b.lat) < 0.3) WHERE distance_m BETWEEN 5000 AND 25000),
  free AS (SELECT *, false AS hit FROM near UNION ALL SELECT site, control, distance_m, hit FROM (
    SELECT *, bool_or(hit) OVER (PARTITION BY site) OR bool_or(hit) OVER (PARTITION BY control) AS gone FROM (
      SELECT site, control, distance_m, row_number() OVER (PARTITION BY site ORDER BY distance_m, control) = 1 AND row_number() OVER (PARTITION BY control ORDER BY distance_m, site) = 1 AS hit FROM free WHERE NOT hit)) WHERE hit OR NOT gone)
SELECT s.site_id AS site, control, distance_m FROM v3 s LEFT JOIN (SELECT * FROM free WHERE hit) ON site = s.site_id WHERE s.site_id % 10 = 0""", "v3")
def j15_nearest_control(d):
    s = d.v3
    return controls.nearest_control(s.filter("site_id % 10 = 0"), s.filter("site_id % 10 <> 0"), 5_000, 25_000, "country")


view("twice", "SELECT raw_name, company_id % 2 AS g FROM v4 UNION ALL SELECT raw_name, 1 FROM v4", "v4")


@query("SELECT raw_name, g, CASE WHEN g = 1 THEN CASE WHEN starts_with(lower(raw_name), 'brand#1') THEN 'first' WHEN starts_with(lower(raw_name), 'brand#') THEN 'brand' END END AS label FROM twice", "twice")
def j16_prefix_lookup(d):
    dim = d.spark.createDataFrame([(1, "Brand#", "brand"), (1, "Brand#1", "first"), (7, "Brand", "other")], "g int, prefix string, label string")
    return jo.prefix_lookup(d.twice, dim, "g", "raw_name", "prefix", "label")


@query("SELECT record_id, n_nationkey AS code FROM v2 LEFT JOIN nation ON upper(state) = upper(n_name) AND regexp_replace(lower(county), '\\s+(county|parish|borough)$', '') = lower(n_name)", "v2")
def j17_gazetteer_lookup(d):
    dim = d.nation.select(F.col("n_name").alias("state"), F.concat(F.initcap("n_name"), F.lit(" County")).alias("county"), F.col("n_nationkey").alias("code"))
    return jo.gazetteer_lookup(d.v2.select("record_id", "state", "county"), dim, "state", "county", "code").select("record_id", "code")


@query("""SELECT doc_id, CASE WHEN the AND NOT (la OR fox OR und) THEN 'en' WHEN la AND NOT (the OR fox OR und) THEN 'fr' WHEN und AND NOT (the OR la OR fox) THEN 'de' WHEN fox AND NOT (the OR la OR und) THEN 'five' END AS code FROM
 (SELECT doc_id, replace(replace(w, ' ', '  '), '  of  the  course  of  this  ', ' _ ') LIKE '% the %' AS the, w LIKE '% de la %' AS la, w LIKE '% of the course of this %' AS fox, w LIKE '% und %' AS und FROM
  (SELECT doc_id, ' ' || trim(regexp_replace(lower(CASE WHEN doc_id % 50 = 0 THEN concat('Of the course, of this ', text) ELSE text END), '[^\\pL\\pN]+', ' ', 'g')) || ' ' AS w FROM documents)) WHERE code IS NOT NULL""")
def j18_dictionary_resolve(d):
    terms = d.spark.createDataFrame([("the", "en"), ("of the", "en"), ("de la", "fr"), ("und", "de"), ("of the course of this", "five")], "term string, code string")
    text = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("Of the course, of this "), "text")).otherwise(F.col("text"))
    return jo.dictionary_resolve(d.documents.select("doc_id", text.alias("text")), terms, "doc_id", ["text"])


@query("""SELECT s.s_suppkey AS id, coalesce(a.k, b.k) AS match_key, CASE WHEN a.k IS NOT NULL THEN 'url' WHEN b.k IS NOT NULL THEN 'name' END AS basis
FROM supplier s LEFT JOIN (SELECT c_custkey % 50 AS u, min(c_custkey) AS k FROM customer WHERE c_custkey % 50 < 20 GROUP BY 1) a ON s.s_suppkey = a.u
LEFT JOIN (SELECT c_nationkey AS nm, min(c_custkey) AS k FROM customer GROUP BY 1) b ON s.s_nationkey = b.nm""")
def j21_cascade_match(d):
    a = d.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("url"), F.col("s_nationkey").alias("name"))
    u = F.col("c_custkey") % 50
    b = d.customer.select(F.col("c_custkey").alias("id"), F.when(u < 20, u).alias("url"), F.col("c_nationkey").alias("name"))
    return jo.cascade_match(a, b, "id", ["url", "name"])


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def u1_union_all(d):
    return d.nation.select(F.col("n_name").alias("name")).unionByName(d.region.select(F.col("r_name").alias("name")))


@query("""SELECT a, b, string_agg(reason, ',' ORDER BY reason) AS reasons FROM (SELECT a.site_id AS a, b.site_id AS b, 'operator' AS reason FROM v3 a JOIN v3 b ON a.operator = b.operator AND a.subdivision = b.subdivision AND a.site_id < b.site_id
UNION SELECT a.site_id, b.site_id, 'external' FROM v3 a JOIN v3 b ON a.external_id = b.external_id AND a.site_id < b.site_id) GROUP BY a, b""", "v3")
def u2_union_distinct(d):
    return jo.block_reasons(d.v3, {"operator": ["operator", "subdivision"], "external": ["external_id"]}, "site_id")


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def u4_set_difference(d):
    return d.part.select("p_partkey").join(d.lineitem.filter("l_quantity > 49"), F.col("p_partkey") == F.col("l_partkey"), "left_anti")
