"""Queries over the scalar functions: each runs them over whole driver columns and holds them against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import geo
from lodestone.functions import text as tx
from lodestone.functions import values as vl
from lodestone.plans.base import query, view

view("odd_names", "SELECT company_id, CASE company_id % 9 WHEN 0 THEN concat('  The ', raw_name, ' Companies') WHEN 1 THEN concat(raw_name, ', Co. S.A.R.L. sarl') WHEN 2 THEN concat(raw_name, ' Holding & Group, Ltd.') WHEN 3 THEN concat(raw_name, ' AG') WHEN 4 THEN 'Group Inc' WHEN 5 THEN NULL WHEN 6 THEN concat(raw_name, ' Pty Ltd') WHEN 7 THEN concat(raw_name, ' L.P.') ELSE raw_name END AS nm FROM v4", "v4")
FIRST = "incorporated|inc|llc|ltd|limited|corp|corporation|plc|sa|ag|gmbh|nv|bv|co|company|companies|holdings|holding|group|lp|llp"


@query(rf"""SELECT company_id, nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(nm, '')), '^\s*the\s+', ''), '[^a-z0-9]+', ' ', 'g'), '\s+({FIRST}|sarl|pte|pty)\s*$', ''), '\s+({FIRST})\s*$', ''), '\s+', ' ', 'g')), '') AS norm FROM odd_names""", "odd_names")
def f1_normalize_company(d):
    return d.odd_names.select("company_id", tx.normalize_company(F.col("nm")).alias("norm"))


@query(r"""SELECT company_id, nullif(trim(regexp_replace(regexp_replace(replace(replace(replace(lower(nm), '&', ' and '), '.', ''), ',', ' '), '\b(inc|llc|ltd|limited|corp|corporation|co|company|plc|gmbh|sa|ag|holdings?|group)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), '') AS norm FROM odd_names""", "odd_names")
def f2_normalize_operator(d):
    return d.odd_names.select("company_id", tx.normalize_operator(F.col("nm")).alias("norm"))


view("stations", "SELECT s_suppkey AS id, CASE s_suppkey % 8 WHEN 0 THEN concat('UNKNOWN', CAST(s_suppkey AS STRING)) WHEN 1 THEN concat('Río Čačak Ångström ', s_name, ' Substation') WHEN 2 THEN concat('tap', CAST(s_suppkey AS STRING)) WHEN 3 THEN concat('Tap ', CAST(s_suppkey AS STRING)) WHEN 4 THEN concat(s_name, ' DC Tie S/S') WHEN 5 THEN concat(s_name, ' Station') WHEN 6 THEN concat(s_name, ' Switch (POI)') ELSE concat(s_name, ' Switching Station') END AS nm FROM supplier")


@query(r"""SELECT id, CASE WHEN NOT regexp_matches(strip_accents(lower(nm)), '^(unknown|tap)[0-9]+$') THEN nullif(trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(nm)), '\b(switching station|substation|switchyard|switching|switch|sub station|s/?s|tap|poi|interchange|delivery station|dc tie)\b', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')), '') END AS norm FROM stations""", "stations")
def f3_normalize_station(d):
    return d.stations.select("id", tx.normalize_station(F.col("nm")).alias("norm"))


@query("SELECT company_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(raw_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 20), '-+$', '') AS slug, concat('co_', substr(md5(raw_name), 1, 16)) AS id, sha256(concat_ws(':', kind, 'doc', CAST(company_id AS STRING))) AS lineage FROM v4", "v4")
def f4_slug_and_ids(d):
    """F4, F7 and F8."""
    return d.v4.select("company_id", tx.slug(F.col("raw_name"), 20).alias("slug"), tx.stable_id(F.col("raw_name"), "co_").alias("id"), tx.lineage_key(F.col("kind"), F.col("company_id")).alias("lineage"))


@query("""SELECT company_id, replace(replace(replace(replace(replace(replace(replace(replace(concat(raw_name, ' 5% "q" & #1 (it''s a/b), +'), '%', '%25'), '&', '%26'), ' ', '%20'), '"', '%22'), chr(39), '%27'), '(', '%28'), ')', '%29'), '/', '%2F') AS enc, CASE WHEN regexp_replace(regexp_replace(lower(trim(kind)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') = 'economy' THEN 'eco' ELSE regexp_replace(regexp_replace(lower(trim(kind)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') END AS skey FROM v4""", "v4")
def f5_percent_encode_source_key(d):
    """F5 and F6."""
    return d.v4.select("company_id", tx.percent_encode(F.concat("raw_name", F.lit(" 5% \"q\" & #1 (it's a/b), +"))).alias("enc"), tx.source_key(F.col("kind"), {"economy": "eco"}).alias("skey"))


view("money", "SELECT o_orderkey AS id, concat('$', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ',000') AS plain, concat(CASE o_custkey % 3 WHEN 0 THEN '-$' ELSE '$' END, CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING), '.5 ', CASE o_custkey % 4 WHEN 0 THEN 'million' WHEN 1 THEN 'billion' WHEN 2 THEN 'thousand' ELSE '' END) AS scaled FROM orders")


@query("""SELECT id, TRY_CAST(regexp_replace(plain, '[$,\\s]', '', 'g') AS DOUBLE) AS num, CAST(floor(TRY_CAST(regexp_extract(replace(scaled, '$', ''), '(-?[0-9.]+)', 1) AS DOUBLE) * CASE WHEN scaled LIKE '%million' THEN 1e6 WHEN scaled LIKE '%billion' THEN 1e9 WHEN scaled LIKE '%thousand' THEN 1e3 ELSE 1 END + 0.5) AS BIGINT) AS usd FROM money""", "money")
def f9_parse_numbers(d):
    """F9 and F10."""
    return d.money.select("id", vl.parse_number(F.col("plain")).alias("num"), vl.parse_usd_scaled(F.col("scaled")).alias("usd"))


view("dates", """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, CASE o_custkey % 10 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
  WHEN 1 THEN concat(CAST(month(o_orderdate) AS STRING), '/', CAST(day(o_orderdate) AS STRING), '/', CAST(year(o_orderdate) AS STRING))
  WHEN 2 THEN concat('Dec ', CAST(day(o_orderdate) AS STRING), ', ', CAST(year(o_orderdate) AS STRING)) WHEN 3 THEN concat('May ', CAST(year(o_orderdate) AS STRING))
  WHEN 4 THEN CAST(year(o_orderdate) AS STRING)
  WHEN 5 THEN concat('est. December ', CAST(day(o_orderdate) AS STRING), ' ', CAST(year(o_orderdate) AS STRING), ' or so') WHEN 6 THEN concat('in May. ', CAST(year(o_orderdate) AS STRING), '?') WHEN 7 THEN concat(CAST(month(o_orderdate) AS STRING), '-', CAST(day(o_orderdate) AS STRING), '-', CAST(year(o_orderdate) AS STRING), ' 10:00')
  WHEN 8 THEN concat('Lot 12, ', CAST(year(o_orderdate) AS STRING)) ELSE 'n/a' END AS s, o_custkey % 10 AS k FROM orders""")


@query("""SELECT id, CASE k WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN make_date(year(d), 12, day(d)) WHEN 3 THEN make_date(year(d), 5, 1) WHEN 4 THEN make_date(year(d), 1, 1) WHEN 5 THEN make_date(year(d), 12, day(d)) WHEN 6 THEN make_date(year(d), 5, 1) WHEN 7 THEN d END AS parsed,
 floor((DATE '2001-08-02' - d) / 365.25 * 10 + 0.5) / 10 AS years, CAST(DATE '2001-08-02' - d AS INTEGER) AS lag, CAST(year(d) AS INTEGER) AS y4 FROM dates""", "dates")
def f11_parse_dates(d):
    """F11, F13, F14 and F21's year."""
    end = F.lit("2001-08-02").cast("date")
    return d.dates.select("id", vl.parse_date_any(F.col("s")).alias("parsed"), vl.years_between(F.col("d"), end).alias("years"), vl.lag_days(F.col("d"), end).alias("lag"), vl.year4(F.concat(F.lit("in "), F.year("d").cast("string"), F.lit("01"))).alias("y4"))


@query("SELECT event_id, CAST(epoch_ms(CAST((event_id % 20000) * 86400000 AS BIGINT)) AS DATE) AS d FROM events")
def f12_epoch_ms(d):
    day = F.col("event_id") % 20000
    return d.events.select("event_id", vl.epoch_ms_to_date((day * 86400000).cast("string")).alias("d"))


#: Worked cases of plan rows, with what is to be read from each.
view("plan_cases", """SELECT * FROM (VALUES
  (0, 'Rebuild Cottonwood to Edith Clarke 345-kV line in Deaf Smith County for data center', 'Future', 'Energized', 345, 'Deaf Smith', 'Rebuild Cottonwood|Edith Clarke', 'load_growth', true, 'actual'),
  (1, 'new San Miguel Switching Station for solar', 'rtp', '', CAST(NULL AS INT), CAST(NULL AS STRING), 'San Miguel', 'generation_interconnection', false, 'projected'),
  (2, 'Bakersfield Switch upgrade, reliability', 'completed', 'Planned', NULL, NULL, 'Bakersfield', 'reliability', false, 'actual'),
  (3, 'Line built in Winston-Salem Counties; congestion', 'future', 'Under Construction', NULL, 'Winston-Salem', '', 'economic', false, 'required'),
  (4, 'asset condition of Mc.Neal-Hill Substation, 138 kV', 'future', 'Cancelled', 138, NULL, 'Mc.Neal-Hill', 'asset_condition', false, 'unknown'),
  (5, 'Energize Line', 'proposed', NULL, NULL, NULL, '', NULL, false, 'projected'),
  (6, 'crypto mine 69 kv', '', '', 69, NULL, '', NULL, true, 'unknown'),
  (7, CAST(NULL AS STRING), 'cancelled', NULL, NULL, NULL, NULL, NULL, false, 'unknown'),
  (8, 'Line from New Switchyard to A Line Project in St. Mary Anne County, policy', 'planned', 'closed out', NULL, 'St. Mary Anne', '', 'policy', false, 'actual')
 ) AS c(k, title, section, status, kv, county, names, driver, large, date_type)""")
view("plans", "SELECT o_orderkey AS id, c.* FROM orders JOIN plan_cases c ON o_custkey % 9 = c.k", "plan_cases")


@query("SELECT id, kv, county, names, driver, large, date_type FROM plans", "plans")
def f15_plan_fields(d):
    """F15 to F19."""
    t = F.col("title")
    return d.plans.select("id", vl.extract_kv(t).alias("kv"), vl.extract_county(t).alias("county"), F.array_join(vl.extract_station_names(t), "|").alias("names"), vl.classify_driver(t).alias("driver"), vl.is_large_load(t).alias("large"), vl.classify_date_type(F.col("section"), F.col("status")).alias("date_type"))


view("incentives", """SELECT o_orderkey AS record_id, c.* FROM orders JOIN (VALUES (0, 'Tax Increment financing', 'tif', 'Albany County Industrial Development Agency', 'Albany'), (1, 'PILOT agreement', 'pilot', 'City of Yonkers Agency', NULL), (2, 'Payment-in-lieu of taxes', 'pilot', 'St. Lawrence COUNTY IDA', 'St. Lawrence'),
  (3, 'low interest Loan', 'loan', '', NULL), (4, 'training support', 'other', NULL, NULL), (5, NULL, NULL, 'County of Kings', NULL), (6, '', NULL, 'A  county', 'A'), (7, 'tax credit grant', 'credit', 'x', NULL), (8, 'Reinvestment Zone abatement', 'tif', 'x', NULL), (9, 'abatement or exemption', 'abatement', 'x', NULL),
  (10, 'cash grant', 'grant', 'x', NULL), (11, 'Sales Tax exemption', 'exemption', 'Countyline Agency', NULL), (12, 'TIF', 'tif', 'x', NULL), (13, 'motif', 'other', 'x', NULL)) AS c(k, raw, kind, authority, county) ON o_custkey % 14 = c.k""")


@query("SELECT record_id, kind, county FROM incentives", "incentives")
def f20_incentive_type(d):
    """F20 and F21's county."""
    return d.incentives.select("record_id", vl.normalize_incentive_type(F.col("raw")).alias("kind"), vl.county_from_authority(F.col("authority")).alias("county"))


view("naics", """SELECT p_partkey AS id, c.*, CASE p_partkey % 3 WHEN 0 THEN ' Operational ' WHEN 1 THEN 'planned' ELSE 'odd' END AS status FROM part JOIN (VALUES (0, '331313', 'smelter'), (1, '331110', 'steel'), (2, '322121', 'paper'), (3, '334413', 'fab'), (4, '324110', 'refinery'), (5, '325412', 'pharma'),
  (6, '325180', 'chemical'), (7, '336111', 'auto'), (8, '336390', 'auto'), (9, '541512', 'other'), (10, NULL, 'unknown'), (11, '33-13 x', 'smelter'), (12, '', 'unknown'), (13, '33', 'other')) AS c(k, code, industry) ON p_partkey % 14 = c.k""")


@query("SELECT id, industry, CASE trim(lower(status)) WHEN 'operational' THEN 'live' WHEN 'planned' THEN 'announced' ELSE 'unknown' END AS status FROM naics", "naics")
def f22_codes(d):
    """F22 and F23."""
    return d.naics.select("id", vl.industry_class(F.col("code")).alias("industry"), vl.map_status(F.col("status"), {"operational": "live", "planned": "announced"}).alias("status"))


LAYER = "CASE WHEN lifecycle IN ('operational', 'commissioning', 'expansion') THEN 'L1' WHEN lifecycle = 'construction' THEN 'L2' WHEN lifecycle IN ('permitted', 'entitled') THEN 'L3' WHEN lifecycle IN ('announced', 'rumored') THEN 'L4' END"


@query(f"SELECT entity_id, {LAYER} AS layer FROM entities", "entities")
def f24_layer(d):
    from lodestone.operators.observations import LAYERS, steps

    return d.entities.select("entity_id", steps(F.col("lifecycle"), LAYERS).alias("layer"))


@query("""SELECT company_id, CASE company_id % 3 WHEN 0 THEN kind || '|' || trim(kind) || ', Ltd' || '|Carrier ' || CAST(size AS VARCHAR) || '|7' WHEN 1 THEN '' ELSE array_to_string(list_filter(list_transform(regexp_split_to_array(replace(raw_name, ' ', ' ; '), '[;,]'), lambda x: trim(x)), lambda x: x <> ''), '|') END AS names, string_split(raw_name, ' ')[2] AS q FROM v4""", "v4")
def f25_name_arrays(d):
    """F25 and F28."""
    q = F.concat(F.lit('news "'), F.get(F.split("raw_name", " "), F.lit(1)), F.lit('" site'))
    size = F.col("size").cast("string")
    listed = F.concat(F.lit('["'), "kind", F.lit('", " '), "kind", F.lit(', Ltd ", {"x": 1, "name": null, "carrier": "Carrier '), size, F.lit('", "tenant": "t"}, {"tenant": 7}, {"x": "y"}, 5, null, " "]'))
    raw = F.when(F.col("company_id") % 3 == 0, listed).when(F.col("company_id") % 3 == 1, F.concat(F.lit('{"name": "'), "kind", F.lit('"}'))).otherwise(F.replace("raw_name", F.lit(" "), F.lit(" ; ")))
    return d.v4.select("company_id", F.array_join(tx.to_name_array(raw), "|").alias("names"), tx.quoted_entity(q).alias("q"))


@query("SELECT p_partkey AS id, concat('<', p_brand, ' & ', chr(CAST(65 + p_partkey % 900 AS INTEGER)), chr(CAST(192 + p_size AS INTEGER))) AS decoded, p_name || ' ' || p_type AS stripped FROM part")
def f29_decode_entities(d):
    coded = F.concat(F.lit("&lt;"), F.col("p_brand"), F.lit(" &amp; &#"), (F.col("p_partkey") % 900 + 65).cast("string"), F.lit(";&#x"), F.hex(F.col("p_size") + 192), F.lit(";"))
    return d.part.select(F.col("p_partkey").alias("id"), tx.decode_entities(coded).alias("decoded"), tx.strip_tags(F.concat(F.lit("<p class='x'>"), F.col("p_name"), F.lit(" <b id='"), F.col("p_size").cast("string"), F.lit("'>"), F.col("p_type"), F.lit("</b></p><script>"), F.col("p_brand"), F.lit("</script>"))).alias("stripped"))


GR = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^\\pL\\pN]+'), lambda w: w <> ''), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"SELECT p_partkey AS id, round(len(list_intersect(a, b)) * 1.0 / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS sim FROM (SELECT p_partkey, {GR.format(c='p_name')} AS a, {GR.format(c='p_type || p_name')} AS b FROM part)")
def f30_trigram_similarity(d):
    return d.part.select(F.col("p_partkey").alias("id"), F.round(tx.trigram_similarity(F.col("p_name"), F.concat("p_type", "p_name")), 6).alias("sim"))


@query("SELECT site_id, round(2 * 6371000.0 * asin(sqrt(pow(sin(radians(31 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(31)) * pow(sin(radians(-99 - lng) / 2), 2))), 2) AS m FROM v3", "v3")
def f31_haversine(d):
    return d.v3.select("site_id", F.round(geo.haversine_m(F.col("lat"), F.col("lng"), F.lit(31.0), F.lit(-99.0)), 2).alias("m"))


view("cadences", """SELECT auto_id, last_artifact_at, CASE CAST(substr(auto_id, 2) AS INT) % 10 WHEN 0 THEN 'hourly' WHEN 1 THEN 'daily' WHEN 2 THEN 'weekly' WHEN 3 THEN 'semiannual' WHEN 4 THEN 'monthly' WHEN 5 THEN 'event_driven' WHEN 6 THEN 'archival_refresh' WHEN 7 THEN 'one_time' WHEN 8 THEN 'biweekly' END AS cadence,
  CASE CAST(substr(auto_id, 2) AS INT) % 10 WHEN 0 THEN 'HOURLY, daily digest' WHEN 1 THEN 'twice Daily' WHEN 2 THEN 'Weekly' WHEN 3 THEN '2 per month' WHEN 4 THEN 'continuous' WHEN 5 THEN 'on events' WHEN 6 THEN 'yearly' END AS said FROM sources""", "sources")


@query("""SELECT auto_id, CAST(CASE cadence WHEN 'hourly' THEN 3600 WHEN 'daily' THEN 86400 WHEN 'weekly' THEN 7 * 86400 WHEN 'biweekly' THEN 14 * 86400 WHEN 'monthly' THEN 31 * 86400 WHEN 'quarterly' THEN 92 * 86400 WHEN 'semiannual' THEN 184 * 86400 WHEN 'annual' THEN 366 * 86400 END AS BIGINT) AS secs,
 CASE WHEN said ILIKE '%hourly%' THEN 'hourly' WHEN said ILIKE '%daily%' THEN 'daily' WHEN said ILIKE '%weekly%' THEN 'weekly' WHEN said ILIKE '%per %' OR said ILIKE '%continuous%' OR said ILIKE '%event%' THEN 'event_driven' ELSE 'archival_refresh' END AS norm,
 last_artifact_at IS NULL OR epoch(TIMESTAMP '2024-02-01' - last_artifact_at) >= 60 * CASE cadence WHEN 'hourly' THEN 50 WHEN 'weekly' THEN 6.5 * 24 * 60 WHEN 'archival_refresh' THEN 27 * 24 * 60 WHEN 'one_time' THEN 365 * 24 * 60 ELSE 20 * 60 END AS due FROM cadences""", "cadences")
def f32_cadence(d):
    """F32 and H9."""
    c = F.col("cadence")
    return d.cadences.select("auto_id", vl.cadence_seconds(c).alias("secs"), vl.normalize_cadence(F.col("said")).alias("norm"), vl.is_due(c, F.col("last_artifact_at"), F.lit("2024-02-01").cast("timestamp")).alias("due"))


@query("""SELECT s_suppkey AS id, CAST(s_suppkey AS STRING) AS number, concat(CASE s_suppkey % 3 WHEN 0 THEN 'n ' WHEN 1 THEN 's ' ELSE '' END, lower(s_name), CASE s_suppkey % 2 WHEN 0 THEN ' st' ELSE ' ave' END) AS body FROM supplier""")
def f33_normalize_address(d):
    a = tx.normalize_address(F.concat(F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 3 == 0, " North ").when(F.col("s_suppkey") % 3 == 1, " South ").otherwise(" "), F.col("s_name"), F.when(F.col("s_suppkey") % 2 == 0, " Street, Suite ").otherwise(" Avenue, Suite "), (F.col("s_suppkey") % 90 + 1).cast("string")))
    return d.supplier.select(F.col("s_suppkey").alias("id"), a["number"].alias("number"), a["body"].alias("body"))


view("addresses", """SELECT s_suppkey AS id, c.* FROM supplier JOIN (VALUES (0, 'Historic District, 11680 Hayden Road, Manassas, VA, USA', 'Historic District', 'Manassas', 'VA', NULL, 'US', 'freetext_us'),
  (1, '1 Main St, Austin, Texas 78701-1234, united states', '1 Main St', 'Austin', 'TX', '78701-1234', 'US', 'freetext_us'), (2, '5 Rue X, Paris, France', '5 Rue X', NULL, NULL, NULL, NULL, 'freetext'), (3, 'only this', 'only this', NULL, NULL, NULL, NULL, 'freetext_unsegmented'),
  (4, ' , Austin', NULL, NULL, NULL, NULL, NULL, NULL), (5, CAST(NULL AS STRING), NULL, NULL, NULL, NULL, NULL, NULL), (6, '2 Elm, O''Fallon, Nowhere 60000, USA', '2 Elm', 'O''Fallon', NULL, '60000', 'US', 'freetext_us'), (7, '3 Elm, 5th Ward, TX 78701, USA', '3 Elm', NULL, NULL, NULL, NULL, 'freetext'),
  (8, '9 Oak, St. Paul, mn 55101, USA', '9 Oak', 'St. Paul', 'MN', '55101', 'US', 'freetext_us')) AS c(k, addr, street, city, state, zip, country, basis) ON s_suppkey % 9 = c.k""")


@query("SELECT id, street, city, state, zip, country, basis FROM addresses", "addresses")
def f34_parse_address(d):
    a = tx.parse_address_rtl(F.col("addr"))
    return d.addresses.select("id", *[a[c].alias(c) for c in ("street", "city", "state", "zip", "country", "basis")])


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS stem, substr(s_name, 1, 6) AS head FROM supplier")
def f36_campus_stem(d):
    """F36 and F37."""
    name = F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, " - Building 4").otherwise(""))
    return d.supplier.select(F.col("s_suppkey").alias("id"), tx.campus_stem(name).alias("stem"), tx.head(F.col("s_name"), 6).alias("head"))


view("issues", """SELECT o_orderkey AS id, CASE o_custkey % 6 WHEN 0 THEN 'Highest' WHEN 1 THEN 'critical' WHEN 2 THEN 'High' WHEN 3 THEN 'Medium' WHEN 4 THEN 'Low' END AS priority, CASE o_orderkey % 7 WHEN 0 THEN 'P1' WHEN 1 THEN 'p2' WHEN 2 THEN 'P3' WHEN 3 THEN 'Governance' WHEN 4 THEN 'decision-needed' WHEN 5 THEN 'BLOCKED' ELSE 'x' END AS label,
  CASE o_orderstatus WHEN 'P' THEN 'Was Blocked' ELSE 'Open' END AS status FROM orders""")


@query("""SELECT id, CASE WHEN lower(coalesce(priority, '')) IN ('highest', 'critical') OR lower(label) = 'p1' THEN 'P1' WHEN lower(coalesce(priority, '')) = 'high' OR lower(label) = 'p2' THEN 'P2' WHEN lower(coalesce(priority, '')) = 'medium' OR lower(label) = 'p3' THEN 'P3' ELSE 'P4' END AS band,
 lower(status) LIKE '%blocked%' OR lower(label) IN ('blocked', 'decision-needed', 'governance') AS blocked FROM issues""", "issues")
def f40_priority_band(d):
    labels = F.array("label", F.lit("other"))
    return d.issues.select("id", tx.priority_band(F.col("priority"), labels).alias("band"), tx.is_blocked(F.col("status"), labels).alias("blocked"))


@query("""SELECT id, greatest(1, least(5, CAST(round(x / 20 + 0.5) AS BIGINT))) AS score, greatest(1, least(5, CAST(round(5 - 4 * x / 100) AS BIGINT))) AS opposed, greatest(1, least(5, CAST(round(1 + 4 * x / 100) AS BIGINT))) AS open,
 least(CASE WHEN w >= 1000 THEN 5 WHEN w >= 300 THEN 4 WHEN w >= 100 THEN 3 WHEN w >= 20 THEN 2 ELSE 1 END, CASE WHEN x >= 95 THEN 5 WHEN x >= 80 THEN 4 WHEN x >= 50 THEN 3 ELSE 2 END)::BIGINT AS power, greatest(coalesce(o_totalprice, 0) - 100000, 0) AS headroom
FROM (SELECT o_orderkey AS id, CAST(o_custkey % 101 AS DOUBLE) AS x, o_totalprice / 100 AS w, o_totalprice FROM orders)""")
def f42_dimension_score(d):
    """F42 and P1."""
    x = (F.col("o_custkey") % 101).cast("double")
    score = lambda kind: vl.dimension_score(x, kind)
    return d.orders.select(F.col("o_orderkey").alias("id"), score("level").alias("score"), score("opposition").alias("opposed"), score("openness").alias("open"), vl.power_score(F.col("o_totalprice") / 100, x).alias("power"), vl.headroom(F.col("o_totalprice"), F.lit(100000.0)).alias("headroom"))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN concat(p_brand, '|', CAST(p_size AS STRING)) WHEN 1 THEN '' END AS texts FROM part")
def f26_json_texts(d):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat(F.lit('["'), "p_brand", F.lit('", '), F.col("p_size").cast("string"), F.lit("]"))).when(k == 1, "[]").when(k == 2, F.concat(F.lit('{"a": "'), "p_brand", F.lit('"}'))).otherwise("broken [")
    return d.part.select(F.col("p_partkey").alias("id"), F.array_join(tx.json_texts(raw), "|").alias("texts"))


@query("""SELECT p_partkey AS id, p_brand AS got, concat('{"brand":"', p_brand, '","none":null}') AS built, concat('{"brand":"', p_brand, '"}') AS bare, concat('{"n":1,"a":{"b":"', p_brand, '","d":[null,{"f":":null"}]}}') AS stripped, concat('{"a":2,"n":null,"z":[', CAST(p_size AS STRING), ']}') AS merged FROM part""")
def f27_json(d):
    """Get, build, strip nulls and merge."""
    doc = F.concat(F.lit('{"n": 1, "a": {"b": "'), "p_brand", F.lit('", "c": null, "d": [null, {"e": null, "f": ":null"}]}, "x": null}'))
    other = F.concat(F.lit('{"z": ['), F.col("p_size").cast("string"), F.lit('], "a": 2}'))
    fields = {"brand": F.col("p_brand"), "none": F.lit(None).cast("string")}
    return d.part.select(F.col("p_partkey").alias("id"), tx.json_get(doc, "a", "b").alias("got"), tx.json_build(**fields).alias("built"), tx.json_build(True, **fields).alias("bare"), tx.json_strip_nulls(doc).alias("stripped"), tx.json_merge(F.lit('{"n": null, "a": {"q": 1}}'), other).alias("merged"))
