"""Adapter views: deterministic projections of the driver's tables into the shapes the operators take."""

from __future__ import annotations

from lodestone.plans.base import view

AS_OF = "2001-08-02"
AS_OF_EVENTS = "2024-02-01"

view("v1", """
SELECT l_orderkey AS entity_id, l_suppkey AS source_id,
  CASE l_suppkey % 6 WHEN 0 THEN 'official_record' WHEN 1 THEN 'operator_first_party' WHEN 2 THEN 'commercial_dataset'
    WHEN 3 THEN 'directory' WHEN 4 THEN 'news' ELSE 'derived' END AS source_class,
  CAST(l_shipdate AS DATE) AS observed_at,
  CASE l_partkey % 4 WHEN 0 THEN 'name' WHEN 1 THEN 'operator' WHEN 2 THEN 'coordinates' ELSE 'capacity' END AS attribute,
  CASE WHEN l_partkey % 4 = 0 THEN l_returnflag WHEN l_partkey % 4 = 1 THEN l_linestatus END AS value_text,
  CASE WHEN l_partkey % 4 = 3 THEN CAST(floor(l_quantity / 20) * 20 AS DOUBLE) END AS value_num,
  CASE WHEN l_partkey % 4 = 2 THEN CAST(30 + floor(l_quantity / 20) AS DOUBLE) END AS lat,
  CASE WHEN l_partkey % 4 = 2 THEN CAST(-100 + floor(l_quantity / 25) AS DOUBLE) END AS lng,
  CASE WHEN l_partkey % 4 = 3 THEN CASE l_suppkey % 2 WHEN 0 THEN 'it_load' ELSE 'gross_utility' END END AS capacity_basis,
  concat('L', CAST(l_suppkey % 7 AS STRING)) AS lineage, (l_suppkey % 3 <> 0) AS redistributable,
  CASE l_linenumber % 4 WHEN 0 THEN 'VRF' WHEN 1 THEN 'SRC' WHEN 2 THEN 'INF' ELSE 'EST' END AS cap,
  CAST(concat('2001-09-', lpad(CAST(1 + (l_orderkey * 7 + l_linenumber * 5 + l_partkey) % 5 AS STRING), 2, '0')) AS DATE) AS ingested_at, (l_suppkey % 23 = 0) AS retracted, (l_suppkey % 19 = 0) AS superseded,
  concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS obs_id
FROM lineitem""")

view("entities", """
SELECT DISTINCT l_orderkey AS entity_id,
  CASE l_orderkey % 5 WHEN 0 THEN 'parcel' WHEN 1 THEN 'address' WHEN 2 THEN 'centroid' WHEN 3 THEN 'municipality' ELSE 'none' END AS geo_precision,
  CASE l_orderkey % 11 WHEN 0 THEN 'operational' WHEN 1 THEN 'commissioning' WHEN 2 THEN 'expansion' WHEN 3 THEN 'construction' WHEN 4 THEN 'permitted' WHEN 5 THEN 'entitled'
    WHEN 6 THEN 'announced' WHEN 7 THEN 'rumored' WHEN 8 THEN 'decommissioned' WHEN 9 THEN 'unheard of' END AS lifecycle,
  concat('L', CAST(1 + l_orderkey % 4 AS STRING)) AS old_layer, CAST(l_orderkey % 101 AS BIGINT) AS old_score,
  CASE l_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' END AS old_band, l_orderkey % 2 = 0 AS old_publishable
FROM lineitem""")

view("bands", """
SELECT * FROM (VALUES ('low', 0, 39, 1), ('medium', 40, 59, 2), ('high', 60, 79, 3), ('verified', 80, 100, 4)) AS b(band, lo, hi, sort_order)""")

view("registry", """
SELECT s_suppkey AS source_id, s_name AS source_name,
  CASE s_suppkey % 4 WHEN 0 THEN 'cleared' WHEN 1 THEN 'attribution_required' WHEN 2 THEN 'restricted' ELSE 'unknown' END AS license_status
FROM supplier""")

view("v2", """
SELECT n_name AS state, concat('s', CAST(o_custkey % 5 AS STRING)) AS source_key, CAST(o_orderkey AS STRING) AS record_id, c_name AS recipient,
  CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE concat(n_name, CASE WHEN o_custkey % 2 = 0 THEN ' County' ELSE '' END) END AS county,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'tax abatement' WHEN '2-HIGH' THEN 'cash grant' WHEN '3-MEDIUM' THEN 'TIF' ELSE 'Sales Tax exemption' END AS award_type,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'abatement' WHEN '2-HIGH' THEN 'grant' WHEN '3-MEDIUM' THEN 'tif' WHEN '4-NOT SPECIFIED' THEN 'exemption' END AS incentive_type,
  o_totalprice AS amount, CAST(o_orderdate AS DATE) AS term_start, CAST(NULL AS DATE) AS term_end, CASE WHEN o_custkey % 4 <> 0 THEN CAST(o_custkey % 4 * 2.5 AS DOUBLE) END AS term_years,
  CASE WHEN o_custkey % 3 <> 0 THEN concat('Program ', CAST(o_custkey % 3 AS STRING)) END AS program_name, CASE WHEN o_custkey % 5 = 0 THEN 'Act 7' END AS statute_citation
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")

view("award_registry", """
SELECT * FROM (VALUES ('s0', 'VRF', 'primary'), ('s1', 'SRC', 'aggregator'), ('s2', 'INF', 'primary'), ('s3', 'EST', 'aggregator')) AS r(source_key, confidence, source_kind)""")

view("v3", """
SELECT c_custkey AS site_id, c_name AS name, c_mktsegment AS operator, CAST(c_nationkey % 5 AS INT) AS country, c_nationkey AS subdivision,
  30 + (c_custkey % 37) * 0.01 AS lat, -100 + (c_custkey % 41) * 0.01 AS lng,
  CASE WHEN c_custkey % 10 <> 0 THEN c_custkey - c_custkey % 10 END AS parent_id,
  CASE WHEN c_custkey % 3 = 0 THEN concat('X', CAST(floor(c_custkey / 6) AS BIGINT)) END AS external_id
FROM customer""")

view("v4", """
SELECT p_partkey AS company_id,
  concat(CASE WHEN p_partkey % 11 = 0 THEN 'The ' ELSE '' END, p_brand, ' ', p_name,
    CASE p_partkey % 6 WHEN 0 THEN ' Inc' WHEN 1 THEN ' LLC' WHEN 2 THEN ' Holdings Inc' WHEN 3 THEN '' WHEN 4 THEN ', Ltd.' ELSE ' Group' END) AS raw_name,
  p_type AS kind, p_size AS size, p_retailprice AS price, (p_partkey % 5 <> 0) AS active
FROM part""")

view("v6", """
SELECT o_orderkey AS mention_id, concat('Supplier#', lpad(CAST(o_custkey % 100 AS STRING), 9, '0')) AS name_frag,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('C', CAST(o_custkey % 5 AS STRING)) END AS county_hint,
  CAST(o_custkey % 4 AS INT) AS state_hint, CAST(100 + 50 * (o_orderkey % 5) AS DOUBLE) AS kv,
  CASE o_orderstatus WHEN 'F' THEN 'actual' WHEN 'O' THEN 'projected' ELSE 'unknown' END AS date_type,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS inservice_date
FROM orders""")

view("anchors", """
SELECT s_suppkey AS anchor_id, s_name AS anchor_name, concat('C', CAST(s_suppkey % 5 AS STRING)) AS county, CAST(s_suppkey % 4 AS INT) AS state,
  CAST(100 + 50 * (s_suppkey % 5) AS DOUBLE) AS kv
FROM supplier""")

view("v7", """
SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'campus' WHEN p_partkey % 10 <= 3 THEN 'site' ELSE 'building' END AS grain,
  CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 10 <= 3 THEN p_partkey - p_partkey % 10
    ELSE p_partkey - p_partkey % 10 + 1 + p_partkey % 3 END AS parent_id,
  CASE WHEN p_partkey % 97 = 0 AND p_partkey > 97 THEN p_partkey - 97 END AS superseded_by, (p_partkey % 2 = 0) AS publishable
FROM part""")

view("v7bad", """
SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'campus' WHEN p_partkey % 10 <= 3 THEN 'site' ELSE 'building' END AS grain,
  CASE WHEN p_partkey % 13 = 0 THEN p_partkey WHEN p_partkey % 17 = 0 THEN -1 WHEN p_partkey % 20 = 1 THEN p_partkey + 1 WHEN p_partkey % 20 = 2 THEN p_partkey - 1
    WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey - 1 END AS parent_id
FROM part""")

view("v8", """
SELECT s_name AS company, CASE WHEN l_returnflag = 'R' THEN 'announced' WHEN l_linestatus = 'O' THEN 'operational' ELSE 'closed' END AS status,
  l_quantity AS capacity, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_extendedprice / 1000 END AS acres, n_name AS state,
  CASE l_linenumber % 4 WHEN 0 THEN 'T1' WHEN 1 THEN 'T2' WHEN 2 THEN 'T3' ELSE 'T4' END AS tier,
  CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE 100 * (1 - l_discount) END AS score,
  concat('tenant', CAST(l_partkey % 3 AS STRING)) AS tenant_a, concat('tenant', CAST(l_partkey % 5 AS STRING)) AS tenant_b
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""")

view("v10", """
SELECT o_orderpriority AS source_id, CAST(o_custkey % 7 AS INT) AS jurisdiction, 'load' AS attribute, CAST(2030 AS INT) AS target_year, 'mw' AS metric,
  CASE o_custkey % 2 WHEN 0 THEN 'base' ELSE 'high' END AS scenario, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS published,
  max(o_totalprice) AS value, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'MW' END AS unit
FROM orders GROUP BY o_orderpriority, o_custkey % 7, o_custkey % 2, CAST(date_trunc('quarter', o_orderdate) AS DATE)""")

view("oplog", """
SELECT event_id, concat('A', CAST(user_id % 20 AS STRING)) AS auto_id, ts AS completed_at, (event_type <> 'error') AS success,
  value AS amount, CASE WHEN event_type = 'error' THEN 'failed' ELSE '[]' END AS errors
FROM events""")

view("sources", """
SELECT auto_id, CASE CAST(substr(auto_id, 2) AS INT) % 5 WHEN 0 THEN 'hourly' WHEN 1 THEN 'daily' WHEN 2 THEN 'weekly' WHEN 3 THEN 'monthly' ELSE NULL END AS cadence,
  CASE CAST(substr(auto_id, 2) AS INT) % 3 WHEN 0 THEN 'cleared' WHEN 1 THEN 'restricted' ELSE 'attribution_required' END AS license_status,
  CASE CAST(substr(auto_id, 2) AS INT) % 4 WHEN 0 THEN 'paused' ELSE 'active' END AS status,
  CASE CAST(substr(auto_id, 2) AS INT) % 6 WHEN 0 THEN 'query' ELSE 'feed' END AS lane, max(completed_at) AS last_artifact_at, count(*) AS n
FROM oplog GROUP BY auto_id""", "oplog")

view("polygons", """
SELECT r_regionkey AS poly_id, v.seq, CAST(-100 + r_regionkey * 0.08 + v.dx AS DOUBLE) AS x, CAST(30 + r_regionkey * 0.07 + v.dy AS DOUBLE) AS y
FROM region CROSS JOIN (VALUES (0, 0.003, 0.004), (1, 0.093, 0.004), (2, 0.093, 0.084), (3, 0.048, 0.034), (4, 0.003, 0.084)) AS v(seq, dx, dy)""")
