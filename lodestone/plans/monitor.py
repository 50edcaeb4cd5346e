"""Queries over monitoring, queue state, quality gates and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.operators import analytics as an
from lodestone.operators import monitor as mo
from lodestone.plans.base import SQL, query, view
from lodestone.plans.fixtures import AS_OF_EVENTS as AT
from lodestone.storage import materialize, shared_dir
from lodestone.streaming import failures
from lodestone.streaming.ingest import HashTable, content_key, ingest_stream, trailing_stream

view("watches", """SELECT concat(lane, ':', auto_id) AS watch_key, auto_id, CASE WHEN CAST(substr(auto_id, 2) AS INT) % 2 = 0 THEN 'poll' ELSE 'error' END AS mode, cadence, CAST(1.5 AS DOUBLE) AS grace FROM sources
UNION ALL SELECT 'feed:none', 'A99', 'poll', 'daily', CAST(1.0 AS DOUBLE)""", "sources")

STALE = f"""SELECT w.watch_key, last_at, CAST(epoch(TIMESTAMP '{AT}') - floor(epoch(last_at)) AS BIGINT) AS age_s, CAST(c * grace AS BIGINT) AS threshold_s,
 last_at IS NULL OR CASE WHEN mode = 'error' THEN err = 'failed' ELSE coalesce(epoch(TIMESTAMP '{AT}') - floor(epoch(last_at)) > c * grace, false) END AS breached FROM
 (SELECT w.*, CASE cadence WHEN 'hourly' THEN 3600 WHEN 'daily' THEN 86400 WHEN 'weekly' THEN 604800 WHEN 'monthly' THEN 2678400 END AS c, last_at, err FROM watches w LEFT JOIN
  (SELECT auto_id, max(completed_at) AS last_at, arg_max(errors, struct_pack(a := completed_at, b := errors)) AS err FROM oplog GROUP BY auto_id) l ON w.auto_id = l.auto_id) w"""


def _checks(d):
    return mo.staleness_check(d.watches, d.oplog.select("auto_id", F.col("completed_at").alias("at"), "errors"), AT)


@query(STALE, "watches", "oplog")
def h1_staleness_check(d):
    return _checks(d).drop("detail")


@query(f"SELECT split_part(watch_key, ':', 1) AS lane, count(*) AS n, string_agg(DISTINCT watch_key, ',' ORDER BY watch_key) AS watches FROM ({STALE}) WHERE breached GROUP BY 1", "watches", "oplog")
def h2_breach_summary(d):
    return mo.breach_summary(_checks(d))


@query("SELECT auto_id, n, f, f / n <= 0.05 AS healthy FROM (SELECT auto_id, count(*) AS n, count(*) FILTER (NOT success) AS f FROM oplog GROUP BY auto_id)", "oplog")
def h3_batch_health(d):
    g = d.oplog.groupBy("auto_id").agg(F.count("*").alias("n"), F.count_if(~F.col("success")).alias("f"))
    return mo.batch_health(g, "n", "f", F.lit(False))


@query(f"SELECT auto_id, max(completed_at) AS last_at, CAST(floor((epoch(TIMESTAMP '{AT}') - floor(epoch(max(completed_at)))) / 3600) AS BIGINT) AS hours_silent FROM oplog GROUP BY auto_id HAVING epoch(TIMESTAMP '{AT}') - floor(epoch(max(completed_at))) > 25 * 3600", "oplog")
def h4_stale_jobs(d):
    return mo.stale_jobs(d.oplog, "auto_id", "completed_at", AT)


@query(f"SELECT auto_id, count(*) AS runs, count(*) FILTER (NOT success) AS failures, max(completed_at) AS last_at, CASE WHEN epoch(TIMESTAMP '{AT}') - floor(epoch(max(completed_at))) > 36 * 3600 THEN 'stale' WHEN count(*) FILTER (NOT success) > 0 THEN 'failing' ELSE 'ok' END AS flag FROM oplog GROUP BY auto_id", "oplog")
def h5_ops_rollup(d):
    return mo.ops_rollup(d.oplog, "auto_id", "completed_at", "success", AT)


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS before, CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'x' ELSE p_brand END AS after, CASE WHEN p_partkey % 11 = 0 THEN 'appeared' WHEN p_partkey % 13 = 0 THEN 'gone' ELSE 'changed' END AS change FROM part WHERE (p_partkey % 11 = 0 OR p_partkey % 13 = 0 OR p_partkey % 7 = 0) AND NOT (p_partkey % 11 = 0 AND p_partkey % 13 = 0)")
def h6_snapshot_diff(d):
    """H6 and J20."""
    p = d.part.select(F.col("p_partkey").alias("id"), "p_brand")
    return mo.snapshot_diff(p.filter("id % 11 <> 0"), p.filter("id % 13 <> 0").withColumn("p_brand", F.when(F.col("id") % 7 == 0, "x").otherwise(F.col("p_brand"))), "id", "p_brand")


view("editions", "SELECT p_brand AS state, CAST(p_size AS INT) AS week, p_type AS section, (p_partkey % 3 <> 0) AS passed FROM part")


@query("SELECT DISTINCT e.state, e.week, e.section FROM editions e JOIN (SELECT state, max(week) AS week FROM editions GROUP BY state) c ON e.state = c.state AND e.week = c.week WHERE NOT passed", "editions")
def h7_failed_sections(d):
    return mo.section_registers(d.editions, d.editions.select("section").distinct(), d.editions.filter("passed"))["failed"].distinct()


@query("SELECT state, max(week) AS week FROM editions GROUP BY state", "editions")
def h7_current_editions(d):
    return mo.section_registers(d.editions, d.editions.select("section").distinct(), d.editions)["current"]


@query(f"SELECT count(*) AS sources, count(*) FILTER (status = 'active') AS active, count(*) FILTER (license_status IN ('cleared', 'attribution_required')) AS cleared, count(*) FILTER (epoch(TIMESTAMP '{AT}') - floor(epoch(last_artifact_at)) <= 86400) AS recent, count(*) FILTER (cadence IS NULL) AS no_cadence FROM sources", "sources")
def h8_census(d):
    return mo.census(d.sources, AT)


@query("""SELECT auto_id, CAST(coalesce(max(n) FILTER (g = last), 0) AS BIGINT) AS trailing_failures, CAST(coalesce(max(n), 0) AS BIGINT) AS longest_run, coalesce(max(n) FILTER (g = last), 0) >= 5 AS in_error FROM (SELECT l.auto_id, l.last, r.g, r.n FROM
 (SELECT auto_id, max(g) AS last FROM (SELECT auto_id, count(*) FILTER (success) OVER (PARTITION BY auto_id ORDER BY completed_at, event_id) AS g FROM oplog) GROUP BY auto_id) l LEFT JOIN
 (SELECT auto_id, g, count(*) AS n FROM (SELECT auto_id, success, count(*) FILTER (success) OVER (PARTITION BY auto_id ORDER BY completed_at, event_id) AS g FROM oplog) WHERE NOT success GROUP BY auto_id, g) r ON l.auto_id = r.auto_id) GROUP BY auto_id""", "oplog")
def g2_failure_runs(d):
    return mo.failure_runs(d.oplog, "auto_id", ["completed_at", "event_id"], "success", 5)


@query(SQL["g2_failure_runs"][0], "oplog")
def g2_failure_stream(d):
    """The same runs from a file stream, which stops after the first third of the rows and is started again."""
    rows = d.oplog.select("auto_id", F.col("completed_at").cast("timestamp").alias("completed_at"), "event_id", "success")
    low, high = rows.agg(F.min("completed_at"), F.max("completed_at")).first()
    base = f"{shared_dir(d.spark)}/stream-{uuid.uuid4().hex}"
    cut = low + (high - low) / 3 if low else None
    before = d.spark.conf.get(failures.STORE[0])
    d.spark.conf.set(*failures.STORE)
    try:
        for part in (F.col("completed_at") <= F.lit(cut), F.col("completed_at") > F.lit(cut)):
            rows.filter(part).write.mode("append").parquet(f"{base}/in")
            out = failures.failure_stream(d.spark.readStream.schema(rows.schema).parquet(f"{base}/in"), "auto_id", "completed_at", "event_id", "success", 5)
            save = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")
            out.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        d.spark.conf.set(failures.STORE[0], before)
    return failures.latest(d.spark.read.schema(failures.OUT).parquet(f"{base}/out")).withColumnRenamed("key", "auto_id")


view("queue", "SELECT o_orderkey AS id, CASE o_custkey % 3 WHEN 0 THEN 'processing' ELSE 'pending' END AS status, CAST(o_custkey % 4 AS INT) AS attempts, o_orderdate AS claimed_at FROM orders")


@query("""SELECT id, CASE WHEN id % 5 = 0 THEN 'done' WHEN id % 5 = 1 THEN CASE WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END WHEN status = 'processing' AND epoch(TIMESTAMP '2001-08-02' - claimed_at) > 26 * 3600 THEN 'pending' ELSE status END AS status,
 attempts + CASE WHEN id % 5 = 1 THEN 1 ELSE 0 END AS attempts FROM queue""", "queue")
def g3_advance_queue(d):
    r = d.queue.filter("id % 5 <= 1").select("id", (F.col("id") % 5 == 0).alias("ok"))
    return mo.advance_queue(d.queue, r, 3, 26, "2001-08-02")


@query(f"SELECT auto_id, status = 'active' AND license_status IN ('cleared', 'attribution_required') AND epoch(TIMESTAMP '{AT}' - last_artifact_at) <= 30 * 86400 AND lane <> 'query' AS countable FROM sources", "sources")
def g4_activity_gate(d):
    return mo.activity_gate(d.sources, AT).select("auto_id", "countable")


@query("SELECT event_type, count(*) FILTER (ts <= TIMESTAMP '2024-01-20' AND floor(epoch(ts)) > epoch(TIMESTAMP '2024-01-19')) AS last_24h, count(*) FILTER (floor(epoch(ts)) <= epoch(TIMESTAMP '2024-01-20')) AS last_30d FROM events GROUP BY event_type".replace("ts <= TIMESTAMP '2024-01-20'", "floor(epoch(ts)) <= epoch(TIMESTAMP '2024-01-20')"))
def g5_trailing_counts(d):
    return mo.trailing_counts(d.events, "event_type", "ts", "2024-01-20")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 400 > 120 THEN 'archive' ELSE 'demote' END AS action FROM customer WHERE c_custkey % 400 > 30 AND c_custkey % 3 = 0 AND c_custkey % 5 <> 0
 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-06-03') AND c_custkey % 11 <> 0""")
def g6_demote_candidates(d):
    day = F.lit("2001-08-02").cast("date")
    u = d.customer.select(F.col("c_custkey").alias("id"), F.date_sub(day, (F.col("c_custkey") % 400).cast("int")).alias("promoted_at"), (F.col("c_custkey") % 3).alias("n_live"))
    pins = u.filter("id % 11 = 0").select("id", day.alias("at"), F.lit("pin").alias("kind")).unionByName(u.filter("id % 7 = 0").select("id", F.date_sub(day, 9).alias("at"), F.lit("unpin").alias("kind")))
    signals = d.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("date").alias("at"))
    return mo.demote_candidates(u, u.filter("id % 5 = 0").select("id", F.lit("pending").alias("status")), signals, pins, "2001-08-02")


@query(f"SELECT e.event_id, NOT coalesce(l.success AND epoch(TIMESTAMP '{AT}') - floor(epoch(l.completed_at)) <= 72 * 3600, false) AS gated FROM oplog e LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY auto_id ORDER BY completed_at DESC, event_id DESC) AS rn FROM oplog) WHERE rn = 1) l ON e.auto_id = l.auto_id", "oplog")
def g7_gate_events(d):
    return mo.gate_events(d.oplog, d.oplog, AT, 72).select("event_id", "gated")


@query(f"SELECT auto_id FROM sources WHERE epoch(TIMESTAMP '{AT}') - floor(epoch(last_artifact_at)) >= 60 * CASE cadence WHEN 'hourly' THEN 50 WHEN 'weekly' THEN 6.5 * 24 * 60 ELSE 20 * 60 END ORDER BY last_artifact_at, auto_id LIMIT 10", "sources")
def r5_select_due(d):
    return mo.select_due(d.sources, AT, "cadence", "last_artifact_at", "auto_id", 10).select("auto_id")


@query("SELECT 'orders' AS name, n AS actual, e AS expected, n = e AS ok FROM (SELECT count(*) AS n FROM orders), (SELECT count(DISTINCT l_orderkey) AS e FROM lineitem) UNION ALL SELECT 'orphans', count(*), CAST(0 AS BIGINT), count(*) = 0 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def q1_run_gates(d):
    """As many orders as the lines name, and no line without its order."""
    n = d.lineitem.select("l_orderkey").distinct().count()
    return mo.run_gates({"orders": (d.orders, n), "orphans": (d.lineitem.join(d.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"), 0)})


@query("SELECT 'positive' AS rule, count(*) FILTER (l_quantity <= 5) AS violations FROM lineitem UNION ALL SELECT 'discount', count(*) FILTER (l_discount > 0.08) FROM lineitem")
def q2_check_rules(d):
    return mo.check_rules(d.lineitem, {"positive": F.col("l_quantity") > 5, "discount": F.col("l_discount") <= 0.08})


@query("SELECT count(acres) AS n_values, count(*) FILTER (acres IS NOT NULL AND score IS NULL) AS without_provenance FROM v8", "v8")
def q3_check_provenance(d):
    return mo.check_provenance(d.v8, "acres", ["score", "company"])


@query("SELECT count(*) AS n, CAST(sum(CAST(concat('0x', substr(md5(concat_ws('|', CAST(o_orderkey AS STRING), o_orderstatus)), 1, 8)) AS BIGINT)) AS BIGINT) AS checksum FROM orders")
def q5_fingerprint(d):
    return mo.fingerprint(d.orders, ["o_orderkey", "o_orderstatus"])


@query("SELECT round(CAST(sum(length(text)) AS DOUBLE), 2) AS total, sum(length(text)) = sum(n_chars) AS ok FROM documents")
def q7_check_budget(d):
    """The characters of all texts against the sum that the documents state."""
    stated = d.documents.agg(F.sum("n_chars")).first()[0]
    return mo.check_budget(d.documents.select(F.length("text").cast("double").alias("n")), "n", float(stated))


@query("SELECT split_part(watch_key, ':', 1) AS lane, count(*) AS n FROM watches GROUP BY 1", "watches")
def r7_group_by_lane(d):
    from lodestone.sources.bodies import group_by_lane

    return group_by_lane(d.watches, "watch_key")


def _stream(d):
    """The events table as a file stream, from a copy that Spark writes: a stream reads a folder."""
    e = materialize(content_key(d.events, "user_id", "props", "event_type").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "content_hash"), "events")
    return d.spark.readStream.schema(e.schema).parquet(e._lodestone_path)


@query("SELECT count(*) AS n, count(*) AS hashes FROM (SELECT DISTINCT user_id, coalesce(props, event_type) AS x FROM events)")
def g1_ingest_stream(d):
    base = f"{shared_dir(d.spark)}/stream-{uuid.uuid4().hex}"
    ingest_stream(_stream(d), f"{base}/table", f"{base}/state", "ts").awaitTermination()
    return HashTable(d.spark, f"{base}/table").read().agg(F.count("*").alias("n"), F.countDistinct("content_hash").alias("hashes"))


@query("""SELECT CAST(epoch(w) AS BIGINT) AS start_s, CAST(epoch(w) AS BIGINT) + 86400 AS end_s, event_type, count(*) AS n FROM (SELECT event_type, date_trunc('hour', ts) - to_hours(CAST(k AS INTEGER)) AS w FROM events, generate_series(0, 23) AS g(k))
WHERE w + INTERVAL 24 HOURS <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 HOURS FROM events) GROUP BY 1, 2, 3""")
def g5_trailing_stream(d):
    base = f"{shared_dir(d.spark)}/stream-{uuid.uuid4().hex}"
    q = trailing_stream(_stream(d), "ts", "event_type").writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = d.spark.read.schema("start timestamp, end timestamp, event_type string, n long").parquet(f"{base}/out")
    return out.select(F.unix_timestamp("start").alias("start_s"), F.unix_timestamp("end").alias("end_s"), "event_type", "n")


@query("SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_totalprice IS NOT NULL AND o_orderkey % 2 = 0 AND o_orderstatus <> 'P'")
def p2_renders(d):
    renders = F.col("o_totalprice").isNotNull() & (F.col("o_orderkey") % 2 == 0) & (F.col("o_orderstatus") != "P")
    return d.orders.withColumn("renders", renders).filter("renders").select(F.col("o_orderkey").alias("id"), "o_totalprice")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) = 'large anvil' ORDER BY p_partkey LIMIT 1")
def p5_point_lookup(d):
    return an.facet_filter(d.part.withColumn("_k", F.lower("p_name")), _k="large anvil").orderBy("p_partkey").limit(1).select("p_partkey", "p_name")
