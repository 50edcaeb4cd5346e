"""Queries over landed text, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import classify
from lodestone.plans.base import query, view
from lodestone.sources import bodies as bo

CLASSES = [("steel|copper|brass", "metal"), ("economy", "budget"), ("promo", "promo"), ("standard", "standard")]


@query("SELECT company_id, CASE WHEN regexp_matches(lower(kind), 'steel|copper|brass') THEN 'metal' WHEN lower(kind) LIKE '%economy%' THEN 'budget' WHEN lower(kind) LIKE '%promo%' THEN 'promo' WHEN lower(kind) LIKE '%standard%' THEN 'standard' ELSE 'other' END AS cls FROM v4", "v4")
def p6_classify(d):
    return d.v4.select("company_id", classify(F.col("kind"), CLASSES, "other").alias("cls"))


@query("SELECT cls, confidence, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(kind), 'steel|copper|brass') THEN 'metal' WHEN lower(kind) LIKE '%economy%' THEN 'budget' ELSE 'other' END AS cls FROM v4) JOIN (VALUES ('metal', 0.9::DOUBLE), ('budget', 0.7::DOUBLE), ('other', 0.3::DOUBLE)) AS c(cls, confidence) USING (cls) GROUP BY 1, 2", "v4")
def p7_classify_with_confidence(d):
    rules = d.spark.createDataFrame([("metal", 0.9), ("budget", 0.7), ("other", 0.3)], "cls string, confidence double")
    c = d.v4.select(classify(F.col("kind"), CLASSES[:2], "other").alias("cls"))
    return c.join(F.broadcast(rules), "cls").groupBy("cls", "confidence").agg(F.count("*").alias("n"))  # three rules


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND NOT regexp_matches(lower(text), '(^|[^a-z0-9])(the|und)([^a-z0-9]|$)') THEN 'skipped' ELSE 'pending' END AS gate FROM documents")
def p8_relevance_gate(d):
    r = d.documents.select("doc_id", F.col("text").alias("title"), F.lit("").alias("summary"), F.when(F.col("doc_id") % 2 == 0, "query").otherwise("feed").alias("lane"))
    return bo.relevance_gate(r, ["the", "und"], "lane").select("doc_id", "gate")


@query("SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, 'the ')) AS hits, count(*) FILTER (regexp_matches(text, 'e')) AS generic_hits FROM documents GROUP BY lang")
def p10_signature_rates(d):
    return bo.signature_rates(d.documents, "lang", "text", "the ", "e")


@query("SELECT excluded, count(*) AS n FROM (SELECT CASE WHEN street IS NULL THEN 'no_street' WHEN id % 5 = 0 THEN 'no_city' WHEN id % 7 = 0 THEN 'no_state' END AS excluded FROM cands) GROUP BY 1", "cands")
def p11_address_gate(d):
    c = d.cands.withColumn("city", F.when(F.col("id") % 5 != 0, "X")).withColumn("state", F.when(F.col("id") % 7 != 0, "TX").otherwise("Texas"))
    return bo.address_gate(c, "street", "city", "state").groupBy("excluded").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_no, md5(c) AS digest FROM (SELECT doc_id, i, trim(substr(text, CAST(i * 1792 + 1 AS BIGINT), 2048), ' ') AS c FROM documents, generate_series(0, CAST(greatest(0, ceil((length(text) - 2048) / 1792)) AS BIGINT)) AS g(i)) WHERE length(c) > 50""")
def x1_chunk_text(d):
    return bo.chunk_text(d.documents, "doc_id", "text").select("doc_id", "chunk_no", F.md5("chunk").alias("digest"))


view("feeds", """SELECT o_orderkey AS id, CASE o_custkey % 2 WHEN 0 THEN concat('<rss><channel><item><title>A &amp; ', o_orderpriority, '</title><link>http://x/', CAST(o_orderkey AS STRING), '</link><pubDate>', CAST(CAST(o_orderdate AS DATE) AS STRING), '</pubDate><description><![CDATA[<b>Hi</b>]]></description></item></channel></rss>')
 ELSE concat('<feed><entry><title>B</title><link rel="alternate" href="http://y/', CAST(o_orderkey AS STRING), '"/><updated>', CAST(CAST(o_orderdate AS DATE) AS STRING), '</updated></entry></feed>') END AS body, o_custkey % 2 AS k, o_orderpriority AS p, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d FROM orders""")


@query("SELECT id, CASE k WHEN 0 THEN concat('A & ', p) ELSE 'B' END AS title, concat(CASE k WHEN 0 THEN 'http://x/' ELSE 'http://y/' END, CAST(id AS STRING)) AS link, d AS published, CASE k WHEN 0 THEN 'Hi' END AS summary FROM feeds", "feeds")
def x2_shred_feed(d):
    return bo.shred_feed(d.feeds, "id", "body").drop("pos")


@query("""SELECT o_orderkey AS id, CAST(0 AS INTEGER) AS pos, 'new' AS title, CAST(o_custkey AS STRING) AS link FROM orders UNION ALL SELECT o_orderkey, 1, 'old', '7' FROM orders WHERE o_custkey % 3 <> 2""")
def x3_shred_json_feed(d):
    k = F.col("o_custkey") % 3
    rec = lambda t, link, a, b, c: F.to_json(F.struct(F.lit(t).alias(a), link.cast("string").alias(b), F.lit("2024-02-01" if t == "new" else "2024-01-01").alias(c)))
    two = lambda a, b, c: F.concat(rec("old", F.lit(7), a, b, c), F.lit(","), rec("new", F.col("o_custkey"), a, b, c))
    body = F.when(k == 0, F.concat(F.lit('{"items": ['), two("title", "url", "date_published"), F.lit("]}"))).when(k == 1, F.concat(F.lit('{"vulnerabilities": ['), two("vulnerabilityName", "cveID", "dateAdded"), F.lit("]}"))).otherwise(F.concat(F.lit("["), rec("new", F.col("o_custkey"), "title", "url", "date"), F.lit("]")))
    return bo.shred_json_feed(d.orders.select(F.col("o_orderkey").alias("id"), body.alias("body")), "id", "body").select("id", "pos", "title", "link")


@query("""SELECT page_id, pos, url, title FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS r FROM (SELECT page_id, min(pos) AS pos, url, arg_min(title, pos) AS title FROM
 (SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), hrefs[i]) AS url, trim(titles[i]) AS title FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"#]*)"[^>]*>([^<]*)</a>', 1) AS hrefs, regexp_extract_all(html, '<a href="([^"#]*)"[^>]*>([^<]*)</a>', 2) AS titles FROM pages), generate_series(1, 200) AS g(i) WHERE i <= len(hrefs))
 WHERE length(title) >= 3 GROUP BY page_id, url)) WHERE r <= 30""")
def x4_extract_links(d):
    return bo.extract_links(d.pages, "page_id", "html", "url", min_text=3)


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat('https://e.org/feed', CAST(p_partkey AS STRING), '.xml') ELSE concat('https://', p_type, '.org/', CAST(p_size AS STRING)) END AS href FROM part WHERE p_partkey % 3 <> 2")
def x5_alternate_links(d):
    rss = F.concat(F.lit('<head><link rel="stylesheet" href="/s.css"><link rel="alternate" type="application/rss+xml" href="/feed'), F.col("p_partkey").cast("string"), F.lit('.xml"></head>'))
    atom = F.concat(F.lit('<link type="application/atom+xml" rel="alternate" href="https://'), F.col("p_type"), F.lit(".org/"), F.col("p_size").cast("string"), F.lit('">'))
    html = F.when(F.col("p_partkey") % 3 == 0, rss).when(F.col("p_partkey") % 3 == 1, atom).otherwise(F.concat(F.lit('<link rel="icon" href="/'), "p_name", F.lit('">')))
    return bo.alternate_links(d.part.select(F.col("p_partkey").alias("id"), html.alias("h"), F.lit("https://e.org/a/b").alias("u")), "id", "h", "u")


@query("SELECT kind, count(*) AS n FROM (SELECT CASE k WHEN 0 THEN 'rss' ELSE 'atom' END AS kind FROM feeds UNION ALL SELECT 'none' FROM pages) GROUP BY kind", "feeds")
def x7_classify_body(d):
    b = d.feeds.select("body").unionByName(d.pages.select(F.col("html").alias("body")))
    return b.select(bo.classify_body(F.col("body"), F.lit("text/html")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_size % 3 = 0 WHEN 1 THEN true WHEN 2 THEN p_size % 3 <> 0 ELSE false END AS allowed FROM part")
def x8_robots_allowed(d):
    k = F.col("p_partkey") % 4
    rules = F.when(k == 0, "User-agent: x\nDisallow: /\n\nUser-agent: *\nDisallow: /a # no\n").when(k == 1, "User-agent: x\nDisallow: /\nUser-agent: *\nDisallow:\n").when(k == 2, "User-agent: *\nDisallow: /b")
    path = F.concat(F.when(F.col("p_size") % 3 == 0, "/b/").otherwise("/a/"), F.replace("p_name", F.lit(" "), F.lit("-")))
    return bo.robots_allowed(d.part.select(F.col("p_partkey").alias("id"), rules.alias("r"), path.alias("p")), "id", "r", "p")


@query("SELECT p_partkey AS id, CAST(g.i AS INTEGER) AS pos, string_split(p_name, ' ')[CAST(g.i + 1 AS BIGINT)] AS value FROM part, generate_series(0, 1) AS g(i)")
def x9_unnest_ordinal(d):
    return bo.unnest_ordinal(d.part.select(F.col("p_partkey").alias("id"), "p_name"), "id", F.split("p_name", " "))


@query("""SELECT conv_id AS doc, CAST(sec AS BIGINT) AS section_no, max(heading) AS heading, count(*) AS n_blocks FROM (SELECT *, coalesce(max(h) OVER (PARTITION BY conv_id, sec), 'Introduction') AS heading FROM
 (SELECT conv_id, role, CASE WHEN role = 'user' THEN text END AS h, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS sec FROM conversations)) WHERE role <> 'user' GROUP BY 1, 2""")
def x10_heading_tree(d):
    b = d.conversations.select(F.col("conv_id").alias("doc"), "turn", F.when(F.col("role") == "user", "heading").otherwise("text").alias("kind"), "text")
    return bo.heading_tree(b, "doc", "turn", "kind", "text").drop("body")
