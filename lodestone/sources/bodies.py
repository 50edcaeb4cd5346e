"""Landed bodies to rows: feeds, JSON feeds, index pages, robots rules, chunks, heading trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import any_term, decode_entities, strip_tags


def relevance_gate(df: DataFrame, terms: list[str], lane: str, title: str = "title", summary: str = "summary") -> DataFrame:
    """`gate`: pending, or skipped for query-lane rows whose title and summary hold none of the terms."""
    text = F.concat_ws(" ", title, summary)
    return df.withColumn("gate", F.when((F.col(lane) == "query") & ~text.rlike(any_term(terms)), "skipped").otherwise("pending"))


def signature_rates(df: DataFrame, group: str, text: str, signature: str, generic: str) -> DataFrame:
    """(group, n, hits, generic_hits): how often a signature and its generic variant occur in each group."""
    t = F.col(text)
    return df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(t.rlike(signature)).alias("hits"), F.count_if(t.rlike(generic)).alias("generic_hits"))


def address_gate(df: DataFrame, street: str, city: str, state: str) -> DataFrame:
    """`excluded`: the first reason for which an address can't be matched, null if it can."""
    s = F.trim(F.col(street))
    why = F.when(s.isNull() | (s == ""), "no_street").when(~s.rlike(r"\d"), "no_number").when(s.rlike(r"(?i)\bp\.?\s*o\.?\s*box\b"), "po_box").when(F.col(city).isNull(), "no_city").when(~F.coalesce(F.col(state).rlike("^[A-Z]{2}$"), F.lit(False)), "no_state")
    return df.withColumn("excluded", why)


def chunk_text(df: DataFrame, key: str, text: str, size: int = 2048, overlap: int = 256, min_len: int = 51) -> DataFrame:
    """(key, chunk_no, chunk): overlapping pieces; the last ends the text; short ones go. Numbers keep their gaps closed."""
    step = size - overlap
    n = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * step)
    parts = F.filter(F.transform(starts, lambda s: F.trim(F.substr(F.col(text), s + 1, F.lit(size)))), lambda c: F.length(c) >= min_len)
    return df.filter(F.col(text).isNotNull()).select(key, F.posexplode(parts).alias("chunk_no", "chunk"))


def _field(item: Column, tag: str) -> Column:
    body = F.regexp_extract(item, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)
    cdata = F.regexp_replace(body, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    return F.nullif(F.trim(decode_entities(strip_tags(cdata))), F.lit(""))


def shred_feed(df: DataFrame, key: str, body: str, most: int = 50) -> DataFrame:
    """(key, pos, title, link, published, summary): RSS items, else Atom entries; the first `most` of a feed, as its contract."""
    rss = F.regexp_extract_all(F.col(body), F.lit(r"(?is)<item(?:\s[^>]*)?>.*?</item\s*>"), F.lit(0))
    atom = F.regexp_extract_all(F.col(body), F.lit(r"(?is)<entry(?:\s[^>]*)?>.*?</entry\s*>"), F.lit(0))
    items = df.select(key, F.posexplode(F.slice(F.when(F.size(rss) > 0, rss).otherwise(atom), 1, most)).alias("pos", "item"))
    i = F.col("item")
    alternate = F.nullif(F.regexp_extract(i, r"""(?is)<link[^>]*rel=["']alternate["'][^>]*href=["']([^"']+)""", 1), F.lit(""))
    href = F.nullif(F.regexp_extract(i, r"""(?is)<link[^>]*href=["']([^"']+)""", 1), F.lit(""))
    link = F.coalesce(_field(i, "link"), alternate, href, _field(i, "guid"))
    return items.select(key, "pos", _field(i, "title").alias("title"), link.alias("link"), F.coalesce(_field(i, "pubDate"), _field(i, "published"), _field(i, "updated")).alias("published"), F.coalesce(_field(i, "description"), _field(i, "summary")).alias("summary"))


#: Adapters of JSON feeds: array path, title, link and date paths of a record.
JSON_FEEDS = (
    ("$.vulnerabilities", ("$.vulnerabilityName", "$.cve.id"), ("$.cveID", "$.cve.id"), ("$.dateAdded", "$.cve.published")),
    ("$.items", ("$.title",), ("$.url", "$.id"), ("$.date_published",)),
    ("$.features", ("$.properties.headline", "$.properties.event"), ("$.id",), ("$.properties.sent",)),
    ("$.incidents", ("$.name",), ("$.shortlink", "$.id"), ("$.updated_at", "$.created_at")),
    ("$", ("$.title", "$.name"), ("$.uri", "$.url", "$.id"), ("$.begin", "$.date")),
)


def shred_json_feed(df: DataFrame, key: str, body: str, most: int = 50) -> DataFrame:
    """(key, pos, title, link, published): the records of the first adapter whose array the body has; newest first, then cut."""
    v = F.try_parse_json(body)
    rows = F.lit(None).cast("array<struct<title:string,link:string,published:string>>")
    for path, title, link, at in reversed(JSON_FEEDS):
        arr = F.try_variant_get(v, path, "array<variant>")
        get = lambda x, paths: F.coalesce(*[F.try_variant_get(x, p, "string") for p in paths], F.lit(None).cast("string"))
        shaped = F.transform(arr, lambda x: F.struct(get(x, title).alias("title"), get(x, link).alias("link"), get(x, at).alias("published")))  # noqa: B023
        rows = F.when(arr.isNotNull(), shaped).otherwise(rows)
    newest = F.array_sort(F.filter(rows, lambda r: r["title"].isNotNull()), lambda a, b: F.when(F.coalesce(a["published"], F.lit("")) > F.coalesce(b["published"], F.lit("")), -1).when(F.coalesce(a["published"], F.lit("")) < F.coalesce(b["published"], F.lit("")), 1).otherwise(0))
    return df.select(key, F.posexplode(F.slice(newest, 1, most)).alias("pos", "r")).select(key, "pos", "r.title", "r.link", "r.published")


def _host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1)), r"^www\.", "")


def _absolute(href: Column, base: Column) -> Column:
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^(https?://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    return F.when(href.rlike("^https?://"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(F.regexp_replace(folder, "/?$", "/"), href))


def extract_links(df: DataFrame, key: str, html: str, base: str, min_text: int = 25, include: str | None = None, exclude: str | None = None, most: int = 30) -> DataFrame:
    """(key, pos, url, title): a page's links to its own host with enough text; fragments off, repeats out, the first `most`."""
    a = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<a\s[^>]*href\s*=\s*[\"'][^\"']+[\"'][^>]*>.*?</a\s*>"), F.lit(0))
    rows = df.select(key, F.col(base).alias("base"), F.posexplode(a).alias("pos", "a"))
    href = F.regexp_extract("a", r"(?is)href\s*=\s*[\"']([^\"'#]*)", 1)
    title = strip_tags(decode_entities(F.col("a")))
    r = rows.select(key, "pos", "base", _absolute(F.trim(href), F.col("base")).alias("url"), title.alias("title"), F.trim(href).alias("href"))
    r = r.filter((F.col("href") != "") & ~F.col("href").rlike("^(?i)(mailto|javascript|tel):") & (F.length("title") >= min_text) & (_host(F.col("url")) == _host(F.col("base"))))
    r = r.filter(F.col("url").rlike(include)) if include else r
    r = r.filter(~F.col("url").rlike(exclude)) if exclude else r
    first = r.groupBy(key, "url").agg(F.min_by(F.struct("pos", "title"), "pos").alias("f")).select(key, "f.pos", "url", "f.title")
    return first.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("pos"))).filter(F.col("_r") <= most).drop("_r")


def alternate_links(df: DataFrame, key: str, html: str, base: str) -> DataFrame:
    """(key, href): feeds that link elements announce."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<link\s[^>]*>"), F.lit(0))
    t = df.select(key, F.col(base).alias("base"), F.explode(tags).alias("t"))
    feed = F.col("t").rlike(r"(?i)rel\s*=\s*[\"']?alternate") & F.col("t").rlike(r"(?i)type\s*=\s*[\"']?application/(rss|atom|feed)\+?(xml|json)")
    href = F.regexp_extract("t", r"(?i)href\s*=\s*[\"']([^\"']+)", 1)
    return t.filter(feed & (href != "")).select(key, _absolute(href, F.col("base")).alias("href")).distinct()


def classify_body(body: Column, content_type: Column) -> Column:
    head = F.lower(F.substring(F.ltrim(body), 1, 500))
    json_ = head.rlike(r"^[\[{]") | F.coalesce(content_type.contains("json"), F.lit(False))
    return F.when(head.rlike(r"<rss|<rdf:rdf"), "rss").when(head.rlike(r"<feed[\s>]"), "atom").when(json_ & head.rlike(r"^[\[{]"), "json").otherwise("none")


def robots_allowed(df: DataFrame, key: str, robots: str, path: str) -> DataFrame:
    """(key, allowed): whether a path is open to every agent; unknown rules (null) never allow."""
    lines = df.select(key, F.col(path).alias("path"), F.posexplode(F.split(F.coalesce(robots, F.lit("")), "\r?\n")).alias("i", "line"), F.col(robots).isNotNull().alias("known"))
    text = F.trim(F.regexp_replace("line", "#.*$", ""))
    agent = F.nullif(F.regexp_extract(text, r"(?i)^user-agent\s*:\s*(\S+)", 1), F.lit(""))
    rule = F.nullif(F.regexp_extract(text, r"(?i)^disallow\s*:\s*(\S+)", 1), F.lit(""))
    w = W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    r = lines.withColumn("rule", rule).withColumn("agent", F.last(agent, ignorenulls=True).over(w))
    hit = (F.col("agent") == "*") & F.col("rule").isNotNull() & F.expr("startswith(path, rule)")
    return r.groupBy(key).agg((F.bool_and("known") & ~F.bool_or(F.coalesce(hit, F.lit(False)))).alias("allowed"))


def unnest_ordinal(df: DataFrame, key: str, array: Column) -> DataFrame:
    return df.select(key, F.posexplode(array).alias("pos", "value"))


def heading_tree(df: DataFrame, doc: str, order: str, kind: str, text: str) -> DataFrame:
    """(doc, section_no, heading, n_blocks, body): blocks under the last heading before them; an implicit Introduction; empty sections go."""
    w = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    is_head = F.col(kind) == "heading"
    b = df.withColumn("section_no", F.count_if(is_head).over(w)).withColumn("heading", F.coalesce(F.last(F.when(is_head, F.col(text)), ignorenulls=True).over(w), F.lit("Introduction")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    return b.filter(~is_head).groupBy(doc, "section_no", "heading").agg(F.count("*").alias("n_blocks"), body.alias("body"))


def group_by_lane(df: DataFrame, key: str) -> DataFrame:
    """(lane, n): rows by what stands before the colon, largest first."""
    return df.groupBy(F.split(key, ":")[0].alias("lane")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lane")
