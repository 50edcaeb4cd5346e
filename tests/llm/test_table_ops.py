"""Quality, sharding, language, images, pages, conversations and the pipeline."""

from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, html_text, image, language, quality, shard

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


def labelled(spark, n=240):
    r = random.Random(1)
    good = lambda: " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(80)) + "."
    bad = lambda: " ".join(["BUY!!!"] * 60)
    rows = [(i, bad() if i % 4 == 0 else good(), f"s{i % 5}", "en", 7) for i in range(n)]
    rows += [(n, None, None, None, 7), (n + 1, "", "s1", None, 7), (n + 2, "x" * 100_000, "s1", "en", 7), rows[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n long")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(n // 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality(spark):
    docs, labels = labelled(spark)
    out = quality.classify(docs, labels).collect()
    assert len(out) == docs.count()
    held_out = [r for r in out if r.doc_id is not None and 120 <= r.doc_id < 240]
    assert sum(r.kept == (r.doc_id % 4 != 0) for r in held_out) >= 0.95 * len(held_out)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in out)


def test_quality_without_labels_or_rows(spark):
    docs, labels = labelled(spark)
    assert quality.classify(docs, labels.limit(0)).filter("not kept").count() == 0
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_sparse_paths_shrink_toward_their_host(spark):
    rows = [("h", "a", 0.9)] * 200 + [("h", "b", 0.1)] + [("g", "a", 0.1)] * 200
    rates = {(r.host, r.section): r for r in quality.site_rates(spark.createDataFrame(rows, "host string, section string, p double"), 0.5).collect()}
    b = rates["h", "b"]
    assert 0.5 < (b.s + b.k * b.prior) / (b.n + b.k) < 0.9


def test_hilbert_curve_is_one(spark):
    g = spark.range(512).select(*[((F.col("id") / 8**i).cast("int") % 8).alias(c) for i, c in enumerate("xyz")])
    g = g.withColumn("h", shard.hilbert3(F.col("x"), F.col("y"), F.col("z"), 3)).orderBy("h").collect()
    assert [r.h for r in g] == list(range(512))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(g, g[1:], strict=False))


def test_shards(spark):
    rows = [(i, "same" if i % 3 else f"t{i}" * (i % 50), f"l{i % 3}", f"s{i % 7}", 1) for i in range(500)] + [(None, None, None, None, 1), (5, "é", "l", None, 1), (5, "é", "l", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard long")
    out = shard.shard_documents(df).collect()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(v) for v in by.values()]
    assert len(out) == len(rows) and set(by) == set(range(24)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = sorted((i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in out) == want
    assert shard.shard_documents(df.limit(0)).count() == 0


def test_a_shard_is_written_by_several_tasks(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    df = spark.range(2_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("t"), (F.col("id") % 70).cast("int")).alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 5).alias("source"), F.lit(1).alias("Slot"))
    shard.write_shards(df, str(tmp_path / "s"), 3, files=4)
    for i in range(3):
        runs = sorted((x[0], x[-1], len(x)) for x in (pq.ParquetFile(f).read(["slot"]).column(0).to_pylist() for f in glob.glob(f"{tmp_path}/s/shard={i}/*.parquet")))
        assert len(runs) >= 3 and sum(n for *_, n in runs) == runs[-1][1] + 1 and all(b - a + 1 == n for a, b, n in runs)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 2_000 and "own_Slot" in back.columns


def test_written_shards_prune(spark, tmp_path):
    df = spark.createDataFrame([(i, "t" * (i % 90), f"l{i % 4}", f"s{i % 9}", i) for i in range(600)], "doc_id long, text string, lang string, source string, n_chars long")
    shard.write_shards(df, str(tmp_path / "s"), 6)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 600
    spread = [r.n for r in back.groupBy("shard").agg(F.countDistinct("lang").alias("n")).collect()]
    assert sum(spread) < 4 * 6


def test_language(spark):
    text = {"en": "the house of the man and the dog was in the garden with that cat ", "de": "der hund und die katze sind nicht in dem haus von der frau "}
    docs = spark.createDataFrame([(i, text["en" if i % 2 else "de"] * 3, "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    page = lambda lang, s: f'<html lang="{lang}"><body><article><p>{s * 4}</p></article></body></html>'
    rows = [(1, "http://a.de/de/1", page("de", text["de"]), "x"), (2, "http://b.com/en/2", page("de", text["en"]), "x"), (3, None, None, "x"), (4, "http://a.de/3", "", "x"), (1, "odd", "<html", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, lang string")
    out = language.identify(pages, language.train(docs)).collect()
    assert len(out) == 5
    got = {(r.page_id, r.url): r.lang for r in out}
    assert got[1, "http://a.de/de/1"] == "de" and got[2, "http://b.com/en/2"] == "en"
    assert language.identify(pages.limit(0), language.train(docs)).count() == 0
    assert language.identify(pages, language.train(docs.limit(0))).filter("lang is not null").count() == 0


def texture(seed, h=64, w=64):
    g = np.random.default_rng(seed)
    x = np.full((h, w), 120.0)
    for _ in range(26):
        y0, x0 = g.integers(0, 56, 2)
        a, b = g.integers(5, 22, 2)
        x[y0 : y0 + a, x0 : x0 + b] = g.integers(0, 256)
    return x


def test_image_copies(spark):
    rows, g = [], np.random.default_rng(5)
    for i in range(12):
        x = texture(i)
        rows.append((10 * i, image.write_pgm(x), "a"))
        rows.append((10 * i + 1, image.write_pgm(np.clip(x[4:60, 2:61] * 0.9 + 12 + g.normal(0, 1, (56, 59)), 0, 255)), "a"))
    rows += [(500, rows[0][1], "b"), (501, None, "b"), (502, b"", "b"), (503, b"P5 4 4 255\n123", "b"), (504, image.write_pgm(np.full((64, 64), 9)), "b"), (None, rows[2][1], "b"), (10, rows[2][1], "b")]
    out = {r.image_id: r for r in image.copies(spark.createDataFrame(rows, "image_id long, image binary, fp string")).collect()}
    found = sum(out[10 * i + 1].component_id == 10 * i for i in range(12))
    assert found >= 11
    assert all(out[10 * i].component_id == 10 * i for i in range(12)) and out[500].component_id == 0
    assert all(out[i].component_id == i and out[i].n_keypoints == 0 for i in (501, 502, 503, 504))


def test_image_lists_longer_than_pairs(spark, monkeypatch):
    monkeypatch.setattr(image, "PAIRED", 2)
    x = texture(3)
    rows = [(i, image.write_pgm(np.clip(x + i, 0, 255))) for i in range(8)]
    out = image.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()
    assert {r.component_id for r in out} == {0}


PROSE = "The cat of the house is in the garden and it was happy with the day that was long and for all of the people in the town the time was good. " * 3


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<article><h1>T &amp; t</h1><p>a<b>b</b>\n c<br>d</p></article>", "T & t ab c d"),
        (f"<nav>menu</nav><div class='cookie-notice'>{PROSE}</div><div><p>{PROSE}</p></div><footer>{PROSE}</footer>", PROSE.strip()),
        (f"<article><p>{PROSE}<p>x<form>q</form><div class=comments><p>{PROSE}</p></div></article>", PROSE.strip() + " x"),
        ("<article><p>5 &lt; 6 &#233;&nbsp;z</p><!-- <p>no</p> --><script>var t='</p>'</script></article>", "5 < 6 é z"),
        ("<article><p>open<!-- never closed", "open"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "t"), (1, None, "<article><p>é</p></article>", "t")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [(1, "", 0), (1, "é", 1)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_collapse(spark):
    a = [("user", "hi"), ("assistant", "yo"), ("user", "more")]
    convs = {1: a[:2], 2: a, 3: a, 4: [("user", "hi"), ("assistant", "no")], 5: [("user", None)], 6: [("user", "")], 7: [("user", "hi")], 8: [(None, "x" * 50_000)]}
    rows = [(c, i, role, text, 0) for c, turns in convs.items() for i, (role, text) in enumerate(turns)] + [(None, 0, "user", "lone", 0)]
    out = {r.conv_id: r for r in chat.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long")).collect()}
    assert set(out) == {2, 4, 5, 6, 8, None} and out[2].n_copies == 2 and out[2].n_turns == 3
    assert out[2].rendered == "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n<|user|>\nmore<|end|>\n"


@tables
def test_collapse_against_sql(spark):
    from compare import duck, mismatch

    assert mismatch(chat.op8_chat_snapshot_collapse(spark, SF), duck(SF), chat.OP8_SQL) is None


@tables
def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(cp.STAGES):
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, SF)
        if i < len(cp.STAGES) - 1:
            assert docs.columns == columns
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before
    assert docs.filter("n_tokens > 0").count() == docs.count() == cp.run(spark, SF).count()


def test_near_descriptors_meet(spark):
    r = random.Random(9)
    rows = []
    for i in range(200):
        bits = [r.getrandbits(32) for _ in range(8)]
        far = list(bits)
        for k in r.sample(range(256), 7):
            far[k // 32] ^= 1 << k % 32
        rows += [(2 * i, 0, bits), (2 * i + 1, 0, far)]
    met = image._pairs(image._posts(spark.createDataFrame(rows, "node long, kp long, bits array<bigint>"))).select("a", "b").distinct().collect()
    assert {(x.a, x.b) for x in met} >= {(2 * i, 2 * i + 1) for i in range(200)}


def test_long_lists_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(image, "BLOCK", 4)
    rows = [(i, k, 7, 60) for i in range(30) for k in (0, 1)]
    posts = spark.createDataFrame(rows, "node long, kp int, key long, m long")
    comp = spark.createDataFrame([(i, i % 3) for i in range(30)], "node long, component long")
    out = [tuple(r) for r in image._across(posts, comp).collect()]
    want = {(a, j, b, k) for a in range(30) for b in range(a + 1, 30) if a % 3 != b % 3 for j in (0, 1) for k in (0, 1)}
    assert len(out) == len(want) and set(out) == want


def test_rendered_has_flat_scaled_and_turned_pictures(spark):
    vectors = spark.createDataFrame([(4 * i, [float(i)]) for i in range(60)], "vec_id long, embedding array<double>")
    seen = {r.image_id: image.read_image(bytes(r.image)) for r in image.rendered(vectors).collect()}
    flat = sum(np.mean(x[1:] == x[:-1]) > 0.6 for i, x in seen.items() if i % 2 == 0)
    sides = [max(x.shape) for i, x in seen.items() if i % 2]
    assert 15 <= flat <= 45 and max(sides) > 64 and min(sides) < 46


ITALIAN = "Il gatto della casa dorme nel giardino mentre i bambini giocano sotto gli alberi e nessuno vuole ancora tornare dentro prima di sera. " * 2
JAPANESE = "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。何でも薄暗いじめじめした所でニャーニャー泣いていた事だけは記憶している。" * 2


@pytest.mark.parametrize("prose", [ITALIAN.strip(), JAPANESE])
def test_main_text_of_other_languages_without_article(prose):
    links = "<div>" + "<a href='x'>altra pagina del sito con un titolo lungo</a> " * 4 + "</div>"
    page = f"<nav>menu</nav>{links}<div><p>{prose}</p><p>{prose}</p></div><div class='cookie-notice'>{prose}</div>"
    assert html_text.main_text(page) == f"{prose} {prose}"


def test_rare_languages_are_classes(spark):
    docs = spark.createDataFrame([(i, "EN" if i % 2 else "de", f"text {i} of the sort") for i in range(3_000)] + [(5_000, "it", "il gatto dorme nel giardino"), (5_001, None, "x"), (None, "fr", "y")], "doc_id long, lang string, text string")
    models = language.train(docs, 40)
    assert models.languages == ["de", "en", "it"] and np.isfinite(models.log_p).all()
    assert np.argmax(models.evidence("il gatto dorme")) == 2


STORY = "The cat of the house is in the garden and it was happy with the day that was long and for all of the people in the town the time was good. " * 3
REMARK = "This is what I think of the matter and it is not what you said in the first place, so there. " * 3


@pytest.mark.parametrize(
    "page",
    [
        *[f'<div {box}="{name}"><article><p>{STORY}</p></article></div>' for box, name in (("class", "post tag-social-media"), ("class", "post category-newsletter"), ("id", "page-alert-wrap"), ("class", "modal"), ("class", "cookie-wall"))],
        *[f'<div class="{name}"><p>{STORY}</p></div>' for name in ("post category-newsletter", "page-alert-wrap", "post comments-open", "has-sidebar", "is-sidebar")],
        *[f'<article><p>{STORY}</p><div class="{name}"><p>{REMARK}</p></div></article>' for name in ("CommentThread", "adBox", "gdprBox", "comment-list", "site-footer", "relatedPosts")],
        f'<article><p>{STORY}</p></article><ol class="commentlist"><li><article class="comment-body"><p>{REMARK}</p></article></li></ol>',
        f'<article><p>{STORY}</p></article><article class="comment"><p>{REMARK}</p></article>',
        f'<article><p>{STORY}</p></article><aside><article><p>{REMARK}</p></article></aside>',
        f'<main><p>{STORY}</p></main><div class="related"><article><p>{REMARK}</p></article></div>',
        f'<article><p>{STORY}</p></article><div hidden><article><p>{REMARK}</p></article></div>',
    ],
)
def test_boxes_by_their_names(page):
    assert html_text.main_text(f"<html><body>{page}</body></html>") == STORY.strip()
