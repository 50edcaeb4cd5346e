"""Inputs that broke an operator once, and operators against plain versions of themselves."""

from __future__ import annotations

import calendar
import collections
import datetime
import hashlib
import random
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, html_text, image, near_dup, pii, quality, shard

PROSE = "The cat of the house is in the garden and it was happy with the day that was long and for all of the people in the town the time was good. " * 3


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def test_hostile_texts_stay(spark):
    rows = ["x@" + "a." * 5_000 + "com", "x@" + "a." * 500_000 + "com", "1" * 1_000_000, "+1 " * 300_000, "a@b" * 300_000, "2020-" * 200_000]
    assert [r.text for r in pii.pseudonymise(texts(spark, rows), "k").orderBy("doc_id").collect()] == rows


def test_clashing_names_and_repeated_ids_of_texts(spark):
    df = spark.createDataFrame([(1, "28.1.2.3", "a", 1), (1, "28.1.2.3", "a", 1), (1, None, "b", 2)], "doc_id long, text string, `key.x` string, found long")
    out = pii.pseudonymise(df, "k")
    assert out.columns == df.columns
    rows = sorted(map(tuple, out.collect()), key=str)
    assert rows[0] == rows[1] and rows[0][1] not in ("28.1.2.3", None) and rows[2][1] is None


def test_dates_are_permuted_within_their_writing(spark):
    days = [datetime.date(1990, 1, 1) + datetime.timedelta(days=i) for i in range(2_500)]
    kinds = {"iso": lambda d: d.isoformat(), "wide": lambda d: f"{d.day:02}/{d.month:02}/{d.year}", "month": lambda d: f"{d.month:02}/{d.day:02}/{d.year}", "narrow": lambda d: f"{d.day}.{d.month}.{d.year}"}
    values = sorted({f(d) for d in days for f in kinds.values()})
    out = {r.a: r.b for r in spark.createDataFrame([(v,) for v in values], "a string").filter(pii.is_date(F.col("a"))).select("a", pii.date_pseudonym(F.col("a"), "k").alias("b")).collect()}
    assert set(out) == set(values) and len(set(out.values())) == len(out)
    assert all(len(a) == len(b) and [c for c in a if not c.isdigit()] == [c for c in b if not c.isdigit()] for a, b in out.items())
    again = spark.createDataFrame([(v,) for v in out.values()], "a string")
    assert again.filter(pii.is_date(F.col("a"))).count() == len(out)
    # One day has one pseudonym, however it is written.
    for d in days[::97]:
        new = datetime.date.fromisoformat(out[d.isoformat()])
        assert out[kinds["wide"](d)] == kinds["wide"](new) and out[kinds["narrow"](d)] == kinds["narrow"](new)
        assert d.day <= 12 or out[kinds["month"](d)] == kinds["month"](new)


def plain_feistel(a, b, m, n, key, kind):
    """The network with hashlib."""
    mixed = lambda i, half, most: int(hashlib.sha256(f"{key}|{kind}|{i}|{half}".encode()).hexdigest()[:15], 16) % most
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            a = (a + mixed(i, b, m)) % m
        else:
            b = (b + mixed(i, a, n)) % n
    return a, b


def plain_date(d: datetime.date, key: str) -> datetime.date:
    days = [(x, y) for y in range(1, 13) for x in range(1, calendar.monthrange(2001, y)[1] + 1)]
    if (d.day, d.month) == (29, 2):
        a, b = plain_feistel(*divmod((d.year - 1904) // 4, 7), 7, 7, key, "dateleap")
        return datetime.date(1904 + 4 * (7 * a + b), 2, 29)
    side = lambda x: (x[0] > 12, x[0] > 9, x[1] > 9)
    like = [x for x in days if side(x) == side((d.day, d.month))]
    kind = f"date{'late' if d.day > 12 else 10 if d.day > 9 else 1}-{10 if d.month > 9 else 1}"
    a, b = plain_feistel(like.index((d.day, d.month)), d.year - 1900, len(like), 200, key, kind)
    return datetime.date(1900 + b, like[a][1], like[a][0])


def test_pseudonyms_against_a_plain_version(spark):
    r = random.Random(3)
    key = "pii-key-" + hashlib.sha256(b"k").hexdigest()
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(days=r.randrange(73_049)) for _ in range(300)] + [datetime.date(y, 2, 29) for y in (1904, 2000, 2096)]
    ssn = [f"{r.choice([*range(1, 666), *range(667, 900)]):03}-{r.randint(1, 99):02}-{r.randint(1, 9999):04}" for _ in range(200)]
    rows = [f"on {d.isoformat()} of" for d in days] + [f"id {x}." for x in ssn]
    got = [x.text for x in pii.pseudonymise(texts(spark, rows), "k").orderBy("doc_id").collect()]
    want = [f"on {plain_date(d, key).isoformat()} of" for d in days]
    for x in ssn:
        area, group, serial = map(int, x.split("-"))
        a, b = plain_feistel(area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
        want.append(f"id {a + (2 if a >= 665 else 1):03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}.")
    assert got == want


def test_addresses_stay_public_and_apart(spark):
    r = random.Random(4)
    values = sorted({f"{r.choice([1, 9, 11, 126, 128, 192, 223])}.{r.choice([0, 167, 168, 169, 255])}.{r.randint(0, 255)}.{r.randint(0, 255)}" for _ in range(20_000)})
    df = spark.createDataFrame([(v,) for v in values], "a string").filter(pii.is_ipv4(F.col("a"))).select("a", pii.ipv4_pseudonym(F.col("a"), "k").alias("b"))
    assert df.filter(~pii.is_ipv4(F.col("b"))).count() == 0 and df.select("b").distinct().count() == df.count()
    assert [x.text for x in pii.pseudonymise(texts(spark, ["10.0.0.1 192.168.1.1 127.0.0.1"]), "k").collect()] == ["10.0.0.1 192.168.1.1 127.0.0.1"]


@pytest.mark.parametrize(
    "page",
    [
        '<div class="wrap has-sidebar"><article><p>{}</p></article></div>',
        '<div class="overflow-hidden"><p>{}</p></div>',
        "<form><div><p>{}</p></div></form>",
        "<form id=f><article><p>{}</p></article></form>",
        '<div class="page with-menu no-banner"><main><p>{}</p></main></div>',
        "<article><p><a href=x>{}</a></p></article>",
        '<div title="hidden"><p>{}</p></div>',
    ],
)
def test_layouts_keep_their_article(page):
    assert html_text.main_text(page.format(PROSE)) == PROSE.strip()


@pytest.mark.parametrize("page", ["<article><p>{}</p></article><form><p>{}</p></form>", '<article><p>{}</p></article><div class="side comments"><article><p>{}</p></article></div>', "<article><p>{}</p><div hidden>{}</div></article>", "<article><p>{}</p><div style='display: none'>{}</div></article>"])
def test_forms_comments_and_hidden_parts_go(page):
    assert html_text.main_text(page.format(PROSE, PROSE)) == PROSE.strip()


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<!", "<b x='>", "</q>", "<div>", "<!--", "<script>", "<a <"])
def test_broken_markup_takes_linear_time(unit):
    page = "<div>" * 1_000 + unit * (1_000_000 // len(unit))
    began = time.time()
    html_text.main_text(page)
    assert time.time() - began < 20


def test_quality_with_any_names_and_repeated_ids(spark):
    r = random.Random(1)
    rows = [(i, "BUY!!! " * 60 if i % 4 == 0 else " ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(60)), "s", "en") for i in range(200)]
    rows += [(1, "BUY!!! " * 90, "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    for c in ("ph", "_ph", "_ps", "evidence", "n_words", "host", "section", "p", "s", "k", "n", "prior", "kept", "low_quality", "_0", "a.b"):
        docs = docs.withColumn(c, F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(100)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 140 <= kept.count() <= 155
    models = [quality.train(docs.repartition(n), labels) for n in (1, 3)]
    assert np.array_equal(models[0].weights, models[1].weights)


def test_posterior_against_a_plain_version(spark):
    r = random.Random(2)
    rows = [(i, "BUY!!! " * r.randint(3, 60) if r.random() < 0.3 else " ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(60)), f"s{i % 3}", f"l{i % 2}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int("BUY" not in t)) for i, t, _, _ in rows[:80]], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {x.doc_id: x for x in quality.classify(docs, labels).collect()}
    e = {x.doc_id: x.evidence for x in quality.evidence(docs, model).collect()}
    p = {i: 1 / (1 + np.exp(-(e[i] + np.log(model.rate / (1 - model.rate))))) for i in e}

    def strength(groups):  # groups: (n, mean, prior mean)
        g = [x for x in groups if x[0] >= 2]
        if len(g) < 2:
            return 20.0
        n = sum(x[0] for x in g)
        chance = sum(x[0] * x[2] * (1 - x[2]) for x in g) / n
        q = sum(x[0] * (x[1] - x[2]) ** 2 for x in g)
        between = (q - len(g) * chance) / max(n - sum(x[0] ** 2 for x in g) / n, 1e-9)
        return float(np.clip(chance / between - 1, 1, 1000)) if between > 0 else 1000.0

    path, host = collections.defaultdict(list), collections.defaultdict(list)
    for i, _, s, lang in rows:
        path[s, lang].append(p[i])
        host[s].append(p[i])
    k = strength([(len(v), np.mean(v), model.rate) for v in host.values()])
    prior = {s: (sum(v) + k * model.rate) / (len(v) + k) for s, v in host.items()}
    kp = strength([(len(v), np.mean(v), prior[s]) for (s, _), v in path.items()])
    for i, _, s, lang in rows:
        v = path[s, lang]
        m = np.clip((sum(v) - p[i] + kp * prior[s]) / (len(v) - 1 + kp), 0.001, 0.999)
        want = 1 / (1 + np.exp(-(e[i] + np.log(m / (1 - m)))))
        assert got[i].low_quality == pytest.approx(want, rel=1e-9) and got[i].kept == (want < 0.5)


def test_each_row_of_a_repeated_id_is_decided_on_its_own(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    base, other = [" ".join(word() for _ in range(60)) for _ in range(2)]
    rows = [(5, base, 1), (7, base + " end", 2), (7, other, 3), (9, other, 4), (None, base, 5), (8, None, 6), (8, "", 7)]
    kept = near_dup.keep_first(spark.createDataFrame(rows, "doc_id long, text string, `row` long"))
    assert sorted(x.row for x in kept.collect()) == [1, 3, 5, 6, 7]


def test_shards_of_equal_rows_and_clashing_names(spark, tmp_path):
    rows = [(1, "a", "l", "s", 5, 6), (1, "a", "l", "s", 5, 6), (2, "b", "l", "s", 7, 8)]
    shard.write_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard long, Slot long"), str(tmp_path / "s"), 2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted((x.doc_id, x.own_shard, x.own_Slot) for x in back.collect()) == [(1, 5, 6), (1, 5, 6), (2, 7, 8)]


def test_shards_against_a_plain_ranking(spark):
    rows = [(i % 90, "t" * (i % 70), f"l{i % 3}", f"s{i % 7}") for i in range(400)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = shard.shard_documents(df, 24).withColumn("tie", F.xxhash64("doc_id", "text_crc32", "size")).collect()
    key = lambda x: (x.hilbert, x.tie % shard.TIES, x.tie, -1 if x.doc_id is None else x.doc_id, x.text_crc32, x["size"])
    order = sorted(out, key=lambda x: (*key(x), x.shard, x.slot))
    n = len(order)
    first = [-(-s * n // 24) for s in range(25)]
    want = [(s, i - first[s]) for s in range(24) for i in range(first[s], first[s + 1])]
    assert [(x.shard, x.slot) for x in order] == want


def png(x: np.ndarray, kind: int) -> bytes:
    """Encode grey (h x w) or colour (h x w x 3) samples with one filter for all rows."""
    x = x.reshape(*x.shape[:2], -1).astype(np.int64)
    h, w, c = x.shape
    p = np.zeros((h + 1, w + 1, c), np.int64)
    p[1:, 1:] = x
    a, b, corner = p[1:, :-1], p[:-1, 1:], p[:-1, :-1]
    d = [abs(v - (a + b - corner)) for v in (a, b, corner)]
    guess = [0, a, b, (a + b) // 2, np.where((d[0] <= d[1]) & (d[0] <= d[2]), a, np.where(d[1] <= d[2], b, corner))][kind]
    lines = ((x - guess) & 255).astype(np.uint8).reshape(h, w * c)
    raw = b"".join(bytes([kind]) + r.tobytes() for r in lines)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if c == 1 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_png(kind):
    g = np.random.default_rng(kind)
    grey, colour = g.integers(0, 256, (7, 5)), g.integers(0, 256, (4, 6, 3))
    assert np.array_equal(image.read_image(png(grey, kind)), grey)
    assert np.array_equal(image.read_image(png(colour, kind)), colour.sum(2) // 3)
    assert image.read_image(png(grey, kind)[:60]) is None


def test_odd_pictures(spark, monkeypatch):
    g = np.random.default_rng(5)
    x = np.kron(g.integers(0, 256, (12, 12)), np.ones((6, 6)))
    rows = [(1, image.write_pgm(np.full((1, 1), 7))), (2, image.write_pgm(np.full((1, 90), 7))), (3, image.write_pgm(np.full((90, 1), 7))), (4, image.write_pgm(x)), (5, png(x.astype(int), 4)), (6, b"\x89PNG\r\n\x1a\n")]
    out = {r.image_id: r for r in image.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert [out[i].n_keypoints for i in (1, 2, 3, 6)] == [0] * 4 and out[5].component_id == 4 and out[4].n_keypoints > 0
    monkeypatch.setattr(image, "LARGEST", x.size - 1)
    assert image.read_image(rows[3][1]) is None and image.read_image(rows[4][1]) is None


def filtered(x, kinds):
    """A PNG of colours x whose lines have these filters, by the format's rules."""
    h, w, c = x.shape
    p = np.zeros((h + 1, w + 1, c), int)
    p[1:, 1:] = x
    raw = b""
    for y in range(h):
        a, b, corner = p[y + 1, :-1], p[y, 1:], p[y, :-1]
        d = [abs(v - (a + b - corner)) for v in (a, b, corner)]
        guess = [0, a, b, (a + b) // 2, np.where((d[0] <= d[1]) & (d[0] <= d[2]), a, np.where(d[1] <= d[2], b, corner))][kinds[y]]
        raw += bytes([kinds[y]]) + ((x[y] - guess) & 255).astype(np.uint8).tobytes()
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("most", [1 << 24, 200, 1])
def test_png_of_mixed_lines_in_parts(monkeypatch, most):
    monkeypatch.setattr(image, "UNFILTERED", most)
    g = np.random.default_rng(9)
    for h, w in ((41, 23), (5, 1), (1, 7)):
        x = g.integers(0, 256, (h, w, 3))
        data = filtered(x, [int(k) for k in g.integers(0, 5, h)])
        assert np.array_equal(image.read_image(data), x.sum(2) // 3)
        assert image.read_image(data[:-30]) is None


def test_a_short_file_that_claims_a_large_picture():
    data = bytearray(filtered(np.zeros((4, 4, 3), int), [0] * 4))
    data[16:24] = struct.pack(">II", 16_000, 16_000)
    assert image.read_image(bytes(data)) is None


def test_tiles_describe_as_the_whole(monkeypatch):
    """The corners don't depend on the tiles that a picture is cut into."""
    g = np.random.default_rng(4)
    x = np.clip(np.kron(g.integers(0, 256, (75, 110)), np.ones((8, 8))) + g.normal(0, 2, (600, 880)), 0, 255).astype(np.uint8)[None]
    whole = image.describe(x)
    monkeypatch.setattr(image, "TILE", (4, 8))
    parts = image.describe(x)
    rows = lambda d: {(*p, *b) for p, b in zip(d[1].tolist(), d[2].tolist(), strict=True)}
    assert len(whole[0]) == len(parts[0]) > 3 * 20 * 2 and len(rows(whole) & rows(parts)) > 0.99 * len(whole[0])


def test_crops_of_large_pictures(spark):
    """Crops of 5.8 million pixels, down to a hundredth, are linked as those of small pictures are."""
    rows, g = [], np.random.default_rng(6)
    for i in range(3):
        # Noise on three scales with some boxes; a picture is faint on its left.
        x = 120 + sum(image._resized(g.normal(0, 34, (1, 2400 // c, 2400 // c)), c)[0] for c in (16, 8, 4))
        for y0, x0, h, w, level in zip(*g.integers(0, 2380, (2, 9000)), *g.integers(6, 20, (2, 9000)), g.integers(-70, 70, 9000), strict=True):
            x[y0 : y0 + h, x0 : x0 + w] += level
        x[:, :1200] = 100 + x[:, :1200] * 0.3
        x = np.clip(np.rint(x), 0, 255)
        rows.append((10 * i, image.write_pgm(x)))
        for k, (t, l, n) in enumerate(((600, 600, 1200), (1301, 77, 700), (333, 1707, 240), (1999, 555, 240)), 1):
            cut = x[t : t + n, l : l + n] * 0.9 + 9
            rows.append((10 * i + k, image.write_pgm(np.clip(cut + g.normal(0, 1, cut.shape), 0, 255))))
    out = {r.image_id: r.component_id for r in image.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    found = [(i, k) for i in range(3) for k in range(1, 5) if out[10 * i + k] == 10 * i]
    assert len(found) >= 11, found
    assert all(out[10 * i] == 10 * i for i in range(3))


def test_hot_lists_meet_by_neighbours(spark):
    """Members of a list longer than PAIRED meet if they share a neighbour; shorter lists stay as they are."""
    points = spark.createDataFrame([(i, 0, [7] + [100 * i + t for t in range(7)], (i // 2 + 1) | (i + 100) << 16) for i in range(40)], "node long, kp long, bits array<bigint>, near long")
    posts = image._refined(image._posts(points), points)
    met = {(r.a, r.b) for r in image._pairs(posts).collect()}
    assert met == {(i, i + 1) for i in range(0, 40, 2)}


def test_ids_with_marks(spark):
    items = spark.createDataFrame([("a\x1fb", "red green blue"), ("c", "red green blue")], "item_id string, text string")
    docs = texts(spark, ["see red green blue now"])
    assert decontaminate.phrase_matches(docs, items).first().item_ids == ["a\x1fb", "c"]
    assert {r.item_id for r in decontaminate.proximity_matches(docs, items).collect()} == {"a\x1fb", "c"}


def test_decoding_unknown_ids_and_other_patterns(spark):
    path, _ = bpe.public_ranks()
    t = spark.createDataFrame([(1, [97, 10**8]), (2, None), (3, [])], "doc_id long, token_ids array<int>")
    assert [r.decoded if r.decoded is None else bytes(r.decoded) for r in bpe.decode(t, path).orderBy("doc_id").collect()] == [None, b"", b""]
    import tiktoken

    pattern = r"[^\n]+|\n"
    rows = ["a b  c.\nd, e", "the cat sat", ""]
    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    assert [list(r.token_ids) for r in bpe.encode(texts(spark, rows), path, pattern).orderBy("doc_id").collect()] == [enc.encode_ordinary(x) for x in rows]


def pipeline_rows():
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(3, 7)))
    rows = []
    for i in range(120):
        body = " ".join(word() for _ in range(r.randint(40, 90)))
        rows.append((i, "BUY!!! " * r.randint(20, 60) if i % 5 == 0 else body + "."))
    item = " ".join(word() for _ in range(14))
    rows += [(200, rows[1][1]), (201, rows[2][1] + " end"), (202, rows[3][1] + " " + item), (203, rows[4][1] + " born 1984-02-29"), (204, None), (205, ""), (206, rows[6][1]), (206, rows[7][1] + " x"), (207, "ein " + rows[8][1] * 300)]
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], item


def test_pipeline_against_plain_versions(spark, tmp_path):
    import corpus_pipeline as cp
    import tiktoken
    from test_text_ops import components, windows

    rows, item = pipeline_rows()
    tables = {
        "documents": spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(80)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, item)], "item_id long, text string"),
    }
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    docs, sf = tables["documents"], str(tmp_path)
    got = []
    for i, (_, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, sf)
        got.append([(x.doc_id, None if i == 4 else x.text, x) for x in docs.collect()])
        docs = spark.createDataFrame([x for *_, x in got[-1]], docs.schema)
    pairs = lambda rows: sorted(((i, t) for i, t, *_ in rows), key=str)
    # 1: what its own posterior keeps (held against a plain version above); junk goes, prose stays.
    posterior = quality.classify(tables["documents"], tables["labels"], columns=["doc_id", "text"]).collect()
    assert pairs(got[0]) == pairs([x for x in posterior if x.kept])
    assert not [t for _, t, _ in got[0] if t and t.startswith("BUY")] and len(got[0]) >= 100
    # 2: each id's text is a document of its own, named by what it says.
    names = {}
    for i, t, _ in sorted(got[0], key=lambda x: (x[0], str(x[1]))):
        names.setdefault((i, t), len(names))
    alone = components([(n, t) for (_, t), n in names.items()], 5, 80)
    least = {}
    for (i, _), n in names.items():
        least[alone[n][1]] = min(i, least.get(alone[n][1], i))
    kept = [(i, t) for i, t, _ in got[0] if least[alone[names[i, t]][1]] == i]
    assert pairs(got[1]) == pairs(kept)
    # 3
    hit = {x[0] for x in windows([(n, t) for (_, t), n in names.items()], [(1, item)]) if x[5]}
    clean = [(i, t) for i, t in kept if names[i, t] not in hit]
    assert pairs(got[2]) == pairs(clean) and len(clean) < len(kept)
    # 4
    key = "pii-key-" + hashlib.sha256(pii.session_key(spark).encode()).hexdigest()
    new = plain_date(datetime.date(1984, 2, 29), key).isoformat()
    assert pairs(got[3]) == pairs([(i, t.replace("1984-02-29", new) if t else t) for i, t in clean])
    assert all(x.n_chars == len(t or "") for _, t, x in got[3] if t is not None)
    # 5
    path, pattern = bpe.public_ranks()
    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = [(i, ",".join(map(str, enc.encode_ordinary(t or "")))) for i, t, _ in got[3]]
    assert pairs([(i, ",".join(map(str, x.token_ids))) for i, _, x in got[4]]) == pairs(want)
    assert sorted(x.ids_sha256 for x in cp.run(spark, sf).collect()) == sorted(hashlib.sha256(x.encode()).hexdigest() for _, x in want)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as cp

    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
