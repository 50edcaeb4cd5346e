"""Joins against nested loops on small data."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import controls
from lodestone.operators import joins as jo
from lodestone.operators.entities import resolve_superseded


def metres(a, b):
    y1, x1, y2, x2 = map(math.radians, (a[1], a[2], b[1], b[2]))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))


def test_geo_pairs_at_poles_and_date_line(spark):
    r = random.Random(3)
    pts = [(i, y + r.uniform(-0.05, 0.05), x + r.uniform(-0.05, 0.05)) for i, (y, x) in enumerate([(0, 180), (0, -180), (89.97, 10), (89.97, 170), (-89.95, 0), (45, 0), (45, 0.02), (60, 179.99), (60, -179.99)] * 12)]
    pts = [(i, min(90.0, max(-90.0, y)), (x + 180) % 360 - 180) for i, y, x in pts]
    got = {(p.a, p.b) for p in jo.geo_pairs(spark.createDataFrame(pts, "site_id long, lat double, lng double"), 5000).collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and metres(a, b) <= 5000}


def grams(s):
    import re

    return {f"  {w} "[i : i + 3] for w in re.split("[^a-z0-9]+", s.lower()) if w for i in range(len(w) + 1)}


def test_trigram_pairs(spark):
    r = random.Random(5)
    words = ["alpha", "alpine", "beta", "betas", "gamma", "gam", "delta"]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 3)))) for i in range(120)]
    got = {(p.a, p.b) for p in jo.trigram_pairs(spark.createDataFrame(rows, "k long, n string"), 0.6, "k", "n").collect()}
    want = set()
    for a, x in rows:
        for b, y in rows:
            g, h = grams(x), grams(y)
            if a < b and g and h and len(g & h) / len(g | h) >= 0.6:
                want.add((a, b))
    assert got == want


def test_point_in_polygon(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    poly = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(ring)], "poly_id int, seq int, x double, y double")
    pts = spark.createDataFrame([(1, 0.5, 2.0), (2, 2.5, 2.0), (3, 0.9, 3.9), (4, 9.0, 9.0)], "id int, lat double, lng double")
    assert {r.id for r in jo.pip_join(pts, poly, "id").collect()} == {1, 3}


def test_large_rings_are_covered_by_their_outline(spark):
    import math

    r = random.Random(2)
    star = [(-3 + (6 + 3 * (i % 2)) * math.cos(i * math.pi / 20), 40 + (6 + 3 * (i % 2)) * math.sin(i * math.pi / 20)) for i in range(40)]
    rings = {1: star, 2: [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)], 3: [(100.0, -5.0), (100.01, -5.0), (100.0, -4.99)], 4: [(-12.0, 30.0), (8.0, 30.0), (8.0, 30.2)]}
    poly = spark.createDataFrame([(k, i, float(x), float(y)) for k, v in rings.items() for i, (x, y) in enumerate(v)], "poly_id int, seq int, x double, y double")
    pts = [(i, r.uniform(-13, 8), r.uniform(-1, 50)) for i in range(4_000)] + [(5_000, 100.002, -4.998), (5_001, 100.009, -4.991), (5_002, None, 1.0)] + [(6_000 + i, x + 1e-4, y) for i, (x, y) in enumerate(star)]

    def inside(x, y, ring):
        hit = False
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a:
                hit = not hit
        return hit

    want = {(i, k) for i, x, y in pts if x is not None for k, ring in rings.items() if inside(x, y, ring)}
    frame = spark.createDataFrame([(i, y, x) for i, x, y in pts], "id int, lat double, lng double")
    got = [(x.id, x.poly_id) for x in jo.pip_join(frame, poly, "id").collect()]
    assert set(got) == want and len(got) == len(want)
    cover = jo.polygon_cover(poly, jo._ring_edges(poly, 0.05), 0.05).groupBy("poly_id").count().collect()
    assert {x.poly_id: x["count"] for x in cover}[1] < 8_000 < (18 / 0.05) ** 2 / 10  # its box has over 100,000
    assert jo.pip_join(frame, poly.limit(0), "id").count() == 0


def test_dictionary_prefers_longer_matches_and_earlier_columns(spark):
    docs = spark.createDataFrame([(1, "in New York city", "paris"), (2, "york", ""), (3, None, "paris york"), (4, None, None)], "id int, a string, b string")
    terms = spark.createDataFrame([("new york", "US"), ("york", "GB"), ("paris", "FR")], "term string, code string")
    assert {(r.id, r.code) for r in jo.dictionary_resolve(docs, terms, "id", ["a", "b"]).collect()} == {(1, "US"), (2, "GB")}


def test_dictionary_equals_a_plain_scan(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)] + ["ä1", "Ωm"]
    phrase = lambda n: " ".join(r.choices(vocabulary, k=n))
    terms = sorted({(phrase(r.choice([1, 1, 2, 2, 3, 5])), r.choice("xyz")) for _ in range(60)} | {(f"w0 w1 {phrase(2)}", "x") for _ in range(40)})
    docs = [(i, phrase(r.randint(0, 9)).replace(" ", r.choice([" ", ", ", "--"])).upper(), phrase(r.randint(0, 30)) if i % 3 else None) for i in range(300)]
    want = set()
    for i, *texts in docs:
        for text in texts:
            words = [w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()]
            spans = {(s, s + len(t.lower().split())) for t, _ in terms for s in range(len(words)) if words[s : s + len(t.split())] == t.lower().split()}
            outer = [x for x in spans if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in spans)]
            codes = {c for t, c in terms for s, e in outer if words[s:e] == t.lower().split()}
            if codes:
                want |= {(i, min(codes))} if len(codes) == 1 else set()
                break
    frames = spark.createDataFrame(docs, "id int, a string, b string"), spark.createDataFrame([(t.lower(), c) for t, c in terms], "term string, code string")
    for most in (500, 3, 1):
        assert {(x.id, x.code) for x in jo.dictionary_resolve(*frames, "id", ["a", "b"], most).collect()} == want
    assert jo.dictionary_resolve(frames[0], frames[1].limit(0), "id", ["a"]).count() == 0


def test_long_pointer_chains(spark):
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "id long, p long")
    assert {r.survivor for r in resolve_superseded(df, "id", "p").collect()} == {0}


def greedy(site, pool):
    got: dict = {s[0]: None for s in site}
    taken = set()
    for d, s, c in sorted((round(metres(a, b), 3), a[0], b[0]) for a in site for b in pool if a[1] is not None and b[1] is not None):
        if 5_000 <= d <= 25_000 and got[s] is None and c not in taken:
            got[s] = c
            taken.add(c)
    return got


def assigned(spark, site, pool, kind="long", **how):
    frame = lambda rows: spark.createDataFrame([(*x, "s") for x in rows], f"site_id {kind}, lat double, lng double, g string")
    out = controls.nearest_control(frame(site), frame(pool), 5_000, 25_000, "g", **how).collect()
    assert len(out) == len(site)
    return {x.site: x.control for x in out}


@pytest.mark.parametrize("whole", [60, 0])
def test_nearest_control_until_none_is_left(spark, whole):
    """In tasks and rounds, and in rounds alone: the result is that of taking pairs in order."""
    r = random.Random(8)
    site = [(i, 30.0, -100.0) for i in range(20)] + [(i, 30 + r.uniform(0, 0.3), -100 + r.uniform(0, 0.3)) for i in range(20, 30)] + [(i, 50 + i / 5, 7.0) for i in range(30, 36)] + [(40, None, 1.0)]
    pool = [(100 + i, 30.06, -100.0) for i in range(9)] + [(120 + i, 30 + r.uniform(0, 0.3), -100 + r.uniform(0, 0.3)) for i in range(17)] + [(140 + i, 56 + i / 5, 7.1) for i in range(6)]
    r.shuffle(site)
    assert assigned(spark, site, pool, whole=whole) == greedy(site, pool)


@pytest.mark.parametrize("whole", [500_000, 0])
def test_nearest_control_takes_turns_at_equal_distances(spark, whole):
    """Members of places at the same distance from a control's place take turns by their ids."""
    site = [(i, 0.0, 0.1 if i % 3 else -0.1) for i in range(9)]
    pool = [(100 + i, 0.0, 0.0) for i in range(5)] + [(110 + i, 0.0, 0.2) for i in range(3)]
    assert assigned(spark, site, pool, whole=whole) == greedy(site, pool)


@pytest.mark.parametrize("whole", [500_000, 10])
def test_nearest_control_of_many_sites_at_one_place(spark, whole):
    r = random.Random(4)
    site = [(f"s{i:05}", 30.0, -100.0) for i in range(1_000)]
    pool = [(f"c{i:05}", *r.choice([(30.06, -100.0), (30.1, -100.0), (29.9, -100.1)])) for i in range(700)]
    got, want = assigned(spark, site, pool, "string", whole=whole), greedy(site, pool)
    assert got == want and sum(c is not None for c in got.values()) == 700


def test_nearest_control_without_candidates(spark):
    assert assigned(spark, [(1, 0.0, 0.0)], [(2, 50.0, 0.0)]) == {1: None}
    assert assigned(spark, [], [(2, 50.0, 0.0)]) == {}


def test_pairs_of_one_large_group_are_made_in_many_tasks(spark):
    rows = spark.range(5_000).select(F.col("id").alias("site_id"), F.lit("g").alias("g"), F.lit(30.0).alias("lat"), F.lit(-100.0).alias("lng"))
    for pairs in (jo.block_pairs(rows, ["g"], "site_id"), jo.geo_pairs(rows, 100.0), jo.trigram_pairs(rows, 0.5, "site_id", "g")):
        by_task = [r.n for r in pairs.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(by_task) == 5_000 * 4_999 // 2 and max(by_task) < sum(by_task) / 2


def test_pairs_by_blocks_are_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jo, "BLOCK", 3)
    g = random.Random(5)
    rows = [(i, g.choice([None, "p", "q"]), g.choice(["s", "t", None]), g.choice([None, *range(20)]), round(g.choice([30.0, 30.01, 30.015, -0.0, 0.0]), 3), g.choice([10.0, 10.01])) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, o string, s string, x int, lat double, lng double")
    both = [(a, b) for a in rows for b in rows if a[0] < b[0]]
    op = {(a[0], b[0]) for a, b in both if a[1] is not None and a[2] is not None and a[1:3] == b[1:3]}
    ext = {(a[0], b[0]) for a, b in both if a[3] is not None and a[3] == b[3]}
    assert sorted(map(tuple, jo.block_pairs(df, ["o", "s"], "k").collect())) == sorted(op)
    got = {(r.a, r.b): r.reasons for r in jo.block_reasons(df, {"operator": ["o", "s"], "external": ["x"]}, "k").collect()}
    assert got == {p: ",".join(n for n, s in (("external", ext), ("operator", op)) if p in s) for p in op | ext}
    geo = sorted((r.a, r.b) for r in jo.geo_pairs(df, 1_200, "k").collect())
    assert geo == sorted((a[0], b[0]) for a, b in both if metres((a[0], *a[4:]), (b[0], *b[4:])) <= 1_200)


def test_a_component_of_many_places_is_solved_in_a_task(spark, monkeypatch):
    """640,000 pairs of places on a lattice: their equal distances would take a round for each of their members."""
    monkeypatch.setattr(controls, "_round", lambda pairs: pytest.fail("goes in rounds"))
    at = lambda i, lat: (i, 30.0 + lat + (i // 2 % 40) * 0.001, -100.0 + (i // 80) * 0.001)
    site, pool = [at(i, 0.0) for i in range(1, 1600, 2)], [at(i, 0.12) for i in range(0, 1600, 2)]
    frame = lambda rows: spark.createDataFrame(rows, "site_id long, lat double, lng double").withColumn("g", F.lit("g"))
    got = {(r.site, r.control) for r in controls.nearest_control(frame(site), frame(pool), 5_000, 25_000, "g").collect()}
    free, want = {i for i, *_ in site + pool}, set()
    for _, s, c in sorted((round(metres(a, b), 3), a[0], b[0]) for a in site for b in pool):
        if s in free and c in free:
            want.add((s, c))
            free -= {s, c}
    assert len(want) == 800 and got == want
