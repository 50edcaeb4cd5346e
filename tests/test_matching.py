"""The matcher, its merges and pointers, in worked cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import entities as en
from lodestone.operators import joins as jo
from lodestone.storage import materialize

SHAPE = "site_id long, name string, operator string, operator_parent string, country string, subdivision string, lat double, lng double, parent_id long, superseded_by long, score int, discovered_at timestamp, public_id string"


def site(i, name="Alpha 1", operator="Acme Inc", parent=None, lat=30.0, **more):
    row = {"country": "US", "subdivision": None, "lng": -100.0, "parent_id": None, "superseded_by": None, "score": 1, "discovered_at": None, "public_id": f"P{i}"} | more
    return (i, name, operator, parent, row["country"], row["subdivision"], lat, row["lng"], row["parent_id"], row["superseded_by"], row["score"], row["discovered_at"], row["public_id"])


def matched(spark, rows, ids=(), **more):
    known = spark.createDataFrame(list(ids), "site_id long, source_key string, external_id string")
    return {(r.a, r.b): r for r in en.match_entities(spark.createDataFrame(rows, SHAPE), en.MatchConfig(**more), known).collect()}


def test_a_null_name_leaves_its_weight_out(spark):
    m = matched(spark, [site(1), site(2, name=None)])[1, 2]
    assert (m.score_name, m.match, m.decision) == (None, 1.0, "queued") and m.qualifier_conflict
    m = matched(spark, [site(1), site(2, operator=None)])[1, 2]
    assert (m.score_operator, m.match, m.decision) == (None, 1.0, "auto_merged") and m.why == "score>=0.92 with coordinate agreement 0.0m"


def test_operators_of_one_parent_score_three_quarters(spark):
    m = matched(spark, [site(1, operator="North LLC", parent="Umbrella Corp"), site(2, operator="South LLC", parent="umbrella"), site(3, operator="East LLC")])
    assert [m[p].score_operator for p in ((1, 2), (1, 3), (2, 3))] == [0.75, 0.0, 0.0]
    assert matched(spark, [site(1, operator="Umbrella"), site(2, operator="South", parent="Umbrella Inc")])[1, 2].score_operator == 0.75


def test_names_are_compared_without_their_operators(spark):
    m = matched(spark, [site(1, name="Acme Dallas"), site(2, name="Dallas"), site(3, name="ACME")])
    assert m[1, 2].score_name == 1.0 and m[1, 3].score_name < 0.2  # of "Acme" nothing is left without the operator: it stays


def test_superseded_sites_and_families_take_no_part(spark):
    assert matched(spark, [site(1), site(2, superseded_by=9), site(3, parent_id=1), site(4, parent_id=1), site(5, country=None)]) == {}
    assert set(matched(spark, [site(1, country=None), site(2, country=None)])) == {(1, 2)}


def test_one_of_many_identifiers_is_enough(spark):
    rows = [site(1), site(2, lat=30.01), site(3, lat=30.01, name="Beta 1")] + [site(i, lat=40.0 + i) for i in range(10, 60)]
    ids = [(1, "s", "a"), (1, "s", "b"), (2, "s", "c"), (2, "s", "b"), (3, "t", "b"), (2, "s", "b"), (None, "s", "b"), (3, "s", None)] + [(i, "s", "often") for i in range(1, 60)]
    m = matched(spark, rows, ids[:8])
    assert m[1, 2].external_id_match and m[1, 2].score_external == 1.0 and not m[1, 3].external_id_match
    m = matched(spark, rows, ids)
    assert m[1, 3].external_id_match and len(m) == len(matched(spark, rows))


def test_too_many_merges_raise(spark):
    df = spark.createDataFrame([site(1), site(2)], SHAPE)
    with pytest.raises(ValueError, match="1 of 1 pairs"):
        en.match_and_merge(df)
    assert en.match_and_merge(df, cfg=en.MatchConfig(share_rail=1.0))[1].count() == 1


def test_survivors_audit_and_reversal(spark):
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d)
    rows = [site(1, score=2, discovered_at=day(9)), site(2, score=2, discovered_at=day(3)), site(3, score=2, discovered_at=day(3)), site(4, score=1), site(5, superseded_by=1)]
    df = spark.createDataFrame(rows, SHAPE)
    out, merges = en.match_and_merge(df, cfg=en.MatchConfig(share_rail=1.0))
    out, merges = materialize(out, "out"), materialize(merges, "merges")
    assert {r.site_id: r.superseded_by for r in out.collect()} == {1: 2, 2: None, 3: 2, 4: 2, 5: 1}
    assert sorted((r.merged, r.surviving, r.merged_public_id, r.method) for r in merges.collect()) == [(1, 2, "P1", "auto"), (3, 2, "P3", "auto"), (4, 2, "P4", "auto")]
    back, audit = en.reverse_merges(out, merges, merges.filter("merged = 3"), F.lit(day(30)))
    assert {r.site_id: r.superseded_by for r in back.collect()} == {1: 2, 2: None, 3: None, 4: 2, 5: 1}
    audit = materialize(audit, "audit")
    assert {r.merged: r.reversed_at for r in audit.collect()} == {1: None, 3: day(30), 4: None}
    again = en.reverse_merges(back, audit, merges, F.lit(day(31)))[1]
    assert {r.merged: r.reversed_at for r in again.collect()} == {1: day(31), 3: day(30), 4: day(31)}


@pytest.mark.parametrize("ring", [2, 3, 4, 5])
def test_a_cycle_of_pointers_raises(spark, ring):
    rows = [(i, 10 + (i - 9) % ring) for i in range(10, 10 + ring)] + [(1, 10), (2, None), (3, 2), (4, 3), (5, 99)]
    df = spark.createDataFrame(rows, "id long, to long")
    with pytest.raises(ValueError, match="cycle"):
        en.resolve_superseded(df, "id", "to")
    free = en.resolve_superseded(df.filter("id < 10 and id > 1"), "id", "to")
    assert {r.id: r.survivor for r in free.collect()} == {2: 2, 3: 2, 4: 2, 5: 99}


def test_classes_stand_for_all_pairs(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choices(["alpha", "beta", "gamma", "delta", "Ωmega", "x1"], k=r.randint(1, 4))), r.choice("ab")) for i in range(400)] + [(900, None, "a"), (901, "", "a"), (902, "alpha", None), (903, "alpha", None)]
    df = spark.createDataFrame(rows, "k long, n string, g string")

    def grams(n):
        return {f"  {w} "[i : i + 3] for w in (n or "").lower().split() for i in range(len(w) + 1)}

    want = {}
    for a, x, g in rows:
        for b, y, h in rows:
            if a < b and g == h and grams(x) and grams(y):
                s = len(grams(x) & grams(y)) / len(grams(x) | grams(y))
                if s >= 0.5:
                    want[a, b] = round(s, 9)
    assert {(p.a, p.b): round(p.similarity, 9) for p in jo.trigram_pairs(df, 0.5, "k", "n", "g").collect()} == want
    pairs, members = jo.trigram_classes(df, 0.5, "k", "n", "g")
    sizes = {m.r: m.n for m in members.collect()}
    assert sum(p.na * p.nb for p in pairs.collect()) + sum(n * (n - 1) // 2 for n in sizes.values()) == len(want)
    classes, own = jo.block_classes(df, ["n", "g"], "k")
    assert {(r["class"], r.n) for r in classes.collect()} == {(c, n) for c, n in ((r["class"], r["count"]) for r in own.groupBy("class").count().collect())}
    assert sum(r.n_pairs for r in classes.collect()) == jo.block_pairs(df, ["n", "g"], "k").count()


def test_pointers_are_followed_by_merges_over_the_rows_that_point(spark, monkeypatch):
    """Files are compressed: a table small enough for a broadcast there isn't so in memory."""
    written = []
    monkeypatch.setattr(en, "materialize", lambda df, name: written.append((df, materialize(df, name))) or written[-1][1])
    df = spark.range(2_000).select("id", F.when(F.col("id") % 10 == 0, F.when(F.col("id") > 0, F.col("id") - 10)).alias("to")).union(spark.sql("select cast(null as bigint), 50L"))
    got = {r.id: r.survivor for r in en.resolve_superseded(df, "id", "to").collect()}
    assert got == {i: 0 if i % 10 == 0 else i for i in range(2_000)} | {None: 0}
    assert len(written) > 5 and all(t.count() == 200 for _, t in written[-1:])
    assert not any("Broadcast" in d._jdf.queryExecution().executedPlan().toString() for d, _ in written)


@pytest.mark.parametrize("cfg, identified", [({"auto": 0.8, "queue": 0.6, "auto_distance_m": 300}, True), ({"auto": 0.86, "block_distance_m": 60.0}, False)])
def test_merges_from_classes_are_those_of_all_pairs(spark, monkeypatch, cfg, identified):
    import datetime as dt

    r = random.Random(3)
    rows = []
    for i in range(1, 161):
        name, operator = r.choice(["Alpha 1", "Alpha 1", "Alpha west 1", "Beta 2", "Acme Alpha 1", None]), r.choice(["Acme Inc", "Acme", "Acmes", "Zeta", None])
        parent = r.choice([None, None, None, r.randint(1, 160), i - i % 10, i])
        more = {"subdivision": r.choice(["x", "y", None]), "country": r.choice(["US", "US", "CA", None]), "parent_id": parent, "score": r.choice([1, 1, 2]), "superseded_by": r.choice([None] * 9 + [1]), "discovered_at": r.choice([None, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)]), "lng": -100 + r.choice([0.0, 0.001, 0.0052, 0.0056, 0.3])}
        rows.append(site(i, name, operator, r.choice([None, "Umbrella"]), r.choice([30.0, 30.0, 30.0005, None]), **more))
    ids = [(r.randint(1, 160), r.choice("st"), r.choice("abcd")) for _ in range(240)]
    sites, ids = materialize(spark.createDataFrame(rows, SHAPE), "sites"), materialize(spark.createDataFrame(ids, "site_id long, source_key string, external_id string"), "ids")
    cfg = en.MatchConfig(share_rail=1.0, **cfg)
    known = ids if identified else None
    pairs = materialize(en.match_entities(sites, cfg, known), "pairs")
    want = sorted(map(tuple, en.apply_merges(sites, pairs)[1].collect()))
    share = en.check_share(pairs, F.col("decision") == "auto_merged", 1.0).first()
    monkeypatch.setattr(en, "block", lambda *_: pytest.fail("all pairs are made"))
    assert en.merge_rail(sites, known, cfg).first() == share and share.flagged > 20
    assert sorted(map(tuple, en.match_and_merge(sites, known, cfg)[1].collect())) == want
