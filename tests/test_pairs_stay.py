"""The matcher's pairs stay where they are made."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from lodestone.operators import entities as en
from lodestone.operators import joins as jo
from lodestone.operators import merging as mg
from lodestone.storage import materialize


def test_no_pair_of_the_matcher_is_shuffled(spark, monkeypatch):
    rows = [(i, None if i % 9 == 0 else f"Site Acme {'hall' if i % 4 else 'mill'} {i % 3}", None if i % 7 == 0 else "Acme" if i % 2 else "Beta", "US" if i % 5 else None, "TX", 30 + i % 6 * 0.01, -100.0, i - 1 if i % 8 == 1 else None) for i in range(1, 41)]
    sites = spark.createDataFrame(rows, "site_id long, name string, operator string, country string, subdivision string, lat double, lng double, parent_id long")
    ids = spark.createDataFrame([(i, "s", f"x{i % 13}") for i in range(1, 41, 2)], "site_id long, source_key string, external_id string")
    got = en.match_entities(sites, identifiers=ids)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(a#\w+, b#|hashpartitioning\((a|b)#", plan)
    told = sorted(map(str, got.collect()))
    monkeypatch.setattr(en, "KINDS", 0)  # names told by pair
    assert told == sorted(map(str, en.match_entities(sites, identifiers=ids).collect())) and len(told) > 200 and any("external_id_match=True" in r for r in told)


def _waiting(df) -> list[int]:
    """Explosions in one step, for every step of the plan that has any: what a step makes of one row waits in memory."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [step.count("Generate explode") for step in re.split(r"Coalesce|Exchange", plan) if "Generate explode" in step]


def test_pairs_of_a_block_do_not_wait_in_memory(spark, monkeypatch):
    monkeypatch.setattr(jo, "BLOCK", 7)
    df = spark.range(100).selectExpr("id as k", "id % 3 as n", "id % 2 as i", "id % 5 as x")  # columns named as the blocks' own are
    pairs = jo.block_pairs(df, ["n", "i"], "k")
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for a in range(100) for b in range(a + 1, 100) if (a - b) % 6 == 0}
    assert max(_waiting(pairs)) == 1
    reasons = jo.block_reasons(df, {"one": ["n", "i"], "two": ["x"]}, "k")
    want = {(a, b): ",".join(["one"] * ((a - b) % 6 == 0) + ["two"] * ((a - b) % 5 == 0)) for a in range(100) for b in range(a + 1, 100)}
    assert {(r.a, r.b): r.reasons for r in reasons.collect()} == {p: r for p, r in want.items() if r}
    assert max(_waiting(reasons)) == 1


def test_reasons_are_named_by_literals(spark):
    """No pair puts its reasons together."""
    df = spark.range(60).selectExpr("id as k", "id % 2 as a", "id % 3 as b", "nullif(id % 5, 4) as c")
    rules = {"z": ["a"], "m": ["b"], "c": ["c"], "all": ["a", "b"]}
    got = jo.block_reasons(df, rules, "k")
    assert "concat_ws" not in got._jdf.queryExecution().optimizedPlan().toString()
    hold = lambda a, b: {"z": a % 2 == b % 2, "m": a % 3 == b % 3, "c": a % 5 == b % 5 != 4, "all": (a - b) % 6 == 0}
    want = {(a, b): ",".join(sorted(r for r, h in hold(a, b).items() if h)) for a in range(60) for b in range(a + 1, 60)}
    assert sorted((r.a, r.b, r.reasons) for r in got.collect()) == sorted((*p, r) for p, r in want.items() if r)


def test_merges_broadcast_only_what_was_counted(spark, monkeypatch):
    """Stored tables are compressed: one that Spark takes for small by its files fills the driver's memory."""
    rows = [(i, f"Site Acme {i % 3}", "Acme" if i % 2 else "Beta", "US", "TX", 30 + i % 40 * 0.01, -100.0, i - 1 if i % 8 == 1 else None, i % 3) for i in range(1, 121)]
    sites = materialize(spark.createDataFrame(rows, "site_id long, name string, operator string, country string, subdivision string, lat double, lng double, parent_id long, score int"), "sites")
    ids = materialize(spark.createDataFrame([(i, "s", f"x{i % 13}") for i in range(1, 121, 2)], "site_id long, source_key string, external_id string"), "ids")
    seen = []

    def hinted(df):
        """Broadcasts of the plan, and those that are left where none is chosen by size."""
        sent = [df.select("*")._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")]
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            return [*sent, df.select("*")._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")]
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    def watched(df, name):
        seen.append((name, *hinted(df)))
        return materialize(df, name)

    for module in (en, jo, mg):
        monkeypatch.setattr(module, "materialize", watched)
    entities, merges = en.match_and_merge(sites, ids, en.MatchConfig(share_rail=1.0))
    entities, audit = en.reverse_merges(entities, materialize(merges, "merges"), merges.limit(1), F.current_timestamp())
    seen += [("entities", *hinted(entities)), ("audit", *hinted(audit))]
    # Blocks of keys look up groups of several blocks, which are few; `similar` are pairs of kinds of names.
    sized = {name for name, sent, least in seen if sent != least} - {"similar", "near", "pairs"}
    assert len(seen) > 15 and not sized, sized


def test_pairs_of_the_matcher_leave_their_step_as_they_end(spark):
    """No step hands on pairs with their sites' facts, and no pair puts its reasons together or makes decimals."""
    rows = [(i, f"Site {i % 3}", "Acme", "US", "TX", 30.0, -100.0) for i in range(1, 9)]
    got = en.match_entities(spark.createDataFrame(rows, "site_id long, name string, operator string, country string, subdivision string, lat double, lng double"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "concat_ws" not in plan and "round(" not in plan and got.count() == 28
    assert plan.strip().startswith("Union")
    values = [0.0, 0.12344999, 0.99995, 20015086.796]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(en.rounded(F.col("v"), 4)).collect()] == [round(v, 4) for v in values]


def test_names_meet_in_blocks_however_they_share_grams(spark, monkeypatch):
    """Groups whose names share few grams and groups whose names share most give what all pairs give, and no pair is shuffled."""
    plans = []
    monkeypatch.setattr(jo, "BLOCK", 9)
    monkeypatch.setattr(jo, "materialize", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or materialize(df, name))
    r = random.Random(5)
    word = lambda n: "".join(r.choices("abcdefghijklmnop", k=n))
    apart = [" ".join(word(5) for _ in range(3)) for _ in range(40)]
    names = [(n, "apart") for n in apart] + [(n[: len(n) - r.randint(0, 4)] + word(2), "apart") for n in apart * 2] + [(f"Large {r.choice('abc')} ring {i % 30}", "dense") for i in range(90)]
    rows = [(i, n, g) for i, (n, g) in enumerate(names)] + [(900, None, "dense"), (901, "", "apart")]

    def grams(n):
        return {f"  {w} "[i : i + 3] for w in (n or "").lower().split() for i in range(len(w) + 1)}

    sets = [(k, g, grams(n)) for k, n, g in rows if grams(n)]
    want = {(a, b): len(x & y) / len(x | y) for a, g, x in sets for b, h, y in sets if a < b and g == h and len(x & y) / len(x | y) >= 0.5}
    got = jo.trigram_pairs(spark.createDataFrame(rows, "k long, n string, g string"), 0.5, "k", "n", "g").collect()
    assert len(got) == len(want) and {(p.a, p.b): p.similarity for p in got} == want
    assert "MapInArrow" in dict(plans)["pairs"]
    assert sum(g == "apart" for k, n, g in rows) > 100 and any(rows[a][2] == "apart" for a, _ in want)
