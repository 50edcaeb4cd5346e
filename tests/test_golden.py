"""Worked examples of the scalar functions and scores."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import dockets as dk
from lodestone.functions import text as tx
from lodestone.functions import values as vl
from lodestone.operators import awards as aw
from lodestone.operators import entities as en
from lodestone.operators import monitor as mo
from lodestone.operators import observations as ob
from lodestone.sources import bodies as bo


def one(spark, expr_of, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr_of(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(("s", "usd"), [("$50.0 million", 50000000), ("$1.2 billion", 1200000000), ("$534.8 million", 534800000), ("750 thousand", 750000), ("n/a", None)])
def test_scaled_money(spark, s, usd):
    assert one(spark, vl.parse_usd_scaled, s) == usd


@pytest.mark.parametrize(("s", "d"), [("12/4/2013", (2013, 12, 4)), ("Dec 4, 2013", (2013, 12, 4)), ("May 2024", (2024, 5, 1)), ("2027", (2027, 1, 1)), ("2013-12-04", (2013, 12, 4)), ("n/a", None)])
def test_dates(spark, s, d):
    assert one(spark, vl.parse_date_any, s) == (datetime.date(*d) if d else None)


def test_epoch(spark):
    assert one(spark, vl.epoch_ms_to_date, "1496102400000") == datetime.date(2017, 5, 30)
    assert one(spark, vl.epoch_ms_to_date, "soon") is None


def test_plan_fields(spark):
    assert one(spark, vl.extract_kv, "a 345-kV line") == 345
    assert one(spark, vl.extract_county, "built in Deaf Smith County soon") == "Deaf Smith"
    assert one(spark, vl.extract_station_names, "Cottonwood to Edith Clarke 345-kV line") == ["Cottonwood", "Edith Clarke"]


@pytest.mark.parametrize(("section", "status", "kind"), [("Future", "In Service", "actual"), ("Future", "cancelled", "unknown"), ("Future", "open", "projected")])
def test_date_type(spark, section, status, kind):
    df = spark.createDataFrame([(section, status)], "a string, b string")
    assert df.select(vl.classify_date_type(F.col("a"), F.col("b")).alias("r")).first().r == kind


def test_recover_json(spark):
    assert one(spark, tx.recover_json, '```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, tx.recover_json, '```JSON\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, tx.recover_json, 'Here: {"a": 1} ok') == '{"a": 1}'
    assert one(spark, tx.recover_json, '{"a": "b " c"}') is None


@pytest.mark.parametrize(("n", "f", "ok"), [(120, 6, True), (120, 7, False), (0, 0, True)])
def test_batch_health(spark, n, f, ok):
    df = spark.createDataFrame([(n, f)], "n int, f int")
    assert mo.batch_health(df, "n", "f", F.lit(False)).first().healthy is ok
    assert mo.batch_health(df, "n", "f", F.lit(True)).first().healthy is False


def test_chunks(spark):
    df = spark.createDataFrame([(1, "x" * 5000), (2, "y" * 40), (3, None)], "id int, t string")
    assert [(r.id, r.chunk_no, len(r.chunk)) for r in bo.chunk_text(df, "id", "t").orderBy("chunk_no").collect()] == [(1, 0, 2048), (1, 1, 2048), (1, 2, 1416)]


def test_word_borders(spark):
    df = spark.createDataFrame([("Data center news", "query"), ("update", "query"), ("metadata centers", "query"), ("update", "feed")], "title string, lane string").withColumn("summary", F.lit(None).cast("string"))
    assert [r.gate for r in bo.relevance_gate(df, ["data", "dc"], "lane").collect()] == ["pending", "skipped", "skipped", "pending"]


def test_empty_observations(spark):
    obs = spark.createDataFrame([], "entity_id long, source_class string, observed_at date, attribute string, value_text string, value_num double, lat double, lng double, capacity_basis string, lineage string, redistributable boolean, cap string, retracted boolean, superseded boolean, obs_id string")
    ent = spark.createDataFrame([(1, "parcel")], "entity_id long, geo_precision string")
    bands = spark.createDataFrame([("low", 0, 39, 1)], "band string, lo int, hi int, sort_order int")
    r = ob.confidence(ent, obs, bands, "2001-08-02").first()
    assert (r.score, r.band) == (15, "low")


@pytest.mark.parametrize(("s", "usd"), [("$500,000", 500000), ("2500000", 2500000), ("-$1.5 million", -1500000), ("", None)])
def test_amounts(spark, s, usd):
    assert one(spark, vl.parse_usd_scaled, s) == usd


@pytest.mark.parametrize(("section", "status", "kind"), [("completed", "Energized", "actual"), ("future", "Planned", "projected"), ("rtp", None, "projected"), ("cancelled", "Cancelled", "unknown"), ("future", "under construction", "required")])
def test_more_date_types(spark, section, status, kind):
    df = spark.createDataFrame([(section, status)], "a string, b string")
    assert df.select(vl.classify_date_type(F.col("a"), F.col("b")).alias("r")).first().r == kind


def test_drivers_and_names(spark):
    assert one(spark, vl.classify_driver, "serve a new data center large load") == "load_growth"
    assert one(spark, vl.classify_driver, "generation interconnection for a solar POI") == "generation_interconnection"
    assert one(spark, vl.classify_driver, None) is None
    assert one(spark, vl.is_large_load, "hyperscale data center") and not one(spark, vl.is_large_load, "routine rebuild")
    assert one(spark, vl.extract_station_names, "new San Miguel Switching Station") == ["San Miguel"]
    assert one(spark, vl.extract_station_names, "Bakersfield Switch upgrade") == ["Bakersfield"]
    assert one(spark, vl.extract_county, "Rebuild in Dickens County, TX") == "Dickens" and one(spark, vl.extract_county, "no county") is None


def test_json_helpers(spark):
    assert one(spark, tx.json_texts, '["a", 1, null, {"x": 2}]') == ["a", "1", None, '{"x":2}']
    assert one(spark, tx.json_texts, '{"a": 1}') is None and one(spark, tx.json_texts, None) is None and one(spark, tx.json_texts, "[]") == []
    assert one(spark, lambda c: tx.json_get(c, "a", "b"), '{"a": {"b": "x"}}') == "x"
    assert one(spark, tx.json_strip_nulls, '{"b": null, "a": [1], "q\\"": "x"}') == '{"a":[1],"q\\"":"x"}'
    nested = '{"a": {"x": null, "y": [null, {"z": null, "w": "\\"k\\":null,"}], "v": null}, "c": ":null", "e": null, "f": null}'
    assert one(spark, tx.json_strip_nulls, nested) == '{"a":{"y":[null,{"w":"\\"k\\":null,"}]},"c":":null"}'
    assert [one(spark, tx.json_strip_nulls, s) for s in ('{"a":null}', '[{"a":null,"b":null}]', "null", "{bad", None)] == ["{}", "[{}]", "null", None, None]
    assert one(spark, lambda c: tx.json_merge(c, F.lit(None).cast("string")), '{"a": 1}') == '{"a":1}'


@pytest.mark.parametrize(("cadence", "minutes", "due"), [("hourly", 49, False), ("hourly", 50, True), ("daily", 1199, False), ("weekly", 9360, True), ("never heard", 1200, True), ("archival_refresh", 38_879, False)])
def test_poll_intervals(spark, cadence, minutes, due):
    at = datetime.datetime(2024, 3, 1)
    df = spark.createDataFrame([(cadence, at - datetime.timedelta(minutes=minutes), at)], "c string, last timestamp, now timestamp")
    assert df.select(vl.is_due(F.col("c"), F.col("last"), F.col("now")).alias("r")).first().r is due


def test_recompute_is_idempotent(spark):
    kind = "entity_id long, source_class string, observed_at date, attribute string, value_text string, value_num double, lat double, lng double, capacity_basis string, lineage string, redistributable boolean, cap string, retracted boolean, superseded boolean, obs_id string"
    day = datetime.date(2001, 8, 1)
    obs = spark.createDataFrame([(1, "official_record", day, "name", "A", None, None, None, None, f"L{i}", True, "VRF", False, False, f"o{i}") for i in range(3)], kind)
    bands = spark.createDataFrame([("low", 0, 39, 1), ("high", 40, 100, 2)], "band string, lo int, hi int, sort_order int")
    ent = spark.createDataFrame([(1, "parcel", "construction", "L4", 10, "low", False), (2, None, "decommissioned", None, 0, "low", False)], "entity_id long, geo_precision string, lifecycle string, old_layer string, old_score long, old_band string, old_publishable boolean")
    moved, stats = ob.recompute(ent, obs, bands, "2001-08-02")
    r = moved.collect()
    assert [(x.entity_id, x.layer, x.band, x.publishable) for x in r] == [(1, "L2", "high", True)] and (stats.first().seen, stats.first().changed) == (2, 1)
    again = spark.createDataFrame([(1, "parcel", "construction", r[0].layer, r[0].score, r[0].band, True)], ent.schema)
    assert ob.recompute(again, obs, bands, "2001-08-02")[0].count() == 0


def test_seasonal_fit_against_least_squares(spark):
    import numpy as np
    from lodestone.operators import analytics as an

    g = np.random.default_rng(1)
    t = np.arange(300.0)
    y = 5 + 0.02 * t + 3 * np.sin(2 * np.pi * t / 24) + g.normal(0, 0.5, 300)
    y[40] += 9
    out = an.seasonal_deltas(spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(t, y, strict=True)], "s string, t double, y double"), "s", "t", "y", 24.0).orderBy("t").collect()
    x = np.stack([np.ones(300), t, np.sin(2 * np.pi * t / 24), np.cos(2 * np.pi * t / 24)], 1)
    rest = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    want = rest / np.sqrt((rest**2).sum() / 296)
    assert np.allclose([r.delta_sigma for r in out], want, atol=1e-6) and [r.flagged for r in out] == [bool(v) for v in abs(want) >= 2]


def test_repeated_rows_keep_their_prefix(spark):
    from lodestone.operators import joins as jo

    df = spark.createDataFrame([("Ab", 1), ("Ab", 1), ("x", 1), ("Ab", 2)], "t string, g int")
    dim = spark.createDataFrame([(1, "a", "one"), (1, "AB", "two")], "g int, p string, v string")
    assert sorted((r.t, r.g, r.v) for r in jo.prefix_lookup(df, dim, "g", "t", "p", "v").collect() if r.v) == [("Ab", 1, "two"), ("Ab", 1, "two")]


AWARDS = [
    ("ok_quality_jobs", {"Fiscal Year": "2007", "Vendor Name": "A G EQUIPMENT CO", "Street Address": "3401 W ALBANY", "Vendor Address City": "BROKEN ARROW", "Issue Date": "08/15/2006", "Payment Amount": "$10649.55", "Department Description": "QUALITY JOBS INCENTIVE PAYMENT"},
     {"source_record_id": "A G EQUIPMENT CO:2007:08/15/2006:$10649.55", "award_value_usd": 10649.55, "term_start": datetime.date(2006, 8, 15), "county_name": None, "incentive_type": "rebate", "statute_citation": "68 O.S. §3601 et seq."}),
    ("wi_wedc_ared", {"uid": "FY17356", "county": "Dodge", "ObjectId": 1, "awardDate": 1496102400000, "awardType": "Grant", "awardAmount": 400000, "municipality": "Horicon"}, {"source_record_id": "FY17356", "term_start": datetime.date(2017, 5, 30), "award_value_usd": 400000.0, "incentive_type": "grant"}),
    ("wi_wedc_ared", {"ObjectId": 42, "county": "Dane", "awardDate": "1496102400000"}, {"source_record_id": "oid:42", "award_value_usd": None, "term_start": None}),
    ("ia_ieda_awards", {"contract_name": "X", "primary_funding_agreement": "21-HQJDF-005", "award_date": "2021-05-21T00:00:00.000", "direct_assistance_awarded": 150000.0, "tax_benefits_awarded": 147524.0}, {"source_record_id": "21-HQJDF-005", "award_value_usd": 297524.0, "incentive_type": "mixed", "term_start": datetime.date(2021, 5, 21)}),
    ("ia_ieda_awards", {"contract_name": "Z"}, {"incentive_type": "other", "award_value_usd": None, "source_record_id": "Z:"}),
    ("dc_tif_areas", {"NAME": "Verizon Center", "TYPE": "TIF", "WARD": "2", "MATURITY_YEAR": 2043, "YEAR_AUTHORIZED": 2007, "INITIAL_AUTHORIZATION": "$50.0 million", "GLOBALID": "{8370B12D}"},
     {"source_record_id": "{8370B12D}", "place_name": "Ward 2", "award_value_usd": 50000000.0, "incentive_type": "tif", "term_start": datetime.date(2007, 1, 1), "term_end": datetime.date(2043, 12, 31), "term_years": 37.0}),
    ("ny_esd_dei", {"total_lead_agency_benefits_awarded": "n/a", "assistance_amount": "5"}, {"award_value_usd": None}),
]


def test_award_records(spark):
    rows = [(i, source, json.dumps(raw)) for i, (source, raw, _) in enumerate(AWARDS)] + [(98, "ok_quality_jobs", "{broken"), (99, "unheard_of", "{}"), (97, None, None)]
    got = {r.i: r.asDict() for r in aw.map_awards(spark.createDataFrame(rows, "i int, source_key string, raw string")).collect()}
    assert set(got) == set(range(len(AWARDS)))
    for i, (_, _, want) in enumerate(AWARDS):
        assert {k: got[i][k] for k in want} == want


def test_portal_rows(spark):
    rows = [(1, {"amountrecaptured": "$9", "Name": " <b>Acme&nbsp; Co</b>", "amountoftaxcredit": "", "grant_amount": "$1,200", "dateagreementapproved": "2016/3/9"}), (2, {"company": "B", "approved": "on 3/9/2016"}), (3, None)]
    df = spark.createDataFrame(rows, "i int, cells map<string, string>")
    patterns = {"name": ["^name$", "company"], "usd": ["amountoftaxcredit", "grant.?amount"], "at": ["date.*approv", "approv"]}
    got = aw.map_portal_row(df, "cells", patterns, ["usd"], ["at"]).orderBy("i").collect()
    day = datetime.date(2016, 3, 9)
    assert [(r.name, r.usd, r.at) for r in got] == [("Acme Co", 1200.0, day), ("B", None, day), (None, None, None)]


AMEND = "APPLICATION OF {} TO AMEND ITS CERTIFICATE OF CONVENIENCE AND NECESSITY FOR THE {}"


@pytest.mark.parametrize(
    ("title", "names"),
    [
        (AMEND.format("ONCOR ELECTRIC DELIVERY COMPANY LLC", "EL CAPITAN SWITCH-TO-DRY LAKE SWITCH 345-KV TRANSMISSION LINE"), ["El Capitan", "Dry Lake"]),
        ("...FOR THE DINOSAUR SWITCH - LONGSHORE SWITCH 765 KV TRANSMISSION LINE", ["Dinosaur", "Longshore"]),
        (AMEND.format("BRAZOS ELECTRIC POWER COOPERATIVE, INC.", "PROPOSED KOSSE SWITCH TO KOSSE 138-KV TRANSMISSION LINE IN LIMESTONE COUNTY"), ["Kosse"]),
        ("PETITION FOR THE NEW O'NEIL-RAY&#9;SWITCHING STATION", ["O'Neil-Ray"]),
        ("FOR THE AB SWITCH TO THE NEW 69 KV TRANSMISSION LINE", []),
        ("UTILITY TO AMEND ITS RATES", []),
        (None, []),
    ],
)
def test_docket_endpoints(spark, title, names):
    assert one(spark, dk.extract_endpoints, title) == names


def test_dockets_are_screened_and_become_mentions(spark):
    rows = [
        (1, AMEND.format("BRAZOS", "PROPOSED KOSSE SWITCH TO KOSSE 138-KV TRANSMISSION LINE IN LIMESTONE COUNTY"), "TX", "48293"),
        (2, "TRANSMISSION AND DISTRIBUTION UTILITY MONTHLY RATE UPDATES", "TX", None),
        (3, "FINAL ORDER energizing the line FOR THE AX SWITCH - BOYD SWITCH TRANSMISSION LINE placed in service", None, None),
        (4, None, None, None),
    ]
    projects, mentions = en.normalize_dockets(spark.createDataFrame(rows, "id long, title string, state string, county_fips string"))
    p = {r.id: r for r in projects.collect()}
    assert set(p) == {1, 3} and (p[1].kv, p[1].county_raw, p[1].date_type, p[1].tier, p[1].driver, p[1].status) == (138, "Limestone", "approved", "EST", "reliability", "approved")
    assert (p[3].kv, p[3].county_raw, p[3].date_type, p[3].tier) == (None, None, "actual", "SRC")
    assert sorted((r.id, r.pos, r.name_frag, r.confidence, r.inservice_date) for r in mentions.collect()) == [(1, 0, "Kosse", 0.3, None), (3, 0, "Boyd", 0.85, None)]
    assert one(spark, lambda c: dk.screen_docket(c)["reason"], rows[1][1]) == "excluded:rate/procedural"


@pytest.mark.parametrize(
    ("s", "d"),
    [("est. Dec 4, 2013", (2013, 12, 4)), ("in May 2024", (2024, 5, 1)), ("12/4/2013 10:00", (2013, 12, 4)), ("12-4-2013", (2013, 12, 4)), ("2013-12-04T10:00", (2013, 12, 4)), ("Sept. 3 2020, late", (2020, 9, 3)), ("Lot 12, 2013", None), ("in 2013", None), ("13/45/2020", None), ("", None), (None, None)],
)
def test_dates_inside_text(spark, s, d):
    assert one(spark, vl.parse_date_any, s) == (datetime.date(*d) if d else None)


@pytest.mark.parametrize(
    ("s", "names"),
    [('["A","B"]', ["A", "B"]), ('[" A ", {"name": "N"}, {"carrier": "C", "tenant": "T"}, {"name": null, "tenant": "T"}, {"x": 1}, 5, null, ""]', ["A", "N", "C", "T"]), ("a; b,c ,", ["a", "b", "c"]), ("[]", []), ('{"name": "x"}', []), ("[broken, text", ["[broken", "text"]), ("", []), (None, [])],
)
def test_name_arrays(spark, s, names):
    assert one(spark, tx.to_name_array, s) == names


@pytest.mark.parametrize(("s", "norm"), [("Łódź Substation", "lodz"), ("Søndre Tap", "sondre"), ("Ångström Switch", "angstrom"), ("Æsir & Œuvre S/S", "aesir oeuvre"), ("Re\u0301union POI", "reunion"), ("Đắk Lắk", "dak lak"), ("TAP12", None), (None, None)])
def test_station_names_lose_their_accents(spark, s, norm):
    assert one(spark, tx.normalize_station, s) == norm


def test_later_ingest_wins_a_tie(spark):
    day = datetime.date
    rows = [(1, "name", "a", day(2024, 1, 1), day(2024, 2, 1), "o1"), (1, "name", "b", day(2024, 1, 1), day(2024, 2, 9), "o2"), (2, "name", "a", day(2024, 1, 1), None, "o3"), (2, "name", "b", day(2024, 1, 1), None, "o4")]
    obs = spark.createDataFrame([(*r, None, None, None, "L" + r[5], "SRC", False, False) for r in rows], "entity_id long, attribute string, value_text string, observed_at date, ingested_at date, obs_id string, value_num double, lat double, lng double, lineage string, cap string, retracted boolean, superseded boolean")
    assert {r.entity_id: r.obs_id for r in ob.best_claims(obs).collect()} == {1: "o2", 2: "o3"}
    assert {r.entity_id: r.obs_id for r in ob.best_claims(obs.drop("ingested_at")).collect()} == {1: "o1", 2: "o3"}


def test_awards_without_a_county_stay(spark):
    awards = spark.createDataFrame([(1, "TX", "Bell COUNTY", None), (2, "TX", "bell", 9), (3, "TX", None, None), (4, "TX", "Nowhere", None), (5, "OK", "Bell", None), (6, "TX", "Old", None)], "id long, state string, county string, jurisdiction_id long")
    counties = spark.createDataFrame([(7, "TX", "Bell County", True), (8, "TX", "bell", True), (6, "TX", "Old County", False)], "jurisdiction_id long, state string, county string, active boolean")
    got = {r.id: (r.jurisdiction_id, r.resolution_method, r.resolution_status, r.candidate_count) for r in en.resolve_awards(awards, counties).collect()}
    none = (None, None, "unresolved", 0)
    assert got == {1: (7, "county_name", "resolved", 1), 2: (9, None, "resolved", None), 3: none, 4: none, 5: none, 6: none}


def test_numbers_of_one_hot_value_are_spread(spark):
    from lodestone.operators import analytics as an

    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(5).alias("v"), F.hash("id").alias("h"), "id")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small ranges are merged
    try:
        out = an.number_rows(df, ["v", "h", "id"], "N-", 6)
        got = [(r.v, r.h, r.id, int(r.public_id[2:])) for r in out.collect()]
        parts = spark.read.parquet(*[f for f in out.inputFiles()]).select(F.shiftright("_at", 33).alias("p"), "v").filter("v = 5").groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert [n for *_, n in sorted(got)] == list(range(1, 20_001)) and len(parts) >= 3
    assert an.number_rows(df.limit(0), ["v"], "N-", 6).count() == 0


def test_words_of_the_evidence_gate_end_at_letters_beyond_ascii(spark):
    from lodestone.operators import ingest as ig

    df = spark.createDataFrame([(1, "the élan ofé"), (2, "ofé the undé"), (3, "éthe of"), (4, "the under of"), (5, "them of"), (6, None)], "id int, text string")
    got = {r.id: r.reason for r in ig.evidence_gate(df, r"(?i)\bthe\b", r"(?i)\bund\b", r"(?i)\bof\b", F.split("text", " ")).collect()}
    assert got == {1: None, 2: "negative", 3: None, 4: None, 5: "no_positive", 6: None}
    assert tx.ascii_words(r"\\b\d") == r"\\b\d"


def test_nested_json_is_stripped_and_merged_in_time(spark):
    """Each step names its input many times: computed again for each token, this took the cube of the tokens."""
    import time

    nulls = json.dumps({f"k{i}": None if i % 2 else {"v": [None, i]} for i in range(400)})
    start = time.monotonic()
    out = json.loads(one(spark, tx.json_strip_nulls, nulls))
    assert out == {f"k{i}": {"v": [None, i]} for i in range(0, 400, 2)}
    both = json.loads(one(spark, lambda c: tx.json_merge(c, F.lit('{"k0": 1}')), nulls))
    assert both == json.loads(nulls) | {"k0": 1}
    assert time.monotonic() - start < 60
