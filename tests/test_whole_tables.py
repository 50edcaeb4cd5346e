"""Queries over ids far apart, against their SQL and plain versions."""

from __future__ import annotations

import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import duck, mismatch
from test_joins import metres

from lodestone import plans
from lodestone.plans.base import Data

NAMES = ["e7_match_entities", "e8_apply_merges", "e8_merged_entities", "e21_group_buildings", "j11_geo_pairs", "j12_trigram_pairs", "j13_block_pairs", "q6_check_share", "u2_union_distinct"]


@pytest.fixture(scope="module")
def beyond(tmp_path_factory):
    """A folder of tables whose ids lie on both sides of each filter."""
    d = tmp_path_factory.mktemp("beyond")
    sites = [*range(380, 430), 452, *range(1480, 1530), *range(14_980, 15_001)]
    segments = ["BUILDING", "MACHINERY", "FURNITURE"]
    customer = {"c_custkey": sites, "c_name": [f"Customer#{i}" for i in sites], "c_mktsegment": [segments[(i + 1) // 2 % 3] for i in sites], "c_nationkey": [(i + 1) // 2 % 4 for i in sites]}
    parts = [*range(1180, 1220), *range(19_960, 20_001)]
    colours = ["azure", "beige", "coral"]
    part = {"p_partkey": parts, "p_brand": [f"Brand#{i % 2}" for i in parts], "p_name": [f"{colours[i % 3]} {colours[i // 3 % 3]}" for i in parts], "p_type": ["STEEL" if i % 2 else "TIN" for i in parts], "p_size": [i % 5 for i in parts], "p_retailprice": [1.0 * i for i in parts]}
    for name, columns in (("customer", customer), ("part", part)):
        pq.write_table(pa.table(columns), d / f"{name}.parquet")
    return str(d)


@pytest.mark.parametrize("name", NAMES)
def test_all_ids(spark, beyond, name):
    assert mismatch(plans.queries()[name](spark, beyond), duck(beyond), plans.oracle_sql()[name]) is None


def test_groups_attach_to_all_sites(spark, beyond):
    site = [(r.site_id, r.lat, r.lng) for r in Data(spark, beyond).v3.collect()]
    groups: dict[str, list] = {}
    for s in site:
        groups.setdefault(f"id:{s[0] % 50}" if s[0] % 4 == 0 else f"{s[0] % 30} main st|787", []).append(s)
    want = {}
    for name, of in groups.items():
        centre = (name, sum(s[1] for s in of) / len(of), sum(s[2] for s in of) / len(of))
        near = [(round(metres(centre, s), 3), f"e:{s[0]}") for s in site if metres(centre, s) <= 100]
        want[name] = (len(of), min(near)[1][2:] if near else None)
    got = plans.queries()["e21_group_buildings"](spark, beyond).collect()
    assert {r.building: (r.n, r.attached_to) for r in got} == want and want["id:2"] == (1, "452")


def test_dates_of_all_events(spark, tmp_path):
    ids = [0, 1, 19_999, 20_000, 20_001, 3_000_000_000]
    pq.write_table(pa.table({"event_id": ids}), tmp_path / "events.parquet")
    got = {r.event_id: r.d for r in plans.queries()["f12_epoch_ms"](spark, str(tmp_path)).collect()}
    assert got == {i: datetime.date(1970, 1, 1) + datetime.timedelta(days=i % 20_000) for i in ids}
