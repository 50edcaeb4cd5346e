"""One-to-one assignment of controls to sites by distance."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.analytics import number_rows
from lodestone.operators.entities import resolve_superseded
from lodestone.operators.joins import geo_pairs
from lodestone.storage import materialize, release

#: Pairs and members of a component that one task solves (some 24 bytes each); rounds between two cuts into components.
WHOLE, ROUNDS = 6_000_000, 4


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): of the edges (a, b), two ids each; the component is its smallest node.

    Each component's larger labels are hung under their smallest smaller neighbour and followed to the end; the graph
    that is left has the ends as nodes, and is handled in the same way until no edge is left.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo < hi").distinct(), "edges")
    label = materialize(edges.select(F.explode(F.array("lo", "hi")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while not edges.isEmpty():
        ends = resolve_superseded(edges.groupBy("hi").agg(F.min("lo").alias("lo")), "hi", "lo")
        at = lambda df, c: df.join(ends.select(F.col("hi").alias(c), F.col("survivor").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")  # noqa: B023, E731
        moved = materialize(at(label, "component"), "labels")
        rest = at(at(edges, "lo"), "hi").select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).filter("lo < hi").distinct()
        rest = materialize(rest, "edges")
        release(label, edges)
        label, edges = moved, rest
    release(edges)
    return label


def _in_order(d: np.ndarray, s: np.ndarray, c: np.ndarray, step: int = 1 << 16) -> Iterator[tuple[float, int, int]]:
    """The rows (d, s, c) in order, as Python's numbers only a part at a time."""
    order = np.lexsort((c, s, d))
    for a in range(0, len(order), step):
        o = order[a : a + step]
        yield from zip(d[o].tolist(), s[o].tolist(), c[o].tolist(), strict=True)


def _taken(pairs: Iterable[tuple[float, int, int]], sites: dict[int, list], controls: dict[int, list]) -> list[tuple]:
    """(site, control, distance): pairs of places, given in order, are taken by distance; members of a place and of equal distances by id."""
    out, at = [], dict.fromkeys([*sites, *controls], 0)
    for d, tied in groupby(pairs, key=lambda p: p[0]):
        near: dict[int, list[int]] = {}
        for _, s, c in tied:
            if at[s] < len(sites[s]) and at[c] < len(controls[c]):
                near.setdefault(s, []).append(c)
        heads = [(sites[s][at[s]], s) for s in near]
        heapq.heapify(heads)
        while heads:
            site, s = heapq.heappop(heads)
            near[s] = [c for c in near[s] if at[c] < len(controls[c])]
            if not near[s]:
                continue
            c = min(near[s], key=lambda c: controls[c][at[c]])
            out.append((site, controls[c][at[c]], d))
            at[s], at[c] = at[s] + 1, at[c] + 1
            if at[s] < len(sites[s]):
                heapq.heappush(heads, (sites[s][at[s]], s))
    return out


def _solved(pairs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(site, control, distance_m) of the components in `pairs`, each in one task."""

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        lists: dict[int, list] = {}
        for place, member in zip(right["place"].tolist(), right[key].tolist(), strict=True):
            lists.setdefault(place, []).append(member)
        for v in lists.values():
            v.sort()
        rows = _in_order(*(left[x].to_numpy() for x in ("distance_m", "s", "c")))
        return pd.DataFrame(_taken(rows, {p: v for p, v in lists.items() if p % 2}, {p: v for p, v in lists.items() if not p % 2}), columns=["site", "control", "distance_m"])

    kind = members.schema[key].dataType.simpleString()
    members = members.toDF(*members.columns)  # names of its own: both come from the same labels
    return pairs.groupBy("component").cogroup(members.groupBy("component")).applyInPandas(solve, f"site {kind}, control {kind}, distance_m double")


def _round(pairs: DataFrame) -> DataFrame:
    """(s, c, distance_m, s_from, c_from, n): places that name each other as nearest, with as many members as both have.

    Nearest is by (distance, next site, next control). Where a place has two at its least distance, their members may
    take turns, and only the first pair is sure.
    """

    def best(x: str, y: str) -> DataFrame:
        m = pairs.groupBy(x).agg(F.min(F.struct("distance_m", f"{y}_next", y)).alias("m"), F.max(F.struct(-F.col("distance_m"), f"{y}_next")).alias("w"))
        return m.select(x, F.col(f"m.{y}").alias(y), (F.col(f"m.{y}_next") == F.col(f"w.{y}_next")).alias(f"{x}_sure"))

    hit = pairs.join(best("s", "c"), ["s", "c"]).join(best("c", "s"), ["s", "c"])
    n = F.when(F.col("s_sure") & F.col("c_sure"), F.least("s_left", "c_left")).otherwise(F.lit(1).cast("long"))
    return hit.select("s", "c", "distance_m", "s_from", "c_from", n.alias("n"))


def _after(pairs: DataFrame, hit: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """The pairs whose places both have members left."""
    for x in ("s", "c"):
        used = hit.select(F.col(x), F.col("n").alias("_n"), (F.col(f"{x}_from") + F.col("n")).alias("_from"))
        used = used.join(members.select(F.col("place").alias(x), F.col("rank").alias("_from"), F.col(key).alias("_next")), [x, "_from"], "left")
        pairs = pairs.join(used, x, "left").filter("_n IS NULL OR _next IS NOT NULL")
        pairs = pairs.withColumns({f"{x}_left": F.col(f"{x}_left") - F.coalesce("_n", F.lit(0)), f"{x}_from": F.coalesce("_from", f"{x}_from"), f"{x}_next": F.coalesce("_next", f"{x}_next")}).drop("_n", "_from", "_next")
    return pairs


def nearest_control(pos: DataFrame, pool: DataFrame, lo_m: float, hi_m: float, stratum: str, key: str = "site_id", whole: int = WHOLE) -> DataFrame:
    """(site, control, distance_m): each site with a control of its stratum between two distances, one to one.

    The result is that of taking the pairs by (distance, site, control), each if both are still free; a site has a null
    control only if others took all of its candidates. Distances count in whole millimetres, so that equal ones are equal
    whatever the order of their arithmetic. Ids are unique over both tables; rows without a place match nothing,
    null strata are one.

    Sites at one place have the same candidates, so places meet, with their numbers of members: many sites at one place
    are one row. The graph of places is cut into components. One of at most `whole` pairs and members is solved in a
    task; in a larger one places that name each other as nearest are matched, all of their members at once, and what
    is left is cut again every few rounds.
    """
    sides = [df.select(key, F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"), F.col(stratum).cast("string").alias("g"), F.lit(i).cast("long").alias("i")) for df, i in ((pos, 1), (pool, 0))]
    both = sides[0].unionByName(sides[1]).filter(f"lat IS NOT NULL AND lng IS NOT NULL AND {key} IS NOT NULL")
    places = both.groupBy("g", "lat", "lng", "i").agg(F.min(key).alias("next"), F.count("*").alias("left"))
    places = materialize(places.withColumn("place", 2 * F.monotonically_increasing_id() + F.col("i")), "places")  # odd: of sites
    near = geo_pairs(places, hi_m, "place", group="g").filter(F.col("distance_m") >= lo_m).filter("a % 2 <> b % 2")
    near = near.select(F.when(F.col("a") % 2 == 1, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(F.col("a") % 2 == 1, F.col("b")).otherwise(F.col("a")).alias("c"), F.round("distance_m", 3).alias("distance_m"))
    side = lambda x: places.select(F.col("place").alias(x), F.col("next").alias(f"{x}_next"), F.col("left").alias(f"{x}_left"), F.lit(0).cast("long").alias(f"{x}_from"))
    pairs = materialize(near.join(side("s"), "s").join(side("c"), "c"), "pairs")

    met = pairs.select(F.explode(F.array("s", "c")).alias("place")).distinct()
    known = places.join(met, "place", "left_semi")
    same = F.col("b.g").eqNullSafe(F.col("p.g")) & (F.col("b.lat") == F.col("p.lat")) & (F.col("b.lng") == F.col("p.lng")) & (F.col("b.i") == F.col("p.i"))
    members = number_rows(both.alias("b").join(known.alias("p"), same).select(F.col("p.place").alias("place"), F.col(f"b.{key}").alias(key)), ["place", key], "", 19)
    members = materialize(members.select("place", key, F.col("public_id").cast("long").alias("at")), "members")
    first = members.groupBy("place").agg(F.min("at").alias("first"))
    members = materialize(members.join(first, "place").select("place", key, (F.col("at") - F.col("first")).alias("rank")), "members")

    found: list[DataFrame] = []
    while not pairs.isEmpty():
        comp = connected(pairs.select(F.col("s").alias("a"), F.col("c").alias("b")))
        place = pairs.select(F.explode(F.array(*[F.struct(F.col(x).alias("node"), F.col(f"{x}_from").alias("from"), F.col(f"{x}_left").alias("left")) for x in ("s", "c")])).alias("p")).select("p.*").distinct().join(comp, "node")
        paired = pairs.join(comp.withColumnRenamed("node", "s"), "s")
        size = paired.groupBy("component").agg(F.count("*").alias("w")).unionByName(place.groupBy("component").agg(F.sum("left").alias("w"))).groupBy("component").agg(F.sum("w").alias("w"))
        light = materialize(size.filter(F.col("w") <= whole).select("component"), "light")
        rows = place.join(light, "component", "left_semi").withColumnRenamed("node", "place").join(members, "place").filter(F.col("rank") >= F.col("from")).select("component", "place", key)
        found.append(materialize(_solved(paired.join(light, "component", "left_semi").select("component", "s", "c", "distance_m"), rows, key), "solved"))
        rest = materialize(paired.join(light, "component", "left_anti").select(*pairs.columns), "pairs")
        release(pairs, comp, light)
        pairs = rest
        for _ in range(ROUNDS):
            if pairs.isEmpty():
                break
            hit = materialize(_round(pairs), "hit")
            rest = materialize(_after(pairs, hit, members, key), "pairs")
            each = hit.select("s", "c", "distance_m", F.posexplode(F.sequence("s_from", F.col("s_from") + F.col("n") - 1)).alias("k", "rs"), "c_from")
            each = each.select("s", "c", "distance_m", "rs", (F.col("c_from") + F.col("k")).alias("rc"))
            named = lambda x, y: members.select(F.col("place").alias(x), F.col("rank").alias(f"r{x}"), F.col(key).alias(y))
            found.append(materialize(each.join(named("s", "site"), ["s", "rs"]).join(named("c", "control"), ["c", "rc"]).select("site", "control", "distance_m"), "matched"))
            release(pairs, hit)
            pairs = rest
    release(pairs, members)
    kind = pos.schema[key].dataType.simpleString()
    done = pos.sparkSession.createDataFrame([], f"site {kind}, control {kind}, distance_m double")
    for f in found:
        done = done.unionByName(f)
    return pos.select(F.col(key).alias("site")).join(done, "site", "left")
