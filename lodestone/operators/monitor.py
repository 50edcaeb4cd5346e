"""Monitoring, queue state and data-quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.values import cadence_seconds, is_due
from lodestone.operators.ingest import best_per_key

SAME_ERROR = ("", "[]", "{}", "null")


def staleness_check(watches: DataFrame, log: DataFrame, as_of: str) -> DataFrame:
    """(watch_key, last_at, age_s, threshold_s, breached, detail) of watches (watch_key, auto_id, mode, cadence, grace).

    One grouped pass over the log (auto_id, at, errors) serves all watches. Modes poll and data breach when the last row
    is older than cadence times grace, or there is none; mode error breaches when the latest row has an error.
    """
    last = log.groupBy("auto_id").agg(F.max("at").alias("last_at"), F.max_by("errors", F.struct(F.col("at").isNotNull(), "at", "errors")).alias("errors"))
    j = watches.join(last, "auto_id", "left")
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last_at")).alias("age_s")
    j = j.withColumn("age_s", age).withColumn("threshold_s", (cadence_seconds(F.col("cadence")) * F.col("grace")).cast("bigint"))
    bad = ~F.coalesce(F.trim("errors"), F.lit("")).isin(*SAME_ERROR)
    none = F.col("last_at").isNull()
    late = F.coalesce(F.col("age_s") > F.col("threshold_s"), F.lit(False))
    breached = none | F.when(F.col("mode") == "error", bad).otherwise(late)
    detail = F.when(none & (F.col("mode") == "poll"), "never polled").when(none, "destination has never been written").when((F.col("mode") == "error") & bad, F.concat(F.lit("error: "), F.trim("errors"))).when(late, "older than its threshold").otherwise("ok")
    return j.select("watch_key", "last_at", "age_s", "threshold_s", breached.alias("breached"), detail.alias("detail"))


def breach_summary(checks: DataFrame) -> DataFrame:
    """(lane, n, watches) of the breached watches, by what stands before the colon of their key."""
    b = checks.filter("breached").withColumn("lane", F.split("watch_key", ":")[0])
    return b.groupBy("lane").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("watch_key")), ",").alias("watches"))


def batch_health(df: DataFrame, attempted: str, failed: str, systemic: Column, tol: float = 0.05) -> DataFrame:
    """`healthy`: no systemic error, and at most `tol` of what was attempted failed."""
    share = F.when(F.col(attempted) == 0, 0.0).otherwise(F.col(failed) / F.col(attempted))
    return df.withColumn("healthy", ~systemic & (share <= tol))


def stale_jobs(log: DataFrame, key: str, ts: str, as_of: str, hours: int = 25) -> DataFrame:
    """(key, last_at, hours_silent): jobs whose latest run of all is older than `hours`."""
    at = F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    g = log.groupBy(key).agg(F.max(ts).alias("last_at"))
    silent = (at - F.unix_timestamp("last_at")) / 3600
    return g.filter(silent > hours).select(key, "last_at", F.floor(silent).cast("bigint").alias("hours_silent"))


def ops_rollup(log: DataFrame, key: str, ts: str, ok: str, as_of: str, hours: int = 36) -> DataFrame:
    """(key, runs, failures, last_at, flag): stale, failing or ok."""
    at = F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    g = log.groupBy(key).agg(F.count("*").alias("runs"), F.count_if(~F.col(ok)).alias("failures"), F.max(ts).alias("last_at"))
    flag = F.when(at - F.unix_timestamp("last_at") > hours * 3600, "stale").when(F.col("failures") > 0, "failing").otherwise("ok")
    return g.withColumn("flag", flag)


def snapshot_diff(prev: DataFrame, cur: DataFrame, key: str, column: str) -> DataFrame:
    """(key, before, after, change): what appeared, went or changed between two snapshots."""
    j = prev.select(key, F.col(column).alias("before"), F.lit(True).alias("i0")).join(cur.select(key, F.col(column).alias("after"), F.lit(True).alias("i1")), key, "full")
    change = F.when(F.col("i0").isNull(), "appeared").when(F.col("i1").isNull(), "gone").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return j.select(key, "before", "after", change.alias("change")).filter("change is not null")


def section_registers(editions: DataFrame, sections: DataFrame, bindings: DataFrame) -> dict[str, DataFrame]:
    """current edition of each state; sections without any binding (dark); sections of the current edition that failed."""
    current = editions.groupBy("state").agg(F.max("week").alias("week"))
    dark = sections.join(bindings, "section", "left_anti").select("section")
    failed = editions.join(current, ["state", "week"], "left_semi").filter("not passed").select("state", "week", "section")
    return {"current": current, "dark": dark, "failed": failed}


def census(registry: DataFrame, as_of: str) -> DataFrame:
    """One row of counters."""
    at = F.lit(as_of).cast("timestamp")
    recent = F.unix_timestamp(at) - F.unix_timestamp("last_artifact_at") <= 86400
    return registry.agg(F.count("*").alias("sources"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("license_status").isin("cleared", "attribution_required")).alias("cleared"), F.count_if(recent).alias("recent"), F.count_if(F.col("cadence").isNull()).alias("no_cadence"))


def failure_runs(df: DataFrame, key: str, order: list[str], ok: str, limit: int) -> DataFrame:
    """(key, trailing_failures, longest_run, in_error): runs of consecutive failures; a success resets."""
    w = W.partitionBy(key).orderBy(*order)
    r = df.withColumn("_g", F.count_if(F.col(ok)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    run = r.filter(~F.col(ok)).groupBy(key, "_g").agg(F.count("*").alias("n"))
    last = r.groupBy(key).agg(F.max("_g").alias("_last"))
    j = last.join(run, key, "left")
    trailing = F.coalesce(F.max(F.when(F.col("_g") == F.col("_last"), F.col("n"))), F.lit(0))
    return j.groupBy(key).agg(trailing.alias("trailing_failures"), F.coalesce(F.max("n"), F.lit(0)).alias("longest_run")).withColumn("in_error", F.col("trailing_failures") >= limit)


def advance_queue(state: DataFrame, results: DataFrame, most: int, stale_h: int, as_of: str) -> DataFrame:
    """(id, status, attempts): results applied to a queue; failures retry below `most` attempts; stale work goes back."""
    at = F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    j = state.join(results.select("id", F.col("ok").alias("_ok")), "id", "left")
    tries = F.col("attempts") + F.when(F.col("_ok") == F.lit(False), 1).otherwise(0)
    stale = (F.col("status") == "processing") & (at - F.unix_timestamp("claimed_at") > stale_h * 3600)
    status = F.when(F.col("_ok"), "done").when(F.col("_ok") == F.lit(False), F.when(tries >= most, "failed").otherwise("pending")).when(stale, "pending").otherwise(F.col("status"))
    return j.select("id", status.alias("status"), tries.alias("attempts"))


def activity_gate(registry: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """`countable`: active, licensed, an artifact within `days`, and not of the query lane."""
    fresh = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last_artifact_at") <= days * 86400
    ok = (F.col("status") == "active") & F.col("license_status").isin("cleared", "attribution_required") & F.coalesce(fresh, F.lit(False)) & (F.col("lane") != "query")
    return registry.withColumn("countable", ok)


def trailing_counts(df: DataFrame, key: str, ts: str, as_of: str) -> DataFrame:
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(ts)
    return df.groupBy(key).agg(F.count_if((age >= 0) & (age < 86400)).alias("last_24h"), F.count_if((age >= 0) & (age < 30 * 86400)).alias("last_30d"))


def demote_candidates(units: DataFrame, proposals: DataFrame, signals: DataFrame, pins: DataFrame, as_of: str, demote: int = 30, quiet: int = 60, archive: int = 120) -> DataFrame:
    """(id, action): promoted long ago, no pending proposal, no recent signal, not pinned, nothing operational.

    units: id, promoted_at, n_live. pins: id, at, kind (pin or unpin); the latest decides.
    """
    day = F.lit(as_of).cast("date")
    age = F.datediff(day, F.col("promoted_at"))
    pinned = best_per_key(pins, ["id"], [F.desc("at"), F.asc("kind")]).filter("kind = 'pin'")
    recent = signals.filter(F.datediff(day, F.col("at")) <= quiet)
    left = units.filter((age > demote) & (F.col("n_live") == 0))
    for no in (proposals.filter("status = 'pending'"), recent, pinned):
        left = left.join(no.select("id"), "id", "left_anti")
    return left.select("id", F.when(age > archive, "archive").otherwise("demote").alias("action"))


def gate_events(events: DataFrame, runs: DataFrame, as_of: str, most_h: int = 26) -> DataFrame:
    """`gated`: whether a job's latest run failed, is too old or is missing."""
    last = best_per_key(runs, ["auto_id"], [F.desc("completed_at"), F.desc("event_id")]).select("auto_id", F.col("success").alias("_ok"), F.col("completed_at").alias("_at"))
    fresh = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("_at") <= most_h * 3600
    return events.join(last, "auto_id", "left").withColumn("gated", ~F.coalesce(F.col("_ok") & fresh, F.lit(False))).drop("_ok", "_at")


def select_due(df: DataFrame, as_of: str, cadence: str, last: str, key: str, limit: int) -> DataFrame:
    due = df.filter(is_due(F.col(cadence), F.col(last), F.lit(as_of).cast("timestamp")))
    return due.orderBy(F.asc_nulls_first(last), key).limit(limit)


def run_gates(checks: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """(name, actual, expected, ok) for counts that must hold; one job for all of them."""
    out = None
    for name, (df, expected) in checks.items():
        row = df.agg(F.count("*").alias("actual")).select(F.lit(name).alias("name"), "actual", F.lit(expected).cast("bigint").alias("expected"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("ok", F.col("actual") == F.col("expected"))


def assert_gates(gates: DataFrame) -> None:
    if bad := gates.filter("not ok").collect():  # one row for each gate
        raise AssertionError("; ".join(f"{r['name']}: {r['actual']} of {r['expected']}" for r in bad))


def check_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): rows for which a rule is false (null counts as kept), in one pass."""
    one = df.agg(*[F.count_if(~F.coalesce(r, F.lit(True))).alias(n) for n, r in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("p")).select("p.*")


def check_provenance(df: DataFrame, value: str, needed: list[str]) -> DataFrame:
    """Counts of values without full provenance."""
    missing = F.lit(False)
    for c in needed:
        missing = missing | F.col(c).isNull()
    return df.agg(F.count(value).alias("n_values"), F.count_if(F.col(value).isNotNull() & missing).alias("without_provenance"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n, checksum): independent of row order; duplicates count."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])), 1, 8), 16, 10).cast("bigint")
    return df.agg(F.count("*").alias("n"), F.sum(h).alias("checksum"))


def check_budget(df: DataFrame, column: str, total: float) -> DataFrame:
    s = F.sum(column)
    return df.agg(F.round(s, 2).alias("total"), (F.abs(s - total) < 0.005).alias("ok"))
