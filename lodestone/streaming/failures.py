"""Runs of consecutive failures, counted by a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Microseconds of an hour.
HOUR = 3_600_000_000
OUT = "key string, seen long, trailing_failures long, longest_run long, in_error boolean"
#: Conditions of the session: state that has variables and timers of its own.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def fold(trailing: int, longest: int, oks: list[bool]) -> tuple[int, int]:
    """The counters after these outcomes."""
    for ok in oks:
        trailing = 0 if ok else trailing + 1
        longest = max(longest, trailing)
    return trailing, longest


class FailureRuns(StatefulProcessor):
    """Counters of one key. Rows that the watermark may still overtake wait in the state by hour, and a timer folds the hours that are over.

    Every batch gives the counters as of all rows seen, those that wait in their order; a late row within the watermark so
    finds its place. State is four numbers and the rows of the watermark's span.
    """

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "seen long, trailing long, longest long, timer long")
        self.waiting = handle.getMapState("waiting", "hour long", "us array<long>, tie array<long>, ok array<boolean>")

    def _settled(self) -> tuple[int, int, int, int]:
        """Rows, both counters, and when the key's one timer is due (0: none is set)."""
        return tuple(self.settled.get()) if self.settled.exists() else (0, 0, 0, 0)

    def _waiting(self) -> dict[int, list[tuple[int, int, bool]]]:
        return {hour: list(zip(*rows, strict=True)) for (hour,), rows in self.waiting.iterator()}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, new = self._waiting(), set()
        for batch in rows:
            for row in zip(batch["us"].tolist(), batch["tie"].tolist(), batch["ok"].tolist(), strict=True):
                hour = row[0] // HOUR
                held.setdefault(hour, []).append(row)
                new.add(hour)
        for hour in new:
            self.waiting.updateValue((hour,), tuple(map(list, zip(*held[hour], strict=True))))
        seen, trailing, longest, timer = self._settled()
        due = (min(held) + 1) * HOUR // 1000
        if not timer or due < timer:
            self.handle.registerTimer(due)
            self.settled.update((seen, trailing, longest, due))
        trailing, longest = fold(trailing, longest, [ok for hour in sorted(held) for *_, ok in sorted(held[hour])])
        seen += sum(map(len, held.values()))
        yield pd.DataFrame({"key": [key[0]], "seen": [seen], "trailing_failures": [trailing], "longest_run": [longest], "in_error": [trailing >= self.limit]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000 // HOUR
        seen, trailing, longest, timer = self._settled()
        held = self._waiting()
        for hour in sorted(h for h in held if h < over):
            rows = held.pop(hour)
            trailing, longest = fold(trailing, longest, [ok for *_, ok in sorted(rows)])
            seen += len(rows)
            self.waiting.removeKey((hour,))
        if expiredTimerInfo.getExpiryTimeInMs() >= timer:  # else one that a late row has set: the other is still to come
            timer = (min(held) + 1) * HOUR // 1000 if held else 0
            if timer:
                self.handle.registerTimer(timer)
        self.settled.update((seen, trailing, longest, timer))
        yield from ()

    def close(self) -> None:
        pass


def failure_stream(stream: DataFrame, key: str, ts: str, tie: str, ok: str, limit: int, watermark: str = "1 day") -> DataFrame:
    """(key, seen, trailing_failures, longest_run, in_error): a row for each key and batch that brings it rows, in update mode.

    Rows are counted by (ts, tie, a whole number that is unique at a time), however they arrive within the watermark; later
    ones are dropped, as streams do. `seen` only grows, so a key's row of the greatest `seen` is its latest. Needs the state
    store named in STORE. A null key is no key; a null outcome is a failure.
    """
    rows = stream.filter(F.col(key).isNotNull()).withWatermark(ts, watermark)
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(ts), F.unix_micros(F.col(ts)).alias("us"), F.col(tie).cast("long").alias("tie"), F.coalesce(F.col(ok), F.lit(False)).alias("ok"))
    return rows.groupBy("key").transformWithStateInPandas(FailureRuns(limit), OUT, outputMode="Update", timeMode="EventTime")


def latest(rows: DataFrame) -> DataFrame:
    """Of the rows that :func:`failure_stream` gave so far, each key's last."""
    return rows.groupBy("key").agg(F.max_by(F.struct("trailing_failures", "longest_run", "in_error"), "seen").alias("r")).select("key", "r.*")
