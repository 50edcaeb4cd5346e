"""Streams that are stopped, started again and fed late or repeated rows."""

from __future__ import annotations

import datetime
import glob
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lodestone.operators import monitor as mo
from lodestone.streaming import failures
from lodestone.streaming.ingest import HashTable, content_key, ingest_stream

OUTCOMES = "k string, at timestamp, tie long, ok boolean"


def test_hundred_batches_stay_few_files(spark, tmp_path):
    table, r, want = HashTable(spark, str(tmp_path / "t")), random.Random(4), {}
    batch = lambda ids: content_key(spark.createDataFrame([(i, None, f"title {i}") for i in ids], "s long, l string, t string"), "s", "l", "t").coalesce(1)
    for epoch in range(100):
        ids = [r.randint(0, 600) for _ in range(6)] if epoch != 50 else list(range(400, 2_000))
        for i in ids:
            want.setdefault(i, epoch)
        table.add(batch(ids), epoch)
        if epoch in (3, 40):
            table.add(batch(ids), epoch)  # as after a failure
    got = [x.s for x in table.read().collect()]
    assert sorted(got) == sorted(want)
    assert len(table.runs()) <= 3 * 8 and len(glob.glob(f"{tmp_path}/t/run-*/*.parquet")) <= 60
    for folder in glob.glob(f"{tmp_path}/t/run-*"):
        ranges = []
        for f in glob.glob(f"{folder}/*.parquet"):
            column = pq.ParquetFile(f).read(["content_hash"]).column(0).to_pylist()
            assert column == sorted(column)
            ranges += [(column[0], column[-1])] if column else []
        ranges.sort()
        assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_each_hash_once_over_restarts(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    for n in range(4):
        rows = [(at(40 * n + i), i % 7, None, f"t{(i + n) % 9}") for i in range(30)]
        content_key(spark.createDataFrame(rows, "ts timestamp, s long, l string, t string"), "s", "l", "t").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("ts timestamp, s long, l string, t string, content_hash string").parquet(str(tmp_path / "in"))
        ingest_stream(stream, str(tmp_path / "t"), str(tmp_path / "c"), "ts").awaitTermination()
    out = HashTable(spark, str(tmp_path / "t")).read()
    assert out.count() == out.select("content_hash").distinct().count() == spark.read.parquet(str(tmp_path / "in")).select("content_hash").distinct().count()


def test_failure_runs_of_a_stream_equal_the_batch(spark, tmp_path):
    r, start = random.Random(7), datetime.datetime(2024, 1, 1)
    rows = [(r.choice("abc"), start + datetime.timedelta(minutes=30 * i + r.randint(0, 90)), i, r.random() < 0.4 if i % 50 else None) for i in range(600)]
    before = spark.conf.get(failures.STORE[0])
    spark.conf.set(*failures.STORE)
    try:
        for n in range(3):  # each part starts before the last one ends
            part = [x for x in rows if n * 200 <= x[2] < (n + 1) * 200] + ([(None, start, -1, True)] if n == 0 else [])
            spark.createDataFrame(part, OUTCOMES).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
            out = failures.failure_stream(spark.readStream.schema(OUTCOMES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "k", "at", "tie", "ok", 3, "12 days")
            save = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/epoch={epoch}")
            out.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(failures.STORE[0], before)
    got = {x.key: (x.trailing_failures, x.longest_run, x.in_error) for x in failures.latest(spark.read.parquet(str(tmp_path / "out"))).collect()}
    batch = spark.createDataFrame(rows, OUTCOMES).withColumn("ok", F.coalesce("ok", F.lit(False)))
    assert got == {x.k: (x.trailing_failures, x.longest_run, x.in_error) for x in mo.failure_runs(batch, "k", ["at", "tie"], "ok", 3).collect()}
