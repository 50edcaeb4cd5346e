"""Structured Streaming forms of the incremental jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def content_key(df: DataFrame, source: str, link: str, title: str) -> DataFrame:
    """`content_hash` of source and link, or title where there is no link."""
    return df.withColumn("content_hash", F.sha2(F.concat_ws("|", F.col(source).cast("string"), F.coalesce(F.col(link), F.col(title))), 256))


#: Runs of one level that are merged into one of the next; bytes of a row group; hashes of a batch that are looked up one by one.
FAN, GROUP_BYTES, LISTED = 8, 1 << 20, 1_000


class HashTable:
    """A Parquet table that holds each content hash once, as a few runs that are sorted by hash.

    A batch adds a run of its own, named by level and epochs. Once FAN runs of a level are there, they are merged into one of
    the next, so runs grow with the logarithm of the batches and files stay few. A run's row groups are small, span ranges
    of the hash that don't overlap, and have Bloom filters: a hash is looked up in one row group a run at most, and mostly in
    none. What a batch reads so follows its own rows, not the table's.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def runs(self) -> list[tuple[int, int, int]]:
        """(level, first epoch, last epoch) of the finished runs, without those that a merged one has taken up."""
        if not self.fs.exists(self._at("")):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self._at(""))]
        all_ = sorted(tuple(map(int, n.split("-")[1:])) for n in names if n.startswith("run-") and self.fs.exists(self._at(f"{n}/_SUCCESS")))
        return [r for r in all_ if not any(o != r and o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in all_)]

    def _name(self, run: tuple[int, int, int]) -> str:
        return "run-{}-{}-{}".format(*run)

    def read(self, runs: list[tuple[int, int, int]] | None = None) -> DataFrame | None:
        """The rows; None before the first batch."""
        runs = self.runs() if runs is None else runs
        return self.spark.read.parquet(*[f"{self.path}/{self._name(r)}" for r in runs]) if runs else None

    def _write(self, rows: DataFrame, run: tuple[int, int, int]) -> None:
        out = rows.sortWithinPartitions("content_hash").write.mode("overwrite").option("parquet.block.size", GROUP_BYTES)
        out.option("parquet.bloom.filter.enabled#content_hash", "true").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/{self._name(run)}")

    def unseen(self, rows: DataFrame, runs: list[tuple[int, int, int]]) -> DataFrame:
        """The rows whose hash none of the runs has."""
        table = self.read(runs)
        if table is None:
            return rows
        listed = [r[0] for r in rows.select("content_hash").limit(LISTED + 1).collect()]
        if len(listed) <= LISTED:  # a few hashes are pushed down to the row groups that may have them
            before = self.spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold")
            self.spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", LISTED)
            try:
                found = [r[0] for r in table.select("content_hash").filter(F.col("content_hash").isin(listed)).collect()]
            finally:
                self.spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", before)
            return rows.filter(~F.col("content_hash").isin(found)) if found else rows
        return rows.join(table.select("content_hash"), "content_hash", "left_anti")

    def add(self, batch: DataFrame, epoch: int) -> None:
        """Store the batch's new hashes. A batch that comes again after a failure replaces its run, or changes nothing if that was merged."""
        runs = self.runs()
        if any(r[0] > 0 and r[1] <= epoch <= r[2] for r in runs):
            return
        runs = [r for r in runs if r != (0, epoch, epoch)]
        batch = batch.dropDuplicates(["content_hash"]).persist()  # one batch, read three times
        try:
            few = batch.limit(LISTED + 1).count() <= LISTED
            new = self.unseen(batch, runs)
            self._write(new.coalesce(1) if few else new.repartitionByRange("content_hash"), (0, epoch, epoch))
        finally:
            batch.unpersist()
        self.merge()

    def merge(self) -> None:
        while True:
            runs = self.runs()
            level = next((k for k in sorted({r[0] for r in runs}) if sum(r[0] == k for r in runs) >= FAN), None)
            if level is None:
                break
            old = [r for r in runs if r[0] == level]
            rows = self.read(old)
            self._write(rows.repartitionByRange("content_hash"), (level + 1, old[0][1], old[-1][2]))
        live = {self._name(r) for r in self.runs()}
        for f in self.fs.listStatus(self._at("")):
            if f.getPath().getName() not in live:
                self.fs.delete(f.getPath(), True)


def ingest_stream(stream: DataFrame, target: str, checkpoint: str, ts: str, watermark: str = "10 minutes") -> StreamingQuery:
    """Append each content hash once to the :class:`HashTable` `target`.

    Repeats within the watermark are dropped by state; later ones are looked up in the table, and a batch that is replayed
    after a failure replaces its own run. So every hash is stored once.
    """
    unique = stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["content_hash"])

    def write(batch: DataFrame, epoch: int) -> None:
        HashTable(batch.sparkSession, target).add(batch, epoch)

    return unique.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trailing_stream(stream: DataFrame, ts: str, key: str, window: str = "24 hours", slide: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """(start, end, key, n) in sliding event-time windows; late rows within the watermark still count."""
    g = stream.withWatermark(ts, watermark).groupBy(F.window(ts, window, slide), key).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")
