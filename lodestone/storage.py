"""Tables in the folder that driver and executors share: they cut lineage, and outlive a lost executor."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The tables that the innermost :func:`scope` has seen written.
_WRITTEN: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One is made only in local mode, where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
    return jsc.getCheckpointDir().get()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there, so a lost executor costs one stage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    if (seen := _WRITTEN.get()) is not None:
        seen.append(out)
    return out


def release(*frames: DataFrame) -> None:
    """Delete what :func:`materialize` wrote, once nothing that is still to be computed reads it."""
    for df in frames:
        if path := getattr(df, "_lodestone_path", None):
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scope() -> Iterator[None]:
    """Delete at the end all tables that operators wrote inside; results have to be computed (written, counted) by then."""
    seen: list[DataFrame] = []
    token = _WRITTEN.set(seen)
    try:
        yield
    finally:
        _WRITTEN.reset(token)
        release(*seen)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """What is written inside goes to Python in batches of at most `rows` rows, so that long rows don't add up."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)
