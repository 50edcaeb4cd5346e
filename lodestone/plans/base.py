"""Registry of queries, and fixture views: SQL text that both Spark and DuckDB run over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

Query = Callable[["Data"], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, tuple[str, tuple[str, ...]]] = {}


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Register a function of Data under its name; `sql` is its oracle, with `views` as common table expressions."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (sql, views)
        return f

    return add


#: name -> (SQL, views it reads)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {}


def view(name: str, sql: str, *reads: str) -> None:
    VIEWS[name] = (sql, reads)


def _closure(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        for x in [*_closure(VIEWS[n][1]), n]:
            if x not in out:
                out.append(x)
    return out


def with_views(sql: str, *views: str) -> str:
    """`sql` behind the WITH clause of the views it names; a WITH of its own is merged."""
    names = _closure(views)
    if not names:
        return sql
    head = ",\n".join(f"{n} AS ({VIEWS[n][0]})" for n in names)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


class Data:
    """The tables of one scale factor, and the fixture views over them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}", name)
        raise AttributeError(name)

    def sql(self, text: str, *views: str) -> DataFrame:
        """Run SQL over tables and views without registering anything in the session's catalog."""
        import re

        text = with_views(text, *views)
        used = {t: getattr(self, t) for t in TABLES if re.search(rf"(?i)\b(?:from|join)\s+{t}\b", text)}
        text = text.replace("{", "{{").replace("}", "}}")  # what is left in braces are the tables
        for t in used:
            text = re.sub(rf"(?i)\b(from|join)(\s+){t}\b", rf"\1\2{{{t}}}", text)
        return self.spark.sql(text, **used)


def adapt(f: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Data(spark, sf_dir))
