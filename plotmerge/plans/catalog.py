"""Registry of the queries: name, Spark function, comparison SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plotmerge.session import tasks_for


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}

#: Rows of a table that one task sorts, groups or joins.
ROWS_A_TASK = 250_000


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``, with the SQL it must agree with."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = Query(name, run, sql)
        return fn

    return register


class Tables:
    """The given tables, read on demand, and the inputs derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def spread(self, name: str) -> DataFrame:
        """A table to compute much on per row.

        The given files are single and small, which is one task; their rows are
        dealt out to all cores. A table of as many splits as cores is left alone.
        """
        df, cores = getattr(self, name), self.spark.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)

    def tasks(self, name: str) -> int | None:
        """Tasks for the rows of a table (from the footers of its files); None: Spark's own."""
        return tasks_for(self.spark, getattr(self, name).count(), ROWS_A_TASK)

    def dealt(self, df: DataFrame, table: str, *keys: str) -> DataFrame:
        """``df``, with about as many rows as the table, dealt by keys that nearly every row has alone.

        The tasks grow in number with the table's rows (from the footers of its files), so
        that a task's hash maps and sorts do not grow. Where a task for each core is
        enough, the rows stay where they are.
        """
        n = self.tasks(table)
        return df if n is None else df.repartition(n, *keys)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))
