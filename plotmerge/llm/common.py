"""What several operators share: stored intermediates, exact ranks, connected components."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotmerge.session import materialize


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate to the shared folder and read it back."""
    return materialize(df, f"llm-{name}")


def whole_text(column: str = "text") -> Column:
    """A text column in which null is the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, for a helper beside the given columns."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def partitions(rows: int, per_partition: int) -> int:
    """How many partitions of at most so many rows hold them all."""
    return max(1, ceil(rows / per_partition))


def rank_in_class(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number the rows of each class from 0 in the order of a seeded hash column ``_h``.

    Rows are range-sorted by (keys, ``_h``) and stored with their partition and place.
    A class may spread over many partitions, so none is ever in one task: the number
    of a row is its place plus an offset for its (partition, class) run, and there are
    at most partitions + classes of these runs. ``keys`` may hold nulls.
    """
    order = [F.col(k) for k in keys] + [F.col("_h")]
    placed = stored(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        name,
    )
    part = F.shiftright("_at", 33).alias("_part")
    runs = placed.groupBy(*keys, part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_part")
    before = F.sum("_n").over(upto) - F.col("_n")
    runs = runs.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"),
        (before - F.col("_first")).alias("_shift"),
    )
    same = F.shiftright("_at", 33) == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = placed.join(runs, same, "left")
    return joined.withColumn("_rank", F.col("_at") + F.col("_shift")).drop(
        "_at", "_p", "_shift", *[f"_k_{k}" for k in keys]
    )


def _size(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of an undirected graph, as (u, v): v the smallest node u reaches.

    ``edges`` has columns u and v of one orderable type; nodes without an edge, and the
    smallest node of each component, have no row. Distributed union by alternating stars:
    every node hangs its larger neighbours, then its smaller ones, on its smallest
    neighbour, until nothing moves. Minima are aggregated before the shuffle and each
    round is written to the shared folder, so neither a hub nor a lost executor matters.
    """
    def larger_first(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(
            F.col("u") != F.col("v")
        ).distinct()

    e = stored(larger_first(edges), f"{name}-edges")
    before = _size(e)
    while before[0]:
        both = e.union(e.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("c"), F.least("u", "m").alias("m")
        )
        large = both.join(lowest, F.col("u") == F.col("c")).where(F.col("v") > F.col("u"))
        e1 = stored(larger_first(large.select(F.col("v").alias("u"), F.col("m").alias("v"))),
                    f"{name}-large")
        low = e1.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = e1.join(low, F.col("u") == F.col("c")).select("v", "m").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).union(low.select(F.col("c").alias("u"), F.col("m").alias("v")))
        e = stored(larger_first(small), f"{name}-small")
        now = _size(e)
        if now == before:
            break
        before = now
    return e
