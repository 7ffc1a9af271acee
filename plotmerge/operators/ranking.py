"""Row numbers for groups of any size.

A plain ``row_number()`` puts a whole group into one task. ``row_numbers`` cuts an integer
order into fixed-width buckets: rows are counted per (group, bucket), the counts are summed
up along the buckets of a group, and only the rows inside one bucket are numbered by a
window. Where the counts show a bucket too large for a task (many rows share an order value,
or lie close), the rows are numbered by ``positions`` instead, which splits by the tie columns
too. Either way the numbers are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotmerge.session import materialize, tasks_for

DEFAULT_WIDTH = 1_000_000
#: Rows of one bucket that a window numbers in one task.
MOST = 2_000_000


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Rows dealt by keys to so many tasks, or left to Spark."""
    return df if tasks is None else df.repartition(tasks, *keys)


def place(df: DataFrame, keys: list[str], order: list[str], tasks: int | None = None) -> DataFrame:
    """Rows range-sorted by key and order, stored with the partition they lie in and their place.

    Rows of a key lie in order in ``_at``, without a gap inside a ``_part``. A key may spread over many.
    """
    columns = [F.col(c) for c in (*keys, *order)]
    ranged = df.repartitionByRange(*columns) if tasks is None else df.repartitionByRange(tasks, *columns)
    placed = ranged.sortWithinPartitions(*columns).withColumn("_at", F.monotonically_increasing_id())
    return materialize(placed, "positions").withColumn("_part", F.shiftright("_at", 33))


def positions(
    df: DataFrame, keys: list[str], order: list[str], out: str = "pos", tasks: int | None = None
) -> DataFrame:
    """Number the rows of each key by ``order``, from 1; any types, ties and gaps.

    Rows are range-sorted by key and order and stored with their place. A key may spread
    over many partitions: the number of a row is its place plus an offset for its
    (partition, key), summed up along the partitions that the key lies in. ``tasks``
    is into how many the rows are sorted and joined, if not as Spark's settings say.
    """
    placed = place(df, keys, order, tasks)
    runs = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_part")
    runs = runs.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col("_part").alias("_run"),
        (F.sum("_n").over(upto) - F.col("_n") - F.col("_first") + 1).alias("_shift"),
    )
    same = F.col("_part") == F.col("_run")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return dealt(placed, tasks, *keys, "_part").join(runs, same).withColumn(out, F.col("_at") + F.col("_shift")).drop(
        "_at", "_part", "_run", "_shift", *[f"_key_{k}" for k in keys]
    )


def row_numbers(
    df: DataFrame,
    keys: list[str],
    order: str,
    out: str = "rn",
    width: int = DEFAULT_WIDTH,
    at_most: int | None = None,
    ties: tuple[str, ...] = (),
    most: int = MOST,
) -> DataFrame:
    """Number the rows of each key by the integer column ``order``, from 1.

    ``ties`` are further columns to order by where ``order`` is equal. The input is
    read twice, once for two columns; hand over a stored table if it is costly.

    With ``at_most`` only the first so many rows of each key are kept; buckets
    behind the limit are dropped before any row of theirs is shuffled for ranking.
    Rows that agree in the order and all ties are numbered in any order.
    """
    bucketed = df.withColumn("_bucket", F.col(order) - F.pmod(F.col(order), F.lit(width)))
    sizes = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    offsets = sizes.withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).drop("_n")
    if at_most is not None:
        offsets = offsets.where(F.col("_before") < at_most)
    # The group key may be NULL (a URL without host); such rows form a group too.
    offsets = offsets.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_bucket").alias("_at"), "_before"
    )
    same = F.col("_bucket") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    largest, rows = sizes.agg(F.max("_n"), F.sum("_n")).first()
    if (largest or 0) > most:
        kept = bucketed.join(offsets, same, "left_semi") if at_most is not None else bucketed
        ranked = positions(kept.drop("_bucket"), keys, [order, *ties], out, tasks_for(df.sparkSession, rows))
        return ranked if at_most is None else ranked.where(F.col(out) <= at_most)
    joined = bucketed.join(offsets, same).drop("_at", *[f"_key_{k}" for k in keys])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order, *ties)
    ranked = joined.withColumn(out, F.col("_before") + F.row_number().over(inside))
    if at_most is not None:
        ranked = ranked.where(F.col(out) <= at_most)
    return ranked.drop("_bucket", "_before")
