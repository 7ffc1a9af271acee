"""Incremental refresh: micro-batches append fold states, readers fold them.

A micro-batch costs what its own rows cost: it writes the partial fold of its
observations as one folder, ``batch=<id>``. Rewriting that folder on a retry gives
the same files, so a lost executor or driver changes nothing. The fold is
associative, so any split into batches gives the table one batch would give.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plotmerge.operators import consolidate as C
from plotmerge.operators import refresh as R
from plotmerge.operators.frontier import KEYS, flag_known
from plotmerge.operators.known import KnownUrls, stored_urls
from plotmerge.sources.registry import SOURCES, SourceSpec
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_pages(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000):
    """Landed files as a stream. The path is a folder, or one file."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    # A pattern that fits this one name: a plain path has to be a folder.
    return stream.parquet(f"{path[:-1]}[{path[-1]}]")


def _folder(checkpoint: str, batch_id: int | str) -> str:
    """Folder of a micro-batch. It names its checkpoint too, so a new checkpoint, which
    counts from 0 again, never writes over what an earlier one has left."""
    return f"batch=r{hashlib.md5(checkpoint.encode()).hexdigest()[:8]}-{batch_id}"


def _append(df: DataFrame, base: str, folder: str) -> None:
    df.write.mode("overwrite").parquet(f"{base}/{folder}")


def fold_stream(
    stream: DataFrame, log: str, checkpoint: str, order: str = "ord"
) -> StreamingQuery:
    """Fold a stream of observations into the state log at ``log``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        _append(C.fold(C.lift(batch, order)), log, _folder(checkpoint, batch_id))

    return _run(stream, step, checkpoint)


def folded(spark: SparkSession, log: str) -> DataFrame:
    """The state of everything in the log: one row per fingerprint."""
    return C.fold(spark.read.parquet(log).drop("batch"))


def current(spark: SparkSession, log: str, run_ts: Column) -> DataFrame:
    """Canonical rows of everything in the log."""
    return C.finish(folded(spark, log), run_ts)


def compact(spark: SparkSession, log: str, target: str) -> None:
    """Write the folded log as the first folder of a new log."""
    _append(folded(spark, log), target, "batch=compacted")


def compact_refresh(spark: SparkSession, base: str, target: str) -> None:
    """Write all outputs of ``refresh_stream`` below a new base, each as one folder."""
    compact(spark, f"{base}/listings", f"{target}/listings")
    sources = spark.read.parquet(f"{base}/sources").drop("batch")
    _append(_earliest(sources), f"{target}/sources", "batch=compacted")
    KnownUrls(spark, f"{target}/known").add(
        _urls(spark.read.parquet(f"{target}/sources/batch=compacted")), "batch=compacted"
    )
    for name in ("checked", "failures"):
        _append(spark.read.parquet(f"{base}/{name}").drop("batch"), f"{target}/{name}", "batch=compacted")


def refresh_stream(
    pages: DataFrame,
    base: str,
    checkpoint: str,
    run_ts: Column,
    skip_known: bool = True,
    known: DataFrame | None = None,
    specs: Mapping[str, SourceSpec] = SOURCES,
    fingerprint_mode: str = "md5",
) -> StreamingQuery:
    """Refresh from a stream of landed pages.

    Below ``base``: ``checked`` (parsed rows), ``listings`` (fold states), ``sources``
    (source rows with their order), ``failures`` (pages without a usable row) and ``known``
    (the index of stored URLs). Known pages are told by their URL columns and not parsed: those of earlier
    micro-batches, and those of a store from before the stream (``known``: source_name,
    source_url). ``compact_refresh`` keeps the number of folders small.
    """
    spark = pages.sparkSession
    index = KnownUrls(spark, f"{base}/known")

    def step(batch: DataFrame, batch_id: int) -> None:
        folder = _folder(checkpoint, batch_id)
        if skip_known:
            landed = batch.select("source_name", F.col("source_url").alias("url"))
            # A retry must not see what its own first attempt has written.
            flagged = index.flag(landed, but=folder)
            if known is not None:
                before = flag_known(landed.distinct(), known.select("source_name", "source_url"))
                before = before.where("known").withColumnRenamed("known", "_before")
                flagged = flagged.join(before, KEYS, "left").withColumn(
                    "known", F.col("known") | F.col("_before").isNotNull()
                ).drop("_before")
            batch, _ = R.split_known(batch, flagged)
        _append(R.observations(batch, run_ts, specs, fingerprint_mode), f"{base}/checked", folder)
        checked = spark.read.parquet(f"{base}/checked/{folder}")
        good = R.usable(checked)
        _append(R.failures(checked), f"{base}/failures", folder)
        _append(C.fold(C.lift(good, "ord")), f"{base}/listings", folder)
        _append(_earliest(R.page_sources(good)), f"{base}/sources", folder)
        index.add(_urls(spark.read.parquet(f"{base}/sources/{folder}")), folder)

    return _run(pages, step, checkpoint)


def _urls(sources: DataFrame) -> DataFrame:
    """URLs of stored sources, as declared and as discovered."""
    return stored_urls(sources.select("source_name", "source_url", F.col("ord.ref_url").alias("ref_url")))


def _earliest(rows: DataFrame) -> DataFrame:
    """Earliest source row of each source advert, with its order."""
    value = [c for c in rows.columns if c not in (C.KEY, *C.SOURCE_KEY, "ord")]
    return (
        rows.groupBy(C.KEY, *C.SOURCE_KEY)
        .agg(F.min(F.struct("ord", *value)).alias("s"))
        .select(C.KEY, *C.SOURCE_KEY, "s.*")
    )


def current_sources(spark: SparkSession, base: str) -> DataFrame:
    return C.merge_sources(spark.read.parquet(f"{base}/sources").drop("batch"))


def _run(
    stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def continuous_state(stream: DataFrame, order: str = "ord") -> DataFrame:
    """The fold as a streaming aggregation, for ``complete`` or ``update`` output.

    Its state has one entry per fingerprint for good, since any later row may
    still fill a gap; ``fold_stream`` keeps that state in files instead.
    """
    return C.fold(C.lift(stream, order))


def new_urls(frontier: DataFrame) -> DataFrame:
    """First sighting of each (source, URL) of a stream; one state entry per URL."""
    return frontier.dropDuplicates(KEYS)


def write_new_urls(frontier: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write first sightings; the state lies in RocksDB and its changes in the checkpoint.

    A restart goes on from the checkpoint and writes no URL twice.
    """
    frontier.sparkSession.conf.set(STATE_STORE, ROCKS_DB)
    return (
        new_urls(frontier).writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def new_urls_within(frontier: DataFrame, at: str, horizon: str) -> DataFrame:
    """The same with state dropped after ``horizon``; later repeats pass again."""
    return frontier.withWatermark(at, horizon).dropDuplicatesWithinWatermark(KEYS)
