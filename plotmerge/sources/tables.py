"""Stored datasets: versioned writes, key/value records, reads.

A table version is a folder that is written once and never changed. The record
of the current version is a key/value row, appended after the write succeeded,
so a lost job leaves the former version current.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotmerge.schemas import META, align, empty


#: Buckets of a new bucketed table; at least a few per executor core on a cluster.
BUCKETS = 64
#: Tasks that write a bucket's rows, so that few buckets keep all cores at work.
WRITERS = 4
MANIFEST = "bucket int, folder string, buckets int"


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The dataset in the wanted schema; an empty one if nothing is there yet."""
    try:
        found = spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return empty(spark, schema)
    return align(found, schema)


def put_meta(spark: SparkSession, path: str, key: str, value: str, at: datetime) -> None:
    spark.createDataFrame([(key, value, at)], META).write.mode("append").parquet(path)


def latest_meta(meta: DataFrame) -> DataFrame:
    """Last written value of each key."""
    return meta.groupBy("key").agg(
        F.max(F.struct("at", "value")).alias("m")
    ).select("key", F.col("m.value").alias("value"), F.col("m.at").alias("at"))


def get_meta(spark: SparkSession, path: str, key: str) -> str | None:
    row = latest_meta(read_or_empty(spark, path, META).where(F.col("key") == key)).first()
    return row["value"] if row else None


class WriteConflict(Exception):
    """Another writer made a version while this one was written."""


class VersionedTable:
    """A dataset whose versions are folders below one base path.

    Every write has a folder of its own, so writers never touch each other's files. A
    version counts from when its record is there; the record names the folder.
    """

    def __init__(self, spark: SparkSession, base: str, name: str, schema: T.StructType):
        self.spark, self.base, self.name, self.schema = spark, base.rstrip("/"), name, schema

    @property
    def _meta(self) -> str:
        return f"{self.base}/meta"

    def _current(self) -> tuple[int, str]:
        number, _, folder = (get_meta(self.spark, self._meta, f"{self.name}.version") or "0").partition(" ")
        return int(number), folder or f"v={number}"

    def version(self) -> int:
        return self._current()[0]

    def path(self) -> str:
        """Folder of the current version."""
        return f"{self.base}/{self.name}/{self._current()[1]}"

    def read(self) -> DataFrame:
        return read_or_empty(self.spark, self.path(), self.schema)

    def write(self, df: DataFrame, at: datetime, cluster_by: tuple[str, ...] = ()) -> int:
        """Write the next version and make it current.

        ``cluster_by`` range-partitions and sorts the files, so a filter on those
        columns skips files; end it with a unique column to split hot values. If the
        version has moved meanwhile, nothing is recorded and ``WriteConflict`` is raised.
        """
        before = self._current()
        new = before[0] + 1
        folder = f"v={new}-{uuid.uuid4().hex[:12]}"
        out = align(df, self.schema)
        if cluster_by:
            out = out.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
        out.write.parquet(f"{self.base}/{self.name}/{folder}")
        self._record(before, new, folder, at)
        return new

    def _record(self, before: tuple[int, str], new: int, folder: str, at: datetime) -> None:
        if self._current() != before:
            raise WriteConflict(f"{self.name}: version {before[0]} is no longer the current one")
        put_meta(self.spark, self._meta, f"{self.name}.version", f"{new} {folder}", at)


class BucketedTable(VersionedTable):
    """A dataset hash-bucketed by a key; an update writes only the buckets it touches.

    A version is a list of which folder holds each bucket (its manifest). An update reads the
    buckets of the changed keys, merges, writes them into a folder of its own, and the next
    manifest names that folder for them and the former ones for the rest. What it costs follows
    the changed keys and the size of a bucket, not the size of the table. ``buckets`` counts when
    a table is made; later the manifest's number holds.
    """

    def __init__(
        self, spark: SparkSession, base: str, name: str, schema: T.StructType, key: str,
        buckets: int = BUCKETS,
    ):
        super().__init__(spark, base, name, schema)
        self.key, self._buckets = key, buckets

    def path(self) -> str:
        """Manifest of the current version."""
        return self._manifest_path(self._current()[1])

    def _manifest_path(self, folder: str) -> str:
        return f"{self.base}/{self.name}-manifest/{folder}"

    def manifest(self) -> dict[int, str]:
        """Folder of each bucket that has rows."""
        return self._manifest(self._current())

    def _manifest(self, current: tuple[int, str]) -> dict[int, str]:
        if not current[0]:
            return {}
        rows = self.spark.read.schema(MANIFEST).parquet(self._manifest_path(current[1])).collect()
        self._buckets = rows[0]["buckets"]
        return {r["bucket"]: r["folder"] for r in rows if r["folder"] is not None}

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self._buckets)).cast("int")

    def _read(self, manifest: dict[int, str], buckets: Iterable[int]) -> DataFrame:
        paths = [
            f"{self.base}/{self.name}/{manifest[b]}/bucket={b}" for b in sorted(buckets) if b in manifest
        ]
        if not paths:
            return empty(self.spark, self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        manifest = self.manifest()
        return self._read(manifest, manifest)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of these keys; at most as many numbers as there are buckets."""
        rows = keys.select(self.bucket_of(F.col(self.key)).alias("bucket")).distinct().collect()
        return sorted(r["bucket"] for r in rows)

    def read_for(self, keys: DataFrame) -> DataFrame:
        """The stored rows of all buckets that hold one of the keys."""
        manifest = self.manifest()
        return self._read(manifest, self.touched(keys))

    def update(
        self, changed: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], at: datetime
    ) -> int:
        """Make ``merge(stored, changed)`` current in the buckets of the changed keys.

        ``merge`` gets the stored rows of these buckets and returns all rows that are to be
        there; rows of other buckets are refused by a check. ``changed`` is read twice. If the
        version has moved meanwhile, nothing is recorded and ``WriteConflict`` is raised.
        """
        before = self._current()
        manifest = self._manifest(before)
        touched = self.touched(changed)
        if not touched:
            return before[0]
        new = before[0] + 1
        folder = f"v={new}-{uuid.uuid4().hex[:12]}"
        target = f"{self.base}/{self.name}/{folder}"
        out = align(merge(self._read(manifest, touched), changed), self.schema)
        writer = F.pmod(F.xxhash64(self.key, F.lit(1)), F.lit(WRITERS))
        out.withColumn("bucket", self.bucket_of(F.col(self.key))).repartition("bucket", writer).write.partitionBy(
            "bucket"
        ).parquet(target)
        written = {
            r["bucket"] for r in self.spark.read.schema("bucket int").parquet(target).distinct().collect()
        }
        if not written <= set(touched):
            raise ValueError(f"{self.name}: the merge gave rows outside the buckets of the changed keys")
        manifest = {b: f for b, f in manifest.items() if b not in touched}
        manifest |= dict.fromkeys(written, folder)
        rows = [(b, f, self._buckets) for b, f in sorted(manifest.items())] or [(0, None, self._buckets)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(self._manifest_path(folder))
        self._record(before, new, folder, at)
        return new

    def upsert(self, changed: DataFrame, at: datetime) -> int:
        """Put rows in place by key."""

        def merge(stored: DataFrame, rows: DataFrame) -> DataFrame:
            kept = stored.join(rows.select(self.key), self.key, "left_anti").select(stored.columns)
            return kept.unionByName(align(rows, self.schema))

        return self.update(changed, merge, at)

    def write(self, df: DataFrame, at: datetime, cluster_by: tuple[str, ...] = ()) -> int:
        raise TypeError("a bucketed table is written by update or upsert")


def write_pages(pages: DataFrame, path: str) -> None:
    """Land raw pages by source, so that one source can be read alone."""
    pages.write.mode("append").partitionBy("source_name").parquet(path)
