"""Session defaults and the shared folder for written intermediates."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from functools import cache
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Duplicate keys in page JSON: the last one counts, the block is not lost.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


SHIPPED = "plotmerge.shipped"


@cache
def packaged() -> str:
    """This package as a zip file on the driver's disk, from where Spark hands it out."""
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="plotmerge-py-")) / package.name
    return shutil.make_archive(str(target), "zip", package.parent, package.name)


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators rely on, and hand the package to the Python workers."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    if spark.conf.get(SHIPPED, None) != packaged():
        try:
            spark.sparkContext.addPyFile(packaged())
        except PySparkException:  # a remote session has no context
            spark.addArtifacts(packaged(), pyfile=True)
        spark.conf.set(SHIPPED, packaged())
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plotmerge")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tasks_for(spark: SparkSession, rows: int, a_task: int = 250_000) -> int | None:
    """Tasks that hold so many rows; None where one for each core does, as Spark coalesces its own to so few."""
    n = -(-rows // a_task)
    return None if n <= spark.sparkContext.defaultParallelism else n


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the cluster's shared checkpoint folder.

    Where the session names no folder, a local master (tests, a laptop) gets a temporary
    one, kept as its setting; a cluster is refused, as its executors would not see it.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="plotmerge-")
        spark.conf.set(CHECKPOINT_DIR, base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate that several plans read, and read it back."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
