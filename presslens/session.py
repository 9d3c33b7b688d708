"""Session defaults, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores: str | int = 8, memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("presslens")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder of this
    machine: on a cluster other executors could not read it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if path is None:
        path = sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="presslens-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for files a job writes and reads back."""
    return f"{shared_dir(spark).rstrip('/')}/presslens-{uuid.uuid4().hex}/{name}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete files under a ``scratch_path`` that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from there.

    Used where a plan reads an expensive or order-sensitive result twice. The
    copy outlives lost executors.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def few_rows(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """``df`` written once, and marked for broadcast if it was counted to be small (one row per label, say)."""
    kept = cut(df)
    return F.broadcast(kept) if kept.count() <= limit else kept


def spread(df: DataFrame) -> DataFrame:
    """Give a CPU-heavy projection enough tasks when the input is a small file.

    The shuffle happens only if the scan has fewer splits than there are cores,
    which bounds what is moved to that many splits; large inputs pass through.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


def narrow(df: DataFrame, rows_per_task: int = 5000) -> DataFrame:
    """Fewer partitions for a small table that an iterative trainer reads many times.

    Every iteration pays for its tasks; a table with enough rows for all its
    partitions is left alone.
    """
    wanted = max(1, -(-df.count() // rows_per_task))
    return df.coalesce(wanted) if wanted < df.rdd.getNumPartitions() else df
