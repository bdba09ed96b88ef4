"""Session helpers: table access, durable cut points, settings."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the test layout, ``folder/name.parquet``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the session has no such setting and runs in one process on one machine, as in tests, a temporary
    folder is used; on a cluster the executors would each write to their own disk, so it is an error there.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        folder = getattr(spark.sparkContext, "_audiolake_folder", None)
        if folder is None:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
            folder = tempfile.mkdtemp(prefix="audiolake-")
            spark.sparkContext._audiolake_folder = folder
            spark.sparkContext.setCheckpointDir(folder)
    return folder


def store(df: DataFrame, label: str, free: bool = False, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    ``free``: the shuffle files of the write are removed as it ends, not when the driver happens to collect its garbage. A
    setting of the session says so, so that no other job should start meanwhile. ``by``: a column of few values; each value's rows are
    files of their own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/audiolake-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    try:
        if free:
            spark.conf.set(CLEANUP, "true")
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        if free:
            spark.conf.set(CLEANUP, before)
    forget(spark, path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let the driver collect its garbage if its heap has grown beyond half of its limit.

    Planning leaves much of it, for which the heap grows rather than being collected, and a heap that has grown is not given back. At
    a cut point little else is held.
    """
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > runtime.maxMemory() / 2:
        runtime.gc()


def forget(spark: SparkSession, path: str) -> None:
    """Remove a folder when the process ends."""
    atexit.register(_remove, spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone already
        pass
