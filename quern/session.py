"""Session defaults, shared scratch folders and materialised intermediate tables."""

from __future__ import annotations

import gc
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH = "/tmp/quern-checkpoints"


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quern")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is absent, a folder set by setCheckpointDir() is used; only a local master gets a local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    already = context._jsc.sc().getCheckpointDir()
    if not already.isEmpty():
        return already.get().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    os.makedirs(_LOCAL_SCRATCH, exist_ok=True)
    context.setCheckpointDir(f"file://{_LOCAL_SCRATCH}")
    return f"file://{_LOCAL_SCRATCH}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the driver's JVM deletes it when it ends."""
    path = f"{scratch_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def release(*tables: DataFrame | None) -> None:
    """Delete tables that materialise() wrote, once nothing reads them any more; others are left alone.

    A collection on the driver then lets Spark's cleaner drop the shuffle files and broadcasts of plans that are done.
    """
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path:
            context = table.sparkSession.sparkContext
            hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(context._jsc.hadoopConfiguration()).delete(hadoop, True)
    session = next((t.sparkSession for t in tables if t is not None), None)
    if session is not None:
        gc.collect()
        session.sparkContext._jvm.System.gc()
