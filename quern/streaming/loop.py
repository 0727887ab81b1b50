"""Loops over arriving rows as streams: micro-batches of bounded size, exactly-once tables, and steps that resume.

A loop's state is Spark's checkpoint (which batches are done) and, beside each table, a folder for each batch. A batch
that runs again after a failure replaces its folder; a batch with a done-marker is passed over. So every row is written
once, however often the loop is started.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.results import exists


def arriving(spark: SparkSession, folder: str, schema: str, files: int = 16, kind: str = "parquet") -> DataFrame:
    """The rows of files as they arrive, at most so many files a batch: what can't be taken yet waits in the folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(folder)


def _done(path: str) -> str:
    return f"{path}/_SUCCESS"  # Spark writes it last


def once(path: str, step: Callable[[DataFrame], DataFrame] = lambda batch: batch, depends: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """A batch writer: a folder a batch, passed over if it is done, after the folders of this batch that it depends on."""

    def write(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, f"batch={number}"
        if exists(spark, _done(f"{path}/{name}")):
            return
        for other in depends:
            if not exists(spark, _done(f"{other}/{name}")):
                raise RuntimeError(f"{other} has not finished {name}")
        step(batch).write.mode("overwrite").parquet(f"{path}/{name}")

    return write


def run(stream: DataFrame, writers: list[Callable[[DataFrame, int], None]], checkpoint: str) -> None:
    """Take all that has arrived, batch by batch, through the writers in order; a second start goes on where the first ended."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.persist()
        try:
            for write in writers:
                write(rows, number)
        finally:
            rows.unpersist()

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def track(metrics: DataFrame, step: int | str, path: str) -> None:
    """Append (step, metric, value) to a table of metrics."""
    step_ = F.lit(step) if isinstance(step, int) else F.col(step)
    metrics.select(step_.cast("long").alias("step"), "metric", F.col("value").cast("double").alias("value")).write.mode("append").parquet(path)


def windowed(stream: DataFrame, time: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """Rows and sum by key and window of time; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def grown(base: DataFrame, stream: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataFrame:
    """A dataset with the rows that a stream has brought so far, each batch prepared by the step that the dataset went through."""
    run(stream, [once(path, step)], checkpoint)
    more = base.sparkSession.read.schema(base.schema).parquet(f"{path}/batch=*")
    return base.unionByName(more)
