"""Admission: work that a limit of rows a second lets through, and files that a limit of bytes does."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


class TokenBucket:
    """Tokens that fill up at a rate, to a most; whoever takes more than there are waits."""

    def __init__(self, rate: float, most: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if rate <= 0 or most < 1:
            raise ValueError("a bucket needs a rate over 0 and room for a token")
        self.rate, self.most, self.clock, self.sleep = rate, most, clock, sleep
        self.tokens, self.at = 0.0, clock()

    def take(self, count: int) -> None:
        """Wait for ``count`` tokens, of which there need not be room for all at once."""
        now = self.clock()
        self.tokens = min(self.most, self.tokens + (now - self.at) * self.rate) - count
        self.at = now
        if self.tokens < 0:
            self.sleep(-self.tokens / self.rate)


def limited(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, per_second: float, tasks: int, slice_rows: int = 64) -> DataFrame:
    """The work of a function on slices of a table, ``per_second`` rows at most by all tasks together.

    Each of the tasks has its share of the rate for itself, so none has to ask another; fewer that run at once stay under it.
    Slices are small enough for a tenth of a second of a task's share.
    """
    share = per_second / tasks
    step = max(1, min(slice_rows, int(share / 10)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = TokenBucket(share, max(1.0, float(step)))
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                bucket.take(part.num_rows)
                yield work(part)

    return df.repartition(tasks).mapInArrow(run, schema)


def arriving_bytes(spark: SparkSession, folder: str, schema: str, most: int, kind: str = "parquet") -> DataFrame:
    """The rows of files as they arrive, files of ``most`` bytes in all a batch, and one file at least."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", str(most)).format(kind).load(folder)
