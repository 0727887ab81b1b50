"""Event time: sliding and session windows that end, late rows that are dropped, and state that expires.

Results are appended once: a window comes out when the watermark passes its end, and its state goes. A row whose windows have
all ended by then is dropped; how many were is in the progress that ``finish`` returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _summed(stream: DataFrame, window: Column, time: str, key: str, value: str, late: str) -> DataFrame:
    sums = stream.withWatermark(time, late).groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sliding(stream: DataFrame, time: str, key: str, value: str, width: str, slide: str, late: str) -> DataFrame:
    """Rows and sum by key and overlapping windows, each ``slide`` after the one before."""
    return _summed(stream, F.window(time, width, slide), time, key, value, late)


def sessions(stream: DataFrame, time: str, key: str, value: str, gap: str, late: str) -> DataFrame:
    """Rows and sum by key and session: rows less than ``gap`` apart belong together."""
    return _summed(stream, F.session_window(time, gap), time, key, value, late)


def first_seen(stream: DataFrame, time: str, key: str, late: str) -> DataFrame:
    """The first row of each key; the key is forgotten once the watermark has passed it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def finish(stream: DataFrame, path: str, checkpoint: str) -> list[dict]:
    """Take all that has arrived and append it to a table of files, each once; the progress of every batch."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return list(query.recentProgress)
