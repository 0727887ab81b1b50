"""Queries over streams with event time, state, admission by bytes and rate, and a dataset class, each with SQL.

Events arrive in six batches of five days each, by file; every tenth comes a batch late, and another tenth four batches late,
which is later than the watermark of six days lets in.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.data_queries import _query
from quern.plans.queries import ROLLOUTS, rollouts
from quern.session import materialise, scratch_path
from quern.sources.datasets import ParquetRows, dataset
from quern.streaming import events as EV
from quern.streaming import limits as LI
from quern.streaming import loop
from quern.streaming import state as ST

LATE = "6 days"
_EVENTS = """WITH e AS (SELECT *, CAST(floor(date_diff('second', TIMESTAMP '2024-01-01', ts) / 432000) AS INT) AS b FROM events),
k AS (SELECT * FROM e WHERE NOT (event_id % 10 = 7 AND b + 4 <= 5)), m AS (SELECT max(ts) - INTERVAL 6 DAY AS mark FROM e)"""


def _arriving(spark: SparkSession, d: str, schema: str, columns: list[str], late: bool = True) -> DataFrame:
    """Events as a stream, a file and a batch after another."""
    day = (F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / 432000
    natural = F.floor(day).cast("int")
    moved = F.when(F.col("event_id") % 10 == 3, 1).when((F.col("event_id") % 10 == 7) & (natural + 4 <= 5), 4).otherwise(0)
    batch = F.least(natural + moved, F.lit(5)) if late else natural
    table = materialise(spark.read.parquet(f"{d}/events.parquet").withColumn("_batch", batch), "events-by-batch")
    path = scratch_path(spark, "arriving")
    for b in range(6):  # one after another, as they are taken by age
        table.where(F.col("_batch") == b).select(*columns).coalesce(1).write.mode("append").parquet(path)
    return loop.arriving(spark, path, schema, files=1)


def _appended(spark: SparkSession, windows: DataFrame) -> DataFrame:
    path = scratch_path(spark, "windows")
    EV.finish(windows, path, scratch_path(spark, "checkpoint"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return spark.read.schema(windows.schema).parquet(path).select(text("start"), text("end"), "event_type", "n", "total")


_TIMES = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') AS start, strftime({1}, '%Y-%m-%d %H:%M:%S.%f') AS \"end\""


@_query("STM-02", _EVENTS + f""", w AS (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS s FROM k)
SELECT {_TIMES.format("s", "s + INTERVAL 1 DAY")}, event_type, count(*) AS n, round(sum(value), 5) + 0.0 AS total FROM w, m WHERE s + INTERVAL 1 DAY <= mark GROUP BY s, event_type""")
def _(spark, d):
    stream = _arriving(spark, d, "ts timestamp, event_type string, value double", ["ts", "event_type", "value"])
    return _appended(spark, EV.sliding(stream, "ts", "event_type", "value", "1 day", "12 hours", LATE))


@_query("STM-03", _EVENTS + f""", g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) > INTERVAL 30 MINUTE AS cut FROM k),
s AS (SELECT *, sum(cut::INT) OVER (PARTITION BY event_type ORDER BY ts) AS no FROM g),
x AS (SELECT event_type, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS z, count(*) AS n, sum(value) AS total FROM s GROUP BY event_type, coalesce(no, 0))
SELECT {_TIMES.format("a", "z")}, event_type, n, round(total, 5) + 0.0 AS total FROM x, m WHERE z <= mark""")
def _(spark, d):
    stream = _arriving(spark, d, "ts timestamp, event_type string, value double", ["ts", "event_type", "value"])
    return _appended(spark, EV.sessions(stream, "ts", "event_type", "value", "30 minutes", LATE))


@_query("STM-04", """WITH e AS (SELECT user_id % 40 AS question, date_diff('day', DATE '2024-01-01', ts::DATE) AS loop, avg((value > 8)::INT) AS mean FROM events GROUP BY 1, 2),
h AS (SELECT *, avg(mean) OVER w AS history, count(*) OVER w AS loops FROM e WINDOW w AS (PARTITION BY question ORDER BY loop)),
u AS (SELECT question, min(loop) AS gone FROM h WHERE loops >= 3 AND (history <= 0.4 OR history >= 0.6) GROUP BY 1)
SELECT question, loop::BIGINT AS loop, round(mean, 5) + 0.0 AS mean, round(history, 5) + 0.0 AS history, CASE WHEN loop = gone THEN 'used' ELSE 'kept' END AS status FROM h LEFT JOIN u USING (question) WHERE gone IS NULL OR loop <= gone""")
def _(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    stream = _arriving(spark, d, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema), events.columns, late=False)
    asked = stream.select((F.col("user_id") % 40).alias("question"), F.datediff("ts", F.lit("2024-01-01")).alias("loop"), (F.col("value") > 8).cast("double").alias("score"))
    path = scratch_path(spark, "histories")
    kept = ST.curriculum(asked, "question", "loop", "score", 0.4, 0.6)
    loop.run(kept, [loop.once(path)], scratch_path(spark, "checkpoint"))
    return spark.read.schema(kept.schema).parquet(path).select("question", "loop", "mean", "history", "status")


@_query("SRC-12-growing", ROLLOUTS + "SELECT row_idx, score FROM r WHERE score > 10")
def _(spark, d):
    r, files = rollouts(spark, d).select("row_idx", "score"), scratch_path(spark, "arriving")
    prepared = lambda rows: rows.where("score > 10")
    r.where("row_idx % 2 = 1").repartition(5).write.parquet(files)
    stream = loop.arriving(spark, files, "row_idx long, score double", files=2)
    return loop.grown(prepared(r.where("row_idx % 2 = 0")), stream, prepared, scratch_path(spark, "grown"), scratch_path(spark, "checkpoint"))


@_query("SNK-08-bytes", ROLLOUTS + "SELECT row_idx, score FROM r")
def _(spark, d):
    files = scratch_path(spark, "arriving")
    rollouts(spark, d).select("row_idx", "score").repartition(8).write.parquet(files)
    stream = LI.arriving_bytes(spark, files, "row_idx long, score double", most=64 << 10)
    path = scratch_path(spark, "taken")
    loop.run(stream, [loop.once(path)], scratch_path(spark, "checkpoint"))
    return spark.read.schema(stream.schema).parquet(path).select("row_idx", "score")


@_query("RWD-09-limited", ROLLOUTS + "SELECT row_idx, CASE WHEN score > 20 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM r")
def _(spark, d):
    def graded(rows: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([rows.column(0), pc.cast(pc.greater(rows.column(1), 20.0), pa.float64())], names=["row_idx", "reward"])

    r = rollouts(spark, d).select("row_idx", F.col("score").cast("double").alias("score"))
    return LI.limited(r, graded, "row_idx long, reward double", per_second=200_000, tasks=4, slice_rows=4096)


@_query("UDF-09", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders")
def _(spark, d):
    path = f"{d}/orders.parquet"
    options = {"path": path if "://" in path else f"file://{path}", "columns": "o_orderkey,o_totalprice"}
    return dataset(spark, ParquetRows, "id long, price double", options, rows=4000)
