"""Streams: late rows and expired state, state after a failure, admission by bytes and rate, dataset classes."""

import time
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.session import scratch_path
from quern.sources import datasets as D
from quern.streaming import events as EV
from quern.streaming import limits as LI
from quern.streaming import loop
from quern.streaming import state as ST

START = datetime(2024, 1, 1)


def _files(spark, batches, schema):
    path = scratch_path(spark, "arriving")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return loop.arriving(spark, path, schema, files=1)


def _at(hours):
    return START + timedelta(hours=hours)


def test_late_rows_are_dropped_and_state_expires(spark):
    batches = [[(_at(1), "a", 1.0)], [(_at(30), "a", 2.0)], [(_at(31), "a", 4.0)], [(_at(2), "a", 8.0), (_at(26), "a", 16.0)], [(_at(90), "a", 32.0)]]
    stream = _files(spark, batches, "ts timestamp, k string, x double")
    path = scratch_path(spark, "out")
    progress = EV.finish(EV.sliding(stream, "ts", "k", "x", "1 hour", "1 hour", "6 hours"), path, scratch_path(spark, "checkpoint"))
    got = {r.start: (r.n, r.total) for r in spark.read.parquet(path).collect()}
    assert got == {_at(1): (1, 1.0), _at(26): (1, 16.0), _at(30): (1, 2.0), _at(31): (1, 4.0)}  # 2 is too late, 90 has not ended
    states = [s for p in progress for s in p["stateOperators"]]
    assert sum(s["numRowsDroppedByWatermark"] for s in states) == 1
    assert states[-1]["numRowsTotal"] == 1 and max(s["numRowsTotal"] for s in states) > 1


def test_sessions_merge_and_end(spark):
    batches = [[(_at(1), "a", 1.0), (_at(2.5), "a", 1.0)], [(_at(1.75), "a", 1.0), (_at(2), "b", 1.0)], [(_at(50), "a", 1.0)]]
    path = scratch_path(spark, "out")
    EV.finish(EV.sessions(_files(spark, batches, "ts timestamp, k string, x double"), "ts", "k", "x", "1 hour", "10 hours"), path, scratch_path(spark, "checkpoint"))
    assert {(r.k, r.start, r.end, r.n) for r in spark.read.parquet(path).collect()} == {("a", _at(1), _at(3.5), 3), ("b", _at(2), _at(3), 1)}


def test_first_rows_of_keys(spark):
    batches = [[(_at(1), "a", 1.0)], [(_at(2), "a", 2.0), (_at(2), "b", 3.0)]]
    path = scratch_path(spark, "out")
    EV.finish(EV.first_seen(_files(spark, batches, "ts timestamp, k string, x double"), "ts", "k", "5 hours"), path, scratch_path(spark, "checkpoint"))
    assert {(r.k, r.x) for r in spark.read.parquet(path).collect()} == {("a", 1.0), ("b", 3.0)}


def _histories(rows, low, high, least):
    """Loop by loop, in plain Python."""
    out, held, used = [], {}, set()
    for number in sorted({r[1] for r in rows}):
        for q in sorted({r[0] for r in rows if r[1] == number and r[0] is not None}):
            scores = [r[2] for r in rows if r[0] == q and r[1] == number and r[2] is not None]
            if q in used or not scores:
                continue
            held.setdefault(q, []).append(sum(scores) / len(scores))
            mean = sum(held[q]) / len(held[q])
            if len(held[q]) >= least and (mean <= low or mean >= high):
                used.add(q)
            out.append((q, number, round(held[q][-1], 9), round(mean, 9), "used" if q in used else "kept"))
    return sorted(out)


def test_state_is_the_same_after_a_failure(spark):
    rows = [(q if q else None, n, None if (q + n) % 7 == 0 else float((q * n * 31 + k) % 5 < q % 5)) for n in range(8) for q in range(9) for k in range(3)]
    stream = _files(spark, [[r for r in rows if r[1] == n] for n in range(8)], "q long, n long, s double")
    kept = ST.curriculum(stream, "q", "n", "s", 0.1, 0.9, least=2)
    path, checkpoint = scratch_path(spark, "histories"), scratch_path(spark, "checkpoint")
    failed = []

    def fails_once(batch, number):
        if number in (2, 5) and number not in failed:
            failed.append(number)
            raise RuntimeError("an executor is gone")

    for _ in range(3):
        try:
            loop.run(kept, [fails_once, loop.once(path)], checkpoint)
        except Exception as error:  # noqa: BLE001  a stream wraps what its batch raised
            assert "an executor is gone" in str(error)
    assert failed == [2, 5]
    got = sorted((r.q, r.n if hasattr(r, "n") else r.loop, round(r.mean, 9), round(r.history, 9), r.status) for r in spark.read.schema(kept.schema).parquet(path).collect())
    assert got == _histories(rows, 0.1, 0.9, 2) and any(r[-1] == "used" for r in got)


def test_admission_by_bytes(spark):
    path = scratch_path(spark, "arriving")
    spark.range(0, 8000, 1, 8).select("id", F.md5(F.col("id").cast("string")).alias("x")).write.parquet(path)
    sizes = []
    stream = LI.arriving_bytes(spark, path, "id long, x string", most=100_000)
    loop.run(stream, [lambda batch, number: sizes.append(batch.count())], scratch_path(spark, "checkpoint"))
    assert sum(sizes) == 8000 and len(sizes) > 2 and max(sizes) <= 3000


def test_token_bucket():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    bucket = LI.TokenBucket(10, 5, lambda: now[0], sleep)
    for _ in range(20):
        bucket.take(3)
    assert now[0] == pytest.approx(6.0) and all(s > 0 for s in slept)
    now[0] += 100
    bucket.take(5)  # the bucket is full, no more
    bucket.take(5)
    assert now[0] == pytest.approx(106.5)
    with pytest.raises(ValueError):
        LI.TokenBucket(0, 1)


def test_rate_of_all_tasks(spark):
    df = spark.range(0, 1200, 1, 3)
    work = lambda rows: pa.record_batch([rows.column(0)], names=["id"])
    LI.limited(df, work, "id long", 1e6, 4).count()  # starts the workers
    began = time.monotonic()
    assert LI.limited(df, work, "id long", 300, 4).agg(F.count_distinct("id")).first()[0] == 1200
    assert 0.9 <= (time.monotonic() - began) / 4.0 <= 1.25  # the last also has the job's own time


CLASS = """
import json, os

class Lines:
    def __init__(self, options):
        self.path = options["path"]
        self.rows = [json.loads(x) for x in open(self.path)]
    def __len__(self):
        return len(self.rows)
    def __getitem__(self, i):
        return self.rows[i]["q"], self.rows[i].get("a")
    def committed(self, number):
        open(self.path + ".done", "w").write(str(number))

class NotOne:
    pass
"""


def test_dataset_class(spark, tmp_path):
    (tmp_path / "mine.py").write_text(CLASS)
    data = tmp_path / "rows.jsonl"
    data.write_text("".join(f'{{"q": {i}, "a": "x{i}"}}\n' for i in range(25)) + '{"q": 25}\n')
    kind = D.load_class(str(tmp_path / "mine.py"), "Lines")
    options = {"path": str(data)}
    table = D.dataset(spark, kind, "q long, a string", options, rows=10)
    assert sorted((r.q, r.a) for r in table.collect()) == [(i, f"x{i}" if i < 25 else None) for i in range(26)]
    assert table.select(F.spark_partition_id()).distinct().count() == 3
    with pytest.raises(TypeError):
        D.load_class(str(tmp_path / "mine.py"), "NotOne")
    empty = tmp_path / "none.jsonl"
    empty.write_text("")
    assert D.dataset(spark, kind, "q long, a string", {"path": str(empty)}).count() == 0


def test_dataset_class_as_a_stream(spark, tmp_path):
    (tmp_path / "mine.py").write_text(CLASS)
    data = tmp_path / "rows.jsonl"
    data.write_text("".join(f'{{"q": {i}}}\n' for i in range(12)))
    kind = D.load_class(str(tmp_path / "mine.py"), "Lines")
    path, checkpoint = scratch_path(spark, "grown"), scratch_path(spark, "checkpoint")
    for more in (0, 7):
        with data.open("a") as file:
            file.writelines(f'{{"q": {100 + i}}}\n' for i in range(more))
        stream = D.dataset(spark, kind, "q long, a string", {"path": str(data)}, rows=5, stream=True)
        loop.run(stream, [loop.once(path)], checkpoint)
    rows = [r.q for r in spark.read.parquet(path).collect()]
    assert sorted(rows) == [*range(12), *range(100, 107)]
    assert (tmp_path / "rows.jsonl.done").read_text() in ("12", "19")


def test_rows_of_a_parquet_file_are_held_in_part(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"z": range(30_000), "a": [f"x{i}" for i in range(30_000)]}), tmp_path / "t.parquet", row_group_size=20_000)
    rows = D.ParquetRows({"path": f"file://{tmp_path}/t.parquet", "columns": "a,z"})
    assert len(rows) == 30_000
    for i in (0, 19_999, 20_000, 5_000, 5_001, 4_096, 4_095, 29_999, 7):
        assert rows[i] == (f"x{i}", i)
        assert len(rows.held) <= D.HELD_ROWS
    with pytest.raises(IndexError):
        rows[30_000]


def test_ranges_are_no_more_than_tasks_can_bear():
    for n in (0, 1, 26, 54_000_000):
        ranges = D._ranges(0, n, 4000)
        assert len(ranges) <= D.MOST_PARTITIONS
        assert [r.first for r in ranges] + [n] == [0] * bool(n) + [r.last for r in ranges] + [n] * (not n)
