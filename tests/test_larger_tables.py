"""Queries over tables whose keys go beyond those of the test data."""

import hashlib
import statistics
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import aggregates as G
from quern.operators import balance as B
from quern.operators import judging as J
from quern.plans import judging_queries as _judging  # noqa: F401
from quern.plans import registry
from quern.plans import text_queries as _texts  # noqa: F401
from quern.sources import readers as IN


def _agrees(spark, folder, name):
    """Rows that the query and its SQL give."""
    c = duckdb.connect()
    for path in folder.iterdir():
        c.execute(f"CREATE VIEW {path.stem} AS FROM '{path}/*.parquet'")
    df = registry.queries()[name](spark, str(folder))
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    return got, sorted(c.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall(), key=repr)


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("large")
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    part.withColumn("p_partkey", F.col("p_partkey") + 1_000_000).write.parquet(str(folder / "part.parquet"))
    return folder


def test_large_ids(spark, parts):
    got, want = _agrees(spark, parts, "SCR-07")
    assert got == want and {same for _, same in want} == {True, False, None}

def test_capped_in_the_order_of_the_files(spark, tmp_path):
    path = str(tmp_path / "questions")
    for first, rows in ((0, 30), (30, 3000)):  # Spark reads the largest file first
        spark.range(first, first + rows).coalesce(1).write.mode("append").json(f"{path}/{first:03}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = IN.capped(spark.read.schema("id long").option("recursiveFileLookup", "true").json(path), 100)
        assert found.columns == ["id"] and sorted(r.id for r in found.collect()) == [*range(100)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _drawn(rows, draws, size, seed):
    """Mean and deviation of each group by a plain loop."""
    out = {}
    for g, values in rows.items():
        ordered = sorted(values)
        pick = lambda d, j, n=len(values): int(hashlib.md5(f"{seed}:{d}:{j}".encode()).hexdigest()[:13], 16) % n
        means = [sum(ordered[pick(d, j)] for j in range(1, size + 1)) / size for d in range(1, draws + 1)]
        out[g] = (statistics.fmean(means), statistics.pstdev(means))
    return out


def test_bootstrap_of_small_and_large_groups(spark):
    rows = {g: [(7 * g + k * k) % 101 + 0.25 for k in range(n)] for g, n in enumerate((1, 2, 12, 13, 400))}
    df = spark.createDataFrame([(g, x) for g, xs in rows.items() for x in xs], "g long, x double")
    made = G.bootstrap(df, "g", "x", draws=4, size=3, seed=9)
    want = _drawn(rows, 4, 3, 9)
    got = {r.g: (r["mean"], r["std"]) for r in made.collect()}
    assert got.keys() == want.keys()
    assert all(got[g] == pytest.approx(want[g]) for g in want)


def test_bootstrap_sends_no_table_that_grows(spark):
    """The picks, which Spark takes for small, are not broadcast; a group of few rows makes no row per pick."""
    df = spark.range(4000).selectExpr("id % 500 AS g", "cast(id AS double) AS x")
    plan = G.bootstrap(df, "g", "x", draws=50)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 3 and sum("rightHint=(strategy=broadcast)" in j for j in joins) == 2 and sum("leftHint=(strategy=merge)" in j for j in joins) == 1


def _peak_mb(run, batch):
    """The most that a function over a batch holds at a time, and its rows."""
    tracemalloc.start()
    rows = sum(out.num_rows for out in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak, rows


def test_batches_are_unpacked_one_by_one():
    one = [{"key": i, "work": i % 7} for i in range(512)]
    batch = pa.record_batch([pa.array(range(400)), pa.array([one] * 400)], names=["batch", "rows"])
    peak, rows = _peak_mb(B._dealt(lambda work: B.greedy(work, 8, True)), batch)
    assert rows == 400 * 512 and peak < 10


def test_nearest_looks_at_blocks_of_a_batch():
    vectors = np.random.default_rng(1).standard_normal((5000, 8))
    batch = pa.record_batch([pa.array(range(5000)), pa.array(vectors.tolist())], names=["key", "v"])
    unit = J._unit(vectors)
    peak, rows = _peak_mb(J._nearest_in(np.arange(256), unit[:256], 3, 256), batch)
    assert rows == 3 * 256 and peak < 12
    out = next(J._nearest_in(np.arange(4), unit[:4], 3, 256)(iter([batch])))
    want = np.argsort(-(unit[:4] @ unit.T), axis=1)[:, :3]
    assert out.column("match").to_pylist() == want.ravel().tolist()


@pytest.mark.parametrize("name", ["DOC-01", "STR-15", "STR-16", "STR-20", "SCR-08"])
def test_rules_in_python_do_not_stay_in_the_split_of_a_small_file(spark, name):
    """A file of one row group is one task's, so rows are dealt before the rules run."""
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    rule = next(i for i, x in enumerate(lines) if "MapInArrow" in x or "ArrowEvalPython" in x)
    assert any("RepartitionByExpression" in x for x in lines[rule:])


def test_chunks_leave_in_batches(spark):
    from quern.functions import markdown as MD

    df = spark.range(0, 300, 1, 1).selectExpr("id", "if(id % 3 = 0, null, concat('# h\\n', id, '\\n## g\\nb', chr(9), 'c')) as text")
    chunks = MD.chunk(df, "text", "id", least=0)
    assert [(r.key, r.chunk, r.headers, r.page_content) for r in chunks.orderBy("key", "chunk").collect()] == [
        x for i in range(300) if i % 3 for x in ((i, 0, {"Header 1": "h"}, str(i)), (i, 1, {"Header 1": "h", "Header 2": "g"}, "bc"))
    ]
