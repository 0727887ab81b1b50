"""Selection by histograms, quantiles, first rows and places, against sorted lists."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import aggregates as G
from quern.operators import filters as L
from quern.operators import order_stats as O
from quern.operators import sampling as M
from quern.session import materialise


def _column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(5)


CASES = {
    "spread": lambda r: r.normal(size=3000).tolist(),
    "many equal": lambda r: [0.25] * 2000 + r.choice([0.0, 0.5, 1.0], 500).tolist(),
    "one": lambda r: [7.5],
    "far apart": lambda r: [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324] + (10.0 ** r.uniform(-300, 300, 400)).tolist(),
    "close": lambda r: [1 + k * math.ulp(1.0) for k in r.integers(0, 40, 500).tolist()],
    "infinite": lambda r: [-math.inf, math.inf, math.inf] + r.normal(size=200).tolist(),
}


@pytest.mark.parametrize("case", CASES)
def test_values_at_ranks(spark, case):
    values = CASES[case](np.random.Generator(np.random.PCG64(3)))
    ranks = sorted({0, len(values) - 1, len(values) // 2, len(values) // 3})
    found, below = O.at_ranks(materialise(_column(spark, values), "t"), ranks)
    order = sorted(values)
    assert [found[r] for r in ranks] == [order[r] for r in ranks]
    assert [below[r] for r in ranks] == [sum(v < order[r] for v in values) for r in ranks]
    with pytest.raises(ValueError):
        O.at_ranks(_column(spark, values), [len(values)])


def test_whole_numbers_stay_exact(spark):
    values = [2**60 + k * 7 for k in range(500)] + [-(2**60), 0, 1]
    found, _ = O.at_ranks(materialise(_column(spark, values, "long"), "t"), [0, 1, 250, 502])
    assert [found[r] for r in (0, 1, 250, 502)] == [sorted(values)[r] for r in (0, 1, 250, 502)]


@pytest.mark.parametrize("most", [10_000, 50])
def test_quantiles(spark, monkeypatch, most):
    monkeypatch.setattr(O, "MOST_IN_TASK", most)
    rng = np.random.Generator(np.random.PCG64(4))
    values = rng.integers(0, 60, 801).tolist()
    df = _column(spark, [float(v) for v in values] + [None] * 9)
    shares = [0.0, 0.1, 0.5, 0.777, 1.0]
    assert O.quantiles(df, F.col("v"), shares) == pytest.approx([float(np.quantile(values, s)) for s in shares], rel=1e-12)
    assert O.quantiles(df, F.col("v"), shares, lower=True) == [float(np.quantile(values, s, method="inverted_cdf")) for s in shares]
    assert O.quantiles(df.where("v is null"), F.col("v"), [0.5]) == [None]
    row = G.distribution(df, "v").first()
    assert (row.median, row["count"]) == (float(np.median(values)), 801) and row.p90 == pytest.approx(float(np.quantile(values, 0.9)))
    assert G.reward_metrics(df.where("v is null"), "v").first().median == 0.0


@pytest.mark.parametrize("most", [10_000, 3])
@pytest.mark.parametrize("k", [0, 1, 4, 37, 100, 101, 500])
def test_first_rows(spark, monkeypatch, most, k):
    monkeypatch.setattr(O, "MOST_IN_TASK", most)
    rows = [(i, (i * 7919) % 5 / 4, i % 3) for i in range(101)]
    df = spark.createDataFrame(rows, "id long, score double, kind long").repartition(4)
    got = O.first_rows(df, [(F.col("score"), True), (F.col("kind"), False), (F.col("id"), True)], k)
    assert got.columns == df.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(sorted(rows, key=lambda r: (-r[1], r[2], -r[0]))[:k])


@pytest.mark.parametrize("most", [10_000, 3])
def test_hash_order_and_buckets(spark, monkeypatch, most):
    monkeypatch.setattr(O, "MOST_IN_TASK", most)
    df = spark.range(300).select(F.col("id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("bucket"), (F.col("id") % 7).cast("double").alias("x"))
    by_hash = {b: [r.id for r in df.where(F.col("bucket") == b).orderBy(L.hash_order(5, F.col("id")), "id").collect()] for b in "ab"}
    got = M.take_quotas(df, "bucket", "id", {"a": 20, "b": 31, "c": 4, "d": 0}, 5).collect()
    assert sorted(r.id for r in got) == sorted(by_hash["a"][:20] + by_hash["b"][:31])
    both = [r.id for r in df.orderBy(L.hash_order(9, F.col("id")), "id").limit(44).collect()]
    assert sorted(r.id for r in M.subsample(df, "id", 44, 9).collect()) == sorted(both)
    assert sorted(r.id for r in L.random_alpha(df, 0.1465, 300, "id", 9).collect()) == sorted(both)
    top = [r.id for r in df.orderBy(F.desc("x"), "id").limit(60).collect()]
    assert sorted(r.id for r in L.top_alpha(df, 0.2, 300, "x", "id").collect()) == sorted(top)


def test_group_median(spark):
    rng = np.random.Generator(np.random.PCG64(6))
    rows = [("hot", float(v)) for v in rng.normal(size=700)] + [("b", 1.0), ("b", 2.0), (None, 5.0), ("c", None)] + [("d", float(v % 4)) for v in range(9)]
    got = {r.g: r["median"] for r in O.group_median(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    want = {g: float(np.median([v for h, v in rows if h == g and v is not None])) for g in ("hot", "b", None, "d")}
    assert got == pytest.approx(want)


def test_places_without_reuse_of_exchanges(spark):
    """Sizes and rows of the ranges come from one written table, so that they agree whatever Spark plans."""
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(0, 400_000, 1, 7).select((F.xxhash64("id") % 100_003).alias("x"), "id")
        placed = M.number_rows(df, ["x", "id"], "place")
        row = placed.agg(F.count_distinct("place").alias("n"), F.min("place").alias("least"), F.max("place").alias("most")).first()
        assert (row.n, row.least, row.most) == (400_000, 0, 399_999)
        first = [(r.x, r.id) for r in placed.where("place < 50").orderBy("place").collect()]
        assert first == [(r.x, r.id) for r in df.orderBy("x", "id").limit(50).collect()]
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
