"""The inverted-file index against all similarities."""

import numpy as np
import pytest

from quern.operators import judging as J
from quern.operators import vector_index as V


def _rows(n, seed, centres=12):
    rng = np.random.Generator(np.random.PCG64(seed))
    means = rng.normal(size=(centres, 16))
    return [(i, (means[i % centres] + 0.6 * rng.normal(size=16)).tolist()) for i in range(n)]


def test_recall_and_exactness(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARE", 60)  # so that lists have several shares
    rows = _rows(1500, 1) + [(2000, None), (2001, [0.0] * 16), (2002, _rows(1, 1)[0][1])]
    corpus = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    queries = corpus.where("id % 50 = 0")
    index, fitted = V.build(corpus, "id", "v", 5)
    assert index.count() == 1502 and index.select("share").distinct().count() > 1 and fitted.probes < len(fitted.centres)
    exact = {(r.query, r["rank"]): (r.match, r.similarity) for r in J.nearest(corpus, queries, "id", "v", 5).collect()}
    every = {(r.query, r["rank"]): (r.match, r.similarity) for r in V.search(index, fitted, queries, "id", "v", 5, probes=len(fitted.centres)).collect()}
    assert every.keys() == exact.keys()
    assert all(every[k][0] == m and every[k][1] == pytest.approx(s, abs=1e-12) for k, (m, s) in exact.items() if k[0] != 2001)
    some = {(r.query, r.match) for r in V.search(index, fitted, queries, "id", "v", 5).collect()}
    assert len(some & {(q, m) for (q, _), (m, _) in exact.items()}) >= 0.9 * len(exact)


def test_recall_on_the_given_vectors(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    queries = e.where("vec_id % 100 = 0")
    index, fitted = V.build(e, "vec_id", "embedding", 5)
    exact = {(r.query, r.match) for r in J.nearest(e, queries, "vec_id", "embedding", 5).collect()}
    found = {(r.query, r.match) for r in V.search(index, fitted, queries, "vec_id", "embedding", 5).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def test_small_and_empty(spark):
    one = spark.createDataFrame([(7, [1.0, 0.0])], "id long, v array<double>")
    for corpus, want in ((one, [(7, 7, 1)]), (one.limit(0), []), (one.selectExpr("id", "cast(null AS array<double>) AS v"), [])):
        index, fitted = V.build(corpus, "id", "v", 3)
        assert [(r.query, r.match, r["rank"]) for r in V.search(index, fitted, one, "id", "v", 3).collect()] == want
