"""Nearest vectors by an inverted-file index: every row lies in the list of its nearest centre, queries look into some lists.

Centres and the number of lists to look into are fitted on a sample of SAMPLE rows at most, by hash of the key: as many lists as
hold TARGET of the true neighbours within the sample. The index itself holds every row. Rows and queries of a list meet in a
cogroup; a large list is cut into shares of SHARE rows, each of which sees the list's queries, so no task grows with a list.
Vectors are compared by cosine; those without length have similarity 0, and null vectors are in no list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.filters import hash_order
from quern.operators.order_stats import first_rows, hash_numbers
from quern.session import materialise

SAMPLE, MOST_LISTS, ROUNDS = 20_000, 1024, 8
TARGET, TESTED = 0.97, 500
SHARE = 20_000
#: Queries that are multiplied with a share at once.
BLOCK = 1024


@dataclass
class Fitted:
    """Centres of the lists, and how many of them a query looks into."""

    centres: np.ndarray
    probes: int


def unit(rows: list | np.ndarray) -> np.ndarray:
    """Rows of length 1; those without length stay."""
    matrix = np.asarray(rows, dtype="float64").reshape(len(rows), -1)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def fit(sample: np.ndarray, k: int, seed: int = 0) -> Fitted:
    """Spherical k-means on a sample, and the least number of lists in which TARGET of its rows' k neighbours lie."""
    lists = max(1, min(MOST_LISTS, math.isqrt(len(sample))))
    centres = sample[np.random.default_rng(seed).choice(len(sample), lists, replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(np.bincount(own, minlength=lists)[:, None] > 0, unit(sums), centres)
    own = np.argmax(sample @ centres.T, axis=1)
    tested = sample[:TESTED]
    near = np.argsort(-(tested @ sample.T), axis=1, kind="stable")[:, : k + 1]  # a row is its own nearest
    place = np.empty((len(tested), lists), dtype=int)
    np.put_along_axis(place, np.argsort(-(tested @ centres.T), axis=1, kind="stable"), np.arange(lists)[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return Fitted(centres, int(needed[math.ceil(TARGET * len(needed)) - 1]) + 1)


def _listed(centres: np.ndarray, lists: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = unit(batch.column(1).to_pylist())
                near = np.argsort(-(rows @ centres.T), axis=1, kind="stable")[:, :lists]
                at = np.repeat(np.arange(len(rows)), near.shape[1])
                vectors = pa.array(rows[at].tolist(), pa.list_(pa.float64()))
                yield pa.record_batch([pa.array(near.ravel().astype("int32")), batch.column(0).take(pa.array(at)), vectors], names=["list", "key", "unit"])

    return run


_ROW = "list int, key long, unit array<double>"


def build(corpus: DataFrame, key: str, vector: str, k: int) -> tuple[DataFrame, Fitted | None]:
    """The index of every row with a vector: (list, share, key, unit); and what it was fitted to, null for no rows."""
    rows = corpus.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"))
    order = [(c, False) for c in (*hash_numbers(hash_order("index", F.col("key"))), F.col("key"))]
    sample = first_rows(rows, order, SAMPLE).select("v").toArrow().column(0).to_pylist()  # SAMPLE rows at most
    if not sample:
        return rows.selectExpr("0 AS list", "0 AS share", "key", "cast(v AS array<double>) AS unit"), None
    fitted = fit(unit(sample), k)
    listed = materialise(rows.mapInArrow(_listed(fitted.centres, 1), _ROW), "vector-lists")
    return listed.join(F.broadcast(_shares(listed)), "list").select("list", F.pmod(F.xxhash64("key"), "shares").cast("int").alias("share"), "key", "unit"), fitted


def _shares(listed: DataFrame) -> DataFrame:
    """(list, shares): a row per list, MOST_LISTS at most."""
    return listed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("long").alias("shares"))


def _best(k: int):
    def run(members: pa.Table, asked: pa.Table) -> pa.Table:
        ids = members.column("key").to_numpy().astype("int64")
        rows = np.array(members.column("unit").to_pylist(), dtype="float64")
        names, wanted = asked.column("key").to_numpy().astype("int64"), asked.column("unit").to_pylist()
        out = []
        for first in range(0, len(names) if len(ids) else 0, BLOCK):
            found = np.array(wanted[first : first + BLOCK], dtype="float64") @ rows.T
            order = np.lexsort((np.broadcast_to(ids, found.shape), -found), axis=1)[:, :k]
            width = order.shape[1]
            out.append((np.repeat(names[first : first + BLOCK], width), ids[order].ravel(), np.take_along_axis(found, order, 1).ravel()))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0)]
        return pa.table(columns, names=["query", "match", "similarity"])

    return run


def search(index: DataFrame, fitted: Fitted | None, queries: DataFrame, key: str, vector: str, k: int, probes: int | None = None) -> DataFrame:
    """(query, match, similarity, rank): the k nearest rows that lie in the lists a query looks into, ties by key.

    With as many probes as lists the result is exact.
    """
    if fitted is None:
        return index.sparkSession.createDataFrame([], "query long, match long, similarity double, rank int")
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"))
    lists = asked.mapInArrow(_listed(fitted.centres, probes or fitted.probes), _ROW)
    shares = index.groupBy("list").agg((F.max("share") + 1).alias("shares"))  # a row per list
    spread = lists.join(F.broadcast(shares), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "key", "unit")
    found = index.groupBy("list", "share").cogroup(spread.groupBy("list", "share")).applyInArrow(_best(k), "query long, match long, similarity double")
    w = W.partitionBy("query").orderBy(F.desc("similarity"), "match")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
