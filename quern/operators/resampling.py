"""Bootstrap of answers to prompts: seeded draws with replacement, reduced by best, worst, mean, median, deviation or majority.

The values of a prompt, bounded by the answers that are drawn for it, are gathered by Spark as one row; a task then draws for
all its prompts. The draws of a size depend on the seed and the number of values alone, so any task repeats them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DRAWS, SEED = 1000, 42
#: Reducers of a table with a row per draw.
REDUCERS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "best": lambda x: x.max(1),
    "worst": lambda x: x.min(1),
    "mean": lambda x: x.mean(1),
    "median": lambda x: np.median(x, axis=1),
    "std": lambda x: x.std(1),
    "sum": lambda x: x.sum(1),
}


@functools.lru_cache(maxsize=64)
def picks(values: int, size: int, draws: int = DRAWS, seed: int = SEED) -> np.ndarray:
    """Places of the values that each draw takes."""
    return np.random.RandomState(seed).randint(0, values, (draws, size))


def majority(values: np.ndarray, votes: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """Of each draw the first value with its most frequent vote; of equal votes, the one that the draw took first."""
    rows, size = drawn.shape
    own = votes[drawn]
    kinds = int(votes.max()) + 1
    cells = (np.arange(rows)[:, None] * kinds + own).ravel()
    count = np.bincount(cells, minlength=rows * kinds).reshape(rows, kinds)
    first = np.full(rows * kinds, size)
    np.minimum.at(first, cells, np.tile(np.arange(size), rows))
    best = np.lexsort((first.reshape(rows, kinds), -count), axis=1)[:, 0]
    return values[drawn[np.arange(rows), first.reshape(rows, kinds)[np.arange(rows), best]]]


def sizes_of(values: int) -> list[int]:
    """2, 4, 8, ... below the number of values, and that number."""
    return [s for s in (1 << k for k in range(1, values.bit_length())) if s < values] + [values] if values > 1 else []


def _gathered(df: DataFrame, keys: list[str], value: str, order: str, vote: str | None) -> DataFrame:
    """(keys, values, votes) in order; rows without a value are left out, and a missing vote is a vote of its own."""
    voted = F.coalesce(F.col(vote).cast("string"), F.lit("\x00")) if vote else F.lit("")
    rows = df.where(F.col(value).isNotNull())
    own = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("x"), voted.alias("v"))))
    listed = rows.groupBy(*keys).agg(own.alias("_rows"))
    return listed.select(*keys, F.transform("_rows", lambda r: r["x"]).alias("_values"), F.transform("_rows", lambda r: r["v"]).alias("_votes"))


def bootstrap(
    df: DataFrame, keys: list[str], value: str, order: str, sizes: tuple[int, ...] = (), reducers: tuple[str, ...] = ("mean",), vote: str | None = None, draws: int = DRAWS, seed: int = SEED
) -> DataFrame:
    """(keys, reducer, size, mean, std) over draws, by prompt. Without sizes, 2, 4, 8, ... and the number of values.

    With a vote, "maj" reduces too. A prompt without values gives no row; one with a single value none without sizes.
    """
    unknown = set(reducers) - REDUCERS.keys()
    if unknown:
        raise ValueError(f"unknown reducers {sorted(unknown)}; known: {sorted(REDUCERS)}")
    listed = _gathered(df, keys, value, order, vote)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema if f.name in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, (values, votes) in enumerate(zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True)):
                x = np.array(values)
                codes = np.array([*map({v: k for k, v in enumerate(dict.fromkeys(votes))}.__getitem__, votes)])
                for size in sizes or sizes_of(len(values)):
                    drawn = picks(len(values), size, draws, seed)
                    found = [(name, REDUCERS[name](x[drawn])) for name in reducers]
                    if vote is not None:
                        found.append(("maj", majority(x, codes, drawn)))
                    for name, y in found:
                        at.append(i)
                        out.append((name, size, float(y.mean()), float(y.std())))
            if out:
                own = [batch.column(k).take(pa.array(at)) for k in range(len(keys))]
                rest = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
                yield pa.record_batch([*own, *rest], names=[*keys, "reducer", "size", "mean", "std"])

    return listed.mapInArrow(run, f"{schema}, reducer string, size long, mean double, std double")


def validation(df: DataFrame, source: str, uid: str, value: str, order: str, vote: str | None = None, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(source, metric, value): mean@N and std@N of a prompt's N values; of n of them drawn with replacement the mean and the
    deviation of the best, the worst and the majority's value; then the mean over the prompts of a source."""
    drawn = bootstrap(df, [source, uid], value, order, (), ("best", "worst"), vote, draws, seed)
    name = lambda tail: F.concat("reducer", F.lit("@"), F.col("size").cast("string"), F.lit(tail))
    parts = F.array(F.struct(name("/mean").alias("metric"), F.col("mean").alias("value")), F.struct(name("/std").alias("metric"), F.col("std").alias("value")))
    whole = df.where(F.col(value).isNotNull()).groupBy(source, uid).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.count(value).cast("string").alias("n"))
    plain = F.array(F.struct(F.concat(F.lit("mean@"), "n").alias("metric"), F.col("m").alias("value")), F.when(F.col("n") != "1", F.struct(F.concat(F.lit("std@"), "n").alias("metric"), F.col("s").alias("value"))))
    rows = drawn.select(source, F.explode(parts).alias("x")).unionByName(whole.select(source, F.explode(F.array_compact(plain)).alias("x")))
    return rows.groupBy(source, "x.metric").agg(F.avg("x.value").alias("value"))
