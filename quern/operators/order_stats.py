"""Exact order statistics that no single task has to see all values for.

A value at a rank is found by histograms: one pass counts the values of a span by BINS equal bins, with the least and the largest
of each; the bin that holds the rank is the next span, until it holds one value only. Both ends of a span fall into
different bins, so every pass narrows it. Only counts move, BINS rows a task and span at most. The first k rows of an order
are those before the kth value, and of those equal to it the first by the next column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import materialise

BINS = 1024
#: Rows that one task may hold: up to so many, Spark's own sort with a limit and its own percentiles do.
MOST_IN_TASK = 10_000


@dataclass
class _Span:
    low: float | int
    high: float | int
    #: Values under the span.
    below: int
    ranks: list[int] = field(default_factory=list)


def _bin(v: Column, span: _Span, whole: bool) -> Column:
    """The number of the bin that a value of a span falls into; rises with the value."""
    if whole:
        step = (span.high - span.low) // BINS + 1
        return F.expr("{} div {}L".format("(_v - {}L)".format(span.low), step))
    if span.low == -math.inf or span.high == math.inf:  # infinities have bins of their own
        return F.when(v == -math.inf, 0).when(v == math.inf, 2).otherwise(1).cast("long")
    width = span.high / 2 - span.low / 2
    return F.least(F.floor((v / 2 - span.low / 2) / width * BINS), F.lit(BINS - 1)).cast("long")


def at_ranks(values: DataFrame, ranks: list[int]) -> tuple[dict[int, float | int], dict[int, int]]:
    """Of a written table with one numeric column and no nulls: the value at each rank from 0, and the values under it."""
    (name,) = values.columns
    whole = isinstance(values.schema[0].dataType, T.IntegralType)
    rows = values.select(F.col(name).cast("long" if whole else "double").alias("_v"))
    ends = rows.agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.count("_v").alias("n")).first()
    if any(not 0 <= r < ends.n for r in ranks):
        raise ValueError(f"ranks must be from 0 to {ends.n - 1}")
    found: dict[int, float | int] = {}
    below: dict[int, int] = {}
    spans = [_Span(ends.low, ends.high, 0, sorted(set(ranks)))] if ranks else []
    while spans:
        open_spans = []
        for span in spans:
            if span.low == span.high or span.low != span.low:
                found |= dict.fromkeys(span.ranks, span.low)
                below |= dict.fromkeys(span.ranks, span.below)
            else:
                open_spans.append(span)
        spans = []
        if not open_spans:
            break
        v = F.col("_v")
        cells = [F.when((v >= s.low) & (v <= s.high), F.struct(F.lit(i).alias("span"), _bin(v, s, whole).alias("bin"))) for i, s in enumerate(open_spans)]
        counted = rows.select("_v", F.explode(F.array_compact(F.array(*cells))).alias("_at")).groupBy("_at.span", "_at.bin")
        bins = counted.agg(F.count("_v").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).collect()  # BINS a span
        for i, span in enumerate(open_spans):
            seen = span.below
            for b in sorted((b for b in bins if b.span == i), key=lambda b: b.bin):
                own = [r for r in span.ranks if seen <= r < seen + b.n]
                if own:
                    spans.append(_Span(b.low, b.high, seen, own))
                seen += b.n
    return found, below


def quantiles(df: DataFrame, value: Column, shares: list[float], lower: bool = False) -> list[float | None]:
    """Quantiles of a column's values, nulls left out: linear between neighbours, or the least value that so many don't exceed.

    Null for no values.
    """
    values = df.select(value.alias("v")).where("v is not null")
    function = "percentile_disc({}) WITHIN GROUP (ORDER BY v)" if lower else "percentile(v, {})"
    few = values.limit(MOST_IN_TASK + 1).agg(F.count("*").alias("n"), *[F.expr(function.format(f"{s!r}D")).alias(f"q{i}") for i, s in enumerate(shares)]).first()
    if few.n <= MOST_IN_TASK:
        return list(few)[1:]
    return _selected(materialise(values, "quantiles"), shares, lower)


def _selected(values: DataFrame, shares: list[float], lower: bool) -> list[float]:
    n = values.count()
    places = [max(0, math.ceil(s * n) - 1) if lower else s * (n - 1) for s in shares]
    found, _ = at_ranks(values, sorted({r for p in places for r in (math.floor(p), math.ceil(p))}))
    out = []
    for p in places:
        a, b = found[math.floor(p)], found[math.ceil(p)]
        out.append(a if a == b else a + (b - a) * (p - math.floor(p)))
    return out


def group_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median) of values, nulls left out: rows are sorted over all tasks by group and value, so a large group is many
    tasks' work, and the middle ones are picked by their place."""
    from quern.operators.sampling import number_rows

    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("_group"), F.col(value).cast("double").alias("_value"))
    placed = materialise(number_rows(rows, ["_group", "_value"], "_place"), "medians")
    sizes = placed.groupBy("_group").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    middle = sizes.select(F.col("_group").alias("_own"), F.explode(F.array(F.expr("_first + (_n - 1) div 2"), F.expr("_first + _n div 2"))).alias("_at"))
    picked = middle.join(placed.select("_place", "_value"), F.col("_at") == F.col("_place"))
    return picked.groupBy(F.col("_own").alias(group)).agg(F.avg("_value").alias("median"))


def hash_numbers(digest: Column) -> list[Column]:
    """An MD5 in hex as three whole numbers in the same order."""
    return [F.conv(F.substring(digest, at, n), 16, 10).cast("long") for at, n in ((1, 15), (16, 15), (31, 2))]


def first_rows(df: DataFrame, order: list[tuple[Column, bool]], k: int) -> DataFrame:
    """The first k rows by columns without nulls, each with whether it falls; of rows equal in all of them any.

    Columns that are no numbers may stand last, among rows that are few.
    """
    keys = [f"_order{i}" for i in range(len(order))]
    keyed = df.select("*", *[c.alias(name) for name, (c, _) in zip(keys, order, strict=True)])
    if k <= MOST_IN_TASK:
        return keyed.orderBy(*[F.desc(n) if falls else F.asc(n) for n, (_, falls) in zip(keys, order, strict=True)]).limit(max(k, 0)).drop(*keys)
    written = materialise(keyed, "first-rows")
    kept, tied, left = F.lit(False), F.lit(True), k
    for name, (_, falls) in zip(keys, order, strict=True):
        ties = written.where(tied).select(name)
        n = ties.count()
        if left >= n:
            return written.where(kept | tied).drop(*keys)
        if not isinstance(written.schema[name].dataType, T.NumericType):
            break
        rank = n - left if falls else left - 1
        found, below = at_ranks(ties, [rank])
        limit = F.lit(found[rank])
        if falls:
            before = n - below[rank] - ties.where(F.col(name) == limit).count()
        else:
            before = below[rank]
        kept = kept | (tied & ((F.col(name) > limit) if falls else (F.col(name) < limit)))
        tied = tied & (F.col(name) == limit)
        left -= before
    rest = written.where(tied).orderBy(*[F.desc(n) if falls else F.asc(n) for n, (_, falls) in zip(keys, order, strict=True)]).limit(left)
    return written.where(kept).unionByName(rest).drop(*keys)


def first_by_bucket(df: DataFrame, bucket: str, quotas: dict[str, int], order: list[tuple[Column, bool]]) -> DataFrame:
    """Of each bucket (few) its first rows, as many as its quota says."""
    wanted = {b: n for b, n in sorted(quotas.items()) if n > 0}
    if sum(wanted.values()) <= MOST_IN_TASK:  # then Spark keeps so many a task before it shuffles any
        keys = [F.desc(c) if falls else F.asc(c) for c, falls in order]
        most = max(wanted.values(), default=0)
        ranked = df.where(F.col(bucket).isin(*wanted)).withColumn("_k", F.row_number().over(W.partitionBy(bucket).orderBy(*keys))).where(F.col("_k") <= most)
        limit = F.create_map(*[x for b, n in wanted.items() for x in (F.lit(b), F.lit(n))]) if wanted else F.lit(None)
        return ranked.where(F.col("_k") <= limit[F.col(bucket)]).drop("_k") if wanted else df.limit(0)
    out = df.limit(0)
    for b, n in wanted.items():
        out = out.unionByName(first_rows(df.where(F.col(bucket) == b), order, n))
    return out
