"""Judges' verdicts, scored completions, prompts with examples, retrieval, and summaries over sources and steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.filters import hash_order
from quern.operators.order_stats import group_median
from quern.operators.sampling import number_rows


def fits(df: DataFrame, tokens: Column, most: int) -> DataFrame:
    """Prompts of at most so many tokens; a prompt that can't be counted is too long."""
    return df.where(F.coalesce(tokens <= most, F.lit(False)))


def keep_unless_rejected(df: DataFrame, verdict: Column) -> DataFrame:
    """Rows that a judge doesn't reject; without a verdict they stay."""
    return df.where(F.coalesce(verdict, F.lit(True)))


def judged(score: Column, verdict: Column, applies: Column, mode: str = "direct") -> Column:
    """A rule's score after a judge's verdict, for the sources it applies to.

    cascade: only a 0 can become 1. direct: the verdict replaces the score, no verdict leaves it, and null becomes 0.
    """
    if mode == "cascade":
        new = F.when((score == 0) & verdict, 1.0).otherwise(score)
    elif mode == "direct":
        new = F.when(score.isNull(), 0.0).otherwise(F.coalesce(verdict.cast("double"), score))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.when(F.coalesce(applies, F.lit(False)), new).otherwise(score)


def examples(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """(key, example, place): for each row k - 1 others, in a random cyclic order of all, from a random place after it.

    Rows meet their examples by place, so the work is k rows a row; with fewer others, all are taken.
    """
    placed = number_rows(df.select(key, hash_order(seed, F.col(key)).alias("order")), ["order", key], "at").select(key, "at")
    n = placed.count()
    take = min(k - 1, n - 1)
    if take < 1:
        return df.select(key, F.col(key).alias("example"), F.lit(0).cast("long").alias("place")).limit(0)
    start = F.conv(F.substring(hash_order(f"{seed}:start", F.col(key)), 1, 8), 16, 10).cast("long")
    wanted = placed.select(key, "at", start.alias("start"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(take - 1).cast("long"))).alias("place"))
    wanted = wanted.select(key, "place", ((F.col("at") + 1 + (F.col("start") + F.col("place")) % (n - 1)) % n).alias("at"))
    return wanted.join(placed.select("at", F.col(key).alias("example")), "at").select(key, "example", "place")


def _nearest_in(ids: np.ndarray, matrix: np.ndarray, k: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top_s, top_k = np.full((len(ids), 0), 0.0), np.full((len(ids), 0), 0, dtype="int64")
        # a batch of Spark's may hold 10,000 rows, each of which has a place for every query of the block
        for batch in (b.slice(at, block) for b in batches for at in range(0, b.num_rows, block)):
            names = batch.column(0).to_numpy(zero_copy_only=False).astype("int64")
            found = matrix @ _unit(np.array(batch.column(1).to_pylist(), dtype="float64")).T
            s, n = np.hstack([top_s, found]), np.hstack([top_k, np.tile(names, (len(ids), 1))])
            order = np.lexsort((n, -s), axis=1)[:, :k]
            top_s, top_k = np.take_along_axis(s, order, 1), np.take_along_axis(n, order, 1)
        width = top_s.shape[1]
        yield pa.RecordBatch.from_pydict({"query": np.repeat(ids, width), "match": top_k.ravel(), "similarity": top_s.ravel()})

    return run


def nearest(corpus: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = 1024) -> DataFrame:
    """(query, match, similarity, rank): each query's k rows of most cosine similarity, ties by key.

    A block of queries goes to all partitions of the corpus, which look at as many rows at once and keep k a query; these few
    meet. No pair of rows is ever made. Vectors without length have similarity 0; nulls match nothing.
    """
    spark, out = corpus.sparkSession, None
    asked = number_rows(queries.where(F.col(vector).isNotNull()).select(key, vector), [key], "at")
    for start in range(0, asked.count(), block):
        rows = asked.where(F.col("at").between(start, start + block - 1)).collect()  # at most a block
        ids, matrix = np.array([r[0] for r in rows], dtype="int64"), _unit(np.array([r[1] for r in rows], dtype="float64"))
        part = corpus.where(F.col(vector).isNotNull()).select(F.col(key).cast("long"), vector).mapInArrow(_nearest_in(ids, matrix, k, block), "query long, match long, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query long, match long, similarity double, rank int")
    w = W.partitionBy("query").orderBy(F.desc("similarity"), "match")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _unit(rows: np.ndarray) -> np.ndarray:
    if rows.ndim == 1:
        return rows.reshape(len(rows), -1)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def passages(contents: Column) -> Column:
    """A list of contents as text: each one's first line is its title, the rest its body."""
    title = lambda c: F.substring_index(c, "\n", 1)
    body = lambda c: F.when(F.contains(c, F.lit("\n")), F.substring(c, F.length(title(c)) + 2, F.length(c))).otherwise("")
    shown = F.transform(contents, lambda c, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), title(c), F.lit(")\n"), body(c), F.lit("\n\n")))
    return F.btrim(F.array_join(shown, ""), F.lit(" \t\n\r\f\x0b"))


def validation(df: DataFrame, source: str, uid: str, value: str) -> DataFrame:
    """(source, metric, value): mean@N and std@N of a prompt's N values, and of n of them drawn with replacement the mean
    and deviation of the best and the worst, for n = 2, 4, ... and N; then the mean over the prompts of a source.

    Draws aren't simulated: of sorted values, the i-th is the best of n with probability (i/N)^n - ((i-1)/N)^n.
    """
    listed = df.groupBy(source, uid).agg(F.sort_array(F.collect_list(value)).alias("v"))
    n = F.size("v").cast("double")
    listed = listed.where("size(v) > 0")
    powers = F.filter(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.pow(F.lit(2.0), i)), lambda p: p < n)
    sizes = F.when(n > 1, F.array_append(powers, n)).otherwise(F.array().cast("array<double>"))

    def moment(size: Column, power: int, worst: bool) -> Column:
        far = lambda i: F.pow((n - i if worst else i + 1) / n, size) - F.pow((n - i - 1 if worst else i) / n, size)
        terms = F.transform("v", lambda x, i: F.pow(x, F.lit(power)) * far(i))
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / n
    spread = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    name = lambda kind, size, tail="": F.concat(F.lit(f"{kind}@"), size.cast("long").cast("string"), F.lit(tail))
    metric = lambda m, v: F.struct(m.alias("metric"), v.alias("value"))
    drawn = lambda kind, worst: F.flatten(F.transform(sizes, lambda s: F.array(
        metric(name(kind, s, "/mean"), moment(s, 1, worst)),
        metric(name(kind, s, "/std"), F.sqrt(F.greatest(moment(s, 2, worst) - F.pow(moment(s, 1, worst), F.lit(2)), F.lit(0.0)))),
    )))
    none = F.array().cast("array<struct<metric:string,value:double>>")
    all_ = F.concat(F.array(metric(name("mean", n), mean)), F.when(n > 1, F.array(metric(name("std", n), spread))).otherwise(none), drawn("best", False), drawn("worst", True))
    return listed.select(source, F.explode(all_).alias("m")).groupBy(source, "m.metric").agg(F.avg("m.value").alias("value"))


def sensitivity(df: DataFrame, n: str, cosine: str, status: str, thresholds: tuple[float, ...] = (0.5, 0.8, 0.9, 0.95)) -> DataFrame:
    """Per n: points in all and by status, and of the valid ones mean, deviation, range, median and shares over thresholds."""
    good = F.when((F.col(status) == "ok") & F.col(cosine).isNotNull(), F.col(cosine))
    count = lambda s: F.count(F.when(F.col(status) == s, 1))
    share = lambda t: F.coalesce(F.avg((good > t).cast("double")), F.lit(0.0)).alias(f"frac_gt_{str(t).replace('.', 'p')}")
    middle = group_median(df.withColumn("_good", good), n, "_good").select(F.col(n).alias("_group"), "median")
    figures = df.groupBy(n).agg(
        F.count(F.lit(1)).alias("total_points"), F.count(good).alias("valid_points"), (F.count(F.lit(1)) - F.count(good)).alias("skipped_points"),
        count("retry_exhausted").alias("retry_exhausted_points"), count("zero_variance").alias("zero_variance_points"),
        F.avg(good).alias("mean"), F.stddev_pop(good).alias("std"), F.min(good).alias("min"), F.max(good).alias("max"), *[share(t) for t in thresholds],
    )
    joined = figures.join(middle, F.col(n).eqNullSafe(F.col("_group")), "left")
    at = figures.columns.index("max") + 1
    return joined.select(*figures.columns[:at], "median", *figures.columns[at:])


def usage(calls: DataFrame, model: str, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Per model: tokens of prompts, completions and reasoning, calls, averages, and the cost by prices of a million."""
    kinds = ("prompt_tokens", "completion_tokens", "reasoning_tokens")
    sums = calls.groupBy(model).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in kinds], F.count(F.lit(1)).alias("num_calls"))
    cost = F.lit(None).cast("double")
    for name, (ask, answer) in prices.items():
        cost = F.when(F.col(model) == name, (F.col("prompt_tokens") * ask + F.col("completion_tokens") * answer) / 1e6).otherwise(cost)
    average = lambda c: F.col(c) / F.col("num_calls")
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    return sums.withColumns({"total_tokens": total, "estimated_cost_usd": cost, "avg_prompt_tokens": average("prompt_tokens"), "avg_completion_tokens": average("completion_tokens")})


def token_normaliser(df: DataFrame, mask: str, ranks: int, micro: int) -> DataFrame:
    """Tokens that count in a micro-batch of all ranks, as the batch has them on average."""
    return df.agg((F.sum(mask) / F.count(F.lit(1)) * (micro * ranks)).alias("tokens"))


def adaptive_kl(steps: DataFrame, step: str, kl: str, n_steps: str, start: float, target: float, horizon: float) -> DataFrame:
    """The coefficient after each step: it grows with the divergence over its target, by a fifth at most a horizon.

    One row a training step: a window without partitions takes them all.
    """
    error = F.least(F.greatest(F.col(kl) / target - 1, F.lit(-0.2)), F.lit(0.2))
    factor = 1 + error * F.col(n_steps) / horizon
    w = W.orderBy(step).rowsBetween(W.unboundedPreceding, 0)
    return steps.withColumn("coefficient", F.lit(start) * F.product(factor).over(w))


def retried(pool: DataFrame, key: str, side: str, item: str, score: str, n: int, attempts: int, seed: int) -> DataFrame:
    """(key, status, attempts_used): n items of each of two sides drawn anew until both have some variance.

    All attempts are drawn at once, as rows; their number is a parameter. A side of fewer than n items never succeeds.
    """
    tries = pool.select(key, side, item, score, F.explode(F.sequence(F.lit(1), F.lit(attempts))).alias("attempt"))
    w = W.partitionBy(key, "attempt", side).orderBy(hash_order(seed, F.col("attempt"), F.col(key), F.col(item)), item)
    drawn = tries.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    sides = drawn.groupBy(key, "attempt", side).agg((F.min(score) < F.max(score)).alias("varied"), F.count(F.lit(1)).alias("size"))
    good = sides.groupBy(key, "attempt").agg(F.sum((F.col("varied") & (F.col("size") == n)).cast("int")).alias("good"))
    first = good.groupBy(key).agg(F.min(F.when(F.col("good") == 2, F.col("attempt"))).alias("first"))
    return first.select(key, F.when(F.col("first").isNull(), "retry_exhausted").otherwise("ok").alias("status"), F.coalesce("first", F.lit(attempts)).alias("attempts_used"))


def merge_sections(docs: DataFrame, structure: DataFrame) -> DataFrame:
    """(place, idx, header1, header2, content) of pages (idx, content) by a structure (pos, id, title, start, end).

    Pages of a section are joined under its chapter's title. Pages of a chapter without sections stay as they are, and
    so do those that no item covers, last. Items may overlap.
    """
    number = F.regexp_extract("id", r"\A[CS]([^.]*)", 1)
    items = structure.withColumns({"chapter": number, "kind": F.substring("id", 1, 1)}).where("kind in ('C', 'S')")
    divided = items.where("kind = 'S' and instr(id, '.') > 0").select("chapter").distinct().withColumn("divided", F.lit(True))
    titles = items.where("kind = 'C'").groupBy("chapter").agg(F.min_by("title", "pos").alias("chapter_title"))
    items = items.join(divided, "chapter", "left").join(titles, "chapter", "left").where("kind = 'S' or divided is null")
    pages = items.where("start <= end").select("pos", "kind", "title", "chapter", "chapter_title", F.explode(F.sequence("start", "end")).alias("idx")).join(docs, "idx")
    joined = pages.where("kind = 'S'").groupBy("pos").agg(
        F.min("idx").alias("idx"), F.first(F.coalesce("chapter_title", F.concat(F.lit("Chapter "), "chapter"))).alias("header1"), F.first("title").alias("header2"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "content"))), lambda x: x["content"]), "\n\n").alias("content"),
    )
    none = F.lit(None).cast("string")
    alone = lambda d, pos: d.select(pos.alias("pos"), "idx", none.alias("header1"), none.alias("header2"), "content")
    rest = docs.join(pages.select("idx").distinct(), "idx", "left_anti")
    return joined.select("pos", "idx", "header1", "header2", "content").unionByName(alone(pages.where("kind = 'C'"), F.col("pos"))).unionByName(alone(rest, F.lit((1 << 31) - 1)))
