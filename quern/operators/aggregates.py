"""Evaluation aggregates. Scores are 1.0, 0.0 or null; null is not the same as wrong, so counts say which they mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.order_stats import quantiles


def accuracy(df: DataFrame, key: str, score: str) -> DataFrame:
    """n_correct, n_total and accuracy over rows with a score; accuracy 0 without any."""
    n, c = F.count(score), F.coalesce(F.sum(score), F.lit(0.0))
    return df.groupBy(key).agg(
        c.cast("long").alias("n_correct"), n.alias("n_total"), F.coalesce(c / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("accuracy")
    )


def pass_at_k(n: Column, c: Column, k: int, short: float | None = 0.0) -> Column:
    """1 - C(n-c, k) / C(n, k) as a product; ``short`` where n < k (0, or null so that means leave it out)."""
    product = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (1 - F.lit(float(k)) / i))
    value = F.when(c == 0, 0.0).when(n - c < k, 1.0).otherwise(1 - product)
    return F.when(n < k, F.lit(short).cast("double")).otherwise(value)


def pass_ladder(df: DataFrame, n: str, c: str, top: int) -> DataFrame:
    """(k, pass_at_k) for k = 1, 2, 4, ... up to ``top``: means over questions."""
    ks = [1 << i for i in range(top.bit_length()) if 1 << i <= top]
    rows = F.array(*[F.struct(F.lit(k).alias("k"), pass_at_k(F.col(n), F.col(c), k).alias("p")) for k in ks])
    return df.select(F.explode(rows).alias("x")).groupBy(F.col("x.k").alias("k")).agg(F.avg("x.p").alias("pass_at_k"))


def length_stats(df: DataFrame, key: str, length: str) -> DataFrame:
    """Mean, sample deviation (0 for one row), least, most."""
    return df.groupBy(key).agg(
        F.avg(length).alias("mean"), F.coalesce(F.stddev_samp(length), F.lit(0.0)).alias("std"), F.min(length).alias("least"), F.max(length).alias("most")
    )


def distribution(df: DataFrame, value: str, percents: tuple[int, ...] = (10, 90)) -> DataFrame:
    """One row: mean, population deviation, min, max, median, count and linear percentiles; 0 if there are no values."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    median, *others = (zero(F.lit(q)) for q in quantiles(df, F.col(value), [0.5, *(p / 100 for p in percents)]))
    figures = df.agg(
        zero(F.avg(value)).alias("mean"), zero(F.stddev_pop(value)).alias("std"), zero(F.min(value)).alias("min"),
        zero(F.max(value)).alias("max"), F.count(value).alias("count"),
    )
    return figures.select("mean", "std", "min", "max", median.alias("median"), "count", *[q.alias(f"p{p}") for p, q in zip(percents, others, strict=True)])


def reduce_by_name(df: DataFrame, name: str, value: str) -> DataFrame:
    """A name with "max" reduces by maximum, else with "min" by minimum, else by mean."""
    return df.groupBy(name).agg(
        F.when(F.col(name).contains("max"), F.max(value)).when(F.col(name).contains("min"), F.min(value)).otherwise(F.avg(value)).alias("reduced")
    )


def majority(df: DataFrame, key: str, vote: str, value: str, order: str = "row_idx") -> DataFrame:
    """The first value of the vote that most rows cast; of equal votes the one seen first."""
    votes = df.groupBy(key, vote).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(order, value)).alias("first"))
    return votes.groupBy(key).agg(F.min_by("first", F.struct(-F.col("n"), F.col("first"))).alias("x")).select(key, F.col(f"x.{value}").alias("majority"))


def spice(df: DataFrame, key: str, score: str) -> DataFrame:
    """exp(-(var_pop - 0.25)^2 / 0.02) per question, null scores as 0."""
    v = F.var_pop(F.coalesce(F.col(score), F.lit(0.0)))
    return df.groupBy(key).agg(F.exp(-F.pow(v - 0.25, 2) / 0.02).alias("reward"))


def class_shares(df: DataFrame, cls: str, question: str) -> DataFrame:
    """Per class: rows, share of rows, questions, share of questions."""
    total = df.agg(F.count(F.lit(1)).alias("_rows"), F.count_distinct(question).alias("_questions"))
    per = df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(question).alias("questions"))
    return per.join(F.broadcast(total)).select(  # one row
        cls, "n", (F.col("n") / F.col("_rows")).alias("share"), "questions", (F.col("questions") / F.col("_questions")).alias("question_share")
    )


def class_delta(df: DataFrame, question: str, cls: str, value: str, one: str, other: str) -> DataFrame:
    """The mean over questions that have both classes of (mean of one class - mean of the other)."""
    per = df.groupBy(question).agg(
        F.avg(F.when(F.col(cls) == one, F.col(value))).alias("a"), F.avg(F.when(F.col(cls) == other, F.col(value))).alias("b")
    )
    return per.where("a is not null and b is not null").agg(F.avg(F.col("a") - F.col("b")).alias("delta"), F.count(F.lit(1)).alias("questions"))


def masked_var(values: Column, mask: Column, unbiased: bool = True) -> Column:
    """The variance of values with mask 1; null for none, or without bias for a single one."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    n = total(mask)
    mean = F.try_divide(total(F.zip_with(values, mask, lambda v, m: v * m)), n)
    var = F.try_divide(total(F.zip_with(values, mask, lambda v, m: (v - mean) * (v - mean) * m)), n)
    return F.try_divide(var * n, n - 1) if unbiased else var


def bootstrap(df: DataFrame, key: str, value: str, draws: int = 1000, size: int = 8, seed: int = 42) -> DataFrame:
    """Mean and deviation, over draws with replacement, of a draw's mean; a draw's rows are picked by hash, per group.

    Rows of a group are numbered, and draw d takes the row number md5(seed, d, j) modulo the group's size. Groups of up to
    draws * size rows are gathered as a row each, which takes its picks by place; of larger ones, the picks are joined with
    the rows, since there are fewer. The hashes are the same in all groups and made once.
    """
    from pyspark.sql import Window as W

    spark, own = df.sparkSession, W.partitionBy(key)
    numbered = df.select(key, F.col(value).cast("double").alias("_v"), (F.row_number().over(own.orderBy(F.col(value).asc_nulls_last())) - 1).alias("_i"))
    numbered = numbered.withColumn("_n", F.count(F.lit(1)).over(own))
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "_d", "_j")), 1, 13), 16, 10).cast("bigint").alias("_h")
    hashes = spark.range(1, draws + 1).select(F.col("id").alias("_d"), F.explode(F.sequence(F.lit(1), F.lit(size))).alias("_j")).select("_d", "_j", digest)
    hashes = hashes.groupBy("_d").agg(F.transform(F.sort_array(F.collect_list(F.struct("_j", "_h"))), lambda x: x["_h"]).alias("_hs"))
    table = hashes.agg(F.transform(F.sort_array(F.collect_list(F.struct("_d", "_hs"))), lambda x: x["_hs"]).alias("_all"))

    small, large = numbered.where(F.col("_n") <= draws * size), numbered.where(F.col("_n") > draws * size)
    listed = small.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("_values"))
    taken = lambda h: F.get("_values", h % F.size("_values"))
    means = listed.join(F.broadcast(table)).select(key, F.transform("_all", lambda hs: _mean(F.transform(hs, taken))).alias("_ms"))
    off = lambda m, avg: (m - avg) * (m - avg)
    means = means.select(key, "_ms", _mean(F.col("_ms")).alias("mean"))
    figures = means.select(key, "mean", F.sqrt(_mean(F.transform("_ms", lambda m: off(m, F.col("mean"))))).alias("std"))

    picks = large.where("_i = 0").select(key, "_n").join(F.broadcast(hashes)).select(key, "_d", F.explode("_hs").alias("_h"), "_n")
    picks = picks.select(key, "_d", (F.col("_h") % F.col("_n")).cast("int").alias("_i"))
    # both sides grow with the table, so neither is broadcast, whatever Spark takes their sizes for
    drawn = picks.hint("merge").join(large.select(key, "_i", "_v"), [key, "_i"]).groupBy(key, "_d").agg(F.avg("_v").alias("_m"))
    return figures.unionByName(drawn.groupBy(key).agg(F.avg("_m").alias("mean"), F.stddev_pop("_m").alias("std")))


def _mean(xs: Column) -> Column:
    """Mean of the values of an array that aren't null; null if there is none."""
    none = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"))
    add = lambda a, x: F.when(x.isNull(), a).otherwise(F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n")))
    return F.aggregate(xs, none, add, lambda a: F.try_divide(a["s"], a["n"]))


def group_mean_std(df: DataFrame, key: str, score: str, eps: float = 1e-6) -> DataFrame:
    """Mean, deviation and count per group from sums; the variance is at least eps, and a single row has (0, 1)."""
    sums = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(score).alias("s1"), F.sum(F.col(score) * F.col(score)).alias("s2"))
    var = (F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / F.greatest(F.col("n") - 1, F.lit(1))
    one = F.col("n") <= 1
    return sums.select(
        key,
        F.when(one, 0.0).otherwise(F.col("s1") / F.col("n")).alias("mean"),
        F.when(one, 1.0).otherwise(F.sqrt(F.greatest(var, F.lit(eps)))).alias("std"),
        F.col("n").alias("count"),
    )


def reward_metrics(df: DataFrame, reward: str) -> DataFrame:
    """One row over rewards: mean, std (population), min, max, median, num_scored, num_positive, frac_positive; 0 if none."""
    v = F.col(reward)
    positive = F.count_if(v > 0)
    figures = {
        "mean": F.avg(v), "std": F.stddev_pop(v), "min": F.min(v), "max": F.max(v), "median": F.any_value(F.lit(quantiles(df, v, [0.5])[0])),
        "num_scored": F.count(v), "num_positive": positive, "frac_positive": F.try_divide(positive, F.count(v)),
    }
    return df.agg(*[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in figures.items()])


def question_rollouts(df: DataFrame, doc: str, reason: str) -> DataFrame:
    """One row: documents, generated, valid (no reject reason) and invalid questions, and counts of the three reasons."""
    valid = F.count_if(F.col(reason).isNull())
    total = F.count(F.lit(1))
    docs = F.count_distinct(doc)
    named = [F.count_if(F.col(reason) == r).alias(n) for r, n in (("failed_parse", "num_failed_parses"), ("empty_question", "num_empty_questions"), ("invalid_ground_truth", "num_invalid_ground_truth"))]
    return df.agg(
        docs.alias("num_documents"), total.alias("num_generated"), valid.alias("num_valid"), (total - valid).alias("num_invalid"),
        F.coalesce(F.try_divide(valid, total), F.lit(0.0)).alias("frac_valid"),
        F.coalesce(F.try_divide(valid, docs), F.lit(0.0)).alias("valid_per_doc"), *named,
    )


def flatten(df: DataFrame, prefix: str) -> DataFrame:
    """Columns of figures to rows (name, value), the name under a prefix."""
    pairs = [F.struct(F.lit(f"{prefix}/{c}").alias("name"), F.col(c).cast("double").alias("value")) for c in df.columns]
    return df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def sub_summaries(df: DataFrame, group: str, score: str) -> DataFrame:
    """Per group: rows and mean score; empty if there is one group at most."""
    each = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"))
    several = each.agg(F.count(F.lit(1)).alias("_groups"))  # one row
    return each.join(F.broadcast(several), F.col("_groups") > 1).drop("_groups")


def pass_ladders(df: DataFrame, group: str, score: str, top: int) -> DataFrame:
    """(k, strict, lenient) for k = 1, 2, 4, ... up to ``top``: means of pass@k over questions, an answer without a score being
    wrong, or none."""
    q = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count(score).alias("v"), F.count_if(F.col(score) > 0).alias("c"))
    strict, lenient = (pass_ladder(q, n, "c", top).withColumnRenamed("pass_at_k", name) for n, name in (("n", "strict"), ("v", "lenient")))
    return strict.join(lenient, "k")


def flag_shares(df: DataFrame, cls: str, flag: str) -> DataFrame:
    """Per class and for all: the share of rows with a flag, and their number."""
    per = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(flag)).alias("count"))
    every = per.agg(F.sum("_n").alias("_n"), F.sum("count").alias("count")).select(F.lit("all").alias(cls), "_n", "count")
    return per.unionByName(every).select(cls, F.coalesce(F.try_divide("count", "_n"), F.lit(0.0)).alias("share"), "count")
