"""Filters over groups of rollouts, joins against documents, and sampling by hash order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.order_stats import first_by_bucket, first_rows, hash_numbers, quantiles
from quern.session import materialise


def hash_order(seed: int | str, *parts: Column) -> Column:
    """A key that puts rows in a random order which any engine with MD5 repeats."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def drop_zero_variance(df: DataFrame, group: str, score: str, keep_single: bool) -> DataFrame:
    """Groups whose scores are all equal go; a group of one is kept or not, as the caller says."""
    spread = F.coalesce(F.min(score) != F.max(score), F.lit(False)) | (F.lit(keep_single) & (F.count(F.lit(1)) == 1))
    kept = df.groupBy(F.col(group).alias("_group")).agg(spread.alias("_kept")).where("_kept")
    return df.join(kept.select("_group"), F.col(group).eqNullSafe(F.col("_group")), "left_semi")


def top_alpha(df: DataFrame, alpha: float, total: int, value: str, tie: str) -> DataFrame:
    """The ceil(alpha * total) best rows; ``total`` may count rows that were filtered before."""
    return first_rows(df, [(F.col(value), True), (F.col(tie), False)], math.ceil(alpha * total))


def random_alpha(df: DataFrame, alpha: float, total: int, key: str, seed: int) -> DataFrame:
    """A share of the rows at random, as many as top_alpha takes."""
    return first_rows(df, [(c, False) for c in (*hash_numbers(hash_order(seed, F.col(key))), F.col(key))], math.ceil(alpha * total))


def top_per_group(df: DataFrame, group: str, value: str, tie: str, count: int) -> DataFrame:
    ranked = W.partitionBy(group).orderBy(F.desc(value), tie)
    return df.withColumn("_k", F.row_number().over(ranked)).where(F.col("_k") <= count).drop("_k")


def group_std_mask(df: DataFrame, group: str, value: str, tau: float | None = None, top_gamma: float | None = None, tau_max: float | None = None) -> DataFrame:
    """Adds masked: the value, or 0 where the group's population deviation is at most tau (fixed, or a quantile of groups)."""
    groups = df.groupBy(group).agg(F.stddev_pop(value).alias("_std"))
    if tau is None:
        groups = materialise(groups, "deviations")  # the bound is one of the deviations, which must not be summed anew in another order
        (tau,) = quantiles(groups, F.col("_std"), [1 - top_gamma])
        tau = tau if tau is None or tau_max is None else min(tau, tau_max)
    groups = groups.withColumn("_tau", F.lit(tau).cast("double"))
    named = groups.withColumnRenamed(group, "_group")
    joined = df.join(named, F.col(group).eqNullSafe(F.col("_group")))  # rows without a group are one too
    return joined.select(*df.columns, F.when(F.col("_std") <= F.col("_tau"), 0.0).otherwise(F.col(value)).alias("masked"))


def rejection_mask(log_ratio: Column, mask: Column, upper: float, lower: float | None = None, level: str = "token") -> Column:
    """The mask, zero where exp(log ratio) leaves [lower, upper]; per token, or for the whole sequence by sum or mean."""
    low = 1 / upper if lower is None else lower
    inside = lambda x: (F.exp(x) >= low) & (F.exp(x) <= upper)
    if level == "token":
        return F.zip_with(log_ratio, mask, lambda x, m: F.when(inside(x), m).otherwise(0))
    total = F.aggregate(F.zip_with(log_ratio, mask, lambda x, m: x * m), F.lit(0.0), lambda a, x: a + x)
    if level == "geometric":
        total = F.try_divide(total, F.aggregate(mask, F.lit(0.0), lambda a, x: a + x))  # null, and all masked, without a token
    elif level != "sequence":
        raise ValueError(f"unknown level {level}")
    return F.transform(mask, lambda m: F.when(inside(total), m).otherwise(0))


def stratify(df: DataFrame, doc: str, order: str) -> DataFrame:
    """Adds spread_idx: an even spread of each document's rows, by ((j + 0.5) / k, first seen, order)."""
    w = W.partitionBy(doc)
    staged = df.withColumns(
        {"_j": F.row_number().over(w.orderBy(order)) - 1, "_k": F.count(F.lit(1)).over(w), "_first": F.min(order).over(w)}
    )
    return staged.withColumn("_at", (F.col("_j") + 0.5) / F.col("_k"))


def difficulty(accuracy: Column) -> Column:
    return F.when(accuracy >= 0.75, "easy").when(accuracy >= 0.25, "medium").otherwise("hard")


def quotas(target: dict[str, float], total: int) -> dict[str, int]:
    """Rounded half to even per bucket; the last takes what remains."""
    names = list(target)
    out = {n: round(target[n] * total) for n in names[:-1]}
    out[names[-1]] = total - sum(out.values())
    return out


def redistribute_shortfall(shortfall: int, surplus: dict[str, int]) -> dict[str, int]:
    """How many more each bucket gives, in proportion to its surplus; the last gives what remains, as far as it can."""
    out, remaining, total = {}, shortfall, sum(surplus.values())
    for i, (name, n) in enumerate(surplus.items()):
        share = remaining if i == len(surplus) - 1 else round(shortfall * n / total)
        out[name] = min(share, n, remaining)
        remaining -= out[name]
    return out


def sample_buckets(df: DataFrame, bucket: str, key: str, wanted: dict[str, int], seed: int) -> DataFrame:
    """Per bucket, the first so many rows in hash order; what a bucket lacks is taken from those with rows left."""
    held = dict(df.where(F.col(bucket).isin(*wanted)).groupBy(bucket).count().collect())  # a row per bucket
    over = {k: held[k] - v for k, v in wanted.items() if held.get(k, 0) > v}
    extra = redistribute_shortfall(sum(max(0, v - held.get(k, 0)) for k, v in wanted.items()), over)
    order = [(c, False) for c in (*hash_numbers(hash_order(seed, F.col(key))), F.col(key))]
    return first_by_bucket(df, bucket, {k: v + extra.get(k, 0) for k, v in wanted.items()}, order)


def workload(length: Column) -> Column:
    return 24576 * length + length * length


def shuffle_choices(choices: Column, seed: int, qid: Column) -> Column:
    """A permutation of an array that depends on seed and question alone."""
    keyed = F.transform(choices, lambda c, i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), qid.cast("string"), i.cast("string"))).alias("k"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda x: x["c"])


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = W.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def overlong_penalty(length: Column, longest: int, buffer: int, factor: float) -> Column:
    """min(-(length - (longest - buffer)) / buffer * factor, 0)."""
    return F.least(-(length - (longest - buffer)) / buffer * factor, F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def structure_ok(question: Column, truth: Column, choices: Column, kind: Column) -> Column:
    """Question and truth are there, with 4 to 8 choices; or with none, if the list is empty or the kind is qa_open."""
    n = F.coalesce(F.size(choices), F.lit(0))
    free = choices.isNotNull() | F.coalesce(F.lower(F.btrim(kind)) == "qa_open", F.lit(False))
    return question.isNotNull() & truth.isNotNull() & F.when(n > 0, n.between(4, 8)).otherwise(free)


def mid_eos(ids: Column, mask: Column, score: Column, eos: int) -> Column:
    """No score, and the token at the place of the mask's sum (the first at least) is the end."""
    place = F.greatest(F.aggregate(mask, F.lit(0), lambda a, x: a + x.cast("int")), F.lit(1))
    return score.isNull() & F.coalesce(F.try_element_at(ids, place) == eos, F.lit(False))


def drop_flat_groups(df: DataFrame, group: str, components: list[str], least: float = 1e-12) -> DataFrame:
    """Groups in which no component's population deviation is over ``least`` go."""
    spread = F.greatest(*[F.coalesce(F.stddev_pop(c), F.lit(0.0)) for c in components]) if len(components) > 1 else F.stddev_pop(components[0])
    kept = df.groupBy(group).agg(spread.alias("_spread")).where(F.col("_spread") > least).select(F.col(group).alias("_group"))
    return df.join(kept, F.col(group).eqNullSafe(F.col("_group")), "left_semi")
