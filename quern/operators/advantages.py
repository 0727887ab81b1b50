"""Group-normalised advantages. A row is a rollout with a scalar score; ``group`` is its question.

All take a table and give it back with a column ``advantage``. Windows aggregate per group with partial sums; a group of
one has its rule stated in each function. Statistics that span the batch come from a one-row aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.order_stats import quantiles

EPSILON = 1e-6

ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def estimator(name: str):
    """Register an estimator under a unique name."""

    def add(f):
        if name in ESTIMATORS:
            raise ValueError(f"estimator {name} exists")
        ESTIMATORS[name] = f
        return f

    return add


def estimate(name: str, df: DataFrame, **options) -> DataFrame:
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name}; known: {sorted(ESTIMATORS)}")
    return ESTIMATORS[name](df, **options)


def _grouped(df: DataFrame, group: str, **figures: Column) -> DataFrame:
    """The rows with figures of their group: partial sums and a join, so that no task has to hold a group, however large.

    Rows without a group are one group.
    """
    per = df.groupBy(F.col(group).alias("_group")).agg(*[c.alias(name) for name, c in figures.items()])
    return df.join(per, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def _mean_std(score: str, mean: str = "_mean", std: str = "_std") -> dict[str, Column]:
    """Mean and sample deviation of a group; (0, 1) for a single row."""
    single = F.count(score) == 1
    return {mean: F.when(single, 0.0).otherwise(F.avg(score)), std: F.when(single, 1.0).otherwise(F.stddev_samp(score))}


@estimator("grpo")
def grpo(df: DataFrame, score: str = "score", group: str = "group", mode: str = "group_std") -> DataFrame:
    """(score - mean) / (deviation + eps). mode: group_std, batch_std, hybrid_std (mean of nonzero group deviations), none."""
    staged = _grouped(df, group, **_mean_std(score))
    if mode == "group_std":
        scale = F.col("_std") + EPSILON
    elif mode == "none":
        scale = F.lit(1.0)
    elif mode == "batch_std":
        total = df.agg(F.coalesce(F.stddev_samp(score), F.lit(1.0)).alias("_scale"))
        staged, scale = staged.join(F.broadcast(total)), F.col("_scale") + EPSILON  # one row
    elif mode == "hybrid_std":
        groups = df.groupBy(group).agg(F.when(F.count(score) == 1, 1.0).otherwise(F.stddev_samp(score)).alias("s"))
        total = groups.where("s > 0").agg(F.coalesce(F.avg("s"), F.lit(1.0)).alias("_scale"))
        staged, scale = staged.join(F.broadcast(total)), F.col("_scale") + EPSILON  # one row
    else:
        raise ValueError(f"unknown mode {mode}")
    return staged.select(*df.columns, ((F.col(score) - F.col("_mean")) / scale).alias("advantage"))


@estimator("grpo_vectorized")
def grpo_vectorized(df: DataFrame, score: str = "score", group: str = "group") -> DataFrame:
    """As grpo, from sums and sums of squares, with the variance floored at eps; a single row has (0, 1)."""
    staged = _grouped(df, group, _n=F.count(score), _s=F.sum(score), _q=F.sum(F.col(score) * F.col(score)))
    n, s, q = F.col("_n"), F.col("_s"), F.col("_q")
    variance = F.greatest((q - s * s / n) / (n - 1), F.lit(EPSILON))
    value = F.when(n == 1, F.col(score) / (1 + EPSILON)).otherwise((F.col(score) - s / n) / (F.sqrt(variance) + EPSILON))
    return staged.select(*df.columns, value.alias("advantage"))


@estimator("grpo_passk")
def grpo_passk(df: DataFrame, score: str = "score", group: str = "group", order: str = "row_idx") -> DataFrame:
    """Only a group's best row (the first by ``order`` among equals) gets (best - second) / (deviation + eps)."""
    best = _grouped(df, group, _first=F.min_by(order, F.struct(-F.col(score), order)), _std=F.stddev_samp(score))
    first = F.col(order) == F.col("_first")
    second = best.where(~first).groupBy(F.col(group).alias("_group")).agg(F.max(score).alias("_second"))
    both = best.join(second, F.col(group).eqNullSafe(F.col("_group")), "left")
    gap = (F.col(score) - F.col("_second")) / (F.col("_std") + EPSILON)
    return both.select(*df.columns, F.when(first, F.coalesce(gap, F.lit(0.0))).otherwise(0.0).alias("advantage"))


@estimator("rloo")
def rloo(df: DataFrame, score: str = "score", group: str = "group") -> DataFrame:
    """Score less the mean of the others: (score - mean) n / (n - 1); a single row keeps its score."""
    staged = _grouped(df, group, _n=F.count(score), _s=F.sum(score))
    rest = (F.col("_s") - F.col(score)) / F.nullif(F.col("_n") - 1, F.lit(0))
    return staged.select(*df.columns, (F.col(score) - F.coalesce(rest, F.lit(0.0))).alias("advantage"))


@estimator("rloo_vectorized")
def rloo_vectorized(df: DataFrame, score: str = "score", group: str = "group") -> DataFrame:
    """As rloo, but a single row gets 0."""
    staged, n = _grouped(df, group, _n=F.count(score), _s=F.sum(score)), F.col("_n")
    value = F.when(n > 1, (n * F.col(score) - F.col("_s")) / F.nullif(n - 1, F.lit(0))).otherwise(0.0)
    return staged.select(*df.columns, value.alias("advantage"))


@estimator("opo")
def opo(df: DataFrame, score: str = "score", group: str = "group", length: str = "length") -> DataFrame:
    """Score less the length-weighted mean of the group; a single row keeps its score."""
    staged = _grouped(df, group, _n=F.count(score), _base=F.sum(F.col(length) * F.col(score)) / F.sum(length))
    return staged.select(*df.columns, (F.col(score) - F.when(F.col("_n") == 1, 0.0).otherwise(F.col("_base"))).alias("advantage"))


@estimator("gpg")
def gpg(df: DataFrame, score: str = "score", group: str = "group", f_norm: float = 1.0) -> DataFrame:
    """alpha (score - mean) / f_norm, alpha being rows over rows with a nonzero score (1 at least)."""
    total = df.agg((F.count(score) / F.greatest(F.lit(1), F.count_if(F.col(score) != 0))).alias("_alpha"))
    staged = _grouped(df, group, **_mean_std(score)).join(F.broadcast(total))  # one row
    return staged.select(*df.columns, (F.col("_alpha") * (F.col(score) - F.col("_mean")) / f_norm).alias("advantage"))


@estimator("reinforce_plus_plus_baseline")
def reinforce_baseline(df: DataFrame, score: str = "score", group: str = "group", length: str = "length") -> DataFrame:
    """Score less the group mean, whitened over all valid tokens: each row counts with its length."""
    staged = _grouped(df, group, **_mean_std(score)).withColumn("_x", F.col(score) - F.col("_mean"))
    return _whiten(staged, F.col("_x"), F.col(length)).select(*df.columns, F.col("_white").alias("advantage"))


def _whiten(df: DataFrame, value: Column, weight: Column) -> DataFrame:
    """(value - mean) / sqrt(var + 1e-8) over weighted rows; the variance has Bessel's factor over the summed weight."""
    sums = df.agg(
        F.sum(weight).alias("_n"), F.sum(value * weight).alias("_s"), F.sum(value * value * weight).alias("_q")
    ).select(
        (F.col("_s") / F.col("_n")).alias("_m"),
        ((F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")) / (F.col("_n") - 1)).alias("_v"),
    )
    return df.join(F.broadcast(sums)).withColumn("_white", (value - F.col("_m")) / F.sqrt(F.col("_v") + 1e-8))  # one row


def whiten(df: DataFrame, value: str, weight: str) -> DataFrame:
    return _whiten(df, F.col(value), F.col(weight)).select(*df.columns, F.col("_white").alias("advantage"))


def gae_advantages(df: DataFrame, key: str, rewards: str, values: str, mask: str, gamma: float, lam: float) -> DataFrame:
    """A row per token: key, pos from 0, advantage (whitened over all tokens with mask 1) and returns (before that, plus values)."""
    raw = gae(F.col(rewards), F.col(values), F.col(mask), gamma, lam)
    zipped = F.arrays_zip(raw.alias("a"), F.col(values).alias("v"), F.col(mask).alias("m"))
    tokens = df.select(key, F.posexplode(zipped).alias("pos", "t")).select(key, "pos", F.col("t.a").alias("a"), F.col("t.v").alias("v"), F.col("t.m").alias("m"))
    return _whiten(tokens, F.col("a"), F.col("m")).select(key, "pos", F.col("_white").alias("advantage"), (F.col("a") + F.col("v")).alias("returns"))


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """Per token, the reverse discounted sum; the carry is reset where the mask is 0."""

    def step(acc: Column, x: Column) -> Column:
        r = x["r"] + gamma * acc["carry"]
        return F.struct((r * x["m"]).alias("carry"), F.concat(F.array(r), acc["out"]).alias("out"))

    zipped = F.reverse(F.arrays_zip(rewards.alias("r"), mask.alias("m")))
    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def suffix_sums(rewards: Column, mask: Column) -> Column:
    """Per token, the sum of masked rewards from it on."""
    masked = F.zip_with(rewards, mask, lambda r, m: r * m)
    start = F.array().cast("array<double>")
    return F.aggregate(
        F.reverse(masked), start, lambda acc, x: F.concat(F.array(x + F.coalesce(F.get(acc, F.lit(0)), F.lit(0.0))), acc)
    )


def gae(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages before whitening, by a masked reverse recursion over tokens."""

    def step(acc: Column, x: Column) -> Column:
        delta = x["r"] + gamma * acc["next"] - x["v"]
        a = delta + gamma * lam * acc["a"]
        on = x["m"] > 0
        return F.struct(
            F.when(on, x["v"]).otherwise(acc["next"]).alias("next"),
            F.when(on, a).otherwise(acc["a"]).alias("a"),
            F.concat(F.array(F.when(on, a).otherwise(acc["a"])), acc["out"]).alias("out"),
        )

    zipped = F.reverse(F.arrays_zip(rewards.alias("r"), values.alias("v"), mask.alias("m")))
    start = F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("a"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def kl(logprob: Column, ref: Column, kind: str = "k1") -> Column:
    """Estimators of the divergence per token: k1, abs, k2 (mse), k3 (low variance, clamped)."""
    d = logprob - ref
    if kind in ("k1", "kl"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("k2", "mse"):
        return 0.5 * d * d
    if kind in ("k3", "low_var_kl"):
        back = F.least(F.greatest(-d, F.lit(-20.0)), F.lit(20.0))
        return F.least(F.greatest(F.exp(back) - back - 1, F.lit(-10.0)), F.lit(10.0))
    raise ValueError(f"unknown kind {kind}")


def quantise(df: DataFrame, score: str, mode: str) -> DataFrame:
    """1bit: 1 for positive scores, else 0. 2bit: -1, -0.1, 0.1 or 1 by sign and the lower median of absolute scores."""
    x = F.col(score)
    if mode == "1bit":
        return df.withColumn("quantised", (x > 0).cast("double"))
    if mode != "2bit":
        raise ValueError(f"unknown mode {mode}")
    t = F.lit(quantiles(df, F.abs(score), [0.5], lower=True)[0])
    level = F.when(x >= t, 1.0).when(x > 0, 0.1).when(x > -t, -0.1).otherwise(-1.0)
    return df.withColumn("quantised", level)


def decoupled(df: DataFrame, scores: dict[str, float], group: str = "group") -> DataFrame:
    """Each component normalised per group as grpo, weighted, summed, and standardised over the batch."""
    total, figures = F.lit(0.0), {}
    for i, (name, weight) in enumerate(scores.items()):
        figures |= _mean_std(name, f"_mean{i}", f"_std{i}")
        total = total + weight * ((F.col(name) - F.col(f"_mean{i}")) / (F.col(f"_std{i}") + EPSILON))
    staged = _grouped(df, group, **figures).withColumn("_sum", total)
    batch = staged.agg(F.avg("_sum").alias("_m"), F.coalesce(F.stddev_samp("_sum"), F.lit(0.0)).alias("_s"))
    joined = staged.join(F.broadcast(batch))  # one row
    return joined.select(*df.columns, ((F.col("_sum") - F.col("_m")) / (F.col("_s") + 1e-8)).alias("advantage"))


def reinforce_plus_plus(df: DataFrame, key: str, rewards: str, mask: str, gamma: float) -> DataFrame:
    """A row per token: key, pos from 0, advantage (the return whitened over all tokens with mask 1, and 0 elsewhere), returns."""
    zipped = F.arrays_zip(discounted_returns(F.col(rewards), F.col(mask), gamma).alias("x"), F.col(mask).alias("m"))
    tokens = df.select(key, F.posexplode(zipped).alias("pos", "t")).select(key, "pos", F.col("t.x").alias("x"), F.col("t.m").alias("m"))
    return _whiten(tokens, F.col("x"), F.col("m")).select(key, "pos", (F.col("_white") * F.col("m")).alias("advantage"), F.col("x").alias("returns"))


def remax(rewards: Column, baseline: Column, mask: Column) -> Column:
    """Per token, the rewards from there on, less a baseline where the mask is 1."""
    return F.zip_with(suffix_sums(rewards, mask), mask, lambda x, m: x - baseline * m)
