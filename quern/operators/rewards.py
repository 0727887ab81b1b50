"""Reward components, their combination, penalties, and resampling by score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.filters import hash_order

# fixed value: the components a reward may have
COMPONENTS = ("influence_rewards", "spice_rewards", "invalid_rewards")


def check_structure(structure: list[dict]) -> dict[str, float]:
    """The weight of each component of groups of terms; unknown, repeated and empty ones are errors."""
    weights: dict[str, float] = {}
    if not structure:
        raise ValueError("a reward structure has a group at least")
    for group in structure:
        if not group.get("terms"):
            raise ValueError("a group has a term at least")
        for term in group["terms"]:
            name = str(term["name"])
            if name not in COMPONENTS:
                raise ValueError(f"unknown component {name!r}; there are {COMPONENTS}")
            if name in weights:
                raise ValueError(f"component {name!r} occurs twice")
            weights[name] = float(term.get("weight", 1.0))
    return weights


def dense_payload(valid: DataFrame, parts: dict[str, DataFrame], key: str, weights: dict[str, float]) -> DataFrame:
    """Each valid question with each component (0 where it is missing) and their weighted sum ``combined``."""
    out = valid.select(key).distinct()
    for name, table in parts.items():
        out = out.join(table.select(key, F.col("reward").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    total = sum((F.col(n) * w for n, w in weights.items() if n in parts), F.lit(0.0))
    return out.withColumn("combined", total)


def normalise_payload(rewards: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    """Rewards for all valid questions and no others; those that have none get 0."""
    return valid.select(key).distinct().join(rewards.select(key, "reward"), key, "left").withColumn("reward", F.coalesce("reward", F.lit(0.0)))


def combined(valid: Column, parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted sum of the components; rows that aren't valid get only the penalty component."""
    term = lambda n: parts[n] * weights.get(n, 1.0)
    every = sum((term(n) for n in parts), F.lit(0.0))
    return F.when(valid, every).otherwise(term("invalid_rewards") if "invalid_rewards" in parts else F.lit(0.0))


def with_bonus(score: Column, opener: Column, mid_eos: Column, bonus: float, penalty: float) -> Column:
    """The score (null as 0) with a formatting bonus for one opener and a penalty for an early end of sequence."""
    return F.coalesce(score, F.lit(0.0)) + F.when(opener == "alright", bonus).otherwise(0.0) + F.when(mid_eos, penalty).otherwise(0.0)


def preconditioned(gradient: Column, reference: Column, second_moment: Column, epsilon: float = 1e-8) -> dict[str, Column]:
    """Dot product and cosine of a gradient scaled by 1 / (sqrt(second moment) + epsilon) with a reference."""
    scaled = F.zip_with(gradient, second_moment, lambda g, v: g / (F.sqrt(v) + epsilon))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12))
    score = dot(scaled, reference)
    return {"preconditioned_dot": score, "preconditioned_cosine": score / (norm(scaled) * norm(reference))}


def resample_weights(df: DataFrame, score: str, method: str, power: float = 2.0) -> DataFrame:
    """Adds weight by method pow, max_min or max_random."""
    if method == "pow":
        return df.withColumn("weight", F.greatest(F.pow(F.abs(score), F.lit(power)) + 1e-8, F.lit(1e-8)))
    ends = df.agg(F.min(score).alias("lowest"), F.max(score).alias("highest"))
    out = df.join(F.broadcast(ends))  # one row
    if method == "max_min":
        weight = F.when((F.col(score) == F.col("highest")) | (F.col(score) == F.col("lowest")), 1.0).otherwise(0.0)
    elif method == "max_random":
        weight = F.when(F.col(score) == F.col("highest"), 0.4).otherwise(0.1)
    else:
        raise ValueError(f"unknown method {method!r}")
    return out.withColumn("weight", weight + 1e-8).drop("lowest", "highest")


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of an MD5."""
    return F.conv(F.substring(hash_order(seed, key), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


#: Consecutive keys in a block, within which cumulative weights are summed in order.
BLOCK = 4096


def resample(df: DataFrame, key: str, weight: str, seed: int) -> DataFrame:
    """As many draws with replacement as there are rows, in proportion to weight: the rows, with ``draw`` from 0.

    A draw is a point of [0, total), a row an interval of it by integer ``key`` order. Intervals come from sums of blocks
    and sums within a block, so no task orders all rows; points meet intervals in equal bins, not in a cross join.
    """
    blocked = df.withColumn("_block", F.floor(F.col(key) / BLOCK))
    sums = blocked.groupBy("_block").agg(F.sum(weight).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    # one row a block, 1 / BLOCK of the keys' range
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    total = sums.agg(F.sum("_sum").alias("_total"), F.sum("_n").alias("_rows"))
    inside = W.partitionBy("_block").orderBy(key)
    high = F.col("_before") + F.sum(weight).over(inside)
    staged = blocked.join(before.select("_block", "_before"), "_block").withColumn("_high", high).withColumn("_low", F.col("_high") - F.col(weight))
    staged = staged.join(F.broadcast(total))  # one row
    bin_of = lambda x: F.floor(x / F.col("_total") * F.greatest(F.col("_rows") / 64, F.lit(1.0)))
    intervals = staged.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_low")), bin_of(F.col("_high")))))
    numbers = df.sparkSession.range(0, df.count()).select(F.col("id").alias("draw"))
    points = numbers.join(F.broadcast(total)).withColumn("_x", draw(F.col("draw"), seed) * F.col("_total")).withColumn("_bin", bin_of(F.col("_x")))
    hit = points.select("draw", "_x", "_bin").join(intervals, "_bin").where((F.col("_x") >= F.col("_low")) & (F.col("_x") < F.col("_high")))
    return hit.select(*df.columns, "draw")
