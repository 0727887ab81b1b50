"""Orders, quotas, curricula and balanced partitions. Random orders are MD5 orders that any engine repeats."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.filters import hash_order
from quern.operators.order_stats import first_by_bucket, first_rows, hash_numbers
from quern.session import materialise


def scatter_order(row: Column, rollouts: int, ranks: int) -> Column:
    """The place of a row in rank-interleaved order: rank, then question, then answer within the rank's share."""
    if rollouts % ranks:
        raise ValueError("rollouts must be divisible by ranks")
    share = rollouts // ranks
    return F.struct(F.floor(row % rollouts / share).alias("rank"), F.floor(row / rollouts).alias("question"), (row % share).alias("answer"))


def epoch_batches(df: DataFrame, key: str, seed: int, epoch: int, size: int) -> DataFrame:
    """Adds epoch, place and batch: a permutation that is a function of (seed, epoch) alone, cut into batches that run on
    over the ends of epochs. To resume is to take the batches from a number on."""
    total = df.count()
    ordered = df.withColumn("_order", hash_order(f"{seed}:{epoch}", F.col(key)))
    placed = number_rows(ordered, ["_order", key], "place").drop("_order")
    return placed.withColumn("epoch", F.lit(epoch)).withColumn("batch", F.floor((F.col("place") + epoch * total) / size))


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the place of a row from 0 in a total order: ranges are sorted apart, only their sizes meet.

    The sorted ranges are written once, with the number of their task and of each row in it: sizes and rows then come from the
    same ranges, whatever is planned, reused or run again.
    """
    part, own = "_number_part", "_number_in"
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialise(ordered.withColumn(own, F.monotonically_increasing_id()).withColumn(part, F.spark_partition_id()), "numbered")
    sizes = numbered.groupBy(part).agg(F.count(F.lit(1)).alias("_n"), F.min(own).alias("_first"))
    # one row a partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = numbered.join(F.broadcast(before.select(part, (F.col("_before") - F.col("_first")).alias("_number_shift"))), part)
    return placed.withColumn(name, F.col(own) + F.col("_number_shift")).select(*df.columns, name)


def equal_quotas(sizes: dict[str, int], total: int) -> dict[str, int]:
    """Equal quotas by field; what small fields lack goes to the others, again and again, in order of their names."""
    if not sizes:
        return {}
    spread = lambda n, names: {f: n // len(names) + (i < n % len(names)) for i, f in enumerate(names)}
    quota, active = spread(total, sorted(sizes)), sorted(sizes)
    while True:
        short = [f for f in active if sizes[f] < quota[f]]
        lack = sum(quota[f] - sizes[f] for f in short)
        quota |= {f: sizes[f] for f in short}
        active = [f for f in active if f not in short]
        if not lack or not active:
            return quota
        for f, more in spread(lack, active).items():
            quota[f] += more


def take_quotas(df: DataFrame, bucket: str, key: str, quotas: dict[str, int], seed: int) -> DataFrame:
    """``quotas`` rows of each bucket in hash order."""
    return first_by_bucket(df, bucket, quotas, _hashed(seed, key))


def _hashed(seed: int | str, key: str) -> list[tuple[Column, bool]]:
    """Hash order, and by key among equal hashes."""
    return [(c, False) for c in (*hash_numbers(hash_order(seed, F.col(key))), F.col(key))]


def balanced(df: DataFrame, bucket: str, key: str, total: int, seed: int) -> DataFrame:
    """A sample with equal quotas by bucket; the sizes of buckets, one row each, come to the driver."""
    sizes = {r[0]: r[1] for r in df.groupBy(bucket).count().collect() if r[0] is not None}
    return take_quotas(df, bucket, key, equal_quotas(sizes, total), seed)


def curriculum(dev: DataFrame, history: DataFrame, pool: DataFrame, used: DataFrame, key: str, bottom: float, top: float, seed: int) -> DataFrame:
    """The next development set: (key, origin). The shares with least and most mean accuracy (0.5 without history) go, and
    as many of the pool come, that were neither used nor stay. Ties go by key."""
    means = history.groupBy(key).agg(F.avg("accuracy").alias("mean"))
    rated = dev.select(key).join(means, key, "left").withColumn("mean", F.coalesce("mean", F.lit(0.5)))
    n = rated.count()
    low, high = int(n * bottom), int(n * top)
    placed = number_rows(rated, ["mean", key], "place")
    gone = placed.where((F.col("place") < low) | (F.col("place") >= n - high))
    stays = placed.where((F.col("place") >= low) & (F.col("place") < n - high)).select(key, F.lit("kept").alias("origin"))
    free = pool.select(key).join(used.select(key), key, "left_anti").join(gone.select(key), key, "left_anti").join(stays.select(key), key, "left_anti")
    new = first_rows(free, _hashed(seed, key), low + high).select(key, F.lit("pool").alias("origin"))
    return stays.unionByName(new)


def subsample(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    return first_rows(df, _hashed(seed, key), size)


def balance_report(assigned: DataFrame, part: str, length: str) -> DataFrame:
    """One row: least, largest and mean sum of the parts, and their spread."""
    sums = assigned.groupBy(part).agg(F.sum(length).alias("s"))
    return sums.agg(F.min("s").alias("least"), F.max("s").alias("most"), (F.max("s") - F.min("s")).alias("spread"), F.avg("s").alias("mean"))


def snake_parts(df: DataFrame, length: str, key: str, parts: int) -> DataFrame:
    """Adds part: rows by falling length go to the parts there and back, so that sums and counts stay nearly equal at any
    size without any task that sees all rows."""
    ranked = number_rows(df.withColumn("_neg", -F.col(length)), ["_neg", key], "_place").drop("_neg")
    lap, at = F.floor(F.col("_place") / parts), (F.col("_place") % parts).cast("int")
    return ranked.withColumn("part", F.when(lap % 2 == 0, at).otherwise(parts - 1 - at)).drop("_place")


def capped_batches(df: DataFrame, length: str, key: str, cap: int) -> DataFrame:
    """Adds part: as many balanced parts as the sum of lengths needs under a cap of tokens each."""
    total = df.agg(F.sum(length)).first()[0] or 0
    return snake_parts(df, length, key, max(1, -(-total // cap)))


def reverse_index(df: DataFrame, position: str, source: str) -> DataFrame:
    """The inverse of a permutation: for each source row, where it went."""
    return df.select(F.col(source).alias(position), F.col(position).alias(source))


def replicate(pool: DataFrame, key: str, total: int) -> DataFrame:
    """``total`` documents by taking the pool's rows in turn, in order of key: adds doc."""
    placed = number_rows(pool, [key], "_place")
    n = pool.count()
    rounds = F.floor((F.lit(total - 1) - F.col("_place")) / n)
    return placed.where(F.col("_place") < total).select(*pool.columns, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), rounds), lambda k: F.col("_place") + k * n)).alias("doc"))


def truncated(df: DataFrame, row: str, workers: int) -> DataFrame:
    """Rows up to the largest multiple of the number of workers."""
    n = df.count()
    return df.where(F.col(row) < n - n % workers)


# fixed values: other spellings of modes
ALIASES = {"randomone": "random_one", "topone": "top_one", "random_1": "random_one", "top_1": "top_one", "topalpha": "top_alpha", "randomalpha": "random_alpha"}
MODES = ("none", "random_one", "top_one", "top_alpha", "random_alpha")


def filter_mode(value: object) -> str:
    """A mode's plain name; top_<i> and random_<i> need i of 1 or more."""
    mode = re.sub("[- ]", "_", str(value).strip().lower()).replace("__", "_")
    mode = ALIASES.get(mode, mode)
    numbered = re.fullmatch(r"(?:top|random)_(\d+)", mode)
    if mode not in MODES and not (numbered and int(numbered[1]) >= 1):
        raise ValueError(f"unknown filter mode {value!r}")
    return mode


def keep_count(mode: object) -> int | None:
    """Rows that a mode keeps of each document; None if it has no such number."""
    name = filter_mode(mode)
    return 1 if name in ("top_one", "random_one") else int(name.rsplit("_", 1)[1]) if name[-1].isdigit() else None


def target_count(total: int, alpha: float) -> int:
    """ceil(alpha * total); nothing for no questions or no share."""
    return 0 if total <= 0 or alpha <= 0 else int(-(-alpha * total // 1))
