"""Policy losses, importance weights and off-policy measures over a token table.

A token table has a row per token: row_idx, old, new, adv and mask (1 or 0), further columns as an operator says. All
losses are column expressions in one pass; what needs a sequence or the batch is a partial aggregate joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.order_stats import first_rows, hash_numbers

#: Bound of log ratios before exp().
SAFE = 20.0
Bounds = tuple[float, float]


def clamp(x: Column, low: float | None, high: float | None) -> Column:
    out = x if low is None else F.greatest(x, F.lit(float(low)))
    return out if high is None else F.least(out, F.lit(float(high)))


def masked_mean(x: Column | str, mask: Column | str = "mask") -> Column:
    """Aggregate: the mean over tokens with mask 1; null without any."""
    x, mask = (F.col(c) if isinstance(c, str) else c for c in (x, mask))
    return F.sum(x * mask) / F.nullif(F.sum(mask), F.lit(0))


def _with_sequence(tokens: DataFrame, row: str = "row_idx", **aggregates: Column) -> DataFrame:
    """Tokens with aggregates of their sequence: combined before the shuffle and joined back."""
    per_row = tokens.groupBy(row).agg(*[a.alias(name) for name, a in aggregates.items()])
    return tokens.join(per_row, row)


def agg_loss(tokens: DataFrame, loss: str = "loss", mode: str = "token-mean", scale: float | None = None) -> DataFrame:
    """One row with ``loss``. Sequences without any valid token count in no mean; ``scale`` is the width of the batch."""
    if mode == "token-mean":
        return tokens.agg(masked_mean(loss).alias("loss"))
    total, count = F.sum(F.col(loss) * F.col("mask")), F.sum("mask")
    if mode == "seq-mean-token-sum":
        return tokens.groupBy("row_idx").agg(total.alias("x"), count.alias("n")).agg(F.avg(F.when(F.col("n") > 0, F.col("x"))).alias("loss"))
    if mode == "seq-mean-token-mean":
        rows = tokens.groupBy("row_idx").agg((total / (count + 1e-8)).alias("x"), count.alias("n"))
        return rows.agg(F.avg(F.when(F.col("n") > 0, F.col("x"))).alias("loss"))
    if mode == "seq-mean-token-sum-norm":
        rows = tokens.groupBy("row_idx").agg(total.alias("x"), F.count(F.lit(1)).alias("width"))
        return rows.agg((F.sum("x") / (F.max("width") if scale is None else F.lit(scale))).alias("loss"))
    raise ValueError(f"unknown mode {mode!r}")


def _ratio(new: str = "new", old: str = "old", bound: float | None = SAFE) -> Column:
    delta = F.col(new) - F.col(old)
    return F.exp(delta if bound is None else clamp(delta, -bound, bound))


def vanilla(tokens: DataFrame, clip: Bounds = (0.2, 0.2), dual: float = 3.0) -> DataFrame:
    """Adds loss of the dual-clip objective, clipped and clipped_lower."""
    if dual <= 1:
        raise ValueError("dual must be over 1")
    ratio, adv = _ratio(), F.col("adv")
    plain, cut, bottom = -adv * ratio, -adv * clamp(ratio, 1 - clip[0], 1 + clip[1]), -adv * dual
    worst = F.greatest(plain, cut)
    return tokens.withColumns(
        {
            "loss": F.when(adv < 0, F.least(bottom, worst)).otherwise(worst),
            "clipped": (cut > plain).cast("double"),
            "clipped_lower": ((worst > bottom) & (adv < 0)).cast("double"),
        }
    )


def gspo(tokens: DataFrame, clip: Bounds = (0.2, 0.2)) -> DataFrame:
    """Adds loss and clipped by the ratio of whole sequences: exp of the mean log ratio of valid tokens."""
    mean = F.sum((F.col("new") - F.col("old")) * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1))
    ratio, adv = F.exp(clamp(F.col("mean_delta"), None, 10.0)), F.col("adv")
    plain, cut = -adv * ratio, -adv * clamp(ratio, 1 - clip[0], 1 + clip[1])
    out = _with_sequence(tokens, mean_delta=mean)
    return out.withColumns({"loss": F.greatest(plain, cut), "clipped": (cut > plain).cast("double")})


def sapo(tokens: DataFrame, tau_pos: float = 1.0, tau_neg: float = 1.05) -> DataFrame:
    """Adds loss through a smooth gate on the ratio, whose temperature goes by the advantage's sign."""
    tau = F.when(F.col("adv") > 0, F.lit(tau_pos)).otherwise(F.lit(tau_neg))
    gate = 4.0 / tau / (1 + F.exp(-tau * (_ratio() - 1.0)))
    return tokens.withColumn("loss", -gate * F.col("adv"))


def gpg_loss(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("loss", -F.col("new") * F.col("adv"))


def reinforce(tokens: DataFrame, weight: str | None = None) -> DataFrame:
    loss = -F.col("adv") * F.col("new")
    return tokens.withColumn("loss", loss if weight is None else loss * F.col(weight))


def cispo(tokens: DataFrame, clip: Bounds = (0.2, 0.2)) -> DataFrame:
    ratio = _ratio()
    cut = clamp(ratio, 1 - clip[0], 1 + clip[1])
    return tokens.withColumns({"loss": -cut * F.col("adv") * F.col("new"), "clipped": (ratio != cut).cast("double")})


def geo_mean(tokens: DataFrame, clip: Bounds = (0.2, 0.2)) -> DataFrame:
    """(row_idx, loss): one loss a sequence; the batch's is their plain mean."""
    delta, sign = F.col("new") - F.col("old"), F.signum("adv")
    least = sign * F.least(sign * delta, sign * clamp(delta, -clip[0], clip[1]))
    count = F.sum("mask") + 1e-8
    return tokens.groupBy("row_idx").agg((-F.sum(F.col("adv") * F.col("mask")) / count * F.exp(F.sum(least * F.col("mask")) / count)).alias("loss"))


def _covariance(tokens: DataFrame) -> DataFrame:
    """Adds cov: the product of a token's deviations of advantage and log probability from the batch's masked means."""
    means = tokens.agg(masked_mean("adv").alias("mean_adv"), masked_mean("new").alias("mean_new"), F.sum("mask").alias("n_valid"))
    # one row of means: its size is fixed
    return tokens.join(F.broadcast(means)).withColumn("cov", (F.col("adv") - F.col("mean_adv")) * (F.col("new") - F.col("mean_new")))


def _first_share(tokens: DataFrame, order: list[tuple[Column, bool]], tie: list[str], share: float) -> DataFrame:
    """The first max(1, floor(share * n_valid)) rows of a table by ``order``: a threshold, then the few at it by ties."""
    count = tokens.agg(F.max("n_valid").alias("n")).first()["n"]
    take = max(1, int(share * (count or 0)))
    return first_rows(tokens, [*order, *((F.col(t), False) for t in tie)], take)


def clip_cov(tokens: DataFrame, key: list[str], clip: Bounds = (0.2, 0.2), share: float = 2e-4, bounds: Bounds = (1.0, 5.0), seed: int = 0) -> DataFrame:
    """Adds loss and dropped: a random share of the tokens, whose covariance lies between bounds and that weren't clipped
    anyway, gets no loss. The draw goes by MD5 of seed and key, so that it can be repeated."""
    ratio, adv = _ratio(bound=None), F.col("adv")
    plain, cut = -adv * ratio, -adv * clamp(ratio, 1 - clip[0], 1 + clip[1])
    out = _covariance(tokens).withColumns({"loss": F.greatest(plain, cut), "clipped": cut > plain})
    fit = out.where((F.col("mask") > 0) & ~F.col("clipped") & (F.col("cov") > bounds[0]) & (F.col("cov") < bounds[1]))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    hit = _first_share(fit, [(c, False) for c in hash_numbers(draw)], key, share).select(*key, F.lit(True).alias("hit"))
    out = out.join(hit, key, "left").withColumn("dropped", F.coalesce("hit", F.lit(False)))
    return out.withColumn("loss", F.when(F.col("dropped"), 0.0).otherwise(F.col("loss"))).drop("hit")


def kl_cov(tokens: DataFrame, key: list[str], share: float = 2e-4, coefficient: float = 1.0) -> DataFrame:
    """Adds loss and penalised: the share of valid tokens with the largest covariance pays for its distance."""
    delta = F.col("new") - F.col("old")
    out = _covariance(tokens).withColumn("loss", -F.col("adv") * F.exp(delta))
    hit = _first_share(out.where("mask > 0"), [(F.round("cov", 9), True)], key, share).select(*key, F.lit(True).alias("hit"))
    out = out.join(hit, key, "left").withColumn("penalised", F.coalesce("hit", F.lit(False)))
    return out.withColumn("loss", F.col("loss") + F.when(F.col("penalised"), coefficient * F.abs(delta)).otherwise(0.0)).drop("hit")


def value_loss(tokens: DataFrame, clip: float = 0.5) -> DataFrame:
    """Adds loss (half the larger squared error of plain and clipped prediction) and clipped, of value, returns, base."""
    cut = F.greatest(F.col("base") - clip, F.least(F.col("base") + clip, F.col("value")))
    plain, clipped = F.pow(F.col("value") - F.col("returns"), 2), F.pow(cut - F.col("returns"), 2)
    return tokens.withColumns({"loss": 0.5 * F.greatest(plain, clipped), "clipped": (clipped > plain).cast("double")})


def kl_rewards(tokens: DataFrame, score: str, reference: str, beta: float) -> DataFrame:
    """Adds kl (masked) and reward, the score less beta * kl."""
    kl = (F.col("old") - F.col(reference)) * F.col("mask")
    return tokens.withColumn("kl", kl).withColumn("reward", F.col(score) - beta * F.col("kl"))


def adapt_coefficient(value: float, target: float, horizon: int, current: float, steps: int) -> float:
    """The next KL coefficient: moved by at most a fifth of steps / horizon towards the target."""
    return value * (1 + max(-0.2, min(0.2, current / target - 1)) * steps / horizon)


def importance_weights(tokens: DataFrame, level: str = "token", cap: float = 2.0, normalise: bool = False) -> DataFrame:
    """Adds raw_weight, weight (at most ``cap``, 0 where masked) and log_ratio of old over rollout, by token or sequence."""
    if level not in ("token", "sequence") or cap <= 0:
        raise ValueError("level is token or sequence, cap positive")
    delta = F.col("old") - F.col("rollout")
    if level == "token":
        out = tokens.withColumn("log_ratio", delta)
    else:
        out = _with_sequence(tokens, log_ratio=F.sum(delta * F.col("mask")))
    out = out.withColumn("raw_weight", F.exp(clamp(F.col("log_ratio"), -SAFE, SAFE)) * F.col("mask"))
    out = out.withColumn("weight", F.least("raw_weight", F.lit(float(cap))))
    if not normalise:
        return out
    if level == "token":
        mean = out.agg(masked_mean("weight").alias("mean_weight"))
    else:
        rows = out.groupBy("row_idx").agg(masked_mean("weight").alias("w"), F.sum("mask").alias("n"))
        mean = rows.agg(F.avg(F.when(F.col("n") > 0, F.col("w"))).alias("mean_weight"))
    scaled = F.when(F.col("mean_weight") > 1e-8, F.col("weight") / F.col("mean_weight")).otherwise(F.col("weight"))
    return out.join(F.broadcast(mean)).withColumn("weight", scaled).drop("mean_weight")  # one row


def weight_metrics(weighted: DataFrame, high: float, low: float | None = None) -> DataFrame:
    """One row of measures of raw_weight by token: mean, max, min, shares beyond the bounds, std and effective sample
    size of the weights held within them, and the same of the sequences' means."""
    low = 1.0 / high if low is None else low
    w, held = F.col("raw_weight"), clamp(F.col("raw_weight"), low, high)
    valid = F.col("mask") > 0
    by_token = weighted.agg(
        masked_mean("raw_weight").alias("mean"),
        F.max(F.when(valid, w)).alias("max"),
        F.min(F.when(valid, w)).alias("min"),
        masked_mean((w > high).cast("double")).alias("fraction_high"),
        masked_mean((w < low).cast("double")).alias("fraction_low"),
        masked_mean(held).alias("m1"),
        masked_mean(held * held).alias("m2"),
    )
    by_token = by_token.withColumns(
        {"std": F.sqrt(F.greatest(F.col("m2") - F.col("m1") * F.col("m1"), F.lit(0.0))), "eff_sample_size": F.pow(F.col("m1") + 1e-8, 2) / F.col("m2")}
    ).drop("m1", "m2")
    rows = weighted.groupBy("row_idx").agg(masked_mean("raw_weight").alias("w")).where("w is not null")
    by_row = rows.agg(
        F.avg("w").alias("seq_mean"),
        F.coalesce(F.stddev_samp("w"), F.lit(0.0)).alias("seq_std"),
        F.max("w").alias("seq_max"),
        F.min("w").alias("seq_min"),
        F.max(F.abs(F.col("w") - 1.0)).alias("seq_max_deviation"),
        F.avg((F.col("w") > high).cast("double")).alias("seq_fraction_high"),
        F.avg((F.col("w") < low).cast("double")).alias("seq_fraction_low"),
    )
    return by_token.join(F.broadcast(by_row))  # one row each


def offpolicy_metrics(tokens: DataFrame) -> DataFrame:
    """One row of distances between the policies ``old`` and ``rollout``: perplexities, kl, k3 and chi squared."""
    delta = F.col("old") - F.col("rollout")
    by_token = tokens.agg(
        masked_mean(-delta).alias("kl"),
        masked_mean(F.exp(delta) - delta - 1).alias("k3_kl"),
        (masked_mean(F.exp(2.0 * clamp(delta, -SAFE, SAFE))) - 1.0).alias("chi2_token"),
    )
    rows = tokens.groupBy("row_idx").agg(masked_mean("old").alias("t"), masked_mean("rollout").alias("r"), F.sum(delta * F.col("mask")).alias("s")).where("t is not null")
    diff = F.col("r") - F.col("t")
    by_row = rows.agg(
        F.avg(F.exp(-F.col("t"))).alias("training_ppl"),
        F.avg(-F.col("t")).alias("training_log_ppl"),
        F.avg(F.exp(-F.col("r"))).alias("rollout_ppl"),
        F.avg(-F.col("r")).alias("rollout_log_ppl"),
        F.avg(diff).alias("log_ppl_diff"),
        F.avg(F.abs(diff)).alias("log_ppl_abs_diff"),
        F.max(diff).alias("log_ppl_diff_max"),
        F.min(diff).alias("log_ppl_diff_min"),
        F.avg(F.exp(diff)).alias("ppl_ratio"),
        (F.avg(F.exp(2.0 * clamp(F.col("s"), -SAFE, SAFE))) - 1.0).alias("chi2_seq"),
    )
    return by_token.join(F.broadcast(by_row))  # one row each


def bypass(tokens: DataFrame, kind: str = "reinforce", cap: float = 2.0, veto: float | None = None) -> DataFrame:
    """The rollout policy stands for the old one: its ratio to ``new`` gives the weights; a sequence with a token whose
    ratio is under ``veto`` goes out. Adds loss and the mask that remains."""
    staged = tokens.withColumns({"rollout": F.col("old"), "kept_old": F.col("old"), "old": F.col("new")})
    staged = importance_weights(staged, "token", cap)
    if veto is not None:
        if veto <= 0:
            raise ValueError("veto must be positive")
        bad = F.max(((F.col("log_ratio") < F.log(F.lit(veto))) & (F.col("mask") > 0)).cast("int"))
        staged = _with_sequence(staged, bad=bad).withColumn("mask", F.when(F.col("bad") == 1, 0).otherwise(F.col("mask"))).drop("bad")
    staged = staged.withColumn("old", F.col("kept_old")).drop("kept_old")
    if kind == "reinforce":
        return reinforce(staged, "weight")
    if kind == "ppo_clip":
        return vanilla(staged)
    raise ValueError(f"unknown kind {kind!r}")


#: Losses by name: each takes a token table and adds its loss.
POLICY_LOSSES = {"vanilla": vanilla, "gspo": gspo, "sapo": sapo, "gpg": gpg_loss, "cispo": cispo, "reinforce": reinforce, "bypass_mode": bypass}


def register_policy_loss(name: str):
    """Add a loss of one's own; names are unique."""

    def add(f):
        if name in POLICY_LOSSES:
            raise ValueError(f"policy loss {name!r} is registered twice")
        POLICY_LOSSES[name] = f
        return f

    return add


def policy_loss(name: str, tokens: DataFrame, **options) -> DataFrame:
    if name not in POLICY_LOSSES:
        raise ValueError(f"unknown policy loss {name!r}; there are {sorted(POLICY_LOSSES)}")
    return POLICY_LOSSES[name](tokens, **options)


def mismatch(tokens: DataFrame, first: str, second: str) -> DataFrame:
    """One row: how many valid tokens differ, their correlation, mean and largest distance."""
    valid = F.col("mask") > 0
    a, b = F.when(valid, F.col(first)), F.when(valid, F.col(second))
    return tokens.agg(
        F.sum(F.when(valid & (F.col(first) != F.col(second)), 1).otherwise(0)).alias("differ"),
        F.corr(a, b).alias("pearson"),
        F.avg(F.abs(a - b)).alias("mean_distance"),
        F.max(F.abs(a - b)).alias("max_distance"),
    )


