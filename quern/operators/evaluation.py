"""Summaries of evaluations and rollouts, in long form: (metric, value), so that none of them is a wide row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.aggregates import pass_at_k
from quern.operators.order_stats import quantiles


def long_form(row: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The columns of a table but ``keys`` as rows (metric, value)."""
    names = [c for c in row.columns if c not in keys]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return row.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.metric", "p.value")


def _share(x: Column, of: Column) -> Column:
    return F.coalesce(x / F.nullif(of, F.lit(0)), F.lit(0.0))


def _per_question(df: DataFrame, group: str, score: str) -> DataFrame:
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(score).alias("valid"),
        F.count_if(F.col(score) > 0).alias("right"),
        F.min(F.coalesce(score, F.lit(0.0))).alias("low"),
        F.max(F.coalesce(score, F.lit(0.0))).alias("high"),
    )


def ladder(n: int, with_n: bool = False) -> list[int]:
    """1, 2, 4, ... up to n, and n itself if asked for."""
    steps = [1 << i for i in range(n.bit_length()) if 1 << i <= n]
    return steps + [n] * (with_n and n not in steps)


def evaluation_summary(df: DataFrame, group: str, score: str, length: str, samples: int) -> DataFrame:
    """Counts, strict and lenient accuracy and pass@k (a question with fewer than k answers counts 0), shares of
    questions by right and by missing answers from 0 to ``samples``, length statistics and the primary metric."""
    q = _per_question(df, group, score)
    total, valid, right = F.sum("n"), F.sum("valid"), F.sum("right")
    counts = {
        "total_questions": F.count(F.lit(1)),
        "total_answers": total,
        "valid_answers": valid,
        "failed_extractions": total - valid,
        "correct_answers": right,
        "accuracy_lenient": _share(right, valid),
        "accuracy_strict": _share(right, total),
        "primary_metric_value": _share(right, total),
    }
    for k in ladder(samples):
        counts[f"pass_at_{k}_strict"] = F.avg(pass_at_k(F.col("n"), F.col("right"), k))
        counts[f"pass_at_{k}_lenient"] = F.avg(pass_at_k(F.col("valid"), F.col("right"), k))
    for k in range(samples + 1):
        counts[f"correct_{k}"] = F.avg((F.col("right") == k).cast("double"))
        counts[f"none_{k}"] = F.avg((F.col("n") - F.col("valid") == k).cast("double"))
    lengths = df.agg(
        F.avg(length).alias("length_mean"), F.coalesce(F.stddev_samp(length), F.lit(0.0)).alias("length_std"), F.min(length).alias("length_min"), F.max(length).alias("length_max")
    )
    return long_form(q.agg(*[v.alias(k) for k, v in counts.items()])).unionByName(long_form(lengths))


def rollout_summary(df: DataFrame, group: str, score: str, samples: int, length: str | None = None) -> DataFrame:
    """As above for rollouts: pass@k leaves out questions with fewer than k answers, k also takes ``samples`` itself, and
    the share of questions with unequal scores is told."""
    q = _per_question(df, group, score)
    total, valid, right = F.sum("n"), F.sum("valid"), F.sum("right")
    counts = {
        "accuracy_strict": _share(right, total),
        "accuracy_lenient": _share(right, valid),
        "num_questions": F.count(F.lit(1)),
        "num_generated_answers": total,
        "num_valid_answers": valid,
        "num_invalid_answers": total - valid,
        "frac_valid_answers": _share(valid, total),
        "frac_diverse_questions": F.avg((F.col("low") != F.col("high")).cast("double")),
    }
    for k in ladder(samples, with_n=True):
        counts[f"pass_at_{k}_strict"] = F.coalesce(F.avg(pass_at_k(F.col("n"), F.col("right"), k, None)), F.lit(0.0))
        counts[f"pass_at_{k}_lenient"] = F.coalesce(F.avg(pass_at_k(F.col("valid"), F.col("right"), k, None)), F.lit(0.0))
    out = long_form(q.agg(*[v.alias(k) for k, v in counts.items()]))
    if length is None:
        return out
    lengths = df.agg(F.avg(length).alias("length_mean"), F.min(length).alias("length_min"), F.max(length).alias("length_max"))
    return out.unionByName(long_form(lengths))


def code_summary(df: DataFrame, status: str, compiled: str, ran: str, passed: str) -> DataFrame:
    """Shares of program runs that compile, run and pass, and a count for each status; null flags count as no."""
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    total = F.count(F.lit(1))
    rates = df.agg(
        total.alias("total_exec_samples"),
        yes(passed).alias("passed_exec_samples"),
        yes(compiled).alias("compile_ok_samples"),
        yes(ran).alias("runtime_ok_samples"),
        _share(yes(compiled), total).alias("compile_ok_rate"),
        _share(yes(ran), total).alias("runtime_ok_rate"),
        _share(yes(passed), total).alias("runtime_pass_rate"),
    )
    kinds = df.groupBy(F.concat(F.lit("status_"), F.coalesce(status, F.lit("unknown"))).alias("metric")).agg(total.cast("double").alias("value"))
    return long_form(rates).unionByName(kinds)


def within_questions(df: DataFrame, group: str, kind: str, value: str) -> DataFrame:
    """By class: the mean over questions of the class's mean, and of its deviation from the question's mean where another
    class has values too, with the number of questions behind each."""
    seen = df.where(F.col(value).isNotNull())
    per = seen.groupBy(group, kind).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    question = per.groupBy(group).agg((F.sum("s") / F.sum("n")).alias("mean"), F.count(F.lit(1)).alias("kinds"))
    both = per.join(question, group)
    own, mixed = F.col("s") / F.col("n"), F.col("kinds") > 1
    return both.groupBy(kind).agg(
        F.avg(own).alias("within_q_mean"),
        F.coalesce(F.avg(F.when(mixed, own - F.col("mean"))), F.lit(0.0)).alias("minus_q_mean"),
        F.count(F.lit(1)).alias("n_questions"),
        F.count_if(mixed).alias("n_mixed_questions"),
    )


def class_advantages(df: DataFrame, group: str, kind: str, advantage: str) -> DataFrame:
    """By class: mean and count of advantages, share and count of questions, and the same within questions."""
    total = df.agg(F.count_distinct(group).alias("total"))
    flat = df.groupBy(kind).agg(F.avg(advantage).alias("advantage_mean"), F.count(F.lit(1)).alias("advantage_count"), F.count_distinct(group).alias("q_count"))
    flat = flat.join(F.broadcast(total)).withColumn("q_share", F.col("q_count") / F.col("total")).drop("total")  # one row
    return flat.join(within_questions(df, group, kind, advantage), kind)


def loop_summary(loops: DataFrame, loop: str, reward: str, score: str, question: str) -> DataFrame:
    """Over all loops: how many there are, mean reward, questions of each loop, mean of scores that aren't null."""
    return long_form(
        loops.agg(
            F.count_distinct(loop).alias("num_gen_loops"),
            F.coalesce(F.avg(reward), F.lit(0.0)).alias("mean_reward"),
            F.count_distinct(loop, question).alias("total_questions_generated"),
            F.coalesce(F.avg(score), F.lit(0.0)).alias("mean_gen_accuracy"),
        )
    )


def training_metrics(tokens: DataFrame, row: str = "row_idx", width: int = 0) -> DataFrame:
    """Of a token table with reward, adv, returns, value and mask: sequence sums over rows with any valid token,
    distributions over valid tokens, explained variance of the value, lengths and the shares cut off or aborted."""
    rows = tokens.groupBy(row).agg(F.sum("reward").alias("reward"), F.sum("mask").alias("length"))
    alive = F.col("length") > 0
    stats = [(f, name) for f, name in ((F.avg, "mean"), (F.max, "max"), (F.min, "min"))]
    by_row = rows.agg(
        *[f(F.when(alive, F.col("reward"))).alias(f"rewards_{n}") for f, n in stats],
        *[f("length").alias(f"response_length_{n}") for f, n in stats],
        *[f(F.when(alive, F.col("length"))).alias(f"non_aborted_length_{n}") for f, n in stats],
        F.avg((F.col("length") == width).cast("double")).alias("response_length_clip_ratio"),
        F.avg((~alive).cast("double")).alias("aborted_ratio"),
    )
    valid = lambda c: F.when(F.col("mask") > 0, c)
    by_token = tokens.agg(
        *[f(valid(F.col(c))).alias(f"{c}_{n}") for c in ("adv", "returns", "value") for f, n in stats],
        (1.0 - F.var_samp(valid(F.col("returns") - F.col("value"))) / (F.var_samp(valid(F.col("returns"))) + 1e-5)).alias("vf_explained_var"),
    )
    return long_form(by_row).unionByName(long_form(by_token))


def timing_per_token(timings: DataFrame, tokens: Column) -> DataFrame:
    """(section, seconds) to milliseconds a token."""
    return timings.select("section", (F.col("seconds") * 1000 / tokens).alias("ms_per_token"))


def throughput(steps: DataFrame, devices: int) -> DataFrame:
    """(step, tokens, seconds) to tokens a second and device."""
    return steps.groupBy("step").agg(F.sum("tokens").alias("tokens"), F.max("seconds").alias("seconds")).withColumn("throughput", F.col("tokens") / (F.col("seconds") * devices))


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, metric, value): count, mean, population deviation, least, largest and median of several columns at once."""
    parts = []
    for c in columns:
        stats = df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.any_value(F.lit(quantiles(df, F.col(c), [0.5])[0])).alias("median"))
        parts.append(long_form(stats).select(F.lit(c).alias("name"), "metric", F.coalesce("value", F.lit(0.0)).alias("value")))
    return reduce(DataFrame.unionByName, parts)


def sub_evaluations(df: DataFrame, part: str, group: str, score: str, samples: int) -> DataFrame:
    """(part, metric, value) per sub-benchmark: counts, strict and lenient accuracy and pass@k; nothing if there is one at most."""
    q = df.groupBy(part, group).agg(F.count(F.lit(1)).alias("n"), F.count(score).alias("valid"), F.count_if(F.col(score) > 0).alias("right"))
    total, valid, right = F.sum("n"), F.sum("valid"), F.sum("right")
    counts = {
        "total_questions": F.count(F.lit(1)), "total_answers": total, "valid_answers": valid, "correct_answers": right,
        "accuracy_strict": _share(right, total), "accuracy_lenient": _share(right, valid),
    }
    for k in ladder(samples):
        counts[f"pass_at_{k}_strict"] = F.avg(pass_at_k(F.col("n"), F.col("right"), k))
        counts[f"pass_at_{k}_lenient"] = F.avg(pass_at_k(F.col("valid"), F.col("right"), k))
    each = q.groupBy(part).agg(*[v.alias(k) for k, v in counts.items()])
    several = each.agg(F.count(F.lit(1)).alias("_parts"))  # one row
    return long_form(each.join(F.broadcast(several), F.col("_parts") > 1).drop("_parts"), (part,))


def question_lengths(df: DataFrame, choices: str, text: str, mask: str) -> DataFrame:
    """(name, metric, value): distributions of the number of choices, the characters of a question and the tokens of a response."""
    tokens = F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x)
    lengths = df.select(
        F.coalesce(F.size(choices), F.lit(0)).alias("num_choices"), F.length(F.coalesce(text, F.lit(""))).alias("question_char_len"), tokens.alias("response_length_tokens")
    )
    return distributions(lengths, lengths.columns)
