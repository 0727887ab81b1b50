"""Queries of evaluation summaries and rewards, each with SQL for the same rows."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern.functions.answers import over
from quern.operators import evaluation as E
from quern.operators import rewards as R
from quern.plans.queries import ROLLOUTS, rollouts
from quern.plans.registry import register
from quern.plans.token_queries import SQL as TOKENS
from quern.plans.token_queries import rounded, tokens


def _query(name: str, sql: str | None):
    def add(f):
        register(name, lambda spark, d: rounded(f(spark, d)), sql)
        return f

    return add


_Q = ROLLOUTS.rstrip() + """, q AS (SELECT "group", count(*) AS n, count(ok) AS v, count(*) FILTER (ok > 0) AS c, min(coalesce(ok, 0)) AS lo, max(coalesce(ok, 0)) AS hi FROM r GROUP BY 1),
k AS (SELECT *, unnest([1, 2, 4, 8]) AS k FROM q),
p AS (SELECT k, n, v, CASE WHEN n < k THEN NULL WHEN c = 0 THEN 0 WHEN n - c < k THEN 1 ELSE 1 - (SELECT product(1 - k::DOUBLE / i) FROM range(n - c + 1, n + 1) t(i)) END AS s,
  CASE WHEN v < k THEN NULL WHEN c = 0 THEN 0 WHEN v - c < k THEN 1 ELSE 1 - (SELECT product(1 - k::DOUBLE / i) FROM range(v - c + 1, v + 1) t(i)) END AS l FROM k)"""
_LONG = "SELECT metric, round(value, 5) + 0.0 AS value FROM ({}) UNPIVOT (value FOR metric IN (COLUMNS(*)))"


@_query("AGG-06", _Q + """, a AS (SELECT count(*)::DOUBLE AS total_questions, sum(n)::DOUBLE AS total_answers, sum(v)::DOUBLE AS valid_answers, sum(n - v)::DOUBLE AS failed_extractions, sum(c)::DOUBLE AS correct_answers,
  (sum(c) / sum(v))::DOUBLE AS accuracy_lenient, (sum(c) / sum(n))::DOUBLE AS accuracy_strict, (sum(c) / sum(n))::DOUBLE AS primary_metric_value FROM q),
l AS (SELECT avg(length)::DOUBLE AS length_mean, stddev_samp(length)::DOUBLE AS length_std, min(length)::DOUBLE AS length_min, max(length)::DOUBLE AS length_max FROM r)
""" + _LONG.format("FROM a") + " UNION ALL " + _LONG.format("FROM l") + """
UNION ALL SELECT 'pass_at_' || k || '_strict', round(avg(coalesce(s, 0)), 5) + 0.0 FROM p GROUP BY k UNION ALL SELECT 'pass_at_' || k || '_lenient', round(avg(coalesce(l, 0)), 5) + 0.0 FROM p GROUP BY k
UNION ALL SELECT 'correct_' || i, round((SELECT avg((c = i)::INT) FROM q), 5) + 0.0 FROM range(9) t(i) UNION ALL SELECT 'none_' || i, round((SELECT avg((n - v = i)::INT) FROM q), 5) + 0.0 FROM range(9) t(i)""")
def _(spark, d):
    return E.evaluation_summary(rollouts(spark, d), "group", "ok", "length", 8)


_ROLL = """, a AS (SELECT (sum(c) / sum(n))::DOUBLE AS accuracy_strict, (sum(c) / sum(v))::DOUBLE AS accuracy_lenient, count(*)::DOUBLE AS num_questions, sum(n)::DOUBLE AS num_generated_answers,
  sum(v)::DOUBLE AS num_valid_answers, sum(n - v)::DOUBLE AS num_invalid_answers, (sum(v) / sum(n))::DOUBLE AS frac_valid_answers, avg((lo <> hi)::INT)::DOUBLE AS frac_diverse_questions FROM q),
l AS (SELECT avg(length)::DOUBLE AS length_mean, min(length)::DOUBLE AS length_min, max(length)::DOUBLE AS length_max FROM r)
""" + _LONG.format("FROM a") + """
UNION ALL SELECT 'pass_at_' || k || '_strict', round(coalesce(avg(s), 0), 5) + 0.0 FROM p GROUP BY k UNION ALL SELECT 'pass_at_' || k || '_lenient', round(coalesce(avg(l), 0), 5) + 0.0 FROM p GROUP BY k"""
_SIX = _Q.replace("[1, 2, 4, 8]", "[1, 2, 4, 6]")


@_query("AGG-11", _SIX + _ROLL + " UNION ALL " + _LONG.format("FROM l"))
def _(spark, d):
    return E.rollout_summary(rollouts(spark, d), "group", "ok", 6, "length")


@_query("AGG-12", _SIX + _ROLL)
def _(spark, d):
    return E.rollout_summary(rollouts(spark, d), "group", "ok", 6)


@_query("AGG-08", """WITH e AS (SELECT event_type AS status, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value > 5 END AS c, value > 20 AS r, value > 60 AS p FROM events),
a AS (SELECT count(*)::DOUBLE AS total_exec_samples, count_if(p)::DOUBLE AS passed_exec_samples, count_if(c)::DOUBLE AS compile_ok_samples, count_if(r)::DOUBLE AS runtime_ok_samples,
  (count_if(c) / count(*))::DOUBLE AS compile_ok_rate, (count_if(r) / count(*))::DOUBLE AS runtime_ok_rate, (count_if(p) / count(*))::DOUBLE AS runtime_pass_rate FROM e)
""" + _LONG.format("FROM a") + " UNION ALL SELECT 'status_' || status, count(*)::DOUBLE FROM e GROUP BY 1")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    flags = e.select("event_type", F.when(F.col("event_id") % 11 != 0, F.col("value") > 5).alias("c"), (F.col("value") > 20).alias("r"), (F.col("value") > 60).alias("p"))
    return E.code_summary(flags, "event_type", "c", "r", "p")


_WITHIN = """, p AS (SELECT "group", class, sum(score) AS s, count(*) AS n FROM r WHERE score IS NOT NULL GROUP BY 1, 2), g AS (SELECT "group", sum(s) / sum(n) AS m, count(*) AS kinds FROM p GROUP BY 1),
w AS (SELECT class, round(avg(s / n), 5) + 0.0 AS within_q_mean, round(coalesce(avg(s / n - m) FILTER (kinds > 1), 0), 5) + 0.0 AS minus_q_mean, count(*) AS n_questions, count(*) FILTER (kinds > 1) AS n_mixed_questions
  FROM p JOIN g USING ("group") GROUP BY 1)"""


@_query("AGG-15", ROLLOUTS.rstrip() + _WITHIN + " SELECT * FROM w")
def _(spark, d):
    return E.within_questions(rollouts(spark, d), "group", "class", "score")


@_query("AGG-16", ROLLOUTS.rstrip() + _WITHIN + """, f AS (SELECT class, round(avg(score), 5) + 0.0 AS advantage_mean, count(*) AS advantage_count, count(DISTINCT "group") AS q_count,
  round(count(DISTINCT "group") / (SELECT count(DISTINCT "group") FROM r), 5) + 0.0 AS q_share FROM r GROUP BY 1) SELECT * FROM f JOIN w USING (class)""")
def _(spark, d):
    return E.class_advantages(rollouts(spark, d), "group", "class", "score")


@_query("AGG-19", ROLLOUTS.rstrip() + """, a AS (SELECT count(DISTINCT doc)::DOUBLE AS num_gen_loops, avg(score)::DOUBLE AS mean_reward, count(DISTINCT (doc, "group"))::DOUBLE AS total_questions_generated, avg(ok)::DOUBLE AS mean_gen_accuracy FROM r) """ + _LONG.format("FROM a"))
def _(spark, d):
    return E.loop_summary(rollouts(spark, d), "doc", "score", "ok", "group")


@_query("AGG-22", TOKENS.rstrip() + """, s AS (SELECT sum(returns - adv) AS reward, sum(mask) AS length FROM t GROUP BY row_idx),
a AS (SELECT avg(reward) FILTER (length > 0) AS rewards_mean, max(reward) FILTER (length > 0) AS rewards_max, min(reward) FILTER (length > 0) AS rewards_min, avg(length)::DOUBLE AS response_length_mean, max(length)::DOUBLE AS response_length_max, min(length)::DOUBLE AS response_length_min,
  avg(length) FILTER (length > 0)::DOUBLE AS non_aborted_length_mean, max(length) FILTER (length > 0)::DOUBLE AS non_aborted_length_max, min(length) FILTER (length > 0)::DOUBLE AS non_aborted_length_min,
  avg((length = 4)::INT)::DOUBLE AS response_length_clip_ratio, avg((length = 0)::INT)::DOUBLE AS aborted_ratio FROM s),
b AS (SELECT avg(adv) FILTER (mask = 1) AS adv_mean, max(adv) FILTER (mask = 1) AS adv_max, min(adv) FILTER (mask = 1) AS adv_min, avg(returns) FILTER (mask = 1) AS returns_mean, max(returns) FILTER (mask = 1) AS returns_max, min(returns) FILTER (mask = 1) AS returns_min,
  avg(value) FILTER (mask = 1) AS value_mean, max(value) FILTER (mask = 1) AS value_max, min(value) FILTER (mask = 1) AS value_min, 1 - var_samp(returns - value) FILTER (mask = 1) / (var_samp(returns) FILTER (mask = 1) + 1e-5) AS vf_explained_var FROM t)
""" + _LONG.format("FROM a") + " UNION ALL " + _LONG.format("FROM b"))
def _(spark, d):
    return E.training_metrics(tokens(spark, d).withColumn("reward", F.col("returns") - F.col("adv")), width=4)


@_query("AGG-23", "SELECT event_type AS section, round(sum(value) * 1000 / (SELECT count(*) FROM lineitem), 5) + 0.0 AS ms_per_token FROM events GROUP BY 1")
def _(spark, d):
    n = spark.read.parquet(f"{d}/lineitem.parquet").count()
    timings = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("section")).agg(F.sum("value").alias("seconds"))
    return E.timing_per_token(timings, F.lit(n))


@_query("AGG-24", "SELECT user_id AS step, sum(event_id) AS tokens, max(value) + 1 AS seconds, round(sum(event_id) / ((max(value) + 1) * 8), 5) + 0.0 AS throughput FROM events GROUP BY 1")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("step"), F.col("event_id").alias("tokens"), (F.col("value") + 1).alias("seconds"))
    return E.throughput(e, 8)


@_query("AGG-36", ROLLOUTS.rstrip() + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS name, metric, round(value, 5) + 0.0 AS value FROM (SELECT count({c})::DOUBLE AS count, avg({c})::DOUBLE AS mean, stddev_pop({c})::DOUBLE AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, quantile_cont({c}, 0.5)::DOUBLE AS median FROM r) UNPIVOT (value FOR metric IN (COLUMNS(*)))"
    for c in ("score", "length", "ok")
))
def _(spark, d):
    return E.distributions(rollouts(spark, d), ["score", "length", "ok"])


_PARTS = ', v AS (SELECT DISTINCT "group" FROM r WHERE ok IS NOT NULL AND row_idx % 3 > 0), i AS (SELECT "group", avg(score) / 100 AS x FROM r WHERE "group" % 4 > 0 GROUP BY 1), s AS (SELECT "group", var_pop(score) / 1000 AS x FROM r WHERE "group" % 5 > 0 GROUP BY 1)'


def _reward_parts(spark: SparkSession, d: str):
    r = rollouts(spark, d)
    influence = r.where("group % 4 > 0").groupBy("group").agg((F.avg("score") / 100).alias("reward"))
    spice = r.where("group % 5 > 0").groupBy("group").agg((F.var_pop("score") / 1000).alias("reward"))
    return r, r.where("ok is not null and row_idx % 3 > 0"), influence, spice


_STRUCTURE = [{"terms": [{"name": "influence_rewards", "weight": 0.7}, {"name": "spice_rewards", "weight": 0.3}]}, {"terms": [{"name": "invalid_rewards"}]}]


def _weights(text: str) -> list[dict]:
    return [{"component": k, "weight": v} for k, v in R.check_structure(json.loads(text)).items()]


@_query("RWD-01", """WITH n AS (SELECT n_nationkey AS k FROM nation) SELECT k, component, CASE component WHEN 'influence_rewards' THEN (k + 1) / 10 WHEN 'spice_rewards' THEN 0.3 ELSE 1.0 END::DOUBLE AS weight
FROM n, (SELECT unnest(['influence_rewards', 'spice_rewards', 'invalid_rewards']) AS component)""")
def _(spark, d):
    text = """concat('[{"terms": [{"name": "influence_rewards", "weight": ', (n_nationkey + 1) / 10, '}, {"name": "spice_rewards", "weight": 0.3}]}, {"terms": [{"name": "invalid_rewards"}]}]')"""
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("k"), F.expr(text).alias("structure"))
    rows = over(_weights, "array<struct<component:string,weight:double>>")(F.col("structure"))
    return n.select("k", F.explode(rows).alias("w")).select("k", "w.*")


@_query("RWD-02", ROLLOUTS.rstrip() + _PARTS + """ SELECT "group", round(coalesce(i.x, 0), 5) + 0.0 AS influence_rewards, round(coalesce(s.x, 0), 5) + 0.0 AS spice_rewards, round(0.7 * coalesce(i.x, 0) + 0.3 * coalesce(s.x, 0), 5) + 0.0 AS combined FROM v LEFT JOIN i USING ("group") LEFT JOIN s USING ("group")""")
def _(spark, d):
    _, valid, influence, spice = _reward_parts(spark, d)
    return R.dense_payload(valid, {"influence_rewards": influence, "spice_rewards": spice}, "group", R.check_structure(_STRUCTURE))


@_query("RWD-03", ROLLOUTS.rstrip() + _PARTS + ' SELECT "group", round(coalesce(i.x, 0), 5) + 0.0 AS reward FROM v LEFT JOIN i USING ("group")')
def _(spark, d):
    _, valid, influence, _ = _reward_parts(spark, d)
    return R.normalise_payload(influence, valid, "group")


@_query("RWD-04", ROLLOUTS.rstrip() + " SELECT row_idx, round(CASE WHEN ok IS NOT NULL THEN 0.7 * score + 0.3 * length - 2.0 ELSE -2.0 END, 5) + 0.0 AS reward FROM r")
def _(spark, d):
    parts = {"influence_rewards": F.col("score"), "spice_rewards": F.col("length"), "invalid_rewards": F.lit(-1.0)}
    return rollouts(spark, d).select("row_idx", R.combined(F.col("ok").isNotNull(), parts, {"influence_rewards": 0.7, "spice_rewards": 0.3, "invalid_rewards": 2.0}).alias("reward"))


@_query("RWD-06", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS g, list_transform(embedding::DOUBLE[], lambda x: x * x + 0.01) AS m FROM embeddings),
r AS (SELECT embedding::DOUBLE[] AS r FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_transform(list_zip(g, m), lambda z: z[1] / (sqrt(z[2]) + 1e-8)) AS y, r FROM v, r)
SELECT vec_id, round(list_dot_product(y, r), 4) + 0.0 AS preconditioned_dot, round(list_dot_product(y, r) / sqrt(list_dot_product(y, y)) / sqrt(list_dot_product(r, r)), 4) + 0.0 AS preconditioned_cosine FROM s""")
def _(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("g"))
    reference = e.where("vec_id = 0").limit(1).select(F.col("g").alias("r"))
    both = e.join(F.broadcast(reference))  # one row
    out = R.preconditioned(F.col("g"), F.col("r"), F.transform("g", lambda x: x * x + 0.01))
    return both.select("vec_id", *[F.round(c, 4).alias(n) for n, c in out.items()])


@_query("RWD-07", ROLLOUTS.rstrip() + " SELECT row_idx, coalesce(ok, 0) + CASE WHEN class = 'click' THEN 0.25 ELSE 0 END + CASE WHEN length = 7 THEN -0.5 ELSE 0 END AS score FROM r")
def _(spark, d):
    opener = F.when(F.col("class") == "click", "alright").otherwise("others")
    return rollouts(spark, d).select("row_idx", R.with_bonus(F.col("ok"), opener, F.col("length") == 7, 0.25, -0.5).alias("score"))



@_query("RWD-10", ROLLOUTS.rstrip() + """, w AS (SELECT row_idx, abs(score) ** 2 + 1e-8 AS weight FROM r), c AS (SELECT *, sum(weight) OVER (ORDER BY row_idx) AS hi, sum(weight) OVER () AS total FROM w),
d AS (SELECT row_idx AS draw, ('0x' || substr(md5('9:' || row_idx), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM r)
SELECT draw, c.row_idx FROM d JOIN c ON u * total >= hi - weight AND u * total < hi""")
def _(spark, d):
    weighed = R.resample_weights(rollouts(spark, d), "score", "pow")
    return R.resample(weighed, "row_idx", "weight", 9).select("draw", "row_idx")
