"""Queries of the losses and weights over a token table made of order lines, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import losses as O
from quern.plans.registry import register

KEY = ["row_idx", "pos", "part"]
SQL = """
WITH t AS (
  SELECT l_orderkey AS row_idx, l_linenumber AS pos, l_partkey AS part, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS mask,
         -(l_quantity / 25) AS old, -(l_quantity / 25) + (l_discount - 0.05) * 8 AS new, (l_tax - 0.04) * 20 AS adv,
         -(l_quantity / 25) + (l_tax - 0.04) * 6 AS rollout, l_quantity / 10 AS value, l_discount * 20 AS base, l_tax * 30 AS returns
  FROM lineitem
)
"""


def tokens(spark: SparkSession, d: str) -> DataFrame:
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    old = -(F.col("l_quantity") / 25)
    return x.select(
        F.col("l_orderkey").alias("row_idx"),
        F.col("l_linenumber").alias("pos"),
        F.col("l_partkey").alias("part"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("mask"),
        old.alias("old"),
        (old + (F.col("l_discount") - 0.05) * 8).alias("new"),
        ((F.col("l_tax") - 0.04) * 20).alias("adv"),
        (old + (F.col("l_tax") - 0.04) * 6).alias("rollout"),
        (F.col("l_quantity") / 10).alias("value"),
        (F.col("l_discount") * 20).alias("base"),
        (F.col("l_tax") * 30).alias("returns"),
    )


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _query(name: str, sql: str):
    def add(f):
        register(name, lambda spark, d: rounded(f(tokens(spark, d))), SQL.rstrip() + sql)
        return f

    return add


_TOKEN_MEAN = "round(sum({x} * mask) / sum(mask), 5) + 0.0 AS {name}"
_RATIO = "exp(least(greatest(new - old, -20), 20))"
_CUT = f"least(greatest({_RATIO}, 0.8), 1.2)"


def _mean(**names: str) -> str:
    return " SELECT " + ", ".join(_TOKEN_MEAN.format(x=x, name=n) for n, x in names.items()) + " FROM "


_query("AGG-32-token-mean", _mean(loss="(-new * adv)") + "t")(lambda t: O.agg_loss(O.gpg_loss(t)))
_query("AGG-32-seq-mean-token-sum", " SELECT round(avg(x), 5) + 0.0 AS loss FROM (SELECT sum(-new * adv * mask) AS x FROM t GROUP BY row_idx HAVING sum(mask) > 0)")(
    lambda t: O.agg_loss(O.gpg_loss(t), mode="seq-mean-token-sum")
)
_query("AGG-32-seq-mean-token-mean", " SELECT round(avg(x), 5) + 0.0 AS loss FROM (SELECT sum(-new * adv * mask) / (sum(mask) + 1e-8) AS x FROM t GROUP BY row_idx HAVING sum(mask) > 0)")(
    lambda t: O.agg_loss(O.gpg_loss(t), mode="seq-mean-token-mean")
)
_query("AGG-32-seq-mean-token-sum-norm", " SELECT round(sum(x) / max(w), 5) + 0.0 AS loss FROM (SELECT sum(-new * adv * mask) AS x, count(*) AS w FROM t GROUP BY row_idx)")(
    lambda t: O.agg_loss(O.gpg_loss(t), mode="seq-mean-token-sum-norm")
)


@_query("ADV-15", """, k AS (SELECT *, (old - rollout) * mask AS kl FROM t)
SELECT row_idx, pos, part, round(kl, 5) + 0.0 AS kl, round(returns - 0.1 * kl, 5) + 0.0 AS reward FROM k""")
def _(t):
    return O.kl_rewards(t, "returns", "rollout", 0.1).select(*KEY, "kl", "reward")


@_query("ADV-17-token", """, w AS (SELECT *, least(exp(least(greatest(old - rollout, -20), 20)) * mask, 1.1) AS w FROM t)
SELECT row_idx, pos, part, round(w / (SELECT sum(w * mask) / sum(mask) FROM w), 5) + 0.0 AS weight FROM w""")
def _(t):
    return O.importance_weights(t, "token", 1.1, True).select(*KEY, "weight")


@_query("ADV-17-sequence", """, s AS (SELECT row_idx, sum((old - rollout) * mask) AS s, sum(mask) AS n FROM t GROUP BY 1),
w AS (SELECT t.*, n, least(exp(least(greatest(s, -20), 20)) * mask, 1.1) AS w FROM t JOIN s USING (row_idx)),
m AS (SELECT avg(x) AS m FROM (SELECT sum(w * mask) / sum(mask) AS x FROM w GROUP BY row_idx HAVING sum(mask) > 0))
SELECT row_idx, pos, part, round(w / m, 5) + 0.0 AS weight FROM w, m""")
def _(t):
    return O.importance_weights(t, "sequence", 1.1, True).select(*KEY, "weight")


@_query("ADV-20", f""", l AS (SELECT *, -adv * {_RATIO} AS a, -adv * {_CUT} AS b, -adv * 3 AS c FROM t), g AS (SELECT *, greatest(a, b) AS w FROM l)"""
    + _mean(loss="(CASE WHEN adv < 0 THEN least(c, w) ELSE w END)", clipped="(b > a)::INT", clipped_lower="(w > c AND adv < 0)::INT") + "g")
def _(t):
    x = O.policy_loss("vanilla", t)
    return x.agg(*[O.masked_mean(c).alias(c) for c in ("loss", "clipped", "clipped_lower")])


@_query("ADV-21", """, s AS (SELECT row_idx, exp(least(sum((new - old) * mask) / greatest(sum(mask), 1), 10)) AS r FROM t GROUP BY 1),
l AS (SELECT t.*, greatest(-adv * r, -adv * least(greatest(r, 0.8), 1.2)) AS x FROM t JOIN s USING (row_idx))
SELECT round(avg(y), 5) + 0.0 AS loss FROM (SELECT sum(x * mask) / (sum(mask) + 1e-8) AS y FROM l GROUP BY row_idx HAVING sum(mask) > 0)""")
def _(t):
    return O.agg_loss(O.gspo(t), mode="seq-mean-token-mean")


@_query("ADV-22", f""", l AS (SELECT *, CASE WHEN adv > 0 THEN 1.0 ELSE 1.05 END AS tau, {_RATIO} AS r FROM t),
x AS (SELECT *, -adv * (4 / tau) / (1 + exp(-tau * (r - 1))) AS x FROM l)
SELECT round(avg(y), 5) + 0.0 AS loss FROM (SELECT sum(x * mask) / (sum(mask) + 1e-8) AS y FROM x GROUP BY row_idx HAVING sum(mask) > 0)""")
def _(t):
    return O.agg_loss(O.sapo(t), mode="seq-mean-token-mean")


@_query("ADV-23", """, l AS (SELECT *, (value - returns) ** 2 AS a, (least(greatest(value, base - 0.5), base + 0.5) - returns) ** 2 AS b FROM t)"""
    + _mean(loss="(0.5 * greatest(a, b))", clipped="(b > a)::INT") + "l")
def _(t):
    return O.value_loss(t).agg(O.masked_mean("loss").alias("loss"), O.masked_mean("clipped").alias("clipped"))


_query("ADV-24", _mean(loss="(-new * adv)") + "t")(lambda t: O.agg_loss(O.policy_loss("gpg", t)))
_MEANS = ", m AS (SELECT sum(adv * mask) / sum(mask) AS ma, sum(new * mask) / sum(mask) AS mn, sum(mask) AS n FROM t)"


@_query("ADV-25", _MEANS + """, c AS (SELECT t.*, (adv - ma) * (new - mn) AS cov, n, -adv * exp(new - old) AS a, -adv * least(greatest(exp(new - old), 0.8), 1.2) AS b FROM t, m),
f AS (SELECT *, row_number() OVER (ORDER BY md5('5:' || row_idx || ':' || pos || ':' || part), row_idx, pos, part) AS k FROM c WHERE mask > 0 AND b <= a AND cov > 0.1 AND cov < 1),
h AS (SELECT row_idx, pos, part FROM f WHERE k <= greatest(1, floor(0.05 * n))),
l AS (SELECT c.*, CASE WHEN h.row_idx IS NOT NULL THEN 0 ELSE greatest(a, b) END AS x, (h.row_idx IS NOT NULL)::INT AS dropped FROM c LEFT JOIN h USING (row_idx, pos, part))
SELECT round(sum(x * mask) / sum(mask), 5) + 0.0 AS loss, round(sum(dropped * mask) / sum(mask), 5) + 0.0 AS dropped FROM l""")
def _(t):
    x = O.clip_cov(t, KEY, share=0.05, bounds=(0.1, 1.0), seed=5)
    return x.agg(O.masked_mean("loss").alias("loss"), O.masked_mean(F.col("dropped").cast("double")).alias("dropped"))


@_query("ADV-26", _MEANS + """, c AS (SELECT t.*, round((adv - ma) * (new - mn), 9) AS cov, n FROM t, m),
h AS (SELECT row_idx, pos, part FROM (SELECT *, row_number() OVER (ORDER BY cov DESC, row_idx, pos, part) AS k FROM c WHERE mask > 0) WHERE k <= greatest(1, floor(0.05 * n)))
SELECT round(sum((-adv * exp(new - old) + CASE WHEN h.row_idx IS NOT NULL THEN abs(new - old) ELSE 0 END) * mask) / sum(mask), 3) + 0.0 AS loss,
       sum((h.row_idx IS NOT NULL)::INT)::BIGINT AS penalised FROM c LEFT JOIN h USING (row_idx, pos, part)""")
def _(t):
    x = O.kl_cov(t, KEY, share=0.05)
    return x.agg(F.round(O.masked_mean("loss"), 3).alias("loss"), F.sum(F.col("penalised").cast("long")).alias("penalised"))


@_query("ADV-27", """, l AS (SELECT *, sign(adv) * least(sign(adv) * (new - old), sign(adv) * least(greatest(new - old, -0.2), 0.2)) AS d FROM t)
SELECT row_idx, round(-sum(adv * mask) / (sum(mask) + 1e-8) * exp(sum(d * mask) / (sum(mask) + 1e-8)), 5) + 0.0 AS loss FROM l GROUP BY 1""")
def _(t):
    return O.geo_mean(t)


_query("ADV-28", _mean(loss=f"(-{_CUT} * adv * new)", clipped=f"({_RATIO} <> {_CUT})::INT") + "t")(
    lambda t: O.cispo(t).agg(O.masked_mean("loss").alias("loss"), O.masked_mean("clipped").alias("clipped"))
)


@_query("ADV-29", """, w AS (SELECT *, least(exp(least(greatest(old - rollout, -20), 20)) * mask, 2) AS w FROM t)
SELECT round(avg(x), 5) + 0.0 AS loss FROM (SELECT sum(-adv * new * w * mask) AS x FROM w GROUP BY row_idx HAVING sum(mask) > 0)""")
def _(t):
    return O.agg_loss(O.reinforce(O.importance_weights(t), "weight"), mode="seq-mean-token-sum")


@_query("ADV-30", """, b AS (SELECT row_idx, max((mask = 1 AND new - old < ln(0.75))::INT) AS bad FROM t GROUP BY 1),
w AS (SELECT t.* EXCLUDE mask, mask AS m0, CASE WHEN bad = 1 THEN 0 ELSE mask END AS mask FROM t JOIN b USING (row_idx)),
x AS (SELECT *, -adv * new * least(exp(new - old) * m0, 1.2) AS x FROM w)
SELECT round(sum(x * mask) / sum(mask), 5) + 0.0 AS loss, sum(mask)::BIGINT AS valid FROM x""")
def _(t):
    x = O.bypass(t, "reinforce", 1.2, 0.75)
    return x.agg(O.masked_mean("loss").alias("loss"), F.sum("mask").alias("valid"))


@_query("AGG-33", """, s AS (SELECT sum(old * mask) / sum(mask) AS t, sum(rollout * mask) / sum(mask) AS r, sum((old - rollout) * mask) AS s FROM t GROUP BY row_idx HAVING sum(mask) > 0),
a AS (SELECT round(avg(exp(-t)), 5) + 0.0 AS training_ppl, round(avg(-t), 5) + 0.0 AS training_log_ppl, round(avg(exp(-r)), 5) + 0.0 AS rollout_ppl, round(avg(-r), 5) + 0.0 AS rollout_log_ppl,
  round(avg(r - t), 5) + 0.0 AS log_ppl_diff, round(avg(abs(r - t)), 5) + 0.0 AS log_ppl_abs_diff, round(max(r - t), 5) + 0.0 AS log_ppl_diff_max, round(min(r - t), 5) + 0.0 AS log_ppl_diff_min,
  round(avg(exp(r - t)), 5) + 0.0 AS ppl_ratio, round(avg(exp(2 * least(greatest(s, -20), 20))) - 1, 5) + 0.0 AS chi2_seq FROM s)
SELECT round(sum((rollout - old) * mask) / sum(mask), 5) + 0.0 AS kl, round(sum((exp(old - rollout) - (old - rollout) - 1) * mask) / sum(mask), 5) + 0.0 AS k3_kl,
  round(sum(exp(2 * (old - rollout)) * mask) / sum(mask) - 1, 5) + 0.0 AS chi2_token, any_value(COLUMNS(a.*)) FROM t, a""")
def _(t):
    return O.offpolicy_metrics(t)


_WEIGHTS = """, w AS (SELECT *, exp(least(greatest(old - rollout, -20), 20)) * mask AS w, least(greatest(exp(least(greatest(old - rollout, -20), 20)) * mask, {low}), {high}) AS h FROM t),
s AS (SELECT sum(w * mask) / sum(mask) AS w FROM w GROUP BY row_idx HAVING sum(mask) > 0),
a AS (SELECT avg(w) AS seq_mean, stddev_samp(w) AS seq_std, max(w) AS seq_max, min(w) AS seq_min, max(abs(w - 1)) AS seq_max_deviation,
  avg((w > {high})::INT) AS seq_fraction_high, avg((w < {low})::INT) AS seq_fraction_low FROM s),
b AS (SELECT sum(w * mask) / sum(mask) AS mean, max(w) FILTER (mask = 1) AS max, min(w) FILTER (mask = 1) AS min, sum((w > {high})::INT * mask) / sum(mask) AS fraction_high,
  sum((w < {low})::INT * mask) / sum(mask) AS fraction_low, sqrt(greatest(sum(h * h * mask) / sum(mask) - (sum(h * mask) / sum(mask)) ** 2, 0)) AS std,
  (sum(h * mask) / sum(mask) + 1e-8) ** 2 / (sum(h * h * mask) / sum(mask)) AS eff_sample_size FROM w)
SELECT round(COLUMNS(*), 5) + 0.0 FROM a, b"""
_query("AGG-34", _WEIGHTS.format(low="(1 / 1.1)", high="1.1"))(lambda t: O.weight_metrics(O.importance_weights(t), 1.1))
_query("AGG-35", _WEIGHTS.format(low="0.95", high="1.2"))(lambda t: O.weight_metrics(O.importance_weights(t), 1.2, 0.95))


@_query("AGG-38", """ SELECT sum((mask = 1 AND old <> new)::INT)::BIGINT AS differ, round(corr(old, new) FILTER (mask = 1), 5) + 0.0 AS pearson,
round(avg(abs(old - new)) FILTER (mask = 1), 5) + 0.0 AS mean_distance, round(max(abs(old - new)) FILTER (mask = 1), 5) + 0.0 AS max_distance FROM t""")
def _(t):
    return O.mismatch(t, "old", "new")
