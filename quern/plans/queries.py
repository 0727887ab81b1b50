"""Queries for the operators, over the test tables, each with SQL for the same rows.

``events`` stands for rollouts (a row per sampled answer), ``orders`` for questions of a customer, ``documents`` for
documents. Figures are rounded, as sums come in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import strings as S
from quern.operators import advantages as A
from quern.operators import aggregates as G
from quern.operators import batch as B
from quern.operators import filters as L
from quern.operators import lookups as LK
from quern.plans.registry import register

ROLLOUTS = """
WITH r AS (
  SELECT event_id AS row_idx, user_id AS "group", value AS score, event_type AS class, (1 + event_id % 7)::BIGINT AS length,
         user_id % 13 AS doc, CASE WHEN event_id % 17 = 0 THEN NULL WHEN value > 10 THEN 1.0 ELSE 0.0 END AS ok
  FROM events
)
"""


def rollouts(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(
        F.col("event_id").alias("row_idx"),
        F.col("user_id").alias("group"),
        F.col("value").alias("score"),
        F.col("event_type").alias("class"),
        (1 + F.col("event_id") % 7).cast("long").alias("length"),
        (F.col("user_id") % 13).alias("doc"),
        F.when(F.col("event_id") % 17 == 0, None).when(F.col("value") > 10, 1.0).otherwise(0.0).alias("ok"),
    )


def _r(c: Column | str) -> Column:
    return F.round(c, 5) + 0.0


def _advantage(name: str, frame, sql: str, with_: str = "", source: str = "r") -> None:
    """Register an estimator with the SQL of its advantage over a table, ``r`` or one that ``with_`` makes of it."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        return frame(rollouts(spark, d)).select("row_idx", _r("advantage").alias("advantage"))

    register(name, query, f"{ROLLOUTS}{with_} SELECT row_idx, round({sql}, 5) + 0.0 AS advantage FROM {source}")


_W = '(PARTITION BY "group")'
_MEAN = f"CASE WHEN count(score) OVER {_W} = 1 THEN 0 ELSE avg(score) OVER {_W} END"
_STD = f"CASE WHEN count(score) OVER {_W} = 1 THEN 1 ELSE stddev_samp(score) OVER {_W} END"
_advantage("ADV-02", lambda r: A.estimate("grpo", r), f"(score - {_MEAN}) / ({_STD} + 1e-6)")
_advantage("ADV-02-none", lambda r: A.grpo(r, mode="none"), f"score - {_MEAN}")
_advantage("ADV-02-batch", lambda r: A.grpo(r, mode="batch_std"), f"(score - {_MEAN}) / (stddev_samp(score) OVER () + 1e-6)")
_advantage(
    "ADV-02-hybrid",
    lambda r: A.grpo(r, mode="hybrid_std"),
    f"(score - {_MEAN}) / ((SELECT coalesce(avg(s), 1) FROM h WHERE s > 0) + 1e-6)",
    ', h AS (SELECT CASE WHEN count(score) = 1 THEN 1 ELSE stddev_samp(score) END AS s FROM r GROUP BY "group")',
)
_advantage(
    "ADV-03",
    A.grpo_vectorized,
    f"CASE WHEN count(score) OVER {_W} = 1 THEN score / (1 + 1e-6) ELSE (score - avg(score) OVER {_W}) / (sqrt(greatest(var_samp(score) OVER {_W}, 1e-6)) + 1e-6) END",
)
_advantage(
    "ADV-04",
    A.grpo_passk,
    f"CASE WHEN row_number() OVER o = 1 THEN coalesce((score - lead(score) OVER o) / (stddev_samp(score) OVER {_W} + 1e-6), 0) ELSE 0 END",
    source='r WINDOW o AS (PARTITION BY "group" ORDER BY score DESC, row_idx)',
)
_advantage(
    "ADV-05",
    lambda r: A.estimate("reinforce_plus_plus_baseline", r),
    "(x - sum(x * length) OVER () / sum(length) OVER ()) / sqrt((sum(x * x * length) OVER () - (sum(x * length) OVER ()) ** 2 / sum(length) OVER ()) / (sum(length) OVER () - 1) + 1e-8)",
    f", s AS (SELECT *, score - {_MEAN} AS x FROM r)",
    "s",
)
_advantage("ADV-06", lambda r: A.estimate("rloo", r), f"score - coalesce((sum(score) OVER {_W} - score) / nullif(count(score) OVER {_W} - 1, 0), 0)")
_advantage("ADV-11", A.rloo_vectorized, f"CASE WHEN count(score) OVER {_W} > 1 THEN (count(score) OVER {_W} * score - sum(score) OVER {_W}) / (count(score) OVER {_W} - 1) ELSE 0 END")
_advantage("ADV-09", A.opo, f"score - CASE WHEN count(score) OVER {_W} = 1 THEN 0 ELSE sum(length * score) OVER {_W} / sum(length) OVER {_W} END")
_advantage("ADV-10", lambda r: A.gpg(r, f_norm=1.2345679), f"(count(score) OVER () / greatest(1, count(*) FILTER (score <> 0) OVER ())) * (score - {_MEAN}) / 1.2345679")
_advantage("ADV-14", lambda r: A.whiten(r, "score", "length"), "(score - sum(score * length) OVER () / sum(length) OVER ()) / sqrt((sum(score * score * length) OVER () - (sum(score * length) OVER ()) ** 2 / sum(length) OVER ()) / (sum(length) OVER () - 1) + 1e-8)")
_LENGTH_MEAN, _LENGTH_STD = (x.replace("score", "length") for x in (_MEAN, _STD))
_advantage(
    "ADV-13",
    lambda r: A.decoupled(r.withColumn("size", F.col("length").cast("double")), {"score": 0.7, "size": 0.3}),
    "(x - avg(x) OVER ()) / (stddev_samp(x) OVER () + 1e-8)",
    f", s AS (SELECT *, 0.7 * (score - {_MEAN}) / ({_STD} + 1e-6) + 0.3 * (length - {_LENGTH_MEAN}) / ({_LENGTH_STD} + 1e-6) AS x FROM r)",
    "s",
)


def _query(name: str, sql: str):
    """Register a function of (spark, folder) with its SQL."""

    def add(f):
        register(name, f, sql)
        return f

    return add


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their lines as token arrays: rewards, values and a mask."""
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    per = x.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_returnflag"))).alias("t"))
    return per.select(
        F.col("l_orderkey").alias("row_idx"),
        F.transform("t", lambda t: t["l_quantity"]).alias("rewards"),
        F.transform("t", lambda t: t["l_discount"] * 10).alias("values"),
        F.transform("t", lambda t: F.when(t["l_returnflag"] == "R", 0).otherwise(1)).alias("mask"),
        F.transform("t", lambda t: (t["l_partkey"] % 10).cast("int")).alias("ids"),
    )


TOKENS = """
WITH t AS (
  SELECT l_orderkey AS row_idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_discount, l_returnflag) AS pos,
         l_quantity AS reward, l_discount * 10 AS value, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS mask, (l_partkey % 10)::INT AS id
  FROM lineitem
)
"""


def _per_token(df: DataFrame, column: Column) -> DataFrame:
    return df.select("row_idx", F.posexplode(column).alias("pos", "x")).select("row_idx", (F.col("pos") + 1).cast("long").alias("pos"), _r("x").alias("x"))


@_query("ADV-08", TOKENS + "SELECT row_idx, pos, round(sum(reward * mask) OVER (PARTITION BY row_idx ORDER BY pos DESC), 5) + 0.0 AS x FROM t")
def _(spark, d):
    return _per_token(_tokens(spark, d), A.suffix_sums(F.col("rewards"), F.col("mask")))


@_query(
    "ADV-07",
    TOKENS
    + """, RECURSIVE_ AS (SELECT *, max(pos) OVER (PARTITION BY row_idx) AS last FROM t)
SELECT a.row_idx, a.pos, round(sum(b.reward * 0.5 ** (b.pos - a.pos)), 5) + 0.0 AS x FROM RECURSIVE_ a JOIN RECURSIVE_ b ON a.row_idx = b.row_idx AND b.pos >= a.pos
WHERE NOT EXISTS (SELECT 1 FROM t c WHERE c.row_idx = a.row_idx AND c.mask = 0 AND c.pos > a.pos AND c.pos <= b.pos) GROUP BY 1, 2""",
)
def _(spark, d):
    return _per_token(_tokens(spark, d), A.discounted_returns(F.col("rewards"), F.col("mask"), 0.5))


@_query(
    "ADV-01",
    TOKENS
    + """, m AS (SELECT *, sum(mask) OVER (PARTITION BY row_idx ORDER BY pos DESC) AS k FROM t),
v AS (SELECT a.*, coalesce((SELECT b.value FROM m b WHERE b.row_idx = a.row_idx AND b.mask = 1 AND b.k = a.k - 1), 0) AS nxt FROM m a WHERE mask = 1),
g AS (SELECT a.row_idx, a.pos, a.k, sum((b.reward + 0.9 * b.nxt - b.value) * (0.9 * 0.8) ** (a.k - b.k)) AS x FROM v a JOIN v b ON a.row_idx = b.row_idx AND b.k <= a.k GROUP BY 1, 2, 3)
SELECT m.row_idx, m.pos, round(coalesce(g.x, 0), 5) + 0.0 AS x FROM m LEFT JOIN g ON g.row_idx = m.row_idx AND g.k = m.k""",
)
def _(spark, d):
    t = _tokens(spark, d)
    return _per_token(t, A.gae(F.col("rewards"), F.col("values"), F.col("mask"), 0.9, 0.8))


@_query(
    "ADV-01-whitened",
    TOKENS
    + """, m AS (SELECT *, sum(mask) OVER (PARTITION BY row_idx ORDER BY pos DESC) AS k FROM t),
v AS (SELECT row_idx, k, reward + 0.9 * coalesce(lead(value) OVER (PARTITION BY row_idx ORDER BY pos), 0) - value AS delta FROM m WHERE mask = 1),
g AS (SELECT row_idx, k, 0.72 ** k * sum(delta / 0.72 ** k) OVER (PARTITION BY row_idx ORDER BY k) AS x FROM v),
f AS (SELECT m.row_idx, m.pos, m.mask, m.value, coalesce(g.x, 0) AS x FROM m LEFT JOIN g ON g.row_idx = m.row_idx AND g.k = m.k),
w AS (SELECT avg(x) FILTER (mask = 1) AS mean, var_samp(x) FILTER (mask = 1) AS var FROM f)
SELECT row_idx, pos, round((x - mean) / sqrt(var + 1e-8), 5) + 0.0 AS advantage, round(x + value, 5) + 0.0 AS returns FROM f, w""",
)
def _(spark, d):
    x = A.gae_advantages(_tokens(spark, d), "row_idx", "rewards", "values", "mask", 0.9, 0.8)
    return x.select("row_idx", (F.col("pos") + 1).cast("long").alias("pos"), _r("advantage").alias("advantage"), _r("returns").alias("returns"))


@_query("ADV-16", ROLLOUTS + "SELECT row_idx, round(score / 100 - length / 10, 5) + 0.0 AS k1, round(abs(score / 100 - length / 10), 5) AS abs, round(0.5 * (score / 100 - length / 10) ** 2, 5) AS k2, round(least(greatest(exp(length / 10 - score / 100) - (length / 10 - score / 100) - 1, -10), 10), 5) AS k3 FROM r")
def _(spark, d):
    r = rollouts(spark, d)
    p, q = F.col("score") / 100, F.col("length") / 10
    return r.select("row_idx", *[_r(A.kl(p, q, k)).alias(k) for k in ("k1", "abs", "k2", "k3")])


@_query("ADV-18", ROLLOUTS + "SELECT row_idx, CASE WHEN score - 10 >= t THEN 1.0 WHEN score - 10 > 0 THEN 0.1 WHEN score - 10 > -t THEN -0.1 ELSE -1.0 END::DOUBLE AS quantised FROM r, (SELECT quantile_disc(abs(score - 10), 0.5) AS t FROM r)")
def _(spark, d):
    return A.quantise(rollouts(spark, d).withColumn("x", F.col("score") - 10), "x", "2bit").select("row_idx", "quantised")


@_query("AGG-02", ROLLOUTS + 'SELECT "group", coalesce(sum(ok), 0)::BIGINT AS n_correct, count(ok) AS n_total, coalesce(sum(ok) / nullif(count(ok), 0), 0)::DOUBLE AS accuracy FROM r GROUP BY 1')
def _(spark, d):
    return G.accuracy(rollouts(spark, d), "group", "ok")


_PASS = ROLLOUTS + """, q AS (SELECT "group", count(ok) AS n, coalesce(sum(ok), 0)::BIGINT AS c FROM r GROUP BY 1),
p AS (SELECT q.*, k, CASE WHEN n < k THEN NULL WHEN c = 0 THEN 0 WHEN n - c < k THEN 1
  ELSE 1 - (SELECT product(1 - k::DOUBLE / i) FROM range(q.n - q.c + 1, q.n + 1) t(i)) END AS p FROM q, (SELECT unnest([1, 2, 4, 8, 16, 32]) AS k))
"""


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return rollouts(spark, d).groupBy("group").agg(F.count("ok").alias("n"), F.coalesce(F.sum("ok"), F.lit(0.0)).cast("long").alias("c"))


@_query("AGG-03", _PASS + 'SELECT "group", round(coalesce(p, 0), 5)::DOUBLE AS pass_at_4 FROM p WHERE k = 4')
def _(spark, d):
    return _counts(spark, d).select("group", _r(G.pass_at_k(F.col("n"), F.col("c"), 4)).alias("pass_at_4"))


@_query("AGG-04", _PASS + 'SELECT "group", round(p, 5)::DOUBLE AS pass_at_32 FROM p WHERE k = 32')
def _(spark, d):
    return _counts(spark, d).select("group", _r(G.pass_at_k(F.col("n"), F.col("c"), 32, None)).alias("pass_at_32"))


@_query("AGG-05", _PASS + "SELECT k::INT AS k, round(avg(coalesce(p, 0)), 5)::DOUBLE AS pass_at_k FROM p GROUP BY 1")
def _(spark, d):
    return G.pass_ladder(_counts(spark, d), "n", "c", 32).select("k", _r("pass_at_k").alias("pass_at_k"))


@_query("AGG-07", ROLLOUTS + 'SELECT "group", round(avg(length), 5) AS mean, round(coalesce(stddev_samp(length), 0), 5) AS std, min(length) AS least, max(length) AS most FROM r GROUP BY 1')
def _(spark, d):
    return G.length_stats(rollouts(spark, d), "group", "length").select("group", _r("mean").alias("mean"), _r("std").alias("std"), "least", "most")


@_query("AGG-13", ROLLOUTS + 'SELECT class, count(*) AS n, round(count(*) / (SELECT count(*) FROM r), 5) AS share, count(DISTINCT "group") AS questions, round(count(DISTINCT "group") / (SELECT count(DISTINCT "group") FROM r), 5) AS question_share FROM r GROUP BY 1')
def _(spark, d):
    x = G.class_shares(rollouts(spark, d), "class", "group")
    return x.select("class", "n", _r("share").alias("share"), "questions", _r("question_share").alias("question_share"))


@_query("AGG-14", ROLLOUTS + """, q AS (SELECT avg(score) FILTER (class = 'click') AS a, avg(score) FILTER (class = 'view') AS b FROM r GROUP BY "group")
SELECT round(avg(a - b), 5) + 0.0 AS delta, count(*) AS questions FROM q WHERE a IS NOT NULL AND b IS NOT NULL""")
def _(spark, d):
    return G.class_delta(rollouts(spark, d), "group", "class", "score", "click", "view").select(_r("delta").alias("delta"), "questions")


@_query("AGG-20", ROLLOUTS + 'SELECT round(avg(score), 5) AS mean, round(stddev_pop(score), 5) AS std, min(score) AS min, max(score) AS max, round(quantile_cont(score, 0.5), 5) AS median, count(score) AS count, round(quantile_cont(score, 0.1), 5) AS p10, round(quantile_cont(score, 0.9), 5) AS p90 FROM r')
def _(spark, d):
    x = G.distribution(rollouts(spark, d), "score")
    return x.select(*[_r(c).alias(c) if c not in ("min", "max", "count") else c for c in x.columns])


@_query("AGG-21", """WITH m AS (SELECT (['loss', 'max_reward', 'min_error', 'accuracy'])[1 + event_id % 4] AS name, value FROM events)
SELECT name, round(CASE WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) ELSE avg(value) END, 5) AS reduced FROM m GROUP BY 1""")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    names = F.array(*[F.lit(x) for x in ("loss", "max_reward", "min_error", "accuracy")])
    named = e.select(F.get(names, (F.col("event_id") % 4).cast("int")).alias("name"), "value")
    return G.reduce_by_name(named, "name", "value").select("name", _r("reduced").alias("reduced"))


@_query("AGG-26", ROLLOUTS + """, v AS (SELECT "group", class, count(*) AS n, min(row_idx) AS first FROM r GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY n DESC, first) AS k FROM v)
SELECT w."group", r.score AS majority FROM w JOIN r ON r.row_idx = w.first WHERE k = 1""")
def _(spark, d):
    return G.majority(rollouts(spark, d), "group", "class", "score")


@_query("AGG-28", "SELECT role, round(avg(CASE WHEN contains(lower(text), 'the') THEN 1.0 ELSE 0.0 END), 5)::DOUBLE AS score FROM conversations GROUP BY 1")
def _(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return LK.share_by(c, "role", F.contains(F.lower("text"), F.lit("the"))).select("role", _r("score").alias("score"))


@_query("AGG-31", ROLLOUTS + 'SELECT "group", round(exp(-pow(var_pop(coalesce(ok, 0)) - 0.25, 2) / 0.02), 5) AS reward FROM r GROUP BY 1')
def _(spark, d):
    return G.spice(rollouts(spark, d), "group", "ok").select("group", _r("reward").alias("reward"))


@_query("AGG-30", TOKENS + "SELECT row_idx, round(CASE WHEN sum(mask) > 1 THEN var_samp(reward) FILTER (mask = 1) END, 4) + 0.0 AS variance FROM t GROUP BY 1")
def _(spark, d):
    return _tokens(spark, d).select("row_idx", (F.round(G.masked_var(F.col("rewards"), F.col("mask")), 4) + 0.0).alias("variance"))


@_query("AGG-01", ROLLOUTS + """SELECT "group", string_agg(coalesce(ok::INT::VARCHAR, '-'), '' ORDER BY row_idx) AS scores FROM r GROUP BY 1""")
def _(spark, d):
    listed = LK.in_order(rollouts(spark, d), "group", ["row_idx"], ["ok"])
    return listed.select("group", LK.score_strip(F.col("ok")).alias("scores"))


def _bootstrap(draws: int, digits: int) -> str:
    """SQL of the bootstrap of a mean by hash, with so many draws."""
    return ROLLOUTS + f""", i AS (SELECT "group", score, row_number() OVER (PARTITION BY "group" ORDER BY score) - 1 AS i FROM r),
z AS (SELECT "group", count(*) AS n FROM r GROUP BY 1),
p AS (SELECT "group", d, ('0x' || substr(md5('42:' || d || ':' || j), 1, 13))::BIGINT % n AS i FROM z, range(1, {draws + 1}) a(d), range(1, 9) b(j)),
m AS (SELECT p."group", d, avg(score) AS m FROM p JOIN i USING ("group", i) GROUP BY 1, 2)
SELECT "group", round(avg(m), {digits}) AS mean, round(stddev_pop(m), {digits}) AS std FROM m GROUP BY 1"""


@_query("AGG-25", _bootstrap(20, 5))
def _(spark, d):
    x = G.bootstrap(rollouts(spark, d), "group", "score", draws=20)
    return x.select("group", _r("mean").alias("mean"), _r("std").alias("std"))


# with eight decimals: the mean of 8000 scores of two decimals often lies half way between figures of five
@_query("AGG-25-full", _bootstrap(1000, 8))
def _(spark, d):
    x = G.bootstrap(rollouts(spark, d), "group", "score")
    return x.select("group", *[(F.round(c, 8) + 0.0).alias(c) for c in ("mean", "std")])


@_query("FLT-04", ROLLOUTS + 'SELECT row_idx FROM (SELECT *, count(*) OVER w AS n, min(ok) OVER w AS lo, max(ok) OVER w AS hi FROM r WINDOW w AS (PARTITION BY "group", class)) WHERE lo <> hi OR n = 1')
def _(spark, d):
    r = rollouts(spark, d).withColumn("g", F.concat_ws(":", "group", "class"))
    return L.drop_zero_variance(r, "g", "ok", keep_single=True).select("row_idx")


@_query("FLT-05", ROLLOUTS + ', g AS (SELECT "group" AS q, avg(score) AS reward FROM r GROUP BY 1 HAVING min(ok) <> max(ok)) SELECT q, round(reward, 5) AS reward FROM (SELECT *, row_number() OVER (ORDER BY reward DESC, q) AS k FROM g) g WHERE k <= ceil(0.2 * (SELECT count(DISTINCT "group") FROM r))')
def _(spark, d):
    every = rollouts(spark, d)
    total = every.select("group").distinct().count()  # before the filter, as the reference counts
    r = L.drop_zero_variance(every, "group", "ok", keep_single=False)
    g = r.groupBy(F.col("group").alias("q")).agg(F.avg("score").alias("reward"))
    return L.top_alpha(g, 0.2, total, "reward", "q").select("q", _r("reward").alias("reward"))


@_query("FLT-08", ROLLOUTS + ', s AS (SELECT doc, stddev_pop(score) AS s FROM r GROUP BY 1), t AS (SELECT quantile_cont(s, 0.5) AS tau FROM s) SELECT row_idx, CASE WHEN s <= tau THEN 0 ELSE score END AS masked FROM r JOIN s USING (doc), t')
def _(spark, d):
    # deviations are compared with a quantile of themselves: equal ones must stay equal, so they are not rounded
    return L.group_std_mask(rollouts(spark, d), "doc", "score", top_gamma=0.5).select("row_idx", "masked")


@_query("FLT-02", "SELECT doc_id FROM documents WHERE greatest(1, length(text) // 4) >= 200")
def _(spark, d):
    x = spark.read.parquet(f"{d}/documents.parquet")
    return x.where(S.token_estimate(F.col("text")) >= 200).select("doc_id")


@_query("FLT-16", "SELECT doc_id, CASE WHEN regexp_matches(source, '^src1') THEN 'math' WHEN regexp_matches(source, '[05]$') THEN 'mcq' ELSE 'general' END AS route FROM documents")
def _(spark, d):
    x = spark.read.parquet(f"{d}/documents.parquet")
    return x.select("doc_id", LK.route(F.col("source"), {"^src1": "math", "[05]$": "mcq"}, "general").alias("route"))


@_query("JN-01", ROLLOUTS + "SELECT row_idx, doc_id, lang FROM r JOIN documents ON doc_id = doc")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumnRenamed("doc_id", "id").withColumn("doc_id", F.col("id"))
    return LK.with_document(rollouts(spark, d), docs, "doc", "id", ["doc_id", "lang"]).select("row_idx", "doc_id", "lang")


@_query("JN-03", ROLLOUTS + "SELECT row_idx, CASE WHEN ok IS NOT NULL THEN coalesce(o_totalprice, 0) ELSE 0 END AS reward FROM r LEFT JOIN orders ON o_orderkey = row_idx")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice")
    joined = rollouts(spark, d).join(o, F.col("o_orderkey") == F.col("row_idx"), "left")
    return joined.select("row_idx", F.when(F.col("ok").isNotNull(), F.coalesce("o_totalprice", F.lit(0.0))).otherwise(0.0).alias("reward"))


@_query("JN-04", ROLLOUTS + 'SELECT "group", arg_min(class, row_idx) AS class FROM r GROUP BY 1')
def _(spark, d):
    return LK.first_value(rollouts(spark, d), "group", "class", "row_idx")


@_query("JN-05", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def _(spark, d):
    c, o = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "orders"))
    return LK.outside(c.select("c_custkey"), o, "c_custkey", "o_custkey")


@_query("JN-07", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    c, o = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "orders"))
    return LK.inside(c.select("c_custkey"), o, "c_custkey", "o_custkey")


@_query("JN-02", ROLLOUTS + ", g AS (SELECT doc, count(*) AS n FROM r WHERE ok = 1 GROUP BY 1) SELECT doc_id, coalesce(n, 0) AS n FROM documents LEFT JOIN g ON doc = doc_id")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    return LK.counted(docs, rollouts(spark, d).where("ok = 1"), "doc_id", "doc")


@_query("RWD-05", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), z AS (SELECT v AS w FROM e WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(v, w), 4) + 0.0 AS dot, round(list_cosine_similarity(v, w), 4) + 0.0 AS cosine FROM e, z")
def _(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    z = e.where("vec_id = 0").select(F.col("embedding").alias("w"))  # the one reference gradient
    x = e.join(F.broadcast(z))
    v, w = F.col("embedding"), F.col("w")
    return x.select("vec_id", (F.round(L.dot(v, w), 4) + 0.0).alias("dot"), (F.round(L.cosine(v, w), 4) + 0.0).alias("cosine"))


@_query("RWD-08", ROLLOUTS + "SELECT row_idx, round(least(-(length - 4) / 2.0 * 0.5, 0), 5)::DOUBLE + 0.0 AS penalty FROM r")
def _(spark, d):
    return rollouts(spark, d).select("row_idx", _r(L.overlong_penalty(F.col("length"), 6, 2, 0.5)).alias("penalty"))


@_query("SMP-01", ROLLOUTS + """, j AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY row_idx) - 1 AS j, count(*) OVER (PARTITION BY doc) AS k, min(row_idx) OVER (PARTITION BY doc) AS f FROM r)
SELECT row_idx, round((j + 0.5) / k, 8) AS at, f AS first_seen FROM j""")
def _(spark, d):
    x = L.stratify(rollouts(spark, d), "doc", "row_idx")
    return x.select("row_idx", F.round("_at", 8).alias("at"), F.col("_first").alias("first_seen"))


@_query("SMP-05", ROLLOUTS + """, a AS (SELECT "group" AS qid, avg(ok) AS a FROM r GROUP BY 1), b AS (SELECT qid, CASE WHEN a >= 0.75 THEN 'easy' WHEN a >= 0.25 THEN 'medium' ELSE 'hard' END AS bucket FROM a),
k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('7:' || qid), qid) AS k FROM b),
h AS (SELECT count(*) FILTER (bucket = 'easy') AS e, count(*) FILTER (bucket = 'medium') AS m, count(*) FILTER (bucket = 'hard') AS h FROM b),
s AS (SELECT greatest(e - 10, 0) AS e, greatest(m - 20, 0) AS m, greatest(h - 20, 0) AS h, greatest(10 - e, 0) + greatest(20 - m, 0) + greatest(20 - h, 0) AS lack FROM h),
x AS (SELECT *, CASE WHEN e = 0 THEN 0 WHEN m + h = 0 THEN least(lack, e) ELSE least(round_even(lack * e / (e + m + h), 0), e, lack) END AS xe FROM s),
y AS (SELECT *, CASE WHEN m = 0 THEN 0 WHEN h = 0 THEN least(lack - xe, m) ELSE least(round_even(lack * m / (e + m + h), 0), m, lack - xe) END AS xm FROM x)
SELECT qid, bucket FROM k, y WHERE k <= CASE bucket WHEN 'easy' THEN 10 + xe WHEN 'medium' THEN 20 + xm ELSE 20 + least(lack - xe - xm, h) END""")
def _(spark, d):
    a = rollouts(spark, d).groupBy(F.col("group").alias("qid")).agg(F.avg("ok").alias("a"))
    wanted = L.quotas({"easy": 0.2, "medium": 0.4, "hard": 0.4}, 50)
    return L.sample_buckets(a.withColumn("bucket", L.difficulty(F.col("a"))), "bucket", "qid", wanted, 7).select("qid", "bucket")


@_query("SMP-11", ROLLOUTS + "SELECT doc, row_idx FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, row_idx) AS k FROM r) WHERE k <= 3")
def _(spark, d):
    return L.top_per_group(rollouts(spark, d), "doc", "score", "row_idx", 3).select("doc", "row_idx")


@_query("SMP-14", ROLLOUTS + "SELECT row_idx, 24576 * length + length * length AS workload FROM r")
def _(spark, d):
    return rollouts(spark, d).select("row_idx", L.workload(F.col("length")).alias("workload"))


@_query("SMP-18", """SELECT n_nationkey, string_agg(c, '' ORDER BY md5('3:' || n_nationkey || ':' || i)) AS choices FROM nation, (SELECT unnest(['A', 'B', 'C', 'D']) AS c, unnest([0, 1, 2, 3]) AS i) GROUP BY 1""")
def _(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    letters = F.array(*[F.lit(c) for c in "ABCD"])
    return n.select("n_nationkey", F.array_join(L.shuffle_choices(letters, 3, F.col("n_nationkey")), "").alias("choices"))


@_query("SRC-06", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def _(spark, d):
    return L.keep_last(spark.read.parquet(f"{d}/orders.parquet"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@_query("SET-05", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def _(spark, d):
    return L.keep_first(spark.read.parquet(f"{d}/orders.parquet"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@_query("SET-01", "SELECT c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def _(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))


@_query("PRJ-05", ROLLOUTS + "SELECT (i - 1)::BIGINT AS row_idx, r.\"group\" FROM (SELECT unnest([5, 3, 3, 9]) AS f, unnest([1, 2, 3, 4]) AS i) JOIN r ON r.row_idx = f")
def _(spark, d):
    return B.gather(rollouts(spark, d).select("row_idx", "group"), [5, 3, 3, 9])


@_query("PRJ-06", ROLLOUTS + "SELECT row_idx FROM r WHERE row_idx >= 10 AND row_idx < 500 AND (row_idx - 10) % 3 = 0")
def _(spark, d):
    return B.slice_rows(rollouts(spark, d), 10, 500, 3).select("row_idx")


@_query("PRJ-08", ROLLOUTS + "SELECT row_idx * 3 + k AS row_idx, score FROM r, range(0, 3) t(k)")
def _(spark, d):
    return B.repeat(rollouts(spark, d).select("row_idx", "score"), 3)


@_query("PRJ-09", ROLLOUTS + "SELECT row_idx, k::INT AS repeat_idx FROM r, range(0, 7) t(k) WHERE k < length - 1")
def _(spark, d):
    return B.repeat_each(rollouts(spark, d).select("row_idx", "length"), (F.col("length") - 1).cast("int")).select("row_idx", "repeat_idx")


@_query("PRJ-12", ROLLOUTS + "SELECT row_idx, (row_idx // 64)::BIGINT AS chunk FROM r")
def _(spark, d):
    return B.split(rollouts(spark, d), 64).select("row_idx", "chunk")


@_query("PRJ-22", TOKENS + "SELECT row_idx, string_agg(id::VARCHAR, ',' ORDER BY pos) FILTER (pos <= 4) || repeat(',-1', greatest(0, 4 - count(*))::INT) AS ids FROM t GROUP BY 1")
def _(spark, d):
    return _tokens(spark, d).select("row_idx", F.array_join(F.transform(B.pad_sequence(F.col("ids"), 4, -1), lambda x: x.cast("string")), ",").alias("ids"))


@_query("PRJ-24", TOKENS + "SELECT row_idx, round(sum(reward * mask) / nullif(sum(mask), 0), 5) + 0.0 AS mean FROM t GROUP BY 1")
def _(spark, d):
    t = _tokens(spark, d)
    some = F.exists("mask", lambda m: m == 1)
    return t.select("row_idx", _r(F.when(some, F.try_divide(F.aggregate(F.zip_with("rewards", "mask", lambda v, m: v * m), F.lit(0.0), lambda a, x: a + x), F.aggregate("mask", F.lit(0.0), lambda a, x: a + x)))).alias("mean"))


@_query("MSK-01", TOKENS + ", f AS (SELECT row_idx, min(pos) FILTER (id IN (1, 2)) AS f FROM t GROUP BY 1) SELECT row_idx, pos, CASE WHEN f IS NULL OR pos <= f THEN 1 ELSE 0 END AS x FROM t JOIN f USING (row_idx)")
def _(spark, d):
    t = _tokens(spark, d)
    return t.select("row_idx", F.posexplode(B.first_eos_mask(F.col("ids"), [1, 2])).alias("pos", "x")).select("row_idx", (F.col("pos") + 1).cast("long").alias("pos"), "x")


_TEXT = "SELECT conv_id, turn, "
_FROM = " FROM conversations"


def _text(name: str, column, sql: str) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", column(F.col("text")).alias("x"))

    register(name, query, f"{_TEXT}{sql} AS x{_FROM}")


_text("STR-22", S.opener, "CASE WHEN ltrim(lower(coalesce(text, '')), E' \\t\\n') LIKE 'alright%' THEN 'alright' WHEN ltrim(lower(coalesce(text, '')), E' \\t\\n') LIKE 'to %' THEN 'to' ELSE 'others' END")
_text("STR-29", S.choice_letter, r"""upper(coalesce(CASE WHEN regexp_matches(text, 'answer is\s+\(?([A-J])\)?', 'i') THEN regexp_extract(text, 'answer is\s+\(?([A-J])\)?', 1, 'i') END,
  CASE WHEN regexp_matches(text, '[aA]nswer:\s*([A-J])') THEN regexp_extract(text, '.*[aA]nswer:\s*([A-J])', 1) END, list_extract(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g'), '\b([A-J])\b', 1), -1)))""")
_text("STR-08", S.squad, r"""array_to_string(list_filter(string_split_regex(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')""")
# answers and percentages of each row's own length, where they are and where they aren't
_text("STR-11", lambda t: S.grade_school_answer(F.concat(t, F.when(F.length(t) % 3 > 0, F.concat(F.lit(" #### 1,"), F.length(t) + 100)).otherwise(" ####")), "strict"), "CASE WHEN length(text) % 3 > 0 THEN '1' || (length(text) + 100) END")
_text("STR-21", lambda t: S.canonical_percent(F.concat(F.regexp_replace(t, " ", "% "), F.lit(" "), F.length(t), F.lit("% 5\\% x%"))), "regexp_replace(replace(text, ' ', '% '), '([0-9])%', '\\1/100', 'g') || ' ' || length(text) || '/100 5/100 x%'")
_text("DOC-07", S.token_estimate, "greatest(1, length(text) // 4)::INT")
_VERDICT = "element_at(array('It is correct', 'CORRECT? No: incorrect.', 'incorrectly so', 'Correct'), cast(length(text) % 4 + 1 as int))"
_text("STR-28", lambda t: S.verdict(F.concat(F.lit("verdict: "), F.expr(_VERDICT), F.lit("; "), F.length(t))), "CASE length(text) % 4 WHEN 1 THEN false WHEN 2 THEN NULL ELSE true END")
