"""More of the registered queries: reshaping, lookups, validity, summaries. Tables stand for the same things as in ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import aggregates as G
from quern.operators import batch as B
from quern.operators import filters as L
from quern.operators import joins as J
from quern.plans.queries import ROLLOUTS, TOKENS, _query, _r, _tokens, rollouts


def _joined(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias(column)


@_query("PRJ-01", ROLLOUTS + "SELECT row_idx, score FROM r")
def _(spark, d):
    return rollouts(spark, d).select("row_idx", "score")


@_query("PRJ-02", ROLLOUTS + 'SELECT row_idx, "group", score, doc FROM r')
def _(spark, d):
    return rollouts(spark, d).drop("class", "length", "ok")


@_query("PRJ-03", ROLLOUTS + 'SELECT row_idx AS position, "group" AS uid FROM r')
def _(spark, d):
    return rollouts(spark, d).select("row_idx", "group").withColumnsRenamed({"row_idx": "position", "group": "uid"})


@_query("PRJ-04", ROLLOUTS + "SELECT row_idx, score, length FROM r")
def _(spark, d):
    r = rollouts(spark, d)
    return B.union_columns(r.select("row_idx", "score"), r.select("row_idx", "score", "length"))


@_query("PRJ-07", ROLLOUTS + "SELECT (SELECT max(row_idx) FROM r) - row_idx AS row_idx, score FROM r")
def _(spark, d):
    r = rollouts(spark, d).select("row_idx", "score")
    return J.reorder(r, F.lit(r.count() - 1) - F.col("row_idx"))


@_query("PRJ-10", ROLLOUTS + "SELECT row_idx * 2 + k AS row_idx, CASE k WHEN 0 THEN length || ',' || doc ELSE doc || ',' || length END AS a FROM r, range(0, 2) t(k)")
def _(spark, d):
    a = rollouts(spark, d).select("row_idx", F.array("length", "doc", "doc", "length").alias("a"))
    return B.unfold_chunks(a, "a", 2).select("row_idx", _joined("a"))


@_query("PRJ-11", ROLLOUTS + "SELECT row_idx, row_idx // ((SELECT count(*) FROM r) // 4) AS chunk FROM r")
def _(spark, d):
    r = rollouts(spark, d).select("row_idx")
    return B.chunk(r, 4, r.count())


@_query(
    "PRJ-13",
    ROLLOUTS + ", n AS (SELECT count(*) AS n FROM r) SELECT row_idx, score, false AS is_pad FROM r UNION ALL "
    "SELECT n + row_idx, score, true FROM r, n WHERE row_idx < (7 - n % 7) % 7",
)
def _(spark, d):
    r = rollouts(spark, d).select("row_idx", "score")
    return B.pad_to_divisor(r, 7, r.count())


@_query("PRJ-14", ROLLOUTS + "SELECT row_idx, score FROM r")
def _(spark, d):
    r = rollouts(spark, d).select("row_idx", "score")
    return B.unpad(B.pad_to_divisor(r, 7, r.count()))


@_query(
    "PRJ-15",
    ROLLOUTS + ", n AS (SELECT count(*) AS n FROM r) SELECT row_idx, score FROM r UNION ALL SELECT n + k, score FROM r, n, range(0, 3) t(k) WHERE row_idx = n - 1",
)
def _(spark, d):
    r = rollouts(spark, d).select("row_idx", "score")
    return J.pad_edge(r, 3, r.count(), "last")


@_query("PRJ-16", ROLLOUTS + "SELECT row_idx // 6 AS batch_idx, string_agg(length::VARCHAR, ',' ORDER BY row_idx) AS length FROM r GROUP BY 1")
def _(spark, d):
    return B.fold(rollouts(spark, d).select("row_idx", "length"), "length", 6).select("batch_idx", _joined("length"))


@_query("PRJ-21", TOKENS + "SELECT row_idx, coalesce(string_agg(id::VARCHAR, ',' ORDER BY pos) FILTER (mask = 1), '') AS ids FROM t GROUP BY 1")
def _(spark, d):
    return _tokens(spark, d).select("row_idx", B.unpad_by_mask(F.col("ids"), F.col("mask")).alias("ids")).select("row_idx", _joined("ids"))


@_query(
    "PRJ-23",
    TOKENS + "SELECT row_idx, pos, CASE WHEN pos = max(CASE WHEN mask = 1 THEN pos END) OVER (PARTITION BY row_idx) THEN 2.5 ELSE 0.0 END::DOUBLE AS x FROM t",
)
def _(spark, d):
    placed = _tokens(spark, d).select("row_idx", F.posexplode(B.at_last_token(F.lit(2.5), F.col("mask"))).alias("pos", "x"))
    return placed.select("row_idx", (F.col("pos") + 1).cast("long").alias("pos"), "x")


_LOG = "(value - 0.5) / 10"
for _level, _inside in {
    "token": f"exp({_LOG}) BETWEEN 1 / 1.02 AND 1.02",
    "sequence": f"exp(sum({_LOG} * mask) OVER (PARTITION BY row_idx)) BETWEEN 1 / 1.02 AND 1.02",
    "geometric": f"exp(sum({_LOG} * mask) OVER (PARTITION BY row_idx) / sum(mask) OVER (PARTITION BY row_idx)) BETWEEN 1 / 1.02 AND 1.02",
}.items():

    @_query(f"FLT-14-{_level}", TOKENS + f"SELECT row_idx, pos, CASE WHEN {_inside} THEN mask ELSE 0 END AS x FROM t")
    def _(spark, d, level=_level):
        t = _tokens(spark, d)
        ratio = F.transform("values", lambda v: (v - 0.5) / 10)
        kept = t.select("row_idx", F.posexplode(L.rejection_mask(ratio, F.col("mask"), 1.02, level=level)).alias("pos", "x"))
        return kept.select("row_idx", (F.col("pos") + 1).cast("long").alias("pos"), "x")


@_query("FLT-09", ROLLOUTS + 'SELECT row_idx, "group" FROM r WHERE "group" IN (SELECT "group" FROM r GROUP BY 1 HAVING greatest(stddev_pop(ok), stddev_pop(length)) > 1e-12)')
def _(spark, d):
    return L.drop_flat_groups(rollouts(spark, d), "group", ["ok", "length"]).select("row_idx", "group")


@_query(
    "FLT-13",
    TOKENS + ", n AS (SELECT row_idx, greatest(sum(mask), 1) AS last FROM t GROUP BY 1) SELECT row_idx, row_idx % 3 = 0 AND id = 2 AS mid FROM t JOIN n USING (row_idx) WHERE pos = last",
)
def _(spark, d):
    score = F.when(F.col("row_idx") % 3 != 0, 1.0)
    return _tokens(spark, d).select("row_idx", L.mid_eos(F.col("ids"), F.col("mask"), score, 2).alias("mid"))


@_query("FLT-15", "SELECT c_custkey, c_nationkey BETWEEN 4 AND 8 OR c_nationkey = 0 OR (c_nationkey > 20 AND c_mktsegment = 'BUILDING') AS ok FROM customer")
def _(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    choices = F.when(F.col("c_nationkey") <= 20, F.array_repeat(F.lit("x"), F.col("c_nationkey")))
    kind = F.when(F.col("c_mktsegment") == "BUILDING", " QA_open")
    return c.select("c_custkey", L.structure_ok(F.col("c_name"), F.col("c_mktsegment"), choices, kind).alias("ok"))


@_query("JN-06", "SELECT doc_id, source FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source")
    return J.excluding(docs, spark.read.parquet(f"{d}/labels.parquet"), "doc_id")


_BOOK = "SELECT l_orderkey AS o, l_linenumber AS line, CASE WHEN l_quantity < 30 THEN (l_partkey % 7)::INT END AS chapter, CASE WHEN l_discount > 0.05 THEN l_returnflag END AS label, (l_suppkey % 5)::INT AS num FROM lineitem"


@_query(
    "JN-08",
    f"""WITH b AS ({_BOOK}), e AS (SELECT *, o * 10 + line AS pos FROM b),
p AS (SELECT chapter, label, num, min(pos) AS problem FROM e WHERE o % 2 = 0 GROUP BY 1, 2, 3),
a AS (SELECT chapter, label, num, min(pos) AS answer FROM e WHERE o % 2 = 1 AND line > 4 GROUP BY 1, 2, 3)
SELECT problem, coalesce(
  (SELECT max(answer) FROM a WHERE a.num = p.num AND a.chapter IS NOT DISTINCT FROM p.chapter AND a.label IS NOT DISTINCT FROM p.label),
  (SELECT max(answer) FROM a WHERE a.num = p.num AND a.chapter IS NOT DISTINCT FROM p.chapter AND a.label IS NULL),
  (SELECT max(answer) FROM a WHERE a.num = p.num AND a.chapter IS NULL AND a.label IS NOT DISTINCT FROM p.label),
  (SELECT max(answer) FROM a WHERE a.num = p.num AND a.chapter IS NULL AND a.label IS NULL)) AS answer FROM p""",
)
def _(spark, d):
    b = spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.col("l_orderkey").alias("at"), F.col("l_linenumber").alias("line"),
        F.when(F.col("l_quantity") < 30, (F.col("l_partkey") % 7).cast("int")).alias("chapter"),
        F.when(F.col("l_discount") > 0.05, F.col("l_returnflag")).alias("label"),
        (F.col("l_suppkey") % 5).cast("int").alias("num"),
    )
    e = b.withColumn("pos", F.col("at") * 10 + F.col("line"))
    problems = e.where("at % 2 = 0").select("chapter", "label", "num", F.col("pos").alias("problem"))
    problems = problems.withColumn("pos", F.col("problem"))
    answers = e.where("at % 2 = 1 AND line > 4").select("chapter", "label", "num", "pos", F.col("pos").alias("answer"))
    return J.fallback_join(problems, answers, "answer", "pos").select("problem", "answer")


@_query("JN-11", "SELECT d.doc_id, length(coalesce(b.text, d.text))::INT AS n FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    other = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text")
    return J.override(docs, other, "doc_id", "text").select("doc_id", F.length("text").alias("n"))


@_query("JN-13", "SELECT o_orderkey, coalesce(s, 0.0) AS s FROM orders LEFT JOIN (SELECT event_id AS o_orderkey, value AS s FROM events WHERE event_id % 3 = 0) USING (o_orderkey)")
def _(spark, d):
    scores = spark.read.parquet(f"{d}/events.parquet").where("event_id % 3 = 0").select(F.col("event_id").alias("o_orderkey"), F.col("value").alias("s"))
    return J.with_default(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), scores, "o_orderkey", "s", 0.0)


_GROUPS = 'SELECT class, count(*) AS n, round(avg(score), 5) + 0.0 AS mean FROM r GROUP BY 1'


@_query("AGG-09", ROLLOUTS + f"SELECT * FROM ({_GROUPS}) WHERE (SELECT count(DISTINCT class) FROM r) > 1")
def _(spark, d):
    return G.sub_summaries(rollouts(spark, d), "class", "score").select("class", "n", _r("mean").alias("mean"))


_REWARDS = "round(avg(score), 5) AS mean, round(stddev_pop(score), 5) AS std, min(score) AS min, max(score) AS max, round(median(score), 5) AS median, count(score)::DOUBLE AS num_scored, count_if(score > 20)::DOUBLE AS num_positive, round(count_if(score > 20) / count(score), 5) AS frac_positive"


@_query("AGG-18", ROLLOUTS + ", c AS (SELECT * REPLACE (score - 20 AS score) FROM r) SELECT " + _REWARDS.replace("score > 20", "score > 0") + " FROM c")
def _(spark, d):
    m = G.reward_metrics(rollouts(spark, d).withColumn("score", F.col("score") - 20), "score")
    return m.select(*[(_r(c) if c in ("mean", "std", "median", "frac_positive") else F.col(c)).alias(c) for c in m.columns])


@_query(
    "AGG-10",
    ROLLOUTS + ", m AS (SELECT count(score)::DOUBLE AS num_scored, max(score) AS max FROM r) "
    "SELECT 'reward/num_scored' AS name, num_scored AS value FROM m UNION ALL SELECT 'reward/max', max FROM m",
)
def _(spark, d):
    return G.flatten(G.reward_metrics(rollouts(spark, d), "score").select("num_scored", "max"), "reward")


_REASON = "CASE row_idx % 11 WHEN 0 THEN 'failed_parse' WHEN 1 THEN 'empty_question' WHEN 2 THEN 'invalid_ground_truth' END"


@_query(
    "AGG-17",
    ROLLOUTS + f", q AS (SELECT doc, {_REASON} AS reason FROM r) SELECT count(DISTINCT doc) AS num_documents, count(*) AS num_generated, count_if(reason IS NULL)::BIGINT AS num_valid, "
    "count_if(reason IS NOT NULL)::BIGINT AS num_invalid, round(count_if(reason IS NULL) / count(*), 5) AS frac_valid, round(count_if(reason IS NULL) / count(DISTINCT doc), 5) AS valid_per_doc, "
    "count_if(reason = 'failed_parse')::BIGINT AS num_failed_parses, count_if(reason = 'empty_question')::BIGINT AS num_empty_questions, count_if(reason = 'invalid_ground_truth')::BIGINT AS num_invalid_ground_truth FROM q",
)
def _(spark, d):
    m = G.question_rollouts(rollouts(spark, d).withColumn("reason", F.expr(_REASON)), "doc", "reason")
    return m.select(*[(_r(c) if c in ("frac_valid", "valid_per_doc") else F.col(c)).alias(c) for c in m.columns])


@_query(
    "AGG-29",
    ROLLOUTS + 'SELECT "group", round(CASE WHEN count(*) = 1 THEN 0 ELSE avg(score) END, 5) + 0.0 AS mean, '
    'round(CASE WHEN count(*) = 1 THEN 1 ELSE sqrt(greatest(var_samp(score), 1e-6)) END, 5) + 0.0 AS std, count(*) AS count FROM r GROUP BY 1',
)
def _(spark, d):
    return G.group_mean_std(rollouts(spark, d), "group", "score").select("group", _r("mean").alias("mean"), _r("std").alias("std"), "count")
