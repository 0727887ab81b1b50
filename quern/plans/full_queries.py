"""Operators in full where an earlier query of the same number shows a part: other modes, both readings, whole summaries."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from quern.functions import markdown as MD
from quern.functions import strings as S
from quern.functions.answers import over
from quern.operators import advantages as A
from quern.operators import aggregates as G
from quern.operators import batch as B
from quern.operators import checkpoints as CK
from quern.operators import evaluation as E
from quern.operators import filters as L
from quern.operators import losses as O
from quern.operators import registries as R
from quern.plans.data_queries import _query
from quern.plans.queries import ROLLOUTS, TOKENS, _per_token, _tokens, rollouts
from quern.plans.text_queries import PARTS, _text, parts
from quern.plans.token_queries import SQL as TOKEN_SQL
from quern.plans.token_queries import tokens
from quern.session import scratch_path
from quern.sources import readers as IN

_R = ROLLOUTS.rstrip()


def _joined(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias(column)


# --- batches and masks


@_query("PRJ-05-mask", _R + ' SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, "group" FROM r WHERE length % 3 > 0')
def _(spark, d):
    return B.masked(rollouts(spark, d).select("row_idx", "group", "length"), F.col("length") % 3 > 0).select("row_idx", "group")


@_query("PRJ-08-tiled", _R + ", n AS (SELECT count(*) AS n FROM r) SELECT row_idx + k * n AS row_idx, score FROM r, n, range(0, 3) t(k)")
def _(spark, d):
    return B.repeat(rollouts(spark, d).select("row_idx", "score"), 3, interleave=False)


@_query("PRJ-16-unfold", _R + " SELECT row_idx, length FROM r")
def _(spark, d):
    folded = B.fold(rollouts(spark, d).select("row_idx", "length"), "length", 6)
    return B.unfold(folded, "length", 6)


@_query("PRJ-21-padded", TOKENS + """, s AS (SELECT row_idx, id, pos + 4 - count(*) OVER (PARTITION BY row_idx) // 2 AS k FROM t), g AS (SELECT r.row_idx, k, s.id FROM (SELECT DISTINCT row_idx FROM t) r CROSS JOIN range(1, 9) g(k) LEFT JOIN s USING (row_idx, k))
SELECT row_idx, string_agg(coalesce(id, -1)::VARCHAR, ',' ORDER BY k) AS ids, string_agg((id IS NOT NULL)::INT::VARCHAR, ',' ORDER BY k) AS mask FROM g GROUP BY 1""")
def _(spark, d):
    t = _tokens(spark, d)
    half = F.floor(F.size("ids") / 2).cast("int")
    prompt, response = F.slice("ids", 1, half), F.slice(F.col("ids"), half + 1, F.size("ids"))
    padded = B.left_right(prompt, response, 4, 4, -1)
    return t.select("row_idx", padded.alias("p")).select("row_idx", F.col("p.ids").alias("ids"), F.col("p.mask").alias("mask")).select("row_idx", _joined("ids"), _joined("mask"))


for _mode, _kept in (
    ("left", "pos > n - 4"),
    ("middle", "(n <= 4 OR pos <= 2 OR pos > n - 2)"),
):

    @_query(f"PRJ-22-{_mode}", TOKENS + f", p AS (SELECT *, count(*) OVER (PARTITION BY row_idx) AS n FROM t) SELECT row_idx, repeat('-1,', greatest(0, 4 - any_value(n))::INT) || string_agg(id::VARCHAR, ',' ORDER BY pos) FILTER ({_kept}) AS ids FROM p GROUP BY 1")
    def _(spark, d, mode=_mode):
        return _tokens(spark, d).select("row_idx", B.pad_sequence(F.col("ids"), 4, -1, left=True, truncation=mode).alias("ids")).select("row_idx", _joined("ids"))


@_query("MSK-02", TOKENS + ", p AS (SELECT *, count(*) OVER (PARTITION BY row_idx) AS n FROM t) SELECT row_idx, coalesce(string_agg(mask::VARCHAR, ',' ORDER BY pos) FILTER (pos > (n + 1) // 2), '') AS mask FROM p GROUP BY 1")
def _(spark, d):
    t = _tokens(spark, d).withColumn("responses", F.slice("ids", 1, F.floor(F.size("ids") / 2).cast("int")))
    return t.select("row_idx", B.response_mask(F.col("mask"), F.col("responses")).alias("mask")).select("row_idx", _joined("mask"))


@_query("MSK-04", TOKENS + """, l AS (SELECT row_idx, count(*) AS n, sum(count(*)) OVER (PARTITION BY row_idx // 16 ORDER BY row_idx) AS upto FROM t GROUP BY 1),
i AS (SELECT row_idx // 16 AS batch, string_agg(id::VARCHAR, ',' ORDER BY row_idx, pos) AS ids FROM t GROUP BY 1),
o AS (SELECT row_idx // 16 AS batch, '0,' || string_agg(upto::BIGINT::VARCHAR, ',' ORDER BY row_idx) AS offsets, string_agg(row_idx::VARCHAR, ',' ORDER BY row_idx) AS rows FROM l GROUP BY 1) SELECT * FROM i JOIN o USING (batch)""")
def _(spark, d):
    t = _tokens(spark, d).withColumn("batch", F.floor(F.col("row_idx") / 16)).withColumn("rows", F.col("row_idx"))
    out = B.collate(t, "batch", "row_idx", ["ids"], ["rows"])
    return out.select("batch", _joined("ids"), _joined("offsets"), _joined("rows"))


# --- advantages


@_query("ADV-07-whitened", TOKENS + """, a AS (SELECT *, sum(1 - mask) OVER (PARTITION BY row_idx ORDER BY pos) AS run FROM t),
g AS (SELECT *, sum(reward * 0.5 ** pos) OVER (PARTITION BY row_idx, run ORDER BY pos DESC) / 0.5 ** pos AS x FROM a),
w AS (SELECT avg(x) FILTER (mask = 1) AS mean, var_samp(x) FILTER (mask = 1) AS var FROM g)
SELECT row_idx, pos, round((x - mean) / sqrt(var + 1e-8) * mask, 5) + 0.0 AS advantage, round(x, 5) + 0.0 AS returns FROM g, w""")
def _(spark, d):
    x = A.reinforce_plus_plus(_tokens(spark, d), "row_idx", "rewards", "mask", 0.5)
    return x.select("row_idx", (F.col("pos") + 1).cast("long").alias("pos"), "advantage", "returns")


@_query("ADV-08-baseline", TOKENS + ", b AS (SELECT *, row_idx % 7 * 3.0 AS base FROM t) SELECT row_idx, pos, round(sum(reward * mask) OVER (PARTITION BY row_idx ORDER BY pos DESC) - base * mask, 5) + 0.0 AS x FROM b")
def _(spark, d):
    t = _tokens(spark, d).withColumn("base", F.col("row_idx") % 7 * 3.0)
    return _per_token(t, A.remax(F.col("rewards"), F.col("base"), F.col("mask")))


@_query("FLT-05-random", _R + ', g AS (SELECT DISTINCT "group" AS q FROM r) SELECT q FROM (SELECT q, row_number() OVER (ORDER BY md5(\'11:\' || q), q) AS k, count(*) OVER () AS n FROM g) WHERE k <= ceil(0.3 * n)')
def _(spark, d):
    g = rollouts(spark, d).select(F.col("group").alias("q")).distinct()
    return L.random_alpha(g, 0.3, g.count(), "q", 11)


# --- summaries

_LADDER = _R + """, q AS (SELECT "group", count(*) AS n, count(ok) AS v, coalesce(sum(ok), 0) AS c FROM r GROUP BY 1), k AS (SELECT *, unnest([1, 2, 4, 8, 16, 32]) AS k FROM q),
p AS (SELECT k, CASE WHEN n < k OR c = 0 THEN 0 WHEN n - c < k THEN 1 ELSE 1 - (SELECT product(1 - k::DOUBLE / i) FROM range((n - c + 1)::BIGINT, n + 1) t(i)) END AS s,
  CASE WHEN v < k OR c = 0 THEN 0 WHEN v - c < k THEN 1 ELSE 1 - (SELECT product(1 - k::DOUBLE / i) FROM range((v - c + 1)::BIGINT, v + 1) t(i)) END AS l FROM k)"""


@_query("AGG-05-lenient", _LADDER + " SELECT k, round(avg(s), 5) + 0.0 AS strict, round(avg(l), 5) + 0.0 AS lenient FROM p GROUP BY 1")
def _(spark, d):
    return G.pass_ladders(rollouts(spark, d), "group", "ok", 32)


@_query("AGG-09-full", _LADDER.replace('SELECT "group", count', 'SELECT class, "group", count').replace("GROUP BY 1), k AS", "GROUP BY 1, 2), k AS").replace("(SELECT k, CASE", "(SELECT class, n, v, c, k, CASE") + """, m AS (
  SELECT class, 'total_questions' AS metric, count(*)::DOUBLE AS value FROM q GROUP BY 1 UNION ALL SELECT class, 'total_answers', sum(n) FROM q GROUP BY 1 UNION ALL SELECT class, 'valid_answers', sum(v) FROM q GROUP BY 1
  UNION ALL SELECT class, 'correct_answers', sum(c) FROM q GROUP BY 1 UNION ALL SELECT class, 'accuracy_strict', sum(c) / sum(n) FROM q GROUP BY 1 UNION ALL SELECT class, 'accuracy_lenient', coalesce(sum(c) / nullif(sum(v), 0), 0) FROM q GROUP BY 1
  UNION ALL SELECT class, 'pass_at_' || k || '_strict', avg(s) FROM p WHERE k <= 4 GROUP BY 1, 2, k UNION ALL SELECT class, 'pass_at_' || k || '_lenient', avg(l) FROM p WHERE k <= 4 GROUP BY 1, 2, k)
SELECT class, metric, round(value, 5) + 0.0 AS value FROM m WHERE (SELECT count(DISTINCT class) FROM r) > 1""")
def _(spark, d):
    return E.sub_evaluations(rollouts(spark, d), "class", "group", "ok", 4)


@_query("AGG-13-eos", _R + """, e AS (SELECT *, ok IS NULL AND row_idx % 3 = 0 AS eos FROM r), x AS (SELECT class, count(*) AS n, count_if(eos) AS k FROM e GROUP BY 1), t AS (SELECT sum(n) AS n, sum(k) AS k FROM x)
SELECT class, round(x.k / x.n, 5) + 0.0 AS share, x.k::BIGINT AS count FROM x UNION ALL SELECT 'all', round(k / n, 5) + 0.0, k::BIGINT FROM t""")
def _(spark, d):
    return G.flag_shares(rollouts(spark, d).withColumn("eos", F.col("ok").isNull() & (F.col("row_idx") % 3 == 0)), "class", "eos")


@_query("AGG-17-lengths", PARTS + ", " + "q AS (SELECT 2 + id % 5 AS num_choices, length(name) AS question_char_len, size AS response_length_tokens FROM p) " + " UNION ALL ".join(
    f"SELECT '{c}' AS name, metric, round(value, 5) + 0.0 AS value FROM (SELECT count({c})::DOUBLE AS count, avg({c})::DOUBLE AS mean, stddev_pop({c})::DOUBLE AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, quantile_cont({c}, 0.5)::DOUBLE AS median FROM q) UNPIVOT (value FOR metric IN (COLUMNS(*)))"
    for c in ("num_choices", "question_char_len", "response_length_tokens")
))
def _(spark, d):
    q = parts(spark, d).select(F.array_repeat("brand", (2 + F.col("id") % 5).cast("int")).alias("choices"), F.col("name").alias("question"), F.array_repeat(F.lit(1), F.col("size").cast("int")).alias("mask"))
    return E.question_lengths(q, "choices", "question", "mask")


# --- texts


@_query("STR-10-score", PARTS + " SELECT id, CASE id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 WHEN 2 THEN 0.1 ELSE 0.0 END::DOUBLE AS score FROM p")
def _(spark, d):
    t = _text(spark, d, "concat(case id % 4 when 1 then repeat('<answer>x</answer> ', 10) else '<answer>no</answer>' end, case when id % 4 = 3 then 'nothing' else concat(' <answer> The ', upper(name), '! </answer>') end)")
    truth = F.when(F.col("id") % 4 == 2, F.lit("another")).otherwise(F.concat(F.lit("the  "), "name"))
    text = F.when(F.col("id") % 4 == 3, F.lit("no tag at all")).otherwise(F.col("text"))
    return t.select("id", S.search_score(text, F.array(truth, F.lit("other")), 0.1).alias("score"))


@_query("STR-27-rest", PARTS + " SELECT id, 'before  and ' || name AS rest, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS calls FROM p")
def _(spark, d):
    t = _text(spark, d, "concat('before <tool_call>', if(id % 2 = 0, concat('{\"name\": \"', name, '\", \"arguments\": {\"n\": \"', id, '\"}}'), '{bad'), '</tool_call> and ', name)")
    return t.select("id", S.without_tool_calls(F.col("text")).alias("rest"), F.size(S.tool_calls(F.col("text"))).alias("calls"))


@_query("DOC-17", PARTS + """ SELECT id // 5 AS g, string_agg('Example ' || k || ':' || chr(10) || 'Question: ' || name || chr(10) || 'Choices:' || chr(10) || '  A) ' || brand || chr(10) || '  B) ' || type || chr(10) || 'Answer: ' || brand, chr(10) || chr(10) ORDER BY id) AS shown
FROM (SELECT *, row_number() OVER (PARTITION BY id // 5 ORDER BY id) AS k FROM p) GROUP BY 1""")
def _(spark, d):
    q = parts(spark, d).select(F.expr("id div 5").alias("g"), F.struct("id", F.col("name").alias("question_text"), F.array("brand", "type").alias("choices"), F.col("brand").alias("ground_truth")).alias("q"))
    return q.groupBy("g").agg(S.seed_examples(F.sort_array(F.collect_list("q"))).alias("shown"))


@_query("SRC-05-capped", PARTS + " SELECT id, name FROM (SELECT *, row_number() OVER (ORDER BY id) AS k FROM p) WHERE k <= 25")
def _(spark, d):
    path = scratch_path(spark, "questions")
    parts(spark, d).select("id", "name").orderBy("id").write.json(path)  # sorted parts, named in order
    return IN.capped(spark.read.schema("id long, name string").json(path), 25)


# --- checkpoints


@_query("CFG-01", """WITH n AS (SELECT n_nationkey AS k FROM nation) SELECT k, CASE k % 5 WHEN 0 THEN [k] WHEN 1 THEN [k, k + 1, k + 2] WHEN 2 THEN [k, k + 2, k + 4] WHEN 3 THEN [k, k + 1, k + 2, k + 9] ELSE [-1, k] END::VARCHAR AS steps FROM n""")
def _(spark, d):
    spec = """case n_nationkey % 5 when 0 then concat(n_nationkey) when 1 then concat(n_nationkey, ':', n_nationkey + 2) when 2 then concat('[', n_nationkey, ':', n_nationkey + 5, ':2]')
      when 3 then concat(n_nationkey, '-', n_nationkey + 2, ', ', n_nationkey + 9, ',', n_nationkey + 1) else concat(n_nationkey, ',-1, ', n_nationkey) end"""
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), F.expr(spec).alias("spec"))
    steps = over(CK.parse, "array<long>")(F.col("spec"))
    return n.select("k", F.concat(F.lit("["), F.array_join(F.transform(steps, lambda x: x.cast("string")), ", "), F.lit("]")).alias("steps"))


@_query("CFG-02", "SELECT r_regionkey::BIGINT * 10 AS step FROM region WHERE r_regionkey > 0")
def _(spark, d):
    folder = scratch_path(spark, "run")
    regions = spark.read.parquet(f"{d}/region.parquet")
    names = F.when(F.col("r_regionkey") > 0, F.concat(F.lit("global_step_"), F.col("r_regionkey") * 10)).otherwise("global_step_x")
    for name in [r.name for r in regions.select(names.alias("name")).collect()]:  # a folder each; there are five
        regions.where(names == name).write.json(f"{folder}/{name}")
    return spark.createDataFrame([(s,) for s in CK.discover(spark, folder)], "step long")


# --- sources and extension points


@_query("SRC-07", PARTS + """ SELECT id, 0 AS chunk, brand AS header, name AS page_content FROM p WHERE id <= 40 UNION ALL SELECT id, 1, brand || '/' || type, 'see ' || name FROM p WHERE id <= 40""")
def _(spark, d):
    path = scratch_path(spark, "markdown")
    t = _text(spark, d, r"""concat('<span id="page-', id, '-0"></span># ', brand, '\n', name, '\n## ', type, '\nsee ', name)""").where("id <= 40")
    t.select("id", "text").write.partitionBy("id").text(path)  # a folder of one text a document
    return MD.chunk(IN.texts(spark, path, "id"), "text", "id", least=0).select(F.col("key").alias("id"), "chunk", F.array_join(F.map_values("headers"), "/").alias("header"), "page_content")


@_query("JN-12", _R + " SELECT a.row_idx, a.score, a.length, b.class FROM r a JOIN r b ON b.row_idx = a.row_idx")
def _(spark, d):
    r = rollouts(spark, d)
    return B.union_columns(r.select("row_idx", "score", "length"), r.select("row_idx", "class", "length"))


@_query("UDF-01", PARTS + """, w AS (SELECT id, list_distinct(string_split(lower(name), ' ')) AS a, list_distinct(string_split(lower(name || ' ' || brand), ' ')) AS b FROM p)
SELECT id, round(len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1), 5) + 0.0 AS reward FROM w""")
def _(spark, d):
    rule = R.from_file(str(Path(__file__).with_name("own_reward.py")), "score")
    return parts(spark, d).select("id", rule(F.upper("name"), F.concat_ws(" ", "name", "brand")).alias("reward"))


@A.estimator("over_worst")
def _over_worst(df, score="score", group="group"):
    """A row's score over its group's least."""
    least = df.groupBy(F.col(group).alias("_group")).agg(F.min(score).alias("_least"))
    joined = df.join(least, F.col(group).eqNullSafe(F.col("_group")))
    return joined.select(*df.columns, (F.col(score) - F.col("_least")).alias("advantage"))


@_query("UDF-06", _R + ' SELECT row_idx, round(score - min(score) OVER (PARTITION BY "group"), 5) + 0.0 AS advantage FROM r')
def _(spark, d):
    return A.estimate("over_worst", rollouts(spark, d)).select("row_idx", "advantage")


@O.register_policy_loss("weighted_log")
def _weighted_log(tokens, weight=1.0):
    """The plain policy gradient with a weight."""
    return tokens.withColumn("loss", -weight * F.col("adv") * F.col("new"))


@_query("UDF-07", TOKEN_SQL.rstrip() + " SELECT row_idx, round(sum(-0.5 * adv * new * mask) / nullif(sum(mask), 0), 5) + 0.0 AS loss FROM t GROUP BY 1")
def _(spark, d):
    lossy = O.policy_loss("weighted_log", tokens(spark, d), weight=0.5)
    return lossy.groupBy("row_idx").agg(F.try_divide(F.sum(F.col("loss") * F.col("mask")), F.sum("mask")).alias("loss"))
