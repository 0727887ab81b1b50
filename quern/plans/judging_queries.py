"""Queries of competitions, judges, registries, summaries, results of other runners and streams, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import answers as X
from quern.functions import competition as C
from quern.functions import grading as N
from quern.operators import advantages as A
from quern.operators import batch as B
from quern.operators import judging as J
from quern.operators import lookups as LK
from quern.operators import registries as R
from quern.operators import resampling as BS
from quern.operators import vector_index as VI
from quern.plans.data_queries import _query
from quern.plans.queries import ROLLOUTS, rollouts
from quern.plans.text_queries import PARTS, _text, parts, spread
from quern.session import scratch_path
from quern.sources import results as IN
from quern.sources import writers as OUT
from quern.streaming import loop

_R = ROLLOUTS.rstrip()

# --- competition papers and figures


@_query("DOC-09", PARTS + " SELECT id, label, body FROM (SELECT id, 'A1' AS label, name AS body FROM p WHERE id % 3 > 0 UNION ALL SELECT id, 'B2', brand || ' \\begin{itemize} \\item[(a)] x \\end{itemize}' FROM p WHERE id % 3 > 0)")
def _(spark, d):
    t = _text(spark, d, r"concat(if(id % 3 > 0, '\\begin{itemize} ', ''), '\\item[A1] ', name, ' \\item[B--2]\n', brand, ' \\begin{itemize} \\item[(a)] x \\end{itemize} \\end{itemize} tail')")
    cut = t.where("id % 3 > 0").unionByName(t.where("id % 3 = 0").withColumn("text", F.col("name")))
    return cut.select("id", F.explode(C.pieces(C.tex_items)(F.col("text"))).alias("x")).select("id", "x.label", "x.body")


@_query("DOC-10", PARTS + """ SELECT id, 'A1' AS label, CASE id % 3 WHEN 0 THEN '[A1.](#page-1-2) ' || name WHEN 1 THEN 'A1. ' || name ELSE '#### A1' || chr(10) || 'Solution. ' || name END AS body FROM p
UNION ALL SELECT id, 'N12', CASE id % 3 WHEN 0 THEN '[N12.](#page-3-4) ' || brand ELSE 'N12. ' || brand END FROM p WHERE id % 3 < 2""")
def _(spark, d):
    t = _text(spark, d, r"""case id % 3 when 0 then concat('[A1.](#page-9-9) no\n### Solutions of all\n[A1.](#page-1-2) ', name, '\n[N12.](#page-3-4) ', brand)
      when 1 then concat('# SOLUTIONS\nA1. ', name, '\nN12. ', brand, '\n') else concat('#### A1\nshow\n#### N2\nx\n#### A1\nSolution. ', name, '\n') end""")
    return t.select("id", F.explode(C.pieces(C.shortlist_solutions)(F.col("text"))).alias("x")).select("id", "x.label", "x.body")


@_query("DOC-15", PARTS + " SELECT id, name || chr(10) || brand AS content FROM p")
def _(spark, d):
    return _text(spark, d, r"concat(if(id % 2 = 0, '\n# Putnam 1999 A1\r\n\n', ' '), name, '\r\n', brand, '\n\n')").select("id", C.without_title(F.col("text")).alias("content"))


@_query("FLT-12", PARTS + " SELECT id, id % 5 < 3 AS figure FROM p")
def _(spark, d):
    t = _text(spark, d, r"concat(name, case id % 5 when 0 then ' [ASY] ' when 1 then ' draw(x); dot(y)' when 2 then ' ![a](b.png)' when 3 then ' draw(x) MP(z) [a](b)' else ' \\begin{TikZpicture}' end)")
    return t.select("id", C.has_figure(F.col("text")).alias("figure"))


@_query("JDG-02", PARTS + " SELECT id, CASE id % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'C' ELSE '' END AS letter FROM p")
def _(spark, d):
    t = _text(spark, d, "concat('I understand A through J ', lower(name), case id % 4 when 0 then ' (B) or A.' when 1 then ' E, then C' when 2 then ' AB' else ' F' end)")
    return t.select("id", C.cleansed_letter(F.col("text"), F.split(F.lit("1,2,3,4"), ",")).alias("letter"))


@_query("DOC-06", PARTS + """, g AS (SELECT id // 6 AS g, string_agg(name, chr(10) || chr(10) ORDER BY id) AS content, min(id) AS idx FROM p WHERE id % 6 < 3 GROUP BY 1)
SELECT idx, CASE WHEN g % 2 = 0 THEN 'Title ' || g ELSE 'Chapter ' || g END AS header1, 'Part ' || g AS header2, content FROM g UNION ALL SELECT id, NULL, NULL, name FROM p WHERE id % 6 >= 3""")
def _(spark, d):
    p = parts(spark, d)
    docs = p.select(F.col("id").alias("idx"), F.col("name").alias("content"))
    g = p.select(F.expr("id div 6").alias("g")).distinct()
    section = g.select((2 * F.col("g") + 1).alias("pos"), F.expr("concat('S', g, '.1')").alias("id"), F.expr("concat('Part ', g)").alias("title"), (6 * F.col("g")).alias("start"), (6 * F.col("g") + 2).alias("end"))
    chapter = g.where("g % 2 = 0").select((2 * F.col("g")).alias("pos"), F.expr("concat('C', g)").alias("id"), F.expr("concat('Title ', g)").alias("title"), (6 * F.col("g")).alias("start"), (6 * F.col("g") + 5).alias("end"))
    lone = g.where("g = 0").select(F.lit(-1).cast("long").alias("pos"), F.lit("X").alias("id"), F.lit("ignored").alias("title"), F.lit(0).cast("long").alias("start"), F.lit(9).cast("long").alias("end"))
    return J.merge_sections(docs, section.unionByName(chapter).unionByName(lone)).select("idx", "header1", "header2", "content")


# --- filters, prompts, retrieval

def _words():
    return F.size(F.split("name", " "))


@_query("FLT-01", PARTS + " SELECT id FROM p WHERE len(string_split(name, ' ')) <= 3 AND id % 7 > 0")
def _(spark, d):
    p = parts(spark, d)
    return J.fits(p, F.when(F.col("id") % 7 > 0, _words()), 3).select("id")


@_query("FLT-03", PARTS + " SELECT id FROM p WHERE id % 3 = 0 OR size > 20")
def _(spark, d):
    return J.keep_unless_rejected(parts(spark, d), F.when(F.col("id") % 3 > 0, F.col("size") > 20)).select("id")


@_query("PRM-01", "SELECT conv_id, string_agg(role || ':' || coalesce(text, ''), '|' ORDER BY turn) AS shown, count(*) AS n FROM conversations GROUP BY 1")
def _(spark, d):
    chats = LK.messages(spark.read.parquet(f"{d}/conversations.parquet"), "conv_id", "turn", "role", "text")
    return chats.select("conv_id", LK.shown(F.col("messages")).alias("shown"), "n")


@_query("PRM-02", PARTS + " SELECT count(*) AS questions, count(*) FILTER (len(string_split(name, ' ')) <= 3) AS kept, count(*) FILTER (len(string_split(name, ' ')) > 3) AS too_long FROM p")
def _(spark, d):
    return LK.fit_report(parts(spark, d), _words(), 3)


_RING = PARTS + """, o AS (SELECT id, name, row_number() OVER (ORDER BY md5('5:' || id), id) - 1 AS spot, ('0x' || substr(md5('5:start:' || id), 1, 8))::BIGINT AS start, count(*) OVER () AS n FROM p),
e AS (SELECT o.id, t.j AS place, (spot + 1 + (start + t.j) % (n - 1)) % n AS spot FROM o, range(3) t(j)), x AS (SELECT e.id, o.id AS example, o.name, e.place FROM e JOIN o USING (spot))"""


@_query("JN-10", _RING + " SELECT id, example, place FROM x")
def _(spark, d):
    return J.examples(parts(spark, d), "id", 4, 5)


@_query("PRM-03", _RING + " SELECT id, string_agg(name, ' / ' ORDER BY place) AS prompt FROM x GROUP BY 1")
def _(spark, d):
    p = parts(spark, d)
    shown = J.examples(p, "id", 4, 5).join(p.select(F.col("id").alias("example"), "name"), "example")
    return shown.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), " / ").alias("prompt"))


@_query("PRM-04", PARTS + " SELECT id, name FROM p")
def _(spark, d):
    made = OUT.save_batch(parts(spark, d).select("id", "name"), scratch_path(spark, "questions"))
    return spark.read.parquet(made.inputFiles()[0].rsplit("/", 1)[0])


_NEAREST = """WITH s AS (SELECT q.vec_id AS query, c.vec_id AS "match", list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, "match") AS rank FROM s)"""


@_query("JN-14", _NEAREST + ' SELECT query, "match", round(s, 5) + 0.0 AS similarity, rank::INT AS rank FROM k WHERE rank <= 5')
def _(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return J.nearest(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)


@_query("JN-14-index", None)
def _(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    index, fitted = VI.build(e, "vec_id", "embedding", 5)
    return VI.search(index, fitted, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)


@_query("JN-14-text", PARTS + " SELECT id, 'Doc 1 (Title: ' || name || ')' || chr(10) || brand || chr(10) || type || chr(10) || chr(10) || 'Doc 2 (Title: ' || brand || ')' AS shown FROM p")
def _(spark, d):
    return parts(spark, d).select("id", J.passages(F.array(F.concat_ws("\n", "name", "brand", "type"), F.col("brand"))).alias("shown"))


# --- summaries


_BY_PROMPT = _R + """, c AS (SELECT doc, "group", score, count(*) OVER w AS n, row_number() OVER (w ORDER BY score) AS i FROM r WINDOW w AS (PARTITION BY doc, "group")),
s AS (SELECT DISTINCT doc, "group", n, k FROM c, (SELECT unnest([2, 4, 8, 16, 32, 64, 128, 256]) AS k) WHERE k < n UNION SELECT DISTINCT doc, "group", n, n FROM c WHERE n > 1),
b AS (SELECT doc, "group", k, sum(score * ((i / n) ** k - ((i - 1) / n) ** k)) AS best, sum(score * score * ((i / n) ** k - ((i - 1) / n) ** k)) AS best2,
  sum(score * (((n - i + 1) / n) ** k - ((n - i) / n) ** k)) AS worst, sum(score * score * (((n - i + 1) / n) ** k - ((n - i) / n) ** k)) AS worst2 FROM c JOIN s USING (doc, "group", n) GROUP BY ALL),
m AS (SELECT doc, 'mean@' || count(*) AS metric, avg(score) AS v FROM r GROUP BY doc, "group" UNION ALL SELECT doc, 'std@' || count(*), stddev_pop(score) FROM r GROUP BY doc, "group" HAVING count(*) > 1
  UNION ALL SELECT doc, 'best@' || k || '/mean', best FROM b UNION ALL SELECT doc, 'best@' || k || '/std', sqrt(greatest(best2 - best * best, 0)) FROM b
  UNION ALL SELECT doc, 'worst@' || k || '/mean', worst FROM b UNION ALL SELECT doc, 'worst@' || k || '/std', sqrt(greatest(worst2 - worst * worst, 0)) FROM b)
SELECT doc, metric, round(avg(v), 5) + 0.0 AS value FROM m GROUP BY ALL"""


@_query("AGG-27", _BY_PROMPT)
def _(spark, d):
    return J.validation(rollouts(spark, d), "doc", "group", "score")


@_query("AGG-27-draws", None)
def _(spark, d):
    r = rollouts(spark, d).withColumn("vote", (F.col("length") % 3).cast("string"))
    return BS.validation(r, "doc", "group", "score", "row_idx", "vote")


@_query("AGG-25-reducers", None)
def _(spark, d):
    return BS.bootstrap(rollouts(spark, d), ["group"], "score", "row_idx", (4, 8), ("mean", "median", "best", "worst", "std"))


_POINTS = _R + """, s AS (SELECT doc, CASE row_idx % 9 WHEN 0 THEN 'retry_exhausted' WHEN 1 THEN 'zero_variance' ELSE 'ok' END AS status, CASE WHEN row_idx % 11 > 0 THEN (row_idx % 101) / 100.0::DOUBLE END AS cosine FROM r),
v AS (SELECT *, CASE WHEN status = 'ok' THEN cosine END AS x FROM s)"""


@_query("AGG-37", _POINTS + """ SELECT doc, count(*) AS total_points, count(x) AS valid_points, count(*) - count(x) AS skipped_points, count(*) FILTER (status = 'retry_exhausted') AS retry_exhausted_points,
count(*) FILTER (status = 'zero_variance') AS zero_variance_points, round(avg(x), 5) + 0.0 AS mean, round(stddev_pop(x), 5) + 0.0 AS std, min(x) AS min, max(x) AS max, round(median(x), 5) + 0.0 AS median,
""" + ", ".join(f"round(coalesce(avg((x > {t})::INT), 0), 5) + 0.0 AS frac_gt_{str(t).replace('.', 'p')}" for t in (0.5, 0.8, 0.9, 0.95)) + " FROM v GROUP BY 1")
def _(spark, d):
    status = F.when(F.col("row_idx") % 9 == 0, "retry_exhausted").when(F.col("row_idx") % 9 == 1, "zero_variance").otherwise("ok")
    cosine = F.when(F.col("row_idx") % 11 > 0, (F.col("row_idx") % 101) / 100.0)
    return J.sensitivity(rollouts(spark, d).select("doc", status.alias("status"), cosine.alias("cosine")), "doc", "cosine", "status")


@_query("AGG-39", _R + """, u AS (SELECT class, sum(length) AS p, sum(length * 3) AS c, sum(row_idx % 5) AS t, count(*) AS n FROM r GROUP BY 1)
SELECT class, p::BIGINT AS prompt_tokens, c::BIGINT AS completion_tokens, t::BIGINT AS reasoning_tokens, n AS num_calls, (p + c)::BIGINT AS total_tokens, CASE class WHEN 'click' THEN round((p * 2.0 + c * 8.0) / 1e6, 5) + 0.0 END AS estimated_cost_usd,
round(p / n, 5) + 0.0 AS avg_prompt_tokens, round(c / n, 5) + 0.0 AS avg_completion_tokens FROM u""")
def _(spark, d):
    r = rollouts(spark, d).select("class", F.col("length").alias("prompt_tokens"), (F.col("length") * 3).alias("completion_tokens"), (F.col("row_idx") % 5).alias("reasoning_tokens"))
    return J.usage(r, "class", {"click": (2.0, 8.0)})


@_query("AGG-41", _R + " SELECT round(sum(length) / count(*) * 32, 5) + 0.0 AS tokens FROM r")
def _(spark, d):
    return J.token_normaliser(rollouts(spark, d), "length", 8, 4)


@_query("ADV-12", _R + """, x AS (SELECT row_idx, "group", score * 0.77171234567 AS score FROM r)
SELECT row_idx, 'rloo' AS estimator, round(score - coalesce((sum(score) OVER w - score) / nullif(count(score) OVER w - 1, 0), 0), 5) + 0.0 AS advantage FROM x WINDOW w AS (PARTITION BY "group")
UNION ALL SELECT row_idx, 'grpo', round((score - CASE WHEN count(score) OVER w = 1 THEN 0 ELSE avg(score) OVER w END) / (CASE WHEN count(score) OVER w = 1 THEN 1 ELSE stddev_samp(score) OVER w END + 1e-6), 5) + 0.0 FROM x WINDOW w AS (PARTITION BY "group")""")
def _(spark, d):
    r = rollouts(spark, d).withColumn("score", F.col("score") * 0.77171234567)  # no halves at the last digit
    rloo, grpo = (A.estimate(name, r).select("row_idx", F.lit(name).alias("estimator"), "advantage") for name in ("rloo", "grpo"))
    return rloo.unionByName(grpo)


@_query("ADV-19", _R + """, s AS (SELECT row_idx // 100 AS step, avg(abs(score)) / 100 AS kl, count(*) AS n FROM r GROUP BY 1)
SELECT step, round(0.2 * product(1 + greatest(least(kl / 0.1 - 1, 0.2), -0.2) * n / 10000) OVER (ORDER BY step), 5) + 0.0 AS coefficient FROM s""")
def _(spark, d):
    steps = rollouts(spark, d).groupBy(F.expr("row_idx div 100").alias("step")).agg((F.avg(F.abs("score")) / 100).alias("kl"), F.count(F.lit(1)).alias("n"))
    return J.adaptive_kl(steps, "step", "kl", "n", 0.2, 0.1, 10000).select("step", "coefficient")


@_query("SMP-19", _R + """, t AS (SELECT "group", row_idx % 2 AS side, row_idx, score, a, row_number() OVER (PARTITION BY "group", a, row_idx % 2 ORDER BY md5('9:' || a || ':' || "group" || ':' || row_idx), row_idx) AS k FROM r, (SELECT unnest([1, 2, 3]) AS a)),
s AS (SELECT "group", a, side, min(score) < max(score) AND count(*) = 2 AS good FROM t WHERE k <= 2 GROUP BY ALL), g AS (SELECT "group", a, count(*) FILTER (good) AS good FROM s GROUP BY ALL),
f AS (SELECT "group", min(a) FILTER (good = 2) AS f FROM g GROUP BY 1) SELECT "group", CASE WHEN f IS NULL THEN 'retry_exhausted' ELSE 'ok' END AS status, coalesce(f, 3)::INT AS attempts_used FROM f""")
def _(spark, d):
    return J.retried(rollouts(spark, d).withColumn("side", F.col("row_idx") % 2), "group", "side", "row_idx", "score", 2, 3, 9)


# --- judges, scorers and registries


@_query("JDG-01", _R + """, v AS (SELECT *, CASE row_idx % 5 WHEN 0 THEN true WHEN 1 THEN false END AS verdict FROM r) SELECT row_idx, CASE WHEN class <> 'click' THEN ok WHEN ok IS NULL THEN 0 ELSE coalesce(verdict::INT, ok) END::DOUBLE AS direct,
CASE WHEN class = 'click' AND ok = 0 AND verdict THEN 1 ELSE ok END::DOUBLE AS "cascade" FROM v""")
def _(spark, d):
    verdict, clicks = F.expr("case row_idx % 5 when 0 then true when 1 then false end"), F.col("class") == "click"
    return rollouts(spark, d).select("row_idx", *[J.judged(F.col("ok"), verdict, clicks, mode).alias(mode) for mode in ("direct", "cascade")])


_SEAM = PARTS + """, s AS (SELECT id, CASE id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS score, CASE id % 4 WHEN 0 THEN 'verifier' WHEN 1 THEN 'choice' ELSE 'general' END AS route FROM p)"""


def _seam(p):
    """Rows that go each way: 3.7 is 3 for a verifier, b is B, 41 isn't 42, 42.0 is 42."""
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("id") % 4 + 1).cast("int"))
    return p.select("id", pick("aime", None, "unknown", None).alias("verifier"), pick(True, True, False, None).alias("choice"), pick("3.7", " b", "41", "42.0").alias("prediction"), pick("3", "B", "42", "42").alias("truth"))


@_query("UDF-05", _SEAM + " SELECT * FROM s")
def _(spark, d):
    p = _seam(parts(spark, d))
    return p.select("id", R.seam(F.col("verifier"), F.col("choice"), F.col("prediction"), F.col("truth"), {"aime": R.VERIFIERS["aime"]}).alias("s")).select("id", "s.score", "s.route")


@_query("SCR-01", _SEAM + " SELECT id, count(*) AS n, sum(x) AS total FROM (SELECT id, unnest([score, 0.0]) AS x FROM s) GROUP BY 1")
def _(spark, d):
    rows = _seam(parts(spark, d)).select("id", "verifier", "choice", "truth", F.explode(F.array(F.col("prediction"), F.lit("none"))).alias("prediction"))
    rows = rows.where("prediction = 'none'").withColumn("verifier", F.lit(None).cast("string")).unionByName(rows.where("prediction != 'none'"))
    scored = rows.select("id", R.seam(F.col("verifier"), F.col("choice"), F.col("prediction"), F.col("truth"), {"aime": R.VERIFIERS["aime"]})["score"].alias("x"))
    return scored.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))


@_query("UDF-02", PARTS + " SELECT id, CASE id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 / 3 END::DECIMAL(9,5)::DOUBLE AS reward FROM p")
def _(spark, d):
    p = parts(spark, d).select("id", F.element_at(F.array(F.lit("exact"), F.lit("ratio"), F.lit("none")), (F.col("id") % 3 + 1).cast("int")).alias("source"), F.lit("ab").alias("a"), F.when(F.col("id") % 3 == 0, "ab").otherwise("abc").alias("b"))
    return p.select("id", R.by_source(F.col("source"), {"exact": lambda a, b: (a == b).cast("double"), "ratio": R.SCORERS["length_ratio"]}, F.col("a"), F.col("b")).alias("reward"))


@_query("UDF-03", PARTS + " SELECT id, (size % 2)::DOUBLE AS verdict FROM p")
def _(spark, d):
    return parts(spark, d).select("id", R.VERIFIERS["aime"](F.concat(F.col("size").cast("string"), F.lit(".9")), (F.col("size") + 1 - F.col("size") % 2).cast("string")).alias("verdict"))


@_query("UDF-04", PARTS + " SELECT id, round(least(length(name), length(brand)) / greatest(length(name), length(brand)), 5) + 0.0 AS score FROM p")
def _(spark, d):
    return parts(spark, d).select("id", R.SCORERS["length_ratio"](F.col("name"), F.col("brand")).alias("score"))


_MASKED = _R + ", m AS (SELECT row_idx, ok, CASE WHEN row_idx % 23 = 0 THEN 0 ELSE length END AS n FROM r), w AS (SELECT *, CASE WHEN n > 0 THEN coalesce(ok, 0) ELSE 0 END AS v FROM m)"


@_query("RWD-09", _MASKED + " SELECT row_idx, 'naive' AS manager, v::DOUBLE AS reward FROM w UNION ALL SELECT row_idx, 'overlong', round(v + least(-(n - 3) / 3, 0), 5) + 0.0 FROM w UNION ALL SELECT row_idx, 'rejecting', v::DOUBLE FROM w WHERE ok IS NOT NULL")
def _(spark, d):
    mask = F.when(F.col("row_idx") % 23 == 0, F.array(F.lit(0))).otherwise(F.array_repeat(F.lit(1), F.col("length").cast("int")))
    r = rollouts(spark, d).select("row_idx", F.col("ok").alias("score"), mask.alias("mask"))
    made = [R.REWARD_MANAGERS[m](r).select("row_idx", F.lit(m).alias("manager"), "reward") for m in ("naive", "overlong", "rejecting")]
    return made[0].unionByName(made[1]).unionByName(made[2])


@_query("UDF-08", _MASKED + " SELECT row_idx, v::DOUBLE AS reward FROM w WHERE ok IS NOT NULL")
def _(spark, d):
    mask = F.when(F.col("row_idx") % 23 == 0, F.array(F.lit(0))).otherwise(F.array_repeat(F.lit(1), F.col("length").cast("int")))
    return R.REWARD_MANAGERS["rejecting"](rollouts(spark, d).select("row_idx", F.col("ok").alias("score"), mask.alias("mask"))).select("row_idx", "reward")


@_query("SCR-02", PARTS + " SELECT id, CASE id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.1 WHEN 2 THEN 0.9 ELSE 0.0 END::DOUBLE AS score FROM p")
def _(spark, d):
    t = _text(spark, d, r"concat(if(id % 2 < 1 and id % 4 = 0 or id % 4 = 1, '<think>a\nb</think> ', ''), '\\boxed{', if(id % 2 = 0, brand, 'other'), '}')")
    shaped = F.col("text").rlike(r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z").cast("double")
    right = X.over(lambda x, y: X.math_equal(X.boxed(x) or "", y), "boolean")(F.col("text"), F.col("brand")).cast("double")
    return t.select("id", (0.9 * right + 0.1 * shaped).alias("score"))


@_query("SCR-08", PARTS + " SELECT id, id % 3 < 2 AS same FROM p")
def _(spark, d):
    t = spread(parts(spark, d)).select("id", F.expr("concat('[', size, ', {\"a\": ', id, '}]')").alias("a"), F.expr("concat('[', size, '.001, {\"a\": ', case id % 3 when 0 then concat(id) when 1 then concat(id, '.0') else concat(id + 1) end, '}]')").alias("b"))
    return t.select("id", X.over(lambda a, b: X.same_output(a, b, 0.01), "boolean")(F.col("a"), F.col("b")).alias("same"))


#: Pairs of answers written around part numbers: formulas, numbers, tuples, equations and words.
_PAIRS = r"""case id % 10 when 0 then array(concat('x + ', id), concat(id, '+x')) when 1 then array(concat('\\frac{', id, '}{2}'), concat(id, '/2')) when 2 then array(concat(2 * id + 1), concat(id))
  when 3 then array(concat(id * 100), concat(id)) when 4 then array(concat('(1,', id, ']'), concat('(1, ', id, ']')) when 5 then array(concat('y=', id, 'x'), concat('2y=', 2 * id, 'x'))
  when 6 then array(concat('\\sqrt{', 2L * id * id, '}'), concat(id, '\\sqrt{2}')) when 7 then array(concat('x-', id), concat(id, '-x')) when 8 then array(concat('some ', name), concat(id))
  else array(concat(id, ', 1+x'), concat(id, ';x+1')) end"""
_VERDICTS = {
    "STR-15": (N.graded, "id % 10 IN (0, 1, 4, 6)"),
    "STR-16": (N.close_enough, "id % 10 IN (0, 1, 3, 4, 5, 6)"),
    "STR-19": (N.judged, "CASE WHEN id % 10 IN (0, 1, 4, 5, 6, 9) THEN true END"),
    "STR-20": (N.verified, "CASE WHEN id % 10 IN (0, 1, 4, 5, 6, 9) THEN true WHEN id % 10 IN (2, 3, 7) THEN false END"),
}
for _name, (_rule, _case) in _VERDICTS.items():

    def _verdict(spark, d, rule=_rule):
        t = spread(parts(spark, d).where("id > 0")).select("id", F.expr(_PAIRS).alias("x"))
        return t.select("id", X.over(lambda a, b: rule(a, b), "boolean")(F.col("x")[0], F.col("x")[1]).alias("same"))

    _query(_name, PARTS + f" SELECT id, {_case} AS same FROM p WHERE id > 0")(_verdict)

# --- batches


@_query("PRJ-19", _R + ' SELECT (i - 1)::BIGINT AS row_idx, r.score FROM (SELECT unnest([7, 0, 7]) AS f, unnest([1, 2, 3]) AS i) JOIN r ON r.row_idx = f')
def _(spark, d):
    return B.gather(rollouts(spark, d).select("row_idx", "score"), [7, 0, 7])


@_query("PRJ-20", _R + ", n AS (SELECT count(*) AS n FROM r), x AS (SELECT row_idx FROM r UNION ALL SELECT n + row_idx FROM r, n WHERE row_idx < (7 - n % 7) % 7) SELECT row_idx, row_idx // ((SELECT count(*) FROM x) // 7) AS chunk FROM x WHERE row_idx < (SELECT n FROM n)")
def _(spark, d):
    r = rollouts(spark, d).select("row_idx")
    n = r.count()
    padded = B.pad_to_divisor(r, 7, n)
    return B.unpad(B.chunk(padded, 7, n + (-n) % 7))


@_query("PRJ-25", PARTS + " SELECT id AS question_id, name AS question_text, CASE WHEN size > 9 THEN brand END AS data_source FROM p WHERE id % 4 > 0")
def _(spark, d):
    p = parts(spark, d).select(F.col("id").alias("question_id"), F.col("name").alias("question_text"), (F.col("id") % 4 > 0).alias("parsed_ok"), F.when(F.col("size") > 9, F.col("brand")).alias("data_source"))
    return LK.parsed_questions(p, "parsed_ok", ["question_id", "question_text", "data_source"])


# --- results of other runners, files and streams


@_query("SRC-16", PARTS + " SELECT id::VARCHAR AS question_id, CASE WHEN id % 2 = 0 THEN [1.0::DOUBLE, 0.0] ELSE [(size % 2)::DOUBLE] END AS answer_scores, CASE WHEN id % 2 = 0 THEN [name, brand] ELSE [name] END AS sampled_answers FROM p")
def _(spark, d):
    raw = """if(id % 2 = 0, concat('{"details": {"0": {"reference": ["', id, '"], "is_correct": [true, false], "prediction": ["', name, '", "', brand, '"]}}}'),
      concat('{"details": [{"example_abbr": "', id, '", "is_correct": ', if(size % 2 = 1, 'true', 'false'), ', "prediction": "', name, '"}]}'))"""
    return IN.program_results(_text(spark, d, raw).withColumnRenamed("text", "raw")).select("question_id", "answer_scores", "sampled_answers")


@_query("SRC-17", PARTS + " SELECT CASE id % 4 WHEN 0 THEN 'q' || id WHEN 1 THEN 'm' || id WHEN 2 THEN 'e' || id ELSE 'lcb_0' END AS question_id, [(size % 2)::DOUBLE] AS answer_scores, [name] AS sampled_answers FROM p")
def _(spark, d):
    own = """case id % 4 when 0 then concat('"question_id": "q', id, '", ') when 1 then concat('"final_metadata": [{"question_id": "m', id, '"}], ') when 2 then concat('"example_abbr": "e', id, '", ') else '' end"""
    raw = f"""concat('{{"details": [{{', {own}, '"correct": ', if(size % 2 = 1, 'true', 'false'), ', "prediction": ["', name, '"]}}]}}')"""
    return IN.contest_results(_text(spark, d, raw).withColumnRenamed("text", "raw")).select("question_id", "answer_scores", "sampled_answers")


@_query("SRC-12", PARTS + " SELECT id, name FROM p WHERE id % 2 = 0 OR size > 9")
def _(spark, d):
    p = parts(spark, d).select("id", "name", "size")
    return IN.appended(p.where("id % 2 = 0"), p.where("id % 2 = 1"), F.col("size") > 9).select("id", "name")


@_query("SRC-13", PARTS + " SELECT id, name FROM p")
def _(spark, d):
    path = scratch_path(spark, "remote")
    parts(spark, d).select("id", "name").write.parquet(path)
    return spark.read.parquet(path if "://" in path else f"file://{path}")


@_query("SRC-14", PARTS + " SELECT id, name FROM p")
def _(spark, d):
    far = scratch_path(spark, "far")
    parts(spark, d).select("id", "name").write.parquet(f"{far}/questions")
    return spark.read.parquet(IN.resolve(spark, "questions", scratch_path(spark, "near"), far))


@_query("SRC-15", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    near = scratch_path(spark, "near")
    path = IN.copy(spark, f"{d}/region.parquet", near)
    return spark.read.parquet(IN.copy(spark, f"{d}/region.parquet", near) and path).select("r_regionkey", "r_name")


@_query("SNK-07", _R + ' SELECT "group", min(row_idx) AS row_idx, arg_min(score, row_idx) AS score FROM r GROUP BY 1')
def _(spark, d):
    path = scratch_path(spark, "influence")
    r = rollouts(spark, d).select("group", "row_idx", "score")
    OUT.write_influence(r, "group", "row_idx", path)
    return spark.read.schema("group long, row_idx long, score double").json(path)


@_query("SNK-09", _R + " SELECT doc AS step, 'score' AS metric, round(avg(score), 5) + 0.0 AS value FROM r GROUP BY 1 UNION ALL SELECT 99, 'rows', count(*)::DOUBLE FROM r")
def _(spark, d):
    r, path = rollouts(spark, d), scratch_path(spark, "metrics")
    loop.track(r.groupBy("doc").agg(F.lit("score").alias("metric"), F.avg("score").alias("value")), "doc", path)
    loop.track(r.agg(F.lit("rows").alias("metric"), F.count(F.lit(1)).alias("value")), 99, path)
    return spark.read.parquet(path)


@_query("SNK-10", _R + ' SELECT row_idx, "group", score FROM r')
def _(spark, d):
    return OUT.save_batch(rollouts(spark, d).select("row_idx", "group", "score"), scratch_path(spark, "batch"))


@_query("SNK-11", "SELECT conv_id, list(text ORDER BY turn, text) AS responses FROM conversations GROUP BY 1")
def _(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").withColumn("place", F.col("turn"))
    path = scratch_path(spark, "rollouts")
    OUT.write_json(OUT.write_generations(c, "conv_id", "text", scratch_path(spark, "generations")), path)
    return spark.read.schema("conv_id long, responses array<string>").json(path)


def _files(spark, df):
    """A table in several files, as they would arrive."""
    path = scratch_path(spark, "arriving")
    df.repartition(6).write.parquet(path)
    return path


@_query("SNK-08", _R + " SELECT row_idx, score * 2 AS score FROM r")
def _(spark, d):
    r = rollouts(spark, d).select("row_idx", "score")
    stream = loop.arriving(spark, _files(spark, r), "row_idx long, score double", files=2)
    first, second, checkpoint = (scratch_path(spark, n) for n in ("first", "second", "checkpoint"))
    double = lambda b: b.withColumn("score", F.col("score") * 2)
    loop.run(stream, [loop.once(first), loop.once(second, double, depends=(first,))], checkpoint)
    return spark.read.parquet(second).select("row_idx", "score")


@_query("UDF-10", _R + ' SELECT row_idx, "group" FROM r WHERE score > 10')
def _(spark, d):
    r = rollouts(spark, d).select("row_idx", "group", "score")
    stream = loop.arriving(spark, _files(spark, r), "row_idx long, `group` long, score double", files=1)
    path, checkpoint = scratch_path(spark, "grown"), scratch_path(spark, "checkpoint")
    for _ in range(2):  # a second start finds nothing new
        loop.run(stream, [loop.once(path, lambda b: b.where("score > 10"))], checkpoint)
    return spark.read.parquet(path).select("row_idx", "group")


@_query("STM-01", "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts)::VARCHAR AS day, count(*) AS n, round(sum(value), 5) + 0.0 AS total FROM events GROUP BY ALL")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("ts", "event_type", "value")
    path, checkpoint = scratch_path(spark, "windows"), scratch_path(spark, "checkpoint")
    stream = loop.windowed(loop.arriving(spark, _files(spark, e), "ts timestamp, event_type string, value double", files=2), "ts", "event_type", "value", "1 day", "3650 days")

    def latest(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/{number % 2}")

    query = stream.writeStream.outputMode("complete").foreachBatch(latest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.read.parquet(f"{path}/{query.lastProgress['batchId'] % 2}")
    return last.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("day"), "n", "total")
