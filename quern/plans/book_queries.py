"""Queries over books: outline, numbered items, and questions paired with answers in one volume or two, each with SQL.

A book per brand is written from the parts: three chapters, two labelled sets of exercises each, and solutions in one of four
layouts: 0 repeats chapter and label, 1 the chapter alone, 2 neither, and 3 restates each problem under a heading. The SQL
pairs the parts themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import books as K
from quern.functions.answers import over
from quern.operators import pairing as P
from quern.plans.data_queries import _query
from quern.session import materialise

#: One row per part: its book, layout, place in the book, and whether it is answered, has a figure, or restates the question.
BOOKS = """WITH a AS (SELECT p_brand AS book, p_partkey AS id, p_partkey % 3 + 1 AS c, CASE WHEN p_partkey % 2 = 0 THEN 'introductory' ELSE 'advanced' END AS label,
    CAST(replace(p_brand, 'Brand#', '') AS INT) % 4 AS wish, p_partkey % 5 > 0 AS answered, p_partkey % 7 = 0 AS figure, p_partkey % 11 = 0 AS same,
    'Find ' || p_name || ' of part ' || p_partkey || '.' || CASE WHEN p_partkey % 7 = 0 THEN ' ![f](f.png)' ELSE '' END AS question FROM part),
b AS (SELECT *, CASE WHEN wish = 3 AND count(CASE WHEN answered THEN 1 END) OVER (PARTITION BY book) < 3 THEN 2 ELSE wish END AS layout,
    CASE WHEN same THEN question ELSE 'By rule ' || id || ' it is the one.' END AS answer FROM a),
p AS (SELECT *, CASE layout WHEN 0 THEN row_number() OVER (PARTITION BY book, c, label ORDER BY id) WHEN 1 THEN row_number() OVER (PARTITION BY book, c ORDER BY id)
    ELSE row_number() OVER (PARTITION BY book ORDER BY id) END AS num FROM b)"""


def exercises(spark: SparkSession, d: str) -> DataFrame:
    """The parts as exercises of books."""
    view = "quern_book_parts"
    spark.read.parquet(f"{d}/part.parquet").createOrReplaceTempView(view)
    return spark.sql(BOOKS.replace("FROM part)", f"FROM {view})") + " SELECT * FROM p")


def _line(df: DataFrame, area: int, c: str, label: str, num: str, line: str) -> DataFrame:
    return df.selectExpr("book", f"{area} AS area", f"cast({c} as int) AS c", f"{label} AS l", f"cast({num} as int) AS num", f"{line} AS line").distinct()


def _joined(lines: DataFrame) -> DataFrame:
    """Lines in order as one text a book: book, text."""
    own = F.transform(F.sort_array(F.collect_list(F.struct("area", "c", "l", "num", "line"))), lambda x: x["line"])
    return lines.groupBy("book").agg(F.array_join(own, "\n").alias("text"))


def problem_lines(p: DataFrame) -> DataFrame:
    chapters = _line(p, 1, "c", "''", "-1", "concat('# Chapter ', c)")
    sets = _line(p, 1, "c", "label", "0", "concat('## **', initcap(label), ' Problems**')")
    items = _line(p, 1, "c", "label", "num", "concat(num, '. ', question)")
    return chapters.unionByName(sets).unionByName(items)


def books(p: DataFrame) -> DataFrame:
    """book, text of one volume."""
    title = _line(p, -1, "0", "''", "0", "concat('# Book of ', book)")
    front, back, head = p.where("layout = 2"), p.where("layout < 2"), p.where("layout = 3")
    known = lambda x: x.where("answered")
    lines = title.unionByName(problem_lines(p))
    lines = lines.unionByName(_line(front, 0, "0", "''", "0", "'## Solutions'")).unionByName(_line(known(front), 0, "0", "''", "num", "concat(num, '. ', answer)"))
    lines = lines.unionByName(_line(back, 2, "0", "''", "0", "'# Solutions to the problems'")).unionByName(_line(back, 2, "c", "''", "-1", "concat('## Chapter ', c)"))
    lines = lines.unionByName(_line(back.where("layout = 0"), 2, "c", "label", "0", "concat('### ', initcap(label))"))
    lines = lines.unionByName(_line(known(back), 2, "c", "if(layout = 0, label, '')", "num", "concat('**', num, '.** ', answer)"))
    lines = lines.unionByName(_line(head, 2, "0", "''", "0", "'# Answers'")).unionByName(_line(head, 2, "0", "''", "num", "concat('#### Problem ', num, ' [A 1999]\\n', question)"))
    second = _line(known(head).where("not same"), 2, "0", "''", "num", "concat('#### Solution ', num, ', Alternative 1\\n', answer, '\\n#### Solution ', num, ', Alternative 2\\nSame.')")
    same = _line(known(head).where("same"), 2, "0", "''", "num", "concat('#### Solution ', num, '\\n', answer)")
    return _joined(lines.unionByName(second).unionByName(same))


def _read(spark: SparkSession, d: str) -> DataFrame:
    return materialise(P.read_books(books(exercises(spark, d)), "book", "text"), "books")


_ANSWER = "answer || CASE WHEN layout = 3 AND NOT same THEN chr(10) || chr(10) || 'Same.' ELSE '' END"


@_query("JN-09", BOOKS + f""" SELECT book, CASE WHEN layout = 3 THEN NULL ELSE CAST(c AS VARCHAR) END AS chapter, CASE WHEN layout = 3 THEN NULL ELSE label END AS label, CAST(num AS VARCHAR) AS num,
    question, CASE WHEN answered THEN {_ANSWER} END AS answer FROM p""")
def _(spark, d):
    pairs = P.pair_up(_read(spark, d))[0]
    return pairs.select("book", *[F.nullif(F.col(k), F.lit(P.NONE)).alias(k) for k in ("chapter", "label")], "num", "question", "answer")


@_query("DOC-13", BOOKS + f""" SELECT book, CASE WHEN layout = 3 THEN NULL ELSE CAST(c AS VARCHAR) END AS chapter, CAST(num AS VARCHAR) AS num,
    '## Problem' || chr(10) || question || chr(10) || chr(10) || '## Answer' || chr(10) || {_ANSWER} || chr(10) AS content,
    book || CASE WHEN layout = 3 THEN '' ELSE ' — Chapter ' || c || ' (' || CASE label WHEN 'advanced' THEN 'Advanced' ELSE 'Introductory' END || ')' END AS header1,
    'Problem ' || num AS header2, 'ordinary' AS layout FROM p WHERE answered AND NOT figure AND NOT same""")
def _(spark, d):
    pairs = P.extract(_read(spark, d))[0]
    written = P.page(*[F.col(c) for c in ("book", "chapter", "label", "num", "question", "answer")])
    return pairs.select("book", "chapter", "num", *written, "layout")


@_query("DOC-13-stats", BOOKS + """ SELECT book, count(DISTINCT (c, label)) AS exercise_sections, CAST(1 AS BIGINT) AS answer_sections, count(*) AS problems,
    count(*) FILTER (answered) AS answers, count(*) FILTER (answered AND NOT figure AND NOT same) AS matched, count(*) FILTER (answered AND figure) AS dropped_figure,
    count(*) FILTER (answered AND NOT figure AND same) AS dropped_noninformative, count(*) FILTER (NOT answered) AS unmatched, CAST(0 AS BIGINT) AS inline, CAST(0 AS BIGINT) AS papers FROM p GROUP BY book""")
def _(spark, d):
    return P.extract(_read(spark, d))[1]


@_query("DOC-11", BOOKS + """, h AS (
    SELECT DISTINCT book, -1 AS area, 0 AS c, '' AS l, 0 AS num, 1 AS level, 'normal' AS kind, 'Book of ' || book AS title, NULL AS own, NULL AS label FROM p
    UNION ALL SELECT DISTINCT book, 0, 0, '', 0, 2, 'answer_key', 'Solutions', NULL, NULL FROM p WHERE layout = 2
    UNION ALL SELECT DISTINCT book, 1, c, '', -1, 1, 'normal', 'Chapter ' || c, CAST(c AS VARCHAR), NULL FROM p
    UNION ALL SELECT DISTINCT book, 1, c, label, 0, 2, 'exercise', upper(label[1:1]) || label[2:] || ' Problems', NULL, label FROM p
    UNION ALL SELECT DISTINCT book, 2, 0, '', 0, 1, 'answer_key', CASE layout WHEN 3 THEN 'Answers' ELSE 'Solutions to the problems' END, NULL, NULL FROM p WHERE layout IN (0, 1, 3)
    UNION ALL SELECT DISTINCT book, 2, c, '', -1, 2, 'normal', 'Chapter ' || c, CAST(c AS VARCHAR), NULL FROM p WHERE layout < 2
    UNION ALL SELECT DISTINCT book, 2, c, label, 0, 3, 'normal', upper(label[1:1]) || label[2:], NULL, label FROM p WHERE layout = 0)
SELECT book, row_number() OVER w - 1 AS place, kind, level, title, last_value(own IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS chapter, label
FROM h WINDOW w AS (PARTITION BY book ORDER BY area, c, l, num)""")
def _(spark, d):
    kind = "array<struct<kind:string,level:long,title:string,chapter:string,label:string>>"
    walk = over(lambda t: [{"kind": s.kind, "level": s.level, "title": s.title, "chapter": s.chapter, "label": s.label} for s in K.sections(t or "") if s.level < 4], kind)
    found = books(exercises(spark, d)).select("book", F.posexplode(walk(F.col("text"))).alias("place", "s"))
    return found.select("book", F.col("place").cast("long").alias("place"), "s.*")


@_query("DOC-12", BOOKS + """, n AS (SELECT book, id, question, row_number() OVER (PARTITION BY book ORDER BY id) AS k FROM p)
SELECT book, CAST(k AS VARCHAR) || CASE k % 4 WHEN 1 THEN '.1' ELSE '' END AS num, CASE WHEN k % 4 = 2 THEN question || chr(10) || '```' || chr(10) || '7. in a fence' || chr(10) || '```' ELSE question END AS body FROM n""")
def _(spark, d):
    ranked = exercises(spark, d).withColumn("k", F.row_number().over(W.partitionBy("book").orderBy("id")))
    # An item of two parts, one with a fence, one by name, and one that stands glued to the end of the item before it.
    line = """CASE k % 4 WHEN 1 THEN concat('\\n- **', k, '.1.** ', question) WHEN 2 THEN concat('\\n', k, ') ', question, '\\n```\\n7. in a fence\\n```')
        WHEN 3 THEN concat('\\nProblem ', k, ': ', question) ELSE concat(IF(figure_before, '\\n', ' '), k, '. ', question) END"""
    before = F.lag("figure", 1, True).over(W.partitionBy("book").orderBy("id"))
    text = ranked.withColumn("figure_before", before).withColumn("line", F.expr(line))
    own = F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"])
    texts = text.groupBy("book").agg(F.concat(F.lit("3.5 is no item\n # 2. nor this"), F.array_join(own, "")).alias("text"))
    items = over(lambda t: [{"num": n, "body": b} for n, b in K.numbered_items((t or "").splitlines())], "array<struct<num:string,body:string>>")
    return texts.select("book", F.explode(items(F.col("text"))).alias("x")).select("book", "x.*")


_TWO = """, q AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY id) AS n FROM p)"""


@_query("DOC-14", BOOKS + _TWO + """ SELECT book, CAST(c AS VARCHAR) AS chapter, label, CAST(n AS VARCHAR) AS num, question, answer FROM q WHERE answered AND NOT figure AND NOT same""")
def _(spark, d):
    return P.extract(_volumes(spark, d))[0].drop("place", "layout")


@_query("DOC-14-stats", BOOKS + _TWO + """ SELECT book, count(DISTINCT (c, label)) AS exercise_sections, 2 * count(DISTINCT c) + 1 AS answer_sections, count(*) AS problems, count(*) FILTER (answered AND NOT figure AND NOT same) AS matched,
    count(*) FILTER (answered AND figure) AS dropped_figure, count(*) FILTER (answered AND NOT figure AND same) AS dropped_noninformative, count(*) FILTER (NOT answered) AS unmatched FROM q GROUP BY book""")
def _(spark, d):
    return P.extract(_volumes(spark, d))[1].drop("answers", "inline", "papers")


def _volumes(spark: SparkSession, d: str) -> DataFrame:
    """Problems numbered through the book, and a volume of solutions by chapter."""
    p = exercises(spark, d).withColumn("num", F.row_number().over(W.partitionBy("book").orderBy("id")))
    preface = _line(p, 0, "0", "''", "0", "'# Preface'")
    solved = _line(p, 1, "c", "''", "-1", "concat('# Chapter ', c)").unionByName(_line(p, 1, "c", "''", "0", "'## All of it'"))
    solved = preface.unionByName(solved).unionByName(_line(p.where("answered"), 1, "c", "''", "num", "concat('Solution ', num, '. ', answer)"))
    both = _joined(problem_lines(p)).join(_joined(solved).withColumnRenamed("text", "solutions"), "book")
    return materialise(P.read_volumes(both, "book", "text", "solutions"), "volumes")
