"""Queries of answers, questions, chunks, readers and writers.

Texts are built around values of the tables, so that the SQL knows what must come out without the scan that finds it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import answers as X
from quern.functions import grading as N
from quern.functions import markdown as MD
from quern.functions import questions as Q
from quern.functions import strings as S
from quern.operators import lookups as LK
from quern.plans.data_queries import _query
from quern.session import scratch_path
from quern.sources import readers as IN
from quern.sources import writers as OUT

PARTS = "WITH p AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size, p_retailprice AS price FROM part)"


def parts(spark, d):
    x = spark.read.parquet(f"{d}/part.parquet")
    return x.select(*[F.col(f"p_{c}").alias(n) for c, n in (("partkey", "id"), ("name", "name"), ("brand", "brand"), ("type", "type"), ("size", "size"), ("retailprice", "price"))])


def spread(rows):
    """Rows dealt by id: a small file is few splits, however many rows it has, and rules in Python take longer than reading."""
    session = rows.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "id")  # a number of its own: adaptive execution joins parts by their bytes, which are few


def _text(spark, d, sql: str):
    return spread(parts(spark, d)).withColumn("text", F.expr(sql))


_BOXES = r"concat('see \\boxed{', brand, '} and \\Boxed {', case id % 4 when 0 then concat('a{', name, '}b') when 1 then concat(' ', name, ' ') when 2 then '' else concat('{', name) end, '} end')"


@_query("STR-01", PARTS + " SELECT id, brand AS first, CASE id % 4 WHEN 0 THEN 'a{' || name || '}b' WHEN 1 THEN name END AS last FROM p")
def _(spark, d):
    t = _text(spark, d, _BOXES)
    return t.select("id", X.over(lambda x: X.boxed(x, True))(F.col("text")).alias("first"), X.over(X.boxed)(F.col("text")).alias("last"))


@_query("STR-02", PARTS + " SELECT id, name AS bare FROM p")
def _(spark, d):
    t = _text(spark, d, r"concat(repeat('\\text{ ', id % 9), name, repeat(' }', id % 9))")
    return t.select("id", S.strip_wrappers(F.col("text")).alias("bare"))


@_query("STR-03", PARTS + " SELECT id, CASE id % 3 WHEN 0 THEN upper(name[1]) WHEN 1 THEN id::VARCHAR END AS answer FROM p")
def _(spark, d):
    t = _text(spark, d, r"case id % 3 when 0 then concat('\\boxed{\\text{', name, '}}') when 1 then concat('x \\boxed{', id, '}') else name end")
    return t.select("id", X.over(X.boxed_letter)(F.col("text")).alias("answer"))


@_query("STR-04", PARTS + " SELECT id, id % 3 < 2 AS same FROM p")
def _(spark, d):
    t = _text(spark, d, r"case id % 3 when 0 then concat('\t ', upper(name), '\n') when 1 then lower(name) when 2 then null end")
    return t.select("id", S.same_choice(F.col("text"), F.col("name")).alias("same"))


@_query("STR-05", PARTS + " SELECT id, id % 3 < 2 AS same FROM p")
def _(spark, d):
    t = _text(spark, d, r"case id % 3 when 0 then concat('\n', id, '.0 ') when 1 then concat(id, '\t') else concat(id, '1') end")
    return t.select("id", S.same_general(F.col("text"), F.col("id").cast("string")).alias("same"))


_CHOICES = "array(name, brand, type, cast(size as string))"


@_query("STR-06", PARTS + " SELECT id, 'Question: ' || name || '?' || chr(10) || 'A) ' || name || chr(10) || 'B) ' || brand || chr(10) || 'C) ' || type || chr(10) || 'D) ' || size AS prompt, CASE id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'C' END AS letter FROM p")
def _(spark, d):
    t = parts(spark, d).withColumn("choices", F.expr(_CHOICES)).withColumn("truth", F.expr("case id % 3 when 0 then concat(' ', brand) when 1 then 'c' else 'none of them' end"))
    return t.select("id", Q.format_choices(F.concat("name", F.lit("?")), F.col("choices")).alias("prompt"), Q.truth_letter(F.col("choices"), F.col("truth")).alias("letter"))


@_query("STR-07", "SELECT p_partkey AS id, regexp_replace(regexp_replace(trim(lower(p_brand || '  -- ' || p_name)), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g') AS key FROM part")
def _(spark, d):
    return parts(spark, d).select("id", S.text_key(F.concat("brand", F.lit("  -- "), "name")).alias("key"))


@_query("STR-09", PARTS + " SELECT id, id % 2 = 0 AS exact, true AS inside FROM p")
def _(spark, d):
    t = _text(spark, d, "if(id % 2 = 0, concat('The ', upper(name), '!'), concat('It is a ', name, ' then'))")
    golden = F.array("name", F.lit("zzz"))
    return t.select("id", S.exact_match(F.col("text"), golden).alias("exact"), S.substring_match(F.col("text"), golden).alias("inside"))


@_query("STR-10", PARTS + " SELECT id, name AS answer FROM p")
def _(spark, d):
    t = _text(spark, d, "concat('<answer>', brand, '</answer> no, <answer> ', name, '\n</answer>')")
    return t.select("id", S.strip(S.last_answer_block(F.col("text"))).alias("answer"))


@_query("STR-12", PARTS + " SELECT id, size || id::VARCHAR AS normal FROM p WHERE size < 1000")
def _(spark, d):
    t = _text(spark, d, r"concat('x = \\text{', size, '},', id, ' dollars')").where("size < 1000")
    return t.select("id", X.over(X.minerva_normal)(F.col("text")).alias("normal"))


@_query("STR-13", PARTS + " SELECT id, CASE WHEN id % 3 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS score, CASE WHEN id % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS strict FROM p")
def _(spark, d):
    t = _text(spark, d, r"concat(repeat('long ', 100), '\nAnswer: ', if(id % 3 = 0, id, id + 1), ' feet\n\\boxed{', if(id % 2 = 0, id, size + id + 1), '}')")
    truth = F.col("id").cast("string")
    return t.select("id", X.over(X.minerva_score, "double")(F.col("text"), truth).alias("score"), X.over(lambda a, b: X.minerva_score(a, b, True), "double")(F.col("text"), truth).alias("strict"))


@_query("STR-14", PARTS + r" SELECT id, '\frac{' || id || '}{' || (size + 1) || '}' AS normal, id % 2 = 0 AS same FROM p WHERE id > 0")
def _(spark, d):
    t = _text(spark, d, r"concat('x = ', id, '/', size + 1, '\\text{ cm}')").where("id > 0")
    other = F.expr(r"concat('\\left\\dfrac{', id, '}{', size + 1 + id % 2, '}^\\circ')")
    return t.select("id", X.over(X.math_normal)(F.col("text")).alias("normal"), X.over(X.math_equal, "boolean")(F.col("text"), other).alias("same"))


@_query("STR-17", PARTS + " SELECT id, id % 5 < 4 AS same FROM p")
def _(spark, d):
    t = _text(spark, d, "case id % 5 when 0 then concat('[', name, ']') when 1 then concat(name, '?') when 2 then concat(\"'\", name, \"'\") when 3 then name else brand end")
    return t.select("id", X.over(X.fuzzy_equal, "boolean")(F.col("text"), F.col("name")).alias("same"))


@_query("STR-18", PARTS + " SELECT id, CASE WHEN id % 5 < 3 THEN true WHEN id % 5 = 3 THEN false END AS same FROM p")
def _(spark, d):
    t = _text(spark, d, r"case id % 5 when 0 then concat(id, '^\\circ') when 1 then concat('\n', id, '.7\\%') when 2 then concat(id, '\\text{ cm}') when 3 then concat(id + 1, '') end")
    return t.select("id", S.same_integer(F.col("text"), F.col("id").cast("string")).alias("same"))


@_query("STR-23", PARTS + " SELECT id, name AS benchmark FROM p")
def _(spark, d):
    return _text(spark, d, "if(id % 2 = 0, concat('a/b.c/', name, '.json'), name)").select("id", S.benchmark_name(F.col("text")).alias("benchmark"))


@_query("STR-24", PARTS + " SELECT id, CASE id % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'qa_mcq' ELSE 'qa_open' END AS kind FROM p")
def _(spark, d):
    t = parts(spark, d).select("id", F.expr("if(id % 3 = 0, 'code', null)").alias("benchmark_type"), F.expr(f"if(id % 3 = 1, {_CHOICES}, null)").alias("choices"))
    return IN.questions(t).select(F.col("question_id").cast("long").alias("id"), F.col("benchmark_type").alias("kind"))


@_query("STR-25", PARTS + " SELECT id, CASE id % 4 WHEN 3 THEN id::VARCHAR ELSE name END AS answer FROM (SELECT id, replace(name, ' ', '') AS name FROM p)")
def _(spark, d):
    t = parts(spark, d).withColumn("name", F.replace("name", F.lit(" "), F.lit("")))
    t = t.withColumn("text", F.expr(r"case id % 4 when 0 then concat('\\boxed{1} \\boxed{', name, '}') when 1 then concat('\\boxed{', name, '} \\boxed{open') when 2 then concat('\\boxed{\\text{', name, '}}') else concat('ANSWER: 0\nANSWER: ', id, '\nend') end"))
    return t.select("id", X.over(X.math500)(F.col("text")).alias("answer"))


@_query("STR-26", PARTS + " SELECT id, CASE WHEN id % 2 = 0 THEN 'x = ' || id ELSE name END AS code FROM p")
def _(spark, d):
    return _text(spark, d, r"if(id % 2 = 0, concat('```python\ny\n```\n```py\nx = ', id, '\n```'), name)").select("id", S.strip(S.code_block(F.col("text"))).alias("code"))


@_query("STR-27", PARTS + " SELECT id, name AS tool FROM p")
def _(spark, d):
    t = _text(spark, d, "concat('<tool_call>{bad</tool_call> <tool_call>{\"name\": \"', name, '\", \"arguments\": {\"n\": \"', id, '\"}}</tool_call>')")
    return t.select("id", F.element_at(S.tool_calls(F.col("text")), -1)["name"].alias("tool"))


@_query("STR-30", PARTS + " SELECT id, (['A', 'B', 'C', 'D'])[1 + id % 4] AS choice FROM p")
def _(spark, d):
    letter = "element_at(array('A', 'B', 'C', 'D'), cast(1 + id % 4 as int))"
    t = _text(spark, d, rf"case size % 3 when 0 then concat('the answer is (', {letter}, ')') when 1 then concat('so option ', {letter}, ' holds') else concat('not A, but ', {letter}, '.') end")
    return t.select("id", X.over(X.medical_choice)(F.col("text")).alias("choice"))


@_query("STR-31", PARTS + " SELECT id, name AS answer FROM p")
def _(spark, d):
    t = _text(spark, d, r"case id % 3 when 0 then concat('**Final Answer:** `', name, '`\n\nend') when 1 then concat('x\nThe answer is: ', name) else concat('Answer: 1\n\nso\n## Answer: *', name, '*') end")
    return t.select("id", X.over(X.hard_answer)(F.col("text")).alias("answer"))


@_query("STR-32", PARTS + " SELECT id, name AS answer FROM p")
def _(spark, d):
    t = _text(spark, d, r"if(id % 2 = 0, concat('x\n  ', name, ' \n\n'), concat('\\boxed{', name, '}\nlast'))")
    return t.select("id", X.over(X.last_line)(F.col("text")).alias("answer"))


@_query("STR-33", PARTS + " SELECT id, CASE id % 4 WHEN 1 THEN upper(name[1]) ELSE name END AS answer FROM p")
def _(spark, d):
    t = _text(spark, d, r"concat('\\boxed{', name, '}')")
    source = F.expr("element_at(array('phybench', 'other', 'math500', 'bbeh'), cast(1 + id % 4 as int))")
    kind = F.expr("if(id % 4 = 1, 'qa_mcq', 'qa_open')")
    return t.select("id", X.over(X.extracted)(source, kind, F.col("text")).alias("answer"))


@_query("SCR-04", PARTS + " SELECT id, CASE id % 3 WHEN 0 THEN round(size / 100, 5) WHEN 1 THEN price END AS number FROM p")
def _(spark, d):
    t = _text(spark, d, r"case id % 3 when 0 then concat(' ', size, '%') when 1 then concat('\n', price) else concat(name, '%') end")
    return t.select("id", X.over(X.parse_number, "double")(F.col("text")).alias("number"))


@_query("SCR-05", PARTS + " SELECT id, price, abs(price - round(price)) / greatest(abs(round(price)), 1e-15) < 1e-4 AS same FROM p")
def _(spark, d):
    t = parts(spark, d)
    return t.select("id", "price", S.numbers_equal(F.col("price"), F.round("price"), 1e-4).alias("same"))


@_query("SCR-06", PARTS + " SELECT id, [name, '(' || size || ', ' || id || ')', '{[' || brand || ',]}'] AS parts FROM p")
def _(spark, d):
    t = _text(spark, d, "concat(name, ', (', size, ', ', id, ') ,{[', brand, ',]},')")
    return t.select("id", X.over(X.split_commas, "array<string>")(F.col("text")).alias("parts"))


# ends agree within one in 10,000, so a number that is only one more would be the same end from 10,000 on
@_query("SCR-07", PARTS + " SELECT id, CASE id % 4 WHEN 0 THEN true WHEN 3 THEN NULL ELSE false END AS same FROM p")
def _(spark, d):
    t = _text(spark, d, r"case id % 4 when 0 then concat('$\\left[', id, '.00, \\infty\\right)$') when 1 then concat('(', id, ',oo)') when 2 then concat('[', 2 * id + 1, ',oo)') else name end")
    return t.select("id", X.over(N.interval_equal, "boolean")(F.col("text"), F.concat(F.lit("["), F.col("id").cast("string"), F.lit(",oo)"))).alias("same"))


@_query("JSN-01", PARTS + r" SELECT id, '{\\frac \n \\alpha ' || name || ' \\sum \" \\u}' AS fixed FROM p")
def _(spark, d):
    t = parts(spark, d).withColumn("text", F.concat(F.lit(r"{\frac \n \\alpha "), "name", F.lit(r' \sum \" \u}')))
    return t.select("id", X.over(Q.fix_escapes)(F.col("text")).alias("fixed"))


@_query("JSN-02", PARTS + " SELECT id, 2 AS n, '{\"a\": \"}' || name || '\"}' AS last FROM p")
def _(spark, d):
    t = _text(spark, d, "concat('x } {{', id, '}} {\"a\": \"}', name, '\"} {')")
    spans = X.over(lambda x: [x[a:b] for a, b in Q.brace_spans(x)], "array<string>")(F.col("text"))
    return t.select("id", spans.alias("s")).select("id", F.size("s").alias("n"), F.element_at("s", -1).alias("last"))


def _generated(spark, d):
    """Responses by id: choices, a letter map, open questions, and four kinds of failure."""
    body = (
        "case id % 8 when 0 then concat('{\"question_text\": \"', name, ' $\\\\frac12$\", \"choices\": [\"', name, '\", \"b\", \"c\", \"d\"], \"ground_truth\": \" ', upper(name), '\"}')"
        " when 1 then concat('<think> {', id, '} </think>```json\n{\"question_text\": [\"', name, '\", ', size, '], \"choices\": {\"A\": 1, \"B\": 2, \"c\": 3, \"D\": \"', brand, '\"}, \"ground_truth\": \"', brand, '\"}\n```')"
        " when 2 then concat('{\"question_text\": \"', name, '\", \"choices\": [], \"ground_truth\": ', size, ', \"answer_type\": \"n\"}')"
        " when 3 then concat('{\"question_text\": \"', name, '\", \"choices\": [\"a\", \"b\"], \"ground_truth\": \"a\"}')"
        " when 4 then '{\"question_text\": \" \", \"choices\": [], \"ground_truth\": \"1\"}'"
        " when 5 then concat('{\"question_text\": \"', name, '\", \"choices\": [\"a\", \"b\", \"c\", \"d\"], \"ground_truth\": \"e\"}')"
        " when 6 then concat('{\"question_text\": \"', name, '\"') else name end"
    )
    return _text(spark, d, body)


@_query("JSN-03", PARTS + """ SELECT id, CASE WHEN id % 8 = 1 THEN '{' || id || '}' END AS thinking, CASE id % 8 WHEN 3 THEN 'missing_required_fields' WHEN 6 THEN 'truncated_json' WHEN 7 THEN 'no_json_object' END AS wrong FROM p""")
def _(spark, d):
    t = _generated(spark, d)
    found = X.over(lambda x: [(r := Q.thinking_and_json(x, Q.well_formed))[0], r[2]], "array<string>")(F.col("text"))
    return t.select("id", found.alias("f")).select("id", F.col("f")[0].alias("thinking"), F.col("f")[1].alias("wrong"))


@_query("JSN-04", PARTS + """ SELECT id, CASE id % 8 WHEN 0 THEN name || ' $\\frac12$' WHEN 1 THEN name || ' ' || size WHEN 2 THEN name WHEN 4 THEN ' ' WHEN 5 THEN name END AS asked,
CASE id % 8 WHEN 0 THEN name WHEN 1 THEN brand WHEN 2 THEN size::VARCHAR WHEN 4 THEN '1' WHEN 5 THEN 'e' END AS truth FROM p""".replace("\\\\frac", "\\frac"))
def _(spark, d):
    rule = lambda x: [q["question_text"], q["ground_truth"]] if (q := Q.parse_question(x)) else None
    return _generated(spark, d).select("id", X.over(rule, "array<string>")(F.col("text")).alias("q")).select("id", F.col("q")[0].alias("asked"), F.col("q")[1].alias("truth"))


@_query("JSN-05", PARTS + """ SELECT id, id % 8 < 3 AS parsed_ok, CASE WHEN id % 8 < 3 THEN NULL WHEN id % 8 = 4 THEN 'empty_question' WHEN id % 8 = 5 THEN 'invalid_ground_truth' ELSE 'failed_parse' END AS reject_reason,
CASE WHEN id % 8 = 2 THEN 'gen_' || size || '_' || id || '_' || substr(md5(name), 1, 8) WHEN id % 8 = 1 THEN 'gen_' || size || '_' || id || '_' || substr(md5(name || ' ' || size), 1, 8) WHEN id % 8 = 0 THEN 'gen_' || size || '_' || id || '_' || substr(md5(name || ' $\\frac12$'), 1, 8) END AS question_id, CASE WHEN id % 8 < 3 THEN id % 8 < 2 END AS is_mcq FROM p""".replace("\\\\frac", "\\frac"))
def _(spark, d):
    return Q.parse_questions(_generated(spark, d), "text", "size", "id").select(F.col("row").alias("id"), "parsed_ok", "reject_reason", "question_id", "is_mcq")


@_query("JSN-06", PARTS + " SELECT id, CASE WHEN id % 2 = 0 AND size % 2 = 0 THEN 'answer_type=' || type || ';unit=' || brand WHEN id % 2 = 0 THEN 'answer_type=' || type WHEN size % 2 = 0 THEN 'unit=' || brand END AS meta FROM p")
def _(spark, d):
    held = LK.filled({"answer_type": F.expr("if(id % 2 = 0, type, null)"), "unit": F.expr("if(size % 2 = 0, brand, null)")})
    shown = F.array_join(F.transform(F.map_entries(held), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return parts(spark, d).select("id", shown.alias("meta"))


@_query("JSN-07", PARTS + " SELECT id, CASE WHEN size > 1 THEN size / 100 ELSE size END::DOUBLE AS fraction FROM p")
def _(spark, d):
    return parts(spark, d).select("id", S.fraction(F.col("size")).cast("double").alias("fraction"))


@_query("FLT-10", PARTS + " SELECT id, CASE WHEN id % 3 = 1 THEN 'failed_parse' WHEN id % 3 = 0 THEN 'seed_copy' END AS reject_reason FROM p WHERE id % 3 < 2 OR name || ' 2' NOT IN (SELECT name FROM p)")
def _(spark, d):
    t = _text(spark, d, "if(id % 3 = 2, concat(name, ' 2'), concat('  ', upper(name), '!'))").withColumn("wrong", F.expr("if(id % 3 = 1, 'failed_parse', null)"))
    seeds = parts(spark, d).select(S.text_key(F.col("name")).alias("key")).distinct().withColumn("copy", F.lit(True))
    joined = t.withColumn("key", S.text_key(F.col("text"))).join(seeds, "key", "left")
    return joined.select("id", F.coalesce("wrong", F.when(F.col("copy"), "seed_copy")).alias("reject_reason"))


@_query("FLT-11", PARTS + " SELECT id, id % 4 < 3 AS empty FROM p")
def _(spark, d):
    t = _text(spark, d, "case id % 4 when 0 then concat('*', upper(name), '*') when 1 then '<b></b>' when 2 then concat(name, ' so it is') else concat(repeat(brand, 9), name) end")
    return t.select("id", S.noninformative(F.col("name"), F.col("text")).alias("empty"))


@_query("FLT-17", PARTS + " SELECT id, brand AS question, name AS answer FROM p WHERE id % 2 = 0")
def _(spark, d):
    t = _text(spark, d, r"if(id % 2 = 0, concat('Q: ', brand, '\nA: ', name), name)")
    pattern = r"(?s)^Q: (.*?)\nA: (.*)$"
    return t.where(F.col("text").rlike(pattern)).select("id", F.regexp_extract("text", pattern, 1).alias("question"), F.regexp_extract("text", pattern, 2).alias("answer"))


@_query("HSH-01", "SELECT p_partkey AS id, ('0x' || substr(md5('42:' || p_brand || ':' || p_partkey), 1, 15))::BIGINT AS seed FROM part")
def _(spark, d):
    digest = F.md5(F.concat_ws(":", F.lit("42"), "brand", F.col("id").cast("string")))
    return parts(spark, d).select("id", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("seed"))


@_query("DOC-01", PARTS + """ SELECT id AS key, 0 AS chunk, brand AS header, name || chr(10) || type AS page_content FROM p
UNION ALL SELECT id, 1, brand || '/' || name, type || '  ' || chr(10) || name FROM p""")
def _(spark, d):
    t = _text(spark, d, r"concat('# ', brand, '\n', name, '\n', type, '\n## ', name, '\n', type, '\n\n  ', name, '\n\n')")
    c = MD.chunk(t, "text", "id", least=0)
    return c.select("key", "chunk", F.array_join(F.map_values("headers"), "/").alias("header"), "page_content")


@_query("DOC-02", PARTS + " SELECT id, type AS first, repeat('y', 100) AS last, 2 AS n FROM p")
def _(spark, d):
    t = _text(spark, d, "concat(type, '\n\n', repeat('y', 100))")
    pieces = X.over(lambda x: MD.bounded(x, 25), "array<string>")(F.col("text"))
    return t.select("id", pieces.alias("s")).select("id", F.col("s")[0].alias("first"), F.element_at("s", -1).alias("last"), F.size("s").alias("n"))


@_query("DOC-03", PARTS + " SELECT id, [type || chr(10) || chr(10) || type, type] AS pieces FROM p")
def _(spark, d):
    t = _text(spark, d, "concat(type, '\n\n', type, '\n\n', type)")
    return t.select("id", X.over(lambda x: MD.by_paragraph(x, 2 * MD.estimate(x.split("\n")[0])), "array<string>")(F.col("text")).alias("pieces"))


@_query("DOC-04", PARTS + " SELECT id, [type || '.', type || '.', type || '.'] AS pieces FROM p")
def _(spark, d):
    t = _text(spark, d, "concat(type, '. ', type, '. ', type)")
    return t.select("id", X.over(lambda x: MD.by_sentence(x, MD.estimate(x.split(". ")[0] + ".")), "array<string>")(F.col("text")).alias("pieces"))


@_query("DOC-05", PARTS + " SELECT id, ['f(' || id || ')', 'g(' || id || ')', 'h'] AS pieces FROM p")
def _(spark, d):
    t = _text(spark, d, "concat('f(', id, '), g(', id, '), h')")
    return t.select("id", X.over(lambda x: MD.by_force(x, 1, lambda s: s.count(",") + bool(s)), "array<string>")(F.col("text")).alias("pieces"))


@_query("DOC-08", PARTS + " SELECT id, 2 + 3 + len(string_split(name, ' ')) AS n FROM p")
def _(spark, d):
    return _text(spark, d, "concat('(a,', name, ') é')").select("id", S.token_count(F.col("text")).cast("long").alias("n"))


@_query("DOC-16", PARTS + " SELECT id, 'system:be brief|user:' || name AS shown FROM p")
def _(spark, d):
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return parts(spark, d).select("id", LK.shown(F.array(message("system", F.lit("be brief")), message("user", F.col("name")))).alias("shown"))


@_query("PAR-01", PARTS + " SELECT id, 0 AS rank, brand AS prompt, name AS response FROM p UNION ALL SELECT id, 1, brand, type FROM p")
def _(spark, d):
    pairs = parts(spark, d).select("id", F.col("brand").alias("prompt"), F.col("name").alias("chosen"), F.col("type").alias("rejected"))
    return IN.pair_rows(pairs, "id").select("id", "rank", "prompt", "response")


@_query("MSK-03", "SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN length(coalesce(text, '')) ELSE 0 END)::BIGINT AS ones, sum(length(coalesce(text, '')))::BIGINT AS width FROM conversations GROUP BY 1")
def _(spark, d):
    chats = LK.messages(spark.read.parquet(f"{d}/conversations.parquet"), "conv_id", "turn", "role", "text")
    masks = chats.select("conv_id", LK.loss_mask(F.col("messages")).alias("m"))
    return masks.select("conv_id", F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x).alias("ones"), F.size("m").cast("long").alias("width"))


def _round_trip(spark, d, df, ending: str):
    """A table written and read again."""
    path = scratch_path(spark, "round-trip") + ending
    if ending == ".parquet":
        df.write.parquet(path)
    else:
        OUT.write_json(df, path)
    return path


@_query("SRC-01", PARTS + " SELECT id, name FROM p ORDER BY md5('5:' || id), id LIMIT 20")
def _(spark, d):
    paths = [_round_trip(spark, d, parts(spark, d).where(f"id % 2 = {k}").select("id", "name"), e) for k, e in ((0, ".parquet"), (1, ".jsonl"))]
    return IN.prompts(spark, paths, 20, 5, "id").select("id", "name")


@_query("SRC-02", PARTS + " SELECT name AS prompt, brand AS response FROM p")
def _(spark, d):
    return IN.single_turn(parts(spark, d).select(F.struct(F.struct("name").alias("b"), "brand").alias("a")), "a.b.name", "a.brand")


@_query("SRC-03", "SELECT conv_id, count(*)::INT AS turns, true AS no_tools FROM conversations GROUP BY 1")
def _(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    m = c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))
    out = IN.multi_turn(m.withColumn("tag", F.col("conv_id")))
    both = m.select("conv_id", F.size("messages").alias("turns"))
    return both.withColumn("no_tools", F.lit(out.where("tools is not null or enable_thinking is not null").isEmpty()))


@_query("SRC-04", PARTS + " SELECT brand AS prompt, id::VARCHAR AS chosen, size::VARCHAR AS rejected FROM p")
def _(spark, d):
    return IN.preference_pairs(parts(spark, d).select(F.col("brand").alias("prompt"), F.col("id").alias("chosen"), F.col("size").alias("rejected")))


@_query("SRC-05", PARTS + " SELECT id::VARCHAR AS question_id, name AS question_text, [brand, type] AS choices, brand AS ground_truth, 'qa_mcq' AS benchmark_type, NULL::VARCHAR AS data_source FROM p")
def _(spark, d):
    rows = parts(spark, d).select("id", F.col("name").alias("Question"), F.array("brand", "type").alias("Options"), F.col("brand").alias("Answer"))
    return IN.questions(IN.read_files(spark, [_round_trip(spark, d, rows, ".jsonl")]))


@_query("SRC-10", PARTS + ", s AS (SELECT id, row_number() OVER (ORDER BY md5('8:' || id), id) AS k FROM p) SELECT id, CASE WHEN k <= 30 THEN 'dev' ELSE 'test' END AS split FROM s WHERE k <= 70")
def _(spark, d):
    return IN.dev_test_split(parts(spark, d), "id", 30, 40, 8).select("id", "split")


@_query("SRC-11", PARTS + " SELECT id, 'even' AS field, (row_number() OVER (ORDER BY id) - 1)::BIGINT AS doc_id FROM p WHERE id % 2 = 0 UNION ALL SELECT id, 'odd', (SELECT count(*) FROM p WHERE id % 2 = 0) + row_number() OVER (ORDER BY id) - 1 FROM p WHERE id % 2 = 1")
def _(spark, d):
    p = parts(spark, d).select("id")
    return IN.numbered_chunks({"even": p.where("id % 2 = 0"), "odd": p.where("id % 2 = 1")}, "id").select("id", "field", "doc_id")


@_query("SRC-18", PARTS + " SELECT id, CASE WHEN id % 3 > 0 THEN name END AS response FROM p")
def _(spark, d):
    p = parts(spark, d)
    results = p.where("id % 3 > 0").select("id", F.col("name").alias("response"))
    return IN.batch_results(results.unionByName(results), p.select("id"), "id")


@_query("SNK-01", PARTS + " SELECT id, CASE WHEN id % 2 = 0 THEN name END AS output, size AS score FROM p")
def _(spark, d):
    rows = parts(spark, d).select("id", F.expr("if(id % 2 = 0, name, null)").alias("output"), F.col("size").alias("score"))
    return spark.read.schema("id long, output string, score int").json(_round_trip(spark, d, rows, ".jsonl"))


@_query("SNK-02", "SELECT conv_id, list(text ORDER BY turn, text) AS responses FROM conversations GROUP BY 1")
def _(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").withColumn("place", F.col("turn"))
    return OUT.write_generations(c, "conv_id", "text", scratch_path(spark, "generations"))


@_query("SNK-03", PARTS + " SELECT id, name FROM p")
def _(spark, d):
    path = scratch_path(spark, "chunks")
    OUT.write_json(parts(spark, d).select("id", "name"), path, gzip=True)
    return spark.read.schema("id long, name string").json(path)


@_query("SNK-04", PARTS + " SELECT id, name || '_tag-' || brand || '_ans' || size || '_temp0.6_len4096_scores.json' AS file FROM p")
def _(spark, d):
    p = parts(spark, d)
    return p.select("id", OUT.output_name(F.concat(F.lit("a/b/"), "name", F.lit(".json")), F.col("brand"), F.col("size"), 0.6, 4096, "scores", "tag").alias("file"))


@_query("SNK-05", PARTS + " SELECT id, size AS score FROM p")
def _(spark, d):
    rows = OUT.detailed(parts(spark, d).select("id", F.col("size").alias("score"), F.array("name").alias("sampled_answers")), "scores")
    back = OUT.payload(rows).select(F.from_json("json", "id long, score int, sampled_answers array<string>").alias("x"))
    return back.where("x.sampled_answers is null").select("x.id", "x.score")


@_query("SNK-06", PARTS + " SELECT id FROM p WHERE size > 5 AND id % 2 = 0")
def _(spark, d):
    p = parts(spark, d)
    metrics = p.select("id", F.lit("total_questions").alias("metric"), F.greatest(F.col("size") - 5, F.lit(0)).cast("double").alias("value")).unionByName(
        p.where("id % 2 = 0").select("id", F.lit("total_answers").alias("metric"), F.lit(3.0).alias("value"))
    )
    return OUT.complete(metrics, "id")


@_query("SNK-12", PARTS + " SELECT id::VARCHAR AS question_id, name AS question_text, [brand] AS choices, CASE WHEN size >= 38 THEN 'easy' WHEN size >= 13 THEN 'medium' ELSE 'hard' END AS difficulty, type AS ground_truth, 'parts' AS data_source FROM p WHERE id % 2 = 0")
def _(spark, d):
    p = parts(spark, d).select(F.col("id").cast("string").alias("question_id"), F.col("name").alias("question_text"), F.array("brand").alias("choices"), "size", F.col("type").alias("ground_truth"), "id")
    label = F.when(F.col("size") >= 38, "easy").when(F.col("size") >= 13, "medium").otherwise("hard")
    return OUT.dev_rows(p.where("id % 2 = 0"), p, "parts", label)
