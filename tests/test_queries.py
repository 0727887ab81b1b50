"""Every query with SQL gives the rows that DuckDB gives over the same tables."""

import math
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.functions import strings as S
from quern.operators import advantages as A
from quern.operators import aggregates as G
from quern.operators import balance as BA
from quern.operators import batch as B
from quern.operators import filters as L
from quern.operators import sampling as M
from quern.plans import book_queries as _books  # noqa: F401
from quern.plans import data_queries as _data  # noqa: F401
from quern.plans import full_queries as _full  # noqa: F401
from quern.plans import judging_queries as _judging  # noqa: F401
from quern.plans import more_queries as _more  # noqa: F401
from quern.plans import queries as _queries  # noqa: F401
from quern.plans import registry
from quern.plans import sampling_queries as _sampling  # noqa: F401
from quern.plans import stream_queries as _streams  # noqa: F401
from quern.plans import text_queries as _texts  # noqa: F401
from quern.plans import token_queries as _tokens  # noqa: F401

FOLDER = os.environ.get("QUERN_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS FROM '{FOLDER}/{name}'")
    return c


def _plain(v):
    return float(f"{v:.6g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    relation = duck.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(_plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)


def test_pass_at_k(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(8, 2, 1), (8, 2, 2), (8, 7, 2), (8, 0, 4), (2, 1, 4)], "n long, c long, k long")
    got = [r[0] for k in (1, 2) for r in rows.where(F.col("k") == k).select(G.pass_at_k(F.col("n"), F.col("c"), k)).collect()]
    assert [round(x, 6) for x in got] == [0.25, round(1 - math.comb(6, 2) / math.comb(8, 2), 6), 1.0]
    assert rows.where("k = 4").select(G.pass_at_k(F.col("n"), F.col("c"), 4)).collect() == [(0.0,), (0.0,)]
    assert rows.where("n = 2").select(G.pass_at_k(F.col("n"), F.col("c"), 4, None)).first()[0] is None


def test_single_rows(spark):
    one = spark.createDataFrame([(0, "q", 3.0)], "row_idx long, group string, score double")
    assert abs(A.grpo(one).first().advantage - 3 / (1 + 1e-6)) < 1e-9
    assert A.rloo(one).first().advantage == 3.0
    assert A.rloo_vectorized(one).first().advantage == 0.0
    with pytest.raises(ValueError):
        A.estimate("none such", one)


def test_spread(spark):
    rows = [(i, "A") for i in range(8)] + [(8 + i, "B") for i in range(4)] + [(12 + i, "C") for i in range(2)]
    spread = L.stratify(spark.createDataFrame(rows, "q long, doc string"), "doc", "q").orderBy("_at", "_first", "q")
    assert [r.q for r in spread.collect()] == [0, 8, 1, 12, 2, 9, 3, 4, 10, 5, 13, 6, 11, 7]


def test_quantise_and_quotas(spark):
    rows = spark.createDataFrame([(-4.0,), (-1.0,), (1.0,), (4.0,)], "s double")
    assert [r.quantised for r in A.quantise(rows, "s", "2bit").collect()] == [-1.0, -1.0, 1.0, 1.0]
    assert L.quotas({"a": 0.25, "b": 0.25, "c": 0.5}, 10) == {"a": 2, "b": 2, "c": 6}


def test_padding(spark):
    rows = spark.range(5).withColumnRenamed("id", "row_idx")
    padded = B.pad_to_divisor(rows, 4, 5)
    assert sorted(r.row_idx for r in padded.collect()) == list(range(8))
    assert B.unpad(padded).count() == 5
    assert B.pad_to_divisor(rows, 5, 5).count() == 5
    with pytest.raises(ValueError):
        B.chunk(rows, 2, 5)


def test_strings(spark):
    from pyspark.sql import functions as F

    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(S.same_general(F.lit("42.0"), F.lit("42"))) is True
    assert value(S.same_general(F.lit(None).cast("string"), F.lit("42"))) is False
    assert value(S.same_integer(F.lit("3.7"), F.lit("3"))) is True
    assert value(S.strip_wrappers(F.lit(r"\text{\mathbf{B}}"))) == "B"
    assert value(S.last_answer_block(F.lit("<answer>a</answer> <answer> b </answer>"))) == "b"
    assert value(S.benchmark_name(F.lit("a/b/c.json"))) == "c"
    assert value(S.noninformative(F.lit("Find x."), F.lit("Find *x*."))) is True


def test_question_structure(spark):
    from pyspark.sql import functions as F

    rows = [(["a"] * 4, None), (["a"] * 8, None), (["a"] * 3, "qa_open"), (["a"] * 9, None), ([], None), (None, "QA_open "), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, choices array<string>, kind string").orderBy("i")
    ok = L.structure_ok(F.lit("q"), F.lit("t"), F.col("choices"), F.col("kind"))
    assert [r.x for r in df.select(ok.alias("x")).collect()] == [True, True, False, False, True, True, False]
    no_truth = L.structure_ok(F.lit("q"), F.lit(None), F.col("choices"), F.col("kind"))
    assert not any(r.x for r in df.select(no_truth.alias("x")).collect())


def test_mid_eos(spark):
    from pyspark.sql import functions as F

    rows = [([5, 2, 0], [1, 1, 0], None), ([5, 2, 0], [1, 1, 0], 1.0), ([5, 6, 2], [1, 1, 0], None), ([5, 2, 7], [1, 0, 1], None), ([2, 5, 5], [0, 0, 0], None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, ids array<int>, mask array<int>, score double").orderBy("i")
    got = df.select(L.mid_eos(F.col("ids"), F.col("mask"), F.col("score"), 2).alias("x")).collect()
    assert [r.x for r in got] == [True, False, False, True, True]


def test_fallback_join(spark):
    from quern.operators import joins as J

    kind = "chapter string, label string, num int, pos int, "
    problems = spark.createDataFrame([("1", "a", 1, 0, "p0"), ("1", "b", 2, 1, "p1"), ("2", "a", 3, 2, "p2"), ("2", "b", 4, 3, "p3"), ("9", "z", 5, 4, "p4"), ("1", "a", 1, 5, "again")], kind + "body string")
    answers = spark.createDataFrame([("1", "a", 1, 0, "full"), ("1", "a", 1, 1, "later"), ("1", None, 2, 2, "chapter"), (None, "a", 3, 3, "label"), (None, None, 4, 4, "bare"), ("8", "z", 5, 5, "other")], kind + "answer string")
    got = {r.body: r.answer for r in J.fallback_join(problems, answers, "answer", "pos").collect()}
    assert got == {"p0": "full", "p1": "chapter", "p2": "label", "p3": "bare", "p4": None}


def _events(folder, accuracy):
    """Events of questions with 20 graded rows each, of which so many are right."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    ids = [i for i in range(40 * len(accuracy)) if i % 17][: 20 * len(accuracy)]
    users = [k // 20 for k in range(len(ids))]
    values = [20.0 + u if k % 20 < accuracy[u] else 1.0 for k, u in enumerate(users)]
    pq.write_table(pa.table({"event_id": ids, "user_id": users, "event_type": ["view"] * len(ids), "value": values}), f"{folder}/events.parquet")
    return str(folder)


def test_top_alpha_counts_the_questions_of_the_data(spark, tmp_path):
    folder = _events(tmp_path, [10] * 10 + [20] * 11)  # 21 questions, 10 of them with variance
    got = [r.q for r in registry.queries()["FLT-05"](spark, folder).collect()]
    assert sorted(got) == [5, 6, 7, 8, 9]  # ceil(0.2 * 21) with the best mean


def test_shortfall_goes_to_buckets_with_rows_left(spark):
    rows = [(i, "easy" if i < 100 else "medium") for i in range(130)]
    df = spark.createDataFrame(rows, "q long, b string")
    sample = lambda wanted: L.sample_buckets(df, "b", "q", wanted, 7).groupBy("b").count().collect()
    # 20 are lacking; surpluses of 90 and 10: 18 and 2
    assert dict(sample({"easy": 10, "medium": 20, "hard": 20})) == {"easy": 28, "medium": 22}
    assert dict(sample({"easy": 10, "medium": 20})) == {"easy": 10, "medium": 20}
    assert dict(sample({"easy": 10, "medium": 20, "hard": 500})) == {"easy": 100, "medium": 30}
    assert L.redistribute_shortfall(5, {}) == {}


def test_gae_is_whitened_and_has_returns(spark):
    rows = [(0, [1.0, 2.0, 4.0], [0.5, 1.0, 2.0], [1, 0, 1]), (1, [3.0], [1.0], [1])]
    df = spark.createDataFrame(rows, "k long, r array<double>, v array<double>, m array<int>")
    got = {(x.k, x.pos): (x.advantage, x.returns) for x in A.gae_advantages(df, "k", "r", "v", "m", 0.5, 0.5).collect()}
    raw = {(0, 2): 2.0, (0, 1): 2.0, (0, 0): 1.0 + 0.5 * 2.0 - 0.5 + 0.25 * 2.0, (1, 0): 2.0}
    valid = [raw[0, 0], raw[0, 2], raw[1, 0]]
    mean = sum(valid) / 3
    std = math.sqrt(sum((x - mean) ** 2 for x in valid) / 2 + 1e-8)
    values = {(0, 0): 0.5, (0, 1): 1.0, (0, 2): 2.0, (1, 0): 1.0}
    for k, a in raw.items():
        assert abs(got[k][0] - (a - mean) / std) < 1e-6 and abs(got[k][1] - a - values[k]) < 1e-9


def test_null_groups_stay(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("a", 2.0)], "g string, x double")
    assert L.group_std_mask(df, "g", "x", tau=0.5).count() == 4
    assert [r.g for r in L.drop_flat_groups(df, "g", ["x"]).collect()] == [None, None]


def test_blanks_of_all_kinds(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    lit = lambda s: F.lit(s).cast("string")
    assert value(S.opener(lit("\n\tAlright"))) == "alright"
    assert value(S.same_general(lit(" x\n"), lit("x"))) is True and value(S.same_choice(lit("\tb"), lit("B "))) is True
    assert value(S.strip_wrappers(lit("\\text{" * 6 + "x" + "}" * 6))) == "x"
    assert value(S.same_integer(lit(None), lit("3"))) is None
    for unit in ("^\\circ", "\\%", "\\text{ cm}", "°"):
        assert value(S.same_integer(lit("42" + unit), lit("42"))) is True, unit


def test_entry_needs_no_session():
    """The driver reads the names before it starts Spark."""
    code = "import __spark_entry__ as e; print(len(e.queries()) - len(e.oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True).returncode == 0


def test_partitions():
    assert BA.greedy([5, 1, 1, 1], 2, equal_size=False) == [[0], [1, 2, 3]]
    assert [len(p) for p in BA.greedy([5, 1, 1, 1], 2, equal_size=True)] == [2, 2]
    parts = BA.largest_differencing([8, 7, 6, 5, 4], 2, False)
    assert sorted(i for p in parts for i in p) == [0, 1, 2, 3, 4] and abs(sum([8, 7, 6, 5, 4][i] for i in parts[0]) - 15) <= 1
    assert M.equal_quotas({"a": 1, "b": 9, "c": 9}, 12) == {"a": 1, "b": 6, "c": 5}
    with pytest.raises(ValueError):
        M.filter_mode("top_0")
