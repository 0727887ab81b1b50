"""Worked cases of competitions, judges, registries and loops."""

import pytest
from pyspark.sql import functions as F

from quern.functions import answers as X
from quern.functions import competition as C
from quern.functions import grading as N
from quern.operators import judging as J
from quern.operators import registries as R
from quern.sources import results as IN
from quern.streaming import loop


def test_competition():
    assert C.tex_items(None) is None
    assert C.tex_items(r"\begin{itemize} no items \end{itemize}") is None
    assert C.tex_items(r"\begin{itemize}\item[A1] x \item[B--2] y \item[A1] z\end{itemize}") == [("A1", "z"), ("B2", "y")]
    assert C.shortlist_solutions("") is None
    assert C.shortlist_solutions("## Solutions\nnothing") is None
    assert C.shortlist_solutions("A1. short\nA1. Solution. long\nC2. no words") == [("A1", "A1. Solution. long")]


def test_verdicts():
    assert [N.close_enough(a, b) for a, b in (("50%", "0.5"), ("1,000", "1000"), ("(1,2)", "(1.00001, 2)"), ("[1,2]", "{1,2}"), ("(1,2)", "(1,2,3)"), ("x", None))] == [True, True, True, True, False, None]
    assert X.either(None, None) is None and X.either(False, True) is True and X.either(None, False) is False
    assert N.judged("x+1", "1+x") is True and N.judged("some words", "1+x") is None
    assert X.same_output('{"a": [1, 2.0]}', '{"a": [1.0, 2]}') is True
    assert X.same_output("true", "1") is True  # as equal values of the language are
    assert X.same_output("true", '"1"') is False and X.same_output("a b", "a b") is True


def test_registries(spark, tmp_path):
    held = R.Registry("verifier")
    held.add("a")(len)
    with pytest.raises(ValueError):
        held.add("a")(len)
    with pytest.raises(ValueError):
        held["b"]
    (tmp_path / "reward.py").write_text("import math\n\ndef score(a, b):\n    return math.sqrt(len(a)) if a == b else None\n")
    rows = spark.createDataFrame([("abcd", "abcd"), ("a", "b"), ("", "")], "a string, b string")
    got = rows.select(R.from_file(str(tmp_path / "reward.py"), "score")(F.col("a"), F.col("b")))
    assert sorted(r[0] for r in got.collect() if r[0] is not None) == [0.0, 2.0]


def test_judged(spark):
    rows = spark.createDataFrame([(0.0, True), (1.0, False), (None, None), (1.0, None)], "s double, v boolean")
    both = rows.select(J.judged(F.col("s"), F.col("v"), F.lit(True)), J.judged(F.col("s"), F.col("v"), F.lit(True), "cascade")).collect()
    assert [tuple(r) for r in both] == [(1.0, 1.0), (0.0, 1.0), (0.0, None), (1.0, 1.0)]


def test_examples_are_others(spark):
    rows = spark.range(7).toDF("id")
    got = J.examples(rows, "id", 4, 1).groupBy("id").agg(F.collect_set("example").alias("x")).collect()
    assert len(got) == 7 and all(len(r["x"]) == 3 and r["id"] not in r["x"] for r in got)
    assert J.examples(rows.limit(2), "id", 4, 1).count() == 2
    assert J.examples(rows.limit(1), "id", 4, 1).count() == 0


def test_nearest_over_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)] + [(9, None), (10, [0.0, 0.0])], "id long, v array<double>")
    got = {(r["query"], r["rank"]): r["match"] for r in J.nearest(rows.repartition(3), rows.where("id < 5"), "id", "v", 3, block=2).collect()}
    assert [got[4, i] for i in (1, 2, 3)] == [1, 4, 7] and len(got) == 15
    assert J.nearest(rows, rows.where("id > 99"), "id", "v", 3).count() == 0


def test_loop_goes_on_after_a_failure(spark, tmp_path):
    rows, first, second = (str(tmp_path / n) for n in ("rows", "first", "second"))
    spark.range(40).repartition(4).write.parquet(rows)
    stream = lambda: loop.arriving(spark, rows, "id long", files=1)
    broken = {"left": 2}

    def step(batch):
        broken["left"] -= 1
        if broken["left"] == 0:
            raise OSError("lost")
        return batch

    writers = [loop.once(first), loop.once(second, step, depends=(first,))]
    with pytest.raises(Exception, match="lost"):
        loop.run(stream(), writers, str(tmp_path / "checkpoint"))
    loop.run(stream(), writers, str(tmp_path / "checkpoint"))
    loop.run(stream(), writers, str(tmp_path / "checkpoint"))
    for path in (first, second):
        assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(40))
    with pytest.raises(Exception, match="has not finished"):
        loop.run(stream(), [loop.once(str(tmp_path / "third"), depends=(str(tmp_path / "none"),))], str(tmp_path / "other"))


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    assert IN.resolve(spark, "a.txt", "/nowhere", str(tmp_path)) == f"{tmp_path}/a.txt"
    with pytest.raises(FileNotFoundError):
        IN.resolve(spark, "b.txt", str(tmp_path))
    there = IN.copy(spark, f"{tmp_path}/a.txt", f"{tmp_path}/near")
    (tmp_path / "a.txt").write_text("y")
    assert IN.copy(spark, f"{tmp_path}/a.txt", f"{tmp_path}/near") == there and open(there).read() == "x"
    IN.copy(spark, f"{tmp_path}/a.txt", f"{tmp_path}/near", again=True)
    assert open(there).read() == "y"
