"""Questions and answers of books: rows that ``functions.books`` reads, matched by joins within each book.

A problem takes the answer under its own key (chapter, label, number), else under (chapter, -, number), (-, label, number) or
(-, -, number). Keys are matched without texts, each problem's four keys in one join; a text moves once, after its match is
known. Of equal keys the first row counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.books import ROW, Row, book_rows, volume_rows
from quern.functions.competition import has_figure
from quern.functions.strings import noninformative
from quern.session import materialise

KEY = ("chapter", "label", "num")
#: Stands for a missing chapter or label in a join's key.
NONE = "∅"
#: Least pairs of a compendium that are taken for one.
LEAST_YEARLY = 10
#: Rows of a book that leave Python together.
OUT_ROWS = 4096
STATS = ("exercise_sections", "answer_sections", "problems", "answers", "matched", "dropped_figure", "dropped_noninformative", "unmatched", "inline", "papers")


def read_books(docs: DataFrame, book: str, text: str) -> DataFrame:
    """The rows of each book with their place: book, place, role, chapter, label, num, body, question, answer."""
    return _placed(docs, book, text, book_rows)


def read_volumes(docs: DataFrame, book: str, problems: str, solutions: str) -> DataFrame:
    """The same of books in two volumes, the second of which is all answers."""
    first, second = (_placed(docs, book, c, lambda t, s=s: volume_rows(t, s)) for c, s in ((problems, False), (solutions, True)))
    return first.unionByName(second)


def _placed(docs: DataFrame, book: str, text: str, rows: Callable[[str | None], Iterator[Row]]) -> DataFrame:
    slim = docs.select(F.col(book).alias("book"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(_read(rows), f"book {slim.schema['book'].dataType.simpleString()}, place int, " + ", ".join(f"{c} string" for c in ROW))


def _read(rows: Callable[[str | None], Iterator[Row]]):
    """Books one by one; their rows leave in batches of OUT_ROWS."""
    kinds = (pa.int32(), *[pa.string()] * len(ROW))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book, text in zip(batch.column(0), batch.column(1), strict=True):
                placed = ((place, *row) for place, row in enumerate(rows(text.as_py())))
                while some := [*islice(placed, OUT_ROWS)]:
                    columns = [pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)]
                    yield pa.record_batch([pa.repeat(book, len(some)), *columns], names=["book", "place", *ROW])

    return run


def _first(rows: DataFrame, *values: str) -> DataFrame:
    """The first row of each key of a book; a missing chapter or label is a value of its own."""
    own = F.struct("place", *values)
    first = rows.groupBy("book", *[F.coalesce(c, F.lit(NONE)).alias(c) for c in KEY]).agg(F.min_by(own, "place").alias("_own"))
    return first.select("book", *KEY, "_own.*")


def match(problems: DataFrame, answers: DataFrame) -> DataFrame:
    """Each problem (unique by book and key) with the answer it takes, null if there is none: adds answer."""
    chapter, label = F.col("chapter"), F.col("label")
    none = F.lit(NONE)
    steps = [F.struct(F.lit(i).alias("step"), c.alias("c"), n.alias("l")) for i, (c, n) in enumerate(((chapter, label), (chapter, none), (none, label), (none, none)))]
    asked = problems.select("book", *KEY, F.explode(F.array(*steps)).alias("_asked"))
    asked = asked.select("book", *KEY, "_asked.*", F.col("num").alias("n"))
    held = answers.select("book", *[F.col(k).alias(n) for k, n in zip(KEY, ("c", "l", "n"), strict=True)])
    taken = asked.join(held, ["book", "c", "l", "n"]).groupBy("book", *KEY).agg(F.min_by(F.struct("c", "l"), "step").alias("_taken"))
    texts = answers.select("book", *[F.col(k).alias(f"_{k}") for k in KEY], F.col("body").alias("answer"))
    same = (F.col("_taken.c") == F.col("_chapter")) & (F.col("_taken.l") == F.col("_label")) & (F.col("num") == F.col("_num"))
    found = taken.join(texts.withColumnRenamed("book", "_book"), (F.col("book") == F.col("_book")) & same).select("book", *KEY, "answer")
    return problems.join(found, ["book", *KEY], "left")


def _judged(pairs: DataFrame) -> DataFrame:
    """Adds figure and restated: why a pair goes."""
    figure = has_figure(F.col("question")) | has_figure(F.col("answer"))
    return pairs.withColumn("figure", figure).withColumn("restated", ~figure & noninformative(F.col("question"), F.col("answer")))


def pair_up(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All problems of the ordinary layouts with answer, figure and restated, and their answers by key.

    A problem's own solution is an answer under its key, if there is none.
    """
    problems = _first(rows.where(F.col("role").isin("problem", "inline")), "role", "body", "question", "answer")
    given = _first(rows.where("role = 'answer'"), "body").select("book", *KEY, "body")
    own = problems.where("answer is not null").join(given.select("book", *KEY), ["book", *KEY], "left_anti")
    held = given.unionByName(own.select("book", *KEY, F.col("answer").alias("body")))
    solved = own.select("book", *KEY, F.lit(True).alias("_own"))
    asked = problems.join(solved, ["book", *KEY], "left").withColumn("question", F.when(F.col("_own"), F.col("question")).otherwise(F.col("body")))
    return _judged(match(asked.drop("answer", "_own", "body"), held)), held


def _papers(rows: DataFrame) -> DataFrame:
    """Pairs of papers before any goes."""
    return _judged(rows.where("role = 'paper'").select("book", "place", *KEY, "question", "answer"))


def _yearly(rows: DataFrame) -> DataFrame:
    """Pairs of compendiums, by year, kind and number."""
    problems, answers = (_first(rows.where(F.col("role") == f"yearly_{x}"), "body") for x in ("problem", "answer"))
    found = problems.withColumnRenamed("body", "question").join(answers.select("book", *KEY, F.col("body").alias("answer")), ["book", *KEY])
    return _judged(found)


def extract(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs and statistics of books: (book, place, layout, chapter, label, num, question, answer) and a row of counts a book.

    A book without an ordinary pair is read as a collection of papers; one with LEAST_YEARLY pairs of a compendium gives these
    alone. ``rows`` are read more than once: write them first.
    """
    ordinary, held = (materialise(x, "pairs") for x in pair_up(rows))
    kept = ordinary.where("answer is not null and not figure and not restated")
    paired = kept.select("book").distinct()
    papers = _papers(rows).join(paired, "book", "left_anti")
    first_papers = _first(papers.where("not figure and not restated"), "question", "answer")
    years = materialise(_yearly(rows), "pairs-by-year")
    good_years = years.where("not figure and not restated")
    whole = good_years.groupBy("book").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_YEARLY)
    bare = [F.nullif(F.col(c), F.lit(NONE)).alias(c) for c in ("chapter", "label")]
    shape = lambda df, layout: df.select("book", "place", F.lit(layout).alias("layout"), *bare, "num", "question", "answer")
    other = shape(kept, "ordinary").unionByName(shape(first_papers, "papers")).join(whole.select("book"), "book", "left_anti")
    pairs = other.unionByName(shape(good_years.join(whole.select("book"), "book", "left_semi"), "yearly"))

    def counts(df: DataFrame, **which: Column) -> DataFrame:
        """One row per counted row of a table, with ones and zeros."""
        return df.select("book", *[F.coalesce(which[n].cast("long"), F.lit(0).cast("long")).alias(n) if n in which else F.lit(0).cast("long").alias(n) for n in STATS])

    one = F.lit(1)
    dropped = {"dropped_figure": F.col("figure"), "dropped_noninformative": F.col("restated")}
    none = F.col("answer").isNull()
    yearly_rows = lambda x: _first(rows.where(F.col("role") == f"yearly_{x}")).join(whole.select("book"), "book", "left_semi")
    parts = [
        counts(rows.where("role = 'exercise_section'"), exercise_sections=one),
        counts(rows.where("role = 'answer_key_section'"), answer_sections=one),
        counts(rows.where("role = 'normal_section'")),
        counts(ordinary, problems=one, unmatched=none, inline=F.col("role") == "inline", dropped_figure=~none & F.col("figure"), dropped_noninformative=~none & F.col("restated")),
        counts(held, answers=one),
        counts(kept, matched=one),
        counts(papers, **dropped),
        counts(first_papers, matched=one, papers=one),
        counts(years, **dropped),
        counts(good_years.join(whole.select("book"), "book", "left_semi"), matched=one),
        counts(yearly_rows("problem"), problems=one),
        counts(yearly_rows("answer"), answers=one),
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return pairs, table.groupBy("book").agg(*[F.sum(n).alias(n) for n in STATS])


def page(book: Column, chapter: Column, label: Column, num: Column, question: Column, answer: Column) -> list[Column]:
    """Content and headings of a pair: content, header1, header2."""
    content = F.concat(F.lit("## Problem\n"), F.trim(question), F.lit("\n\n## Answer\n"), F.trim(answer), F.lit("\n"))
    named = F.concat(book, F.coalesce(F.concat(F.lit(" — Chapter "), F.nullif(chapter, F.lit(""))), F.lit("")))
    capital = F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, 1 << 20))
    header = F.concat(named, F.coalesce(F.concat(F.lit(" ("), F.nullif(capital, F.lit("")), F.lit(")")), F.lit("")))
    return [content.alias("content"), header.alias("header1"), F.concat(F.lit("Problem "), num).alias("header2")]
