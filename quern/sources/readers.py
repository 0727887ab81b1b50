"""Readers: tables of prompts, messages, preference pairs, benchmarks and documents, with one schema each.

Paths are read by Spark alone, so any file system that it knows will do. Columns that a file may lack are filled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.filters import hash_order
from quern.operators.sampling import number_rows

MESSAGES = "array<struct<role:string,content:string>>"


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet and JSON files by their ending, one after the other; other endings are errors."""
    def one(path: str) -> DataFrame:
        if path.endswith(".parquet"):
            return spark.read.parquet(path)
        if path.endswith((".jsonl", ".ndjson")):
            return spark.read.json(path)
        if path.endswith(".json"):
            return spark.read.json(path, multiLine=True)
        raise ValueError(f"unknown kind of file: {path}")

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(one, paths))


def first_of(df: DataFrame, *names: str, kind: str = "string") -> Column:
    """The first of several columns that a table has and a row fills; null if there is none."""
    have = [F.col(n).cast(kind) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast(kind)


def prompts(spark: SparkSession, paths: list[str], most: int | None = None, seed: int | None = None, key: str | None = None) -> DataFrame:
    """All rows, or ``most`` of them: in hash order by ``seed`` and ``key``, else the first by key."""
    out = read_files(spark, paths)
    if most is None or most < 0:
        return out
    if key is None:
        raise ValueError("a bounded read needs a key")
    order = [F.col(key)] if seed is None else [hash_order(seed, F.col(key)), F.col(key)]
    return out.orderBy(*order).limit(most)


def single_turn(df: DataFrame, prompt: str, response: str) -> DataFrame:
    """(prompt, response) by names that may reach into structs by dots."""
    return df.select(F.col(prompt).cast("string").alias("prompt"), F.col(response).cast("string").alias("response"))


def multi_turn(df: DataFrame, messages: str = "messages", tools: str = "tools", thinking: str = "enable_thinking") -> DataFrame:
    """(messages, tools, enable_thinking); the last two may be missing."""
    return df.select(F.col(messages).cast(MESSAGES).alias("messages"), first_of(df, tools).alias("tools"), first_of(df, thinking, kind="boolean").alias("enable_thinking"))


def preference_pairs(df: DataFrame) -> DataFrame:
    """(prompt, chosen, rejected)."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in ("prompt", "chosen", "rejected")])


def pair_rows(pairs: DataFrame, key: str) -> DataFrame:
    """Each pair as two rows, the chosen one first: (key, rank, prompt, response)."""
    both = F.posexplode(F.array("chosen", "rejected")).alias("rank", "response")
    return pairs.select(key, "prompt", both)


QUESTION = "question_id string, question_text string, choices array<string>, ground_truth string, benchmark_type string, data_source string"


def questions(df: DataFrame) -> DataFrame:
    """Rows of a benchmark under any of its usual names, as QUESTION."""
    choices = next((F.col(c).cast("array<string>") for c in ("choices", "options", "Options") if c in df.columns), F.lit(None).cast("array<string>"))
    return df.select(
        first_of(df, "question_id", "id", "uuid").alias("question_id"),
        first_of(df, "question_text", "question", "Question", "problem").alias("question_text"),
        F.coalesce(choices, F.array().cast("array<string>")).alias("choices"),
        first_of(df, "ground_truth", "answer", "Answer").alias("ground_truth"),
        F.coalesce(first_of(df, "benchmark_type"), F.when(F.size(choices) > 0, "qa_mcq").otherwise("qa_open")).alias("benchmark_type"),
        first_of(df, "data_source").alias("data_source"),
    )


def documents(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, content, source); of rows that repeat an id, one stays: that with the greatest content."""
    slim = df.select(F.col(key).alias("doc_id"), first_of(df, "content", "text").alias("content"), first_of(df, "source", "field").alias("source"))
    return slim.groupBy("doc_id").agg(F.max(F.struct("content", "source")).alias("x")).select("doc_id", "x.*")


def dev_test_split(df: DataFrame, key: str, dev: int, test: int, seed: int) -> DataFrame:
    """Adds split: in hash order the first rows are dev, the next test; the rest goes."""
    placed = number_rows(df.withColumn("_h", hash_order(seed, F.col(key))), ["_h", key], "_place").drop("_h")
    return placed.where(F.col("_place") < dev + test).withColumn("split", F.when(F.col("_place") < dev, "dev").otherwise("test")).drop("_place")


def numbered_chunks(fields: dict[str, DataFrame], order: str) -> DataFrame:
    """Chunks of several fields in one table with a running doc_id over all, by field and order."""
    every = reduce(DataFrame.unionByName, [df.withColumn("field", F.lit(f)) for f, df in fields.items()])
    return number_rows(every, ["field", order], "doc_id")


def batch_results(results: DataFrame, work: DataFrame, key: str = "custom_id") -> DataFrame:
    """Work items with their response, null where none came back; of repeated answers the smallest by text."""
    answers = results.groupBy(key).agg(F.min("response").alias("response"))
    return work.join(answers, key, "left")


def capped(questions: DataFrame, most: int | None) -> DataFrame:
    """The first questions of a benchmark, as read from its files, in their order; all of them without a number over 0.

    A file may be read in several splits, which a limit alone would take as they come.
    """
    if not most or most <= 0:
        return questions
    place = [F.col(f"_metadata.{c}").alias(f"_{c}") for c in ("file_path", "file_block_start")]
    placed = questions.select("*", *place, F.monotonically_increasing_id().alias("_row"))
    return placed.orderBy("_file_path", "_file_block_start", "_row").limit(most).select(*questions.columns)


def texts(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, text) of text files, one a document, whose folders are named by key; the anchors of pages go.

    Pickled documents are not read: what they hold is a program.
    """
    whole = spark.read.text(path, wholetext=True)
    return whole.select(key, F.regexp_replace("value", r'<span id="page-\d+-\d+"></span>', "").alias("text"))
