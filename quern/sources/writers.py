"""Writers: samples as JSON lines, chunks, results at three levels of detail, and what makes a result complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = {"metrics_only": "", "scores": "_scores", "full": "_full"}


def write_json(df: DataFrame, path: str, gzip: bool = False) -> None:
    """JSON lines, nulls kept, so that a row has the same fields in all files."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").option("compression", "gzip" if gzip else "none").json(path)


def write_generations(df: DataFrame, key: str, responses: str, path: str) -> DataFrame:
    """One row per prompt with the list of its responses, in order of their text's place; as Parquet."""
    grouped = df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", responses))), lambda x: x[responses]).alias("responses"))
    grouped.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def output_name(benchmark: Column, run: Column, checkpoint: Column, temperature: float, length: int, detail: str = "metrics_only", tag: str | None = None) -> Column:
    """The file name of a result: benchmark, run (with a model's tag before it), checkpoint, temperature, length, detail."""
    base = F.regexp_replace(F.substring_index(benchmark, "/", -1), r"\.json$", "")
    run = F.concat(F.lit(f"{tag}-"), run) if tag else run
    tail = F.lit(f"_temp{temperature}_len{length}{LEVELS[detail]}.json")
    return F.concat(base, F.lit("_"), run, F.lit("_ans"), checkpoint.cast("string"), tail)


def detailed(questions: DataFrame, detail: str, answers: str = "sampled_answers") -> DataFrame:
    """The questions that a result of some detail holds: none, all without the answers' text, or all."""
    if detail not in LEVELS:
        raise ValueError(f"unknown detail {detail!r}; there are {sorted(LEVELS)}")
    return questions.limit(0) if detail == "metrics_only" else questions.drop(answers) if detail == "scores" else questions


def payload(questions: DataFrame) -> DataFrame:
    """A row per question with its JSON; a result's file is these lines and the metrics table's."""
    return questions.select(F.to_json(F.struct(*questions.columns), {"ignoreNullFields": "false"}).alias("json"))


def complete(metrics: DataFrame, key: str) -> DataFrame:
    """The results that are complete: some questions and some answers."""
    wide = metrics.groupBy(key).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in ("total_questions", "total_answers")])
    return wide.where((F.col("total_questions") > 0) & (F.col("total_answers") > 0)).select(key)


def dev_rows(wanted: DataFrame, results: DataFrame, source: str, difficulty: Column) -> DataFrame:
    """The wanted questions in the schema of a development set, with the difficulty's name."""
    rows = results.join(wanted.select("question_id").distinct(), "question_id", "left_semi")
    return rows.select("question_id", "question_text", F.coalesce("choices", F.array().cast("array<string>")).alias("choices"), difficulty.alias("difficulty"), "ground_truth", F.lit(source).alias("data_source"))


def write_influence(rows: DataFrame, key: str, order: str, path: str) -> None:
    """A row per question as JSON lines, the first by some order."""
    names = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*names), order).alias("row")).select(key, *[F.col(f"row.{c}").alias(c) for c in names])
    write_json(first, path)


def save_batch(batch: DataFrame, path: str) -> DataFrame:
    """A batch as Parquet, with its schema, read back; any later session can load it."""
    batch.write.mode("overwrite").parquet(path)
    return batch.sparkSession.read.schema(batch.schema).parquet(path)
