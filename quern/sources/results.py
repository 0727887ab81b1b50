"""Results of outside benchmark runners as rows of questions, files found near or far, and tables that grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELDS = "map<string,string>"


def entries(raw: Column) -> Column:
    """The details of a result's JSON, a list or an object, as an array of objects by field, values as JSON text."""
    details = F.get_json_object(raw, "$.details")
    listed = F.from_json(details, f"array<{_FIELDS}>")
    named = F.map_values(F.from_json(details, f"map<string,{_FIELDS}>"))
    both = F.when(F.ltrim(details).startswith("["), listed).otherwise(named)
    return F.filter(F.coalesce(both, F.array().cast(f"array<{_FIELDS}>")), lambda d: d.isNotNull())


def listed(value: Column) -> Column:
    """A field that is a list or a single value, as a list of texts; empty if it is missing."""
    is_list = F.ltrim(value).startswith("[")
    empty = F.array().cast("array<string>")
    return F.when(value.isNull(), empty).when(is_list, F.from_json(value, "array<string>")).otherwise(F.array(value))


def scores(value: Column) -> Column:
    """1 or 0 for each sample; anything but false, 0, null and an empty text is true."""
    return F.transform(listed(value), lambda v: F.when(v.isNull() | F.lower(v).isin("false", "0", "0.0", "", "null", "none"), 0.0).otherwise(1.0))


def program_results(results: DataFrame, raw: str = "raw") -> DataFrame:
    """(question_id, answer_scores, sampled_answers, base_results, plus_results) of results of completed functions.

    A single verdict for several samples stays single: grading each anew means running programs.
    """
    d = results.select(F.explode(entries(F.col(raw))).alias("d"))
    name = F.coalesce(F.nullif(F.get(listed(F.col("d")["reference"]), F.lit(0)), F.lit("")), F.col("d")["example_abbr"])
    return d.select(
        name.alias("question_id"), scores(F.col("d")["is_correct"]).alias("answer_scores"), listed(F.col("d")["prediction"]).alias("sampled_answers"),
        listed(F.col("d")["base_result"]).alias("base_results"), listed(F.col("d")["plus_result"]).alias("plus_results"),
    )


def contest_results(results: DataFrame, raw: str = "raw") -> DataFrame:
    """(question_id, answer_scores, sampled_answers, eval_results) of results of contest programs.

    The id is the entry's, else that of its first metadata, else its short name, else its place.
    """
    d = results.select(F.posexplode(entries(F.col(raw))).alias("place", "d"))
    meta = F.get_json_object(F.get(listed(F.col("d")["final_metadata"]), F.lit(0)), "$.question_id")
    filled = lambda c: F.nullif(c, F.lit(""))
    name = F.coalesce(filled(F.col("d")["question_id"]), filled(meta), filled(F.col("d")["example_abbr"]), F.concat(F.lit("lcb_"), F.col("place").cast("string")))
    return d.select(
        name.alias("question_id"), scores(F.col("d")["correct"]).alias("answer_scores"), listed(F.col("d")["prediction"]).alias("sampled_answers"),
        listed(F.col("d")["eval_result"]).alias("eval_results"),
    )


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def resolve(spark: SparkSession, relative: str, *roots: str) -> str:
    """The first root under which a path is there: near ones first, then far ones."""
    for root in roots:
        if exists(spark, path := f"{root.rstrip('/')}/{relative}"):
            return path
    raise FileNotFoundError(f"{relative} is under none of {roots}")


def copy(spark: SparkSession, source: str, folder: str, again: bool = False) -> str:
    """A copy of a file in another file system, made once: a part is renamed when whole, so no reader sees half of it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = f"{folder.rstrip('/')}/{source.rstrip('/').rsplit('/', 1)[-1]}"
    if exists(spark, there) and not again:
        return there
    a, part, b = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, f"{there}.part", there))
    files = b.getFileSystem(conf)
    if not jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, files, part, False, True, conf):
        raise OSError(f"{source} was not copied")
    files.delete(b, True)
    if not files.rename(part, b):
        raise OSError(f"{there} was not put in place")
    return there


def appended(base: DataFrame, new: DataFrame, keep: Column) -> DataFrame:
    """A table with new rows, filtered as the others were."""
    return base.unionByName(new.where(keep), allowMissingColumns=True)
