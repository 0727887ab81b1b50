"""Operator 1, exact dedup: two-pass Bloom filtering finds possibly repeated hashes; only those rows shuffle.

Texts are equal if they are the same after replacing each run of white space by one space. Of equal texts the row with
the smallest id stays.

Defined cases: a null text counts as empty, and all empty texts are one group. Rows with a null id come last in their
group, so they stay only if the whole group has no id. Rows that repeat an id and a text are repeats like any other: one
of them stays. An empty table gives an empty result. Added columns whose names are taken get a trailing underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._common import SPACE, attach, bloom_flag, packed, repeated_bloom, unpacked
from quern.session import materialise


def text_hash(text: Column) -> Column:
    """Hex SHA-256 of the normalised text."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with keep_id, group_size, kept and text_sha256 added."""
    rows = _resolve(packed(docs, id=F.col(f"`{id_col}`"), sha=text_hash(F.col(f"`{text_col}`"))))
    return rows.select(*unpacked(docs, keep_id=F.col("keep_id"), group_size=F.col("size"), kept=F.col("kept"), text_sha256=F.col("sha")))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs`` alone."""
    rows = _resolve(packed(docs, id=F.col(f"`{id_col}`"), sha=text_hash(F.col(f"`{text_col}`"))))
    return rows.where("kept").select(*unpacked(docs))


def _resolve(rows: DataFrame) -> DataFrame:
    """Add keep_id, size and kept to rows with id and sha.

    The hashes are written once for the filter. Rows that it flags are written with a number each, which breaks ties
    between rows of the same id and text: groups and rows read the same table, so a lost executor can't renumber them.
    """
    keys = rows if rows.columns == ["id", "sha"] else materialise(rows.select("sha"), "exact-keys")
    bloom = repeated_bloom(keys, "sha")
    flagged = bloom_flag(rows, "sha", bloom, "maybe")
    sure = flagged.where("not maybe").drop("maybe").withColumns(
        {"keep_id": F.col("id"), "size": F.lit(1).cast("long"), "kept": F.lit(True)}
    )
    maybe = materialise(flagged.where("maybe").drop("maybe").withColumn("number", F.monotonically_increasing_id()), "exact-maybe")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("number").alias("number"))
    groups = materialise(
        maybe.groupBy("sha").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1"), "exact-groups"
    )
    first = F.col("first")
    met = attach(maybe, groups, "sha", "size", F.col("number"), maybe.count()).select(
        *rows.columns,
        F.when(first.isNull(), F.col("id")).otherwise(first["id"]).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("size"),
        (first.isNull() | (first["number"] == F.col("number"))).alias("kept"),
    )
    return sure.unionByName(met)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    keys = materialise(docs.select(F.col("doc_id").alias("id"), text_hash(F.col("text")).alias("sha")), "exact-keys")
    return _resolve(keys).select(
        F.col("id").alias("doc_id"), "keep_id", F.col("size").alias("group_size"), "kept", F.col("sha").alias("text_sha256")
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
