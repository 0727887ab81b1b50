"""Lookups: rows against a keyed table, with defaults, overrides and keys that give way step by step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_default(rows: DataFrame, table: DataFrame, key: str, column: str, default: float | str) -> DataFrame:
    """Adds the table's column by key (unique there); the default where there is none."""
    return rows.join(table.select(key, column), key, "left").withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def excluding(rows: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``held``; rows without a key stay."""
    return rows.join(held.select(key).distinct(), key, "left_anti")


def override(rows: DataFrame, table: DataFrame, key: str, column: str) -> DataFrame:
    """The column from the table where it has the key and a value, else the row's own."""
    other = table.select(key, F.col(column).alias("_other"))
    return rows.join(other, key, "left").withColumn(column, F.coalesce("_other", column)).drop("_other")


def fallback_join(problems: DataFrame, answers: DataFrame, value: str, order: str, keys: tuple[str, str, str] = ("chapter", "label", "num")) -> DataFrame:
    """Each problem with the value of the answer under (chapter, label, num), else (chapter, null, num), (null, label, num),
    (null, null, num). Of problems or answers with equal keys the first by ``order`` counts; value is null without a match.

    One null-safe join per step, each on the whole key, so that none multiplies rows.
    """
    chapter, label, num = keys

    def first(df: DataFrame, *kept: str) -> DataFrame:
        return df.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in kept])

    out = first(problems, *[c for c in problems.columns if c not in keys])
    found = first(answers.select(*keys, order, F.struct(value).alias("_hit")), "_hit")
    hits = []
    for i, (with_chapter, with_label) in enumerate(((True, True), (True, False), (False, True), (False, False))):
        side = found.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_hit").alias(f"_hit{i}"))
        null = F.lit(None)
        same = lambda k, own: F.col(f"_{k}").eqNullSafe(F.col(k) if own else null.cast(problems.schema[k].dataType))
        out = out.join(side, same(chapter, with_chapter) & same(label, with_label) & same(num, True), "left").drop(*[f"_{k}" for k in keys])
        hits.append(f"_hit{i}")
    return out.withColumn(value, F.coalesce(*hits)[value]).drop(*hits)


def reorder(df: DataFrame, place: Column, index: str = "row_idx") -> DataFrame:
    """Rows moved to the position that ``place`` gives; it must be a permutation."""
    return df.withColumn(index, place.cast("long"))


def pad_edge(df: DataFrame, size: int, total: int, candidate: str = "first", index: str = "row_idx") -> DataFrame:
    """``size`` copies of the first or the last row appended."""
    if candidate not in ("first", "last"):
        raise ValueError(f"unknown candidate {candidate}")
    edge = df.where(F.col(index) == (0 if candidate == "first" else total - 1))
    copies = edge.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))) if size else edge.limit(0).withColumn("_k", F.lit(0))
    return df.unionByName(copies.withColumn(index, F.lit(total).cast("long") + F.col("_k")).drop("_k"))
