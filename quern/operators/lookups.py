"""Small joins, groups and labels that loops ask for again and again: rows against documents, pools, rollouts and turns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_document(rows: DataFrame, docs: DataFrame, key: str, doc_key: str, columns: list[str]) -> DataFrame:
    """Rows with columns of the document they name; rows without one go. Documents are unique by key."""
    side = docs.select(F.col(doc_key).alias("_doc"), *columns)
    return rows.join(side, F.col(key) == F.col("_doc")).drop("_doc")


def counted(docs: DataFrame, rows: DataFrame, doc_key: str, key: str, name: str = "n") -> DataFrame:
    """Documents with the number of rows that name them, counted before the join; 0 for none."""
    per = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    return docs.join(per, F.col(doc_key) == F.col("_key"), "left").withColumn(name, F.coalesce("_n", F.lit(0).cast("long"))).drop("_key", "_n")


def first_value(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """The value of each group's first row."""
    return rows.groupBy(group).agg(F.min_by(value, order).alias(value))


def outside(rows: DataFrame, pool: DataFrame, key: str, pool_key: str | None = None) -> DataFrame:
    """Rows whose key the pool doesn't have; rows without a key stay."""
    return rows.join(pool.select(F.col(pool_key or key).alias("_key")), F.col(key) == F.col("_key"), "left_anti")


def inside(rows: DataFrame, pool: DataFrame, key: str, pool_key: str | None = None) -> DataFrame:
    """Rows whose key the pool has, once each however often it does."""
    return rows.join(pool.select(F.col(pool_key or key).alias("_key")), F.col(key) == F.col("_key"), "left_semi")


def by_loop(loops: list[DataFrame], name: str = "loop") -> DataFrame:
    """The rows of several loops in one table, with the loop's number."""
    return reduce(DataFrame.unionByName, [df.withColumn(name, F.lit(i)) for i, df in enumerate(loops)])


def membership(rows: DataFrame, key: str, one: DataFrame, other: DataFrame, names: tuple[str, str], pool_key: str = "id") -> DataFrame:
    """Rows with label: in one pool alone, in the other alone, in both or in neither."""
    flag = lambda df, n: df.select(F.col(pool_key).alias(f"_{n}")).distinct()
    a, b = flag(one, "a"), flag(other, "b")
    both = rows.join(a, F.col(key) == F.col("_a"), "left").join(b, F.col(key) == F.col("_b"), "left")
    in_a, in_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    label = F.when(in_a & in_b, "both").when(in_a, f"{names[0]}_only").when(in_b, f"{names[1]}_only").otherwise("neither")
    return both.withColumn("label", label).drop("_a", "_b")


def in_order(rows: DataFrame, group: str, order: list[str], columns: list[str]) -> DataFrame:
    """A row a group with its columns as lists of equal order; a group must fit a row."""
    own = F.sort_array(F.collect_list(F.struct(*order, *[c for c in columns if c not in order])))
    listed = rows.groupBy(group).agg(own.alias("_rows"))
    return listed.select(group, *[F.col(f"_rows.{c}").alias(c) for c in columns])


def score_strip(scores: Column) -> Column:
    """Scores as a strip of signs: 1, 0, and a dash for none."""
    return F.array_join(F.transform(scores, lambda x: F.coalesce(x.cast("int").cast("string"), F.lit("-"))), "")


def share_by(rows: DataFrame, group: str, hit: Column) -> DataFrame:
    """The share of each group's rows that a test hits; a null is no hit."""
    return rows.groupBy(group).agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("score"))


def loop_accuracy(rows: DataFrame, group: str, loop: str, score: str) -> DataFrame:
    """Per question and loop: scored answers and their mean."""
    return rows.groupBy(group, F.col(loop).alias("loop")).agg(F.count(score).alias("n"), F.avg(score).alias("accuracy"))


def route(source: Column, rules: dict[str, str], default: str) -> Column:
    """The route of the first pattern that a source has."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(rules.items()):
        out = F.when(source.rlike(pattern), name).otherwise(out)
    return F.coalesce(out, F.lit(default))


def keep_shares(rows: DataFrame, field: str, share: float) -> DataFrame:
    """How many rows of each field a share is, rounded up."""
    return rows.groupBy(field).agg(F.ceil(share * F.count(F.lit(1))).alias("keep"))


def messages(rows: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(conversation, messages, n): role and content by turn, no text being an empty one."""
    own = rows.select(conversation, turn, F.col(role).alias("role"), F.coalesce(text, F.lit("")).alias("content"))
    listed = own.groupBy(conversation).agg(F.sort_array(F.collect_list(F.struct(turn, "role", "content"))).alias("_rows"))
    picked = F.transform("_rows", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return listed.select(conversation, picked.alias("messages"), F.size("_rows").cast("long").alias("n"))


def shown(chat: Column, between: str = "|") -> Column:
    """Messages as text, role before content."""
    return F.array_join(F.transform(chat, lambda m: F.concat_ws(":", m["role"], m["content"])), between)


def loss_mask(chat: Column, trained: str = "assistant") -> Column:
    """A mark for each character of the messages: 1 where the role is trained on."""
    return F.flatten(F.transform(chat, lambda m: F.array_repeat(F.coalesce(m["role"] == trained, F.lit(False)).cast("int"), F.length(m["content"]))))


def fit_report(rows: DataFrame, size: Column, most: int) -> DataFrame:
    """One row: prompts in all, those of at most so many units, and those that are longer; without a size a prompt is too long."""
    fits = F.coalesce(size <= most, F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("questions"), F.count_if(fits).alias("kept"), F.count_if(~fits).alias("too_long"))


def parsed_questions(rows: DataFrame, ok: str, columns: list[str]) -> DataFrame:
    """The columns of the rows that were parsed."""
    return rows.where(F.coalesce(F.col(ok), F.lit(False))).select(*columns)


def filled(fields: dict[str, Column]) -> Column:
    """The fields that have a value other than an empty text, as a map; null for none."""
    pairs = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*fields.values()))
    held = F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != ""))
    return F.when(F.size(held) > 0, held)
