"""Batch algebra: rows have an explicit position ``row_idx``; every function is lazy and needs no total order but that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gather(df: DataFrame, idxs: list[int], index: str = "row_idx") -> DataFrame:
    """Rows by a list of positions given by the caller, in its order, repeats allowed; the new position replaces the old."""
    spark = df.sparkSession
    wanted = spark.range(1).select(F.posexplode(F.array(*[F.lit(i).cast("long") for i in idxs])).alias("_to", "_from"))
    rest = [c for c in df.columns if c != index]
    # the list is an argument of the call and as long as that
    return df.join(F.broadcast(wanted), F.col(index) == F.col("_from")).select(F.col("_to").cast("long").alias(index), *rest)


def slice_rows(df: DataFrame, start: int, end: int, step: int = 1, index: str = "row_idx") -> DataFrame:
    i = F.col(index)
    return df.where((i >= start) & (i < end) & ((i - start) % step == 0))


def repeat(df: DataFrame, times: int, interleave: bool = True, index: str = "row_idx", size: int | None = None) -> DataFrame:
    """Each row ``times`` times: next to each other, or the whole table again and again (``size`` rows each)."""
    rest = [c for c in df.columns if c != index]
    many = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    if interleave:
        place = F.col(index) * times + F.col("_k")
    else:
        place = F.col("_k") * F.lit(df.count() if size is None else size) + F.col(index)
    return many.select(place.cast("long").alias(index), *rest)


def repeat_each(df: DataFrame, times: Column, index: str = "row_idx") -> DataFrame:
    """Rows repeated by a count of their own; 0 drops a row. Adds repeat_idx."""
    return df.withColumn("_n", times).where("_n > 0").withColumn("repeat_idx", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")


def unfold_chunks(df: DataFrame, column: str, n_split: int, index: str = "row_idx") -> DataFrame:
    """An array column cut into n_split equal parts, a row each."""
    part = (F.size(column) / n_split).cast("int")
    many = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n_split - 1))))
    rest = [c for c in df.columns if c not in (index, column)]
    return many.select(
        (F.col(index) * n_split + F.col("_k")).cast("long").alias(index), F.slice(column, F.col("_k") * part + 1, part).alias(column), *rest
    )


def chunk(df: DataFrame, chunks: int, total: int, index: str = "row_idx") -> DataFrame:
    """Adds chunk: equal runs of rows; the total must divide."""
    if total % chunks:
        raise ValueError(f"{total} rows don't make {chunks} equal chunks")
    return df.withColumn("chunk", F.floor(F.col(index) / (total // chunks)).cast("long"))


def split(df: DataFrame, size: int, index: str = "row_idx") -> DataFrame:
    """Adds chunk: runs of ``size`` rows, the last may be shorter."""
    return df.withColumn("chunk", F.floor(F.col(index) / size).cast("long"))


def pad_to_divisor(df: DataFrame, divisor: int, total: int, index: str = "row_idx") -> DataFrame:
    """Recycles rows from the head until the total divides; adds is_pad."""
    pad = -total % divisor
    again = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(max(0, pad - 1)))).alias("_k")).where(
        F.lit(pad > 0) & (F.col(index) == F.col("_k") % max(1, total))
    )
    rest = [c for c in df.columns if c != index]
    padded = again.select((F.lit(total) + F.col("_k")).cast("long").alias(index), *rest, F.lit(True).alias("is_pad"))
    return df.select(index, *rest, F.lit(False).alias("is_pad")).unionByName(padded)


def unpad(df: DataFrame) -> DataFrame:
    return df.where("not is_pad").drop("is_pad")


def fold(df: DataFrame, column: str, size: int, index: str = "row_idx") -> DataFrame:
    """Runs of ``size`` rows to one row with an array, in order."""
    pairs = F.sort_array(F.collect_list(F.struct(index, column)))
    return df.groupBy(F.floor(F.col(index) / size).cast("long").alias("batch_idx")).agg(F.transform(pairs, lambda x: x[column]).alias(column))


def union_columns(left: DataFrame, right: DataFrame, index: str = "row_idx") -> DataFrame:
    """Columns side by side by position; a column that both have must be equal, or the query fails."""
    both = [c for c in right.columns if c in left.columns and c != index]
    renamed = right.select(index, *[F.col(c).alias(f"_r_{c}" if c in both else c) for c in right.columns if c != index])
    joined = left.join(renamed, index)
    same = F.lit(True)
    for c in both:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    checked = [F.when(same, F.col(c)).otherwise(F.raise_error(F.lit("columns differ"))).alias(c) for c in both]
    return joined.select(*[c for c in left.columns if c not in both], *checked, *[c for c in right.columns if c not in left.columns])


def pad_sequence(ids: Column, length: int, pad: int, left: bool = False, truncation: str = "right") -> Column:
    """An array padded or cut to ``length``: cut from the right, the left or the middle, or an error."""
    n = F.size(ids)
    if truncation == "right":
        cut = F.slice(ids, 1, length)
    elif truncation == "left":
        cut = F.slice(ids, F.greatest(n - length, F.lit(0)) + 1, F.lit(length))
    elif truncation == "middle":
        head, tail = length // 2, length - length // 2
        cut = F.when(n <= length, ids).otherwise(F.concat(F.slice(ids, 1, head), F.slice(ids, n - tail + 1, F.lit(tail))))
    elif truncation == "error":
        cut = F.when(n <= length, ids).otherwise(F.raise_error(F.lit("sequence is too long")))
    else:
        raise ValueError(f"unknown truncation {truncation}")
    filler = F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - n, F.lit(0)))
    return F.concat(filler, cut) if left else F.concat(cut, filler)


def unpad_by_mask(ids: Column, mask: Column) -> Column:
    return F.filter(ids, lambda x, i: F.get(mask, i) == 1)


def at_last_token(score: Column, mask: Column) -> Column:
    """A scalar placed at the last valid token, 0 elsewhere."""
    last = F.array_max(F.transform(mask, lambda m, i: F.when(m == 1, i).otherwise(-1)))
    return F.transform(mask, lambda m, i: F.when(i == last, score).otherwise(0.0))


def masked_mean(values: Column, mask: Column) -> Column:
    total = F.aggregate(F.zip_with(values, mask, lambda v, m: v * m), F.lit(0.0), lambda a, x: a + x)
    return total / F.aggregate(mask, F.lit(0.0), lambda a, x: a + x)


def first_eos_mask(ids: Column, eos: list[int]) -> Column:
    """1 up to and with the first end token, then 0."""
    ends = F.filter(F.transform(ids, lambda x, i: F.when(x.isin(eos), i)), lambda i: i.isNotNull())
    first = F.array_min(ends)
    return F.transform(ids, lambda x, i: F.when(first.isNull() | (i <= first), 1).otherwise(0))


def masked(df: DataFrame, keep: Column, index: str = "row_idx") -> DataFrame:
    """The rows that a mask keeps, in their order, numbered anew."""
    from quern.operators.sampling import number_rows

    kept = number_rows(df.where(keep).withColumnRenamed(index, "_old"), ["_old"], index)
    return kept.select(*df.columns)


def unfold(df: DataFrame, column: str, size: int, batch: str = "batch_idx", index: str = "row_idx") -> DataFrame:
    """A row for each value of arrays that ``fold`` made of ``size`` rows each."""
    rest = [c for c in df.columns if c not in (batch, column)]
    many = df.select(batch, *rest, F.posexplode(column).alias("_k", column))
    return many.select((F.col(batch) * size + F.col("_k")).cast("long").alias(index), *rest, column)


def left_right(prompt: Column, response: Column, prompt_length: int, response_length: int, pad: int) -> Column:
    """(ids, mask): the end of a prompt padded on the left, and the beginning of a response padded on the right."""
    ones = lambda x: F.transform(x, lambda _: F.lit(1))
    both = lambda a, b, filler: F.concat(pad_sequence(a, prompt_length, filler, left=True, truncation="left"), pad_sequence(b, response_length, filler))
    return F.struct(both(prompt, response, pad).alias("ids"), both(ones(prompt), ones(response), 0).alias("mask"))


def response_mask(mask: Column, responses: Column) -> Column:
    """The part of an attention mask that belongs to the response, which stands last."""
    n = F.size(responses)
    return F.slice(mask, F.greatest(F.size(mask) - n, F.lit(0)) + 1, n)


def collate(df: DataFrame, batch: str, index: str, ragged: list[str], plain: list[str] | None = None) -> DataFrame:
    """A row a batch: sequences of any length one after another, ``offsets`` (from 0) where each begins and the last ends, and
    further columns as lists. A batch must fit a row; the sequences of a row are equally long."""
    plain = plain or []
    rows = F.sort_array(F.collect_list(F.struct(index, *ragged, *plain)))
    listed = df.groupBy(batch).agg(rows.alias("_rows"))
    sizes = F.transform("_rows", lambda r: F.size(r[ragged[0]]))
    upto = F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
    field = lambda name: F.transform("_rows", lambda r: r[name])
    return listed.select(batch, *[F.flatten(field(c)).alias(c) for c in ragged], upto.alias("offsets"), *[field(c).alias(c) for c in plain])
