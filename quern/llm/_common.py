"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import materialise

#: White space of the contracts, as a Java pattern and as the same characters.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Cells of a Bloom filter. Its table has at most BLOOM_BITS / 64 rows of two longs, 16 MB, whatever the corpus is;
#: a fuller filter lets more rows through to the shuffle and never changes a result.
BLOOM_BITS = 1 << 26

#: A group is heavy if it holds more than one in HEAVY_PARTS of all rows, so there are fewer than HEAVY_PARTS of them.
HEAVY_PARTS = 1024


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and white space alone give an empty array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have yet."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"{name}_"
    return name


def _probes(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(BLOOM_BITS)) for seed in (11, 12)]


def _as_words(cells: DataFrame) -> DataFrame:
    """Cells to a table of 64-bit words: (word, bits)."""
    one = F.expr("shiftleft(1L, cast(cell % 64 as int))")
    return cells.groupBy(F.expr("cell div 64").alias("word")).agg(F.bit_or(one).alias("bits"))


def repeated_bloom(keys: DataFrame, key: str) -> DataFrame:
    """First pass: the filter of cells that two or more rows fall into. Counts combine before the shuffle."""
    cells = keys.select(F.explode(F.array(*_probes(F.col(key)))).alias("cell"))
    return materialise(_as_words(cells.groupBy("cell").count().where("count > 1")), "bloom")


def member_bloom(keys: DataFrame, key: str) -> DataFrame:
    """The filter of the cells of all given keys."""
    cells = keys.select(F.explode(F.array(*_probes(F.col(key)))).alias("cell"))
    return materialise(_as_words(cells), "bloom")


def bloom_flag(rows: DataFrame, key: str, bloom: DataFrame, flag: str) -> DataFrame:
    """Second pass: add a boolean that is false only if the filter surely does not hold the key; no shuffle."""
    hits, out = [], rows
    for i, cell in enumerate(_probes(F.col(key))):
        word, bits = f"_bloom_word{i}", f"_bloom_bits{i}"
        out = out.withColumn(f"_bloom_cell{i}", cell)
        side = F.broadcast(bloom.select(F.col("word").alias(word), F.col("bits").alias(bits)))
        out = out.join(side, F.expr(f"_bloom_cell{i} div 64 = {word}"), "left")
        hits.append(F.expr(f"coalesce({bits} & shiftleft(1L, cast(_bloom_cell{i} % 64 as int)), 0L) != 0"))
    return out.select(*rows.columns, (hits[0] & hits[1]).alias(flag))


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: Column, total: int) -> DataFrame:
    """Left join of rows with one row per key, safe where one key holds a third of all rows.

    Heavy keys (fewer than HEAVY_PARTS by construction) are broadcast. Rows of heavy keys then get a key of their own
    for the join of the rest, so that no task gets them all. ``spread`` is any column that varies within a key.
    """
    others = [c for c in groups.columns if c != key]
    least = max(64, -(-total // HEAVY_PARTS))
    heavy = groups.where(F.col(size) >= least).select(
        F.col(key).alias("_heavy_key"), *[F.col(c).alias(f"_heavy_{c}") for c in others]
    )
    light = groups.where(F.col(size) < least).select(
        F.col(key).cast("string").alias("_light_key"), *[F.col(c).alias(f"_light_{c}") for c in others]
    )
    out = rows.join(F.broadcast(heavy), F.col(key) == F.col("_heavy_key"), "left")
    alone = F.col("_heavy_key").isNotNull() | F.col(key).isNull()
    own = F.when(alone, F.concat(F.lit("~"), F.xxhash64(spread).cast("string"))).otherwise(F.col(key).cast("string"))
    out = out.withColumn("_own_key", own).join(light, F.col("_own_key") == F.col("_light_key"), "left")
    return out.select(
        *rows.columns,
        *[F.coalesce(F.col(f"_heavy_{c}"), F.col(f"_light_{c}")).alias(c) for c in others],
    )


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """The rows of a caller with their columns numbered c0, c1, ... and key columns beside them: none can clash."""
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    return docs.select(*own, *[c.alias(name) for name, c in keys.items()])


def carried(docs: DataFrame) -> list[str]:
    """The numbered names of a caller's columns."""
    return [f"c{i}" for i in range(len(docs.columns))]


def unpacked(docs: DataFrame, **added: Column) -> list[Column]:
    """A caller's columns under their own names, and new ones, whose names get underscores where they are taken."""
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return own + [value.alias(fresh(docs, name)) for name, value in added.items()]


def without(docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``dropped`` (a column of the same name, no nulls); null keys stay.

    Rows that a Bloom filter rules out pass straight through; only the others meet the dropped keys in a shuffle.
    """
    keys = dropped.select(F.col(key).alias("key")).distinct()
    flagged = bloom_flag(packed(docs, key=F.col(f"`{key}`")), "key", member_bloom(keys, "key"), "maybe")
    sure = flagged.where("not maybe").select(*carried(docs))
    maybe = flagged.where("maybe").join(keys, "key", "left_anti").select(*carried(docs))
    return sure.unionByName(maybe).select(*unpacked(docs))
