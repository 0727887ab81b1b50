"""Operator 2, mixing sources to target weights: Poisson replication.

Each source has a rate, its target share of all characters divided by what it holds. A document's number of copies is a
Poisson count with that mean, inverted from a uniform number that the hash of seed and id gives; the copies are dealt out
to partitions by a second hash and sorted by it, which is a global shuffle.

Defined cases: a null source is a source of its own; a null text has no characters; a null id hashes as the empty
string; rows that repeat an id get the same count. A source without characters, or one without a target weight, has rate
0. An empty table gives an empty result. Added columns whose names are taken get a trailing underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._common import attach, packed, unpacked
from quern.session import materialise

SEED = 7
#: Without explicit weights, a source's weight is its number of characters to this power.
FLATTEN = 0.5
#: Sources up to this many are broadcast as (source, rate), under 8 MB; more of them are joined with hot keys set apart.
MAX_BROADCAST_SOURCES = 1 << 16
#: A rate over this is the sum of several Poisson counts of at most this mean, so that exp(-rate) stays precise.
PART = 32.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the parts."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def poisson_inverse(rate: Column, u: Column) -> Column:
    """The number of k with P(X <= k) < u, for X Poisson of a mean up to PART."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("n"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["cdf"] + p).alias("cdf"), (acc["n"] + (acc["cdf"] < u).cast("int")).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["n"])


def rates(docs: DataFrame, weights: dict[str, float] | None, source_col: str, text_col: str) -> DataFrame:
    """(_source, rate, n): one row per source."""
    sizes = docs.groupBy(_source_key(source_col).alias("_source")).agg(
        F.sum(F.length(F.coalesce(F.col(text_col), F.lit("")))).cast("double").alias("chars"), F.count(F.lit(1)).alias("n")
    )
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow("chars", F.lit(FLATTEN)))
    else:
        given = F.create_map(*[x for k, v in weights.items() for x in (F.lit(f"s{k}"), F.lit(float(v)))])
        weighed = sizes.withColumn("weight", F.coalesce(given[F.col("_source")], F.lit(0.0)))
    weighed = materialise(weighed, "mix-sizes")
    total = weighed.agg(
        F.sum("chars").alias("all_chars"), F.sum(F.when(F.col("chars") > 0, F.col("weight"))).alias("all_weight")
    )
    rate = F.col("weight") / F.col("all_weight") * F.col("all_chars") / F.col("chars")
    # one row of totals: its size is fixed
    return weighed.join(F.broadcast(total)).select(
        "_source", F.when((F.col("chars") > 0) & (F.col("weight") > 0), rate).otherwise(0.0).alias("rate"), "n"
    )


def _source_key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null"))


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Copies of ``docs`` at the target mixture, in shuffled order; adds copy (from 1), n_copies and shuffle_key."""
    table = materialise(rates(docs, weights, source_col, text_col), "mix-rates")
    keyed = packed(docs, _source=_source_key(source_col), id=F.col(f"`{id_col}`"))
    if table.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        rated = keyed.join(F.broadcast(table.select("_source", "rate")), "_source")
    else:
        rated = attach(keyed, table, "_source", "n", F.col("id"), docs.count())
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    drawn = F.aggregate(
        F.sequence(F.lit(1), parts),
        F.lit(0),
        lambda acc, j: acc + poisson_inverse(F.col("rate") / parts, uniform(F.lit(seed), F.col("id"), j)),
    )
    copies = rated.withColumn("n_copies", drawn).where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("copy")))
    dealt = copies.withColumn("shuffle_key", key).drop("_source", "id", "rate", "n")
    shuffled = dealt.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")
    return shuffled.select(*unpacked(docs, copy=F.col("copy"), n_copies=F.col("n_copies"), shuffle_key=F.col("shuffle_key")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = f"""
WITH sizes AS (
  SELECT coalesce('s' || source, 'null') AS src, sum(length(coalesce(text, '')))::DOUBLE AS chars FROM documents GROUP BY 1
), rates AS (
  SELECT src, CASE WHEN chars > 0 THEN chars ** {FLATTEN} / sum(chars ** {FLATTEN}) OVER () * sum(chars) OVER () / chars
              ELSE 0 END AS rate FROM sizes
), parts AS (
  SELECT src, greatest(1, ceil(rate / {PART}))::INT AS m, rate / greatest(1, ceil(rate / {PART})) AS mean FROM rates
), terms AS (
  SELECT src, k, sum(CASE WHEN mean > 0 THEN exp(k * ln(mean) - mean - lgamma(k + 1)) ELSE (k = 0)::INT END)
    OVER (PARTITION BY src ORDER BY k) AS cdf
  FROM parts, range(0, 140) t(k)
), draws AS (
  SELECT row_id, src, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || j), 1, 13))::BIGINT
    / {1 << 52}.0::DOUBLE AS u
  FROM (SELECT doc_id, rowid_ AS row_id, coalesce('s' || source, 'null') AS src
        FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents))
  JOIN parts USING (src), range(1, 1000) g(j) WHERE j <= m
), counts AS (
  SELECT row_id, sum((SELECT count(*) FROM terms t WHERE t.src = d.src AND t.cdf < d.u))::INT AS n_copies
  FROM draws d GROUP BY row_id
)
SELECT doc_id, text, lang, source, n_chars, c::INT AS copy, n_copies,
       md5('{SEED}/order:' || coalesce(doc_id::VARCHAR, '') || ':' || c) AS shuffle_key
FROM (SELECT *, row_number() OVER () AS row_id FROM documents) JOIN counts USING (row_id), range(1, 10000) g(c)
WHERE c <= n_copies
"""
