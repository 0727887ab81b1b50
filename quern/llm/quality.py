"""Operator 4, quality rules: learned decision lists.

Native column expressions give each document its statistics. From a bounded sample of labelled documents, sequential
covering grows conjunctions of thresholds (each step takes the literal with the best information gain), prunes them on
rows held out for that, and removes what they cover; the accepted rules become one ordered Spark conditional expression.

Defined cases: a null or blank text has no words, so base_failed holds and it isn't kept; null ids are scored like any
others; labels that are null or have no document are ignored, and a document with several labels counts as bad if one
of them says so; without labels of both kinds there are no rules and base_failed alone decides. Equal gains go to the
first statistic and threshold; repeated rows are rated alike, and very long texts are counted whole. The learner stops at MAX_RULES
rules of MAX_LITERALS conditions each, which bounds the model and not the data. An empty table gives an empty result. Added columns whose names are taken get a trailing underscore.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._common import SPACE_CHARS, fresh, packed, unpacked, words_of
from quern.session import materialise

#: Labelled documents that rules are learned from, at most: those with the smallest hash of their id.
MAX_LABELLED = 10_000
#: Thresholds per statistic, at most, evenly spaced among the distinct values of the sample.
THRESHOLDS = 64
#: A rule must be right on this share of held-out rows that it covers, and cover so many rows in all.
LEAST_PRECISION, LEAST_COVER = 0.9, 8
MAX_RULES, MAX_LITERALS = 16, 4
#: Starts that led to an imprecise rule before learning ends.
MAX_FAILURES = 64

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: lambdas would compute it again for each element."""
    return F.transform(F.array(value), body)[0]


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""

    def of_sorted(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        repeated = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        places = F.array_sort(F.transform(repeated, lambda i: F.get(s, i)["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

        def step(acc: Column, p: Column) -> Column:
            return F.struct((p + 5).alias("end"), (acc["n"] + (p + 5 - F.greatest(p, acc["end"]))).alias("n"))

        return F.aggregate(places, start, step, lambda acc: acc["n"])

    return _let(F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the five counts, as columns named _n_words and so on, and without the text's columns changed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashes = F.transform(words_of(F.col(text_col)), lambda w: F.xxhash64(w))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    staged = docs.withColumns(
        {
            "_hashes": hashes,
            "_lines": lines,
            "_word_chars": (F.length(text) - F.size(F.split(text, r"[\x20\x09-\x0D]")) + 1).cast("long"),
            "_n_symbols": (F.size(F.split(text, r"[#*$%&|<>]")) - 1).cast("long"),
        }
    )
    five = lambda w, i: F.xxhash64(*[F.get(w, i + k) for k in range(5)])
    windows = F.when(
        F.size("_hashes") >= 5,
        _let(F.col("_hashes"), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: five(w, i))),
    ).otherwise(F.array().cast("array<bigint>"))
    staged = staged.withColumns(
        {
            "_n_words": F.size("_hashes").cast("long"),
            "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_windows": windows,
        }
    )
    return staged.withColumn(
        "_n_repeat_words",
        F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0).cast("long")).otherwise(
            _covered(F.col("_windows"))
        ),
    ).select(*docs.columns, *[f"_{c}" for c in COUNTS])


def ratios() -> dict[str, Column]:
    """The statistics that rules test, from the counts."""
    n = F.greatest(F.col("_n_words"), F.lit(1)).cast("double")
    return {
        "words": F.col("_n_words").cast("double"),
        "mean_word_chars": F.col("_word_chars") / n,
        "symbols_per_word": F.col("_n_symbols") / n,
        "dup_lines_per_word": F.col("_n_dup_lines") / n,
        "repeat_share": F.col("_n_repeat_words") / n,
    }


def base_failed() -> Column:
    return (F.col("_n_words") < 10) | (100 * F.col("_n_repeat_words") > 20 * F.col("_n_words"))


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}"

    def column(self, values: dict[str, Column]) -> Column:
        return values[self.feature] > self.threshold if self.above else values[self.feature] <= self.threshold


Rule = tuple[Literal, ...]


def learn(rows: list[tuple[int, tuple[float, ...]]], features: tuple[str, ...]) -> list[Rule]:
    """Rules for bad rows, in order, from (label, values) with label 1 for good. Sets of rows are bits of an integer."""
    everything = (1 << len(rows)) - 1
    bad = sum(1 << i for i, (label, _) in enumerate(rows) if label == 0)
    #: every third row, by a hash of its values, is held out for pruning
    held = sum(1 << i for i, (_, v) in enumerate(rows) if zlib.crc32(repr((i, v)).encode()) % 3 == 0)
    literals: dict[Literal, int] = {}
    for f, name in enumerate(features):
        values = sorted({v[f] for _, v in rows})
        cuts = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
        for cut in cuts[:: max(1, -(-len(cuts) // THRESHOLDS))]:
            above = sum(1 << i for i, (_, v) in enumerate(rows) if v[f] > cut)
            literals[Literal(name, True, cut)] = above
            literals[Literal(name, False, cut)] = everything & ~above
    rules: list[Rule] = []
    left, failed = everything, set()
    while len(rules) < MAX_RULES and len(failed) < MAX_FAILURES and (left & bad).bit_count() >= LEAST_COVER:
        grown = _grow(literals, left & ~held, bad, failed)
        if grown is None:
            break
        rule = _prune(grown, literals, left & held, bad)
        covered = left
        for x in rule:
            covered &= literals[x]
        seen = covered & held if (covered & held).bit_count() >= 3 else covered
        if covered.bit_count() < LEAST_COVER or (seen & bad).bit_count() < LEAST_PRECISION * seen.bit_count():
            failed.add(rule[0])  # another start may still find a precise rule
            continue
        rules.append(rule)
        left &= ~covered
    return rules


def _grow(literals: dict[Literal, int], rows: int, bad: int, failed: set[Literal]) -> list[Literal] | None:
    rule: list[Literal] = []
    while len(rule) < MAX_LITERALS and (rows & ~bad):
        p0, n0 = (rows & bad).bit_count(), (rows & ~bad).bit_count()
        if not p0:
            return None
        best, gain = None, 1e-9
        for x, covered in literals.items():
            if not rule and x in failed:
                continue
            p = (rows & covered & bad).bit_count()
            if p < LEAST_COVER // 2:
                continue
            n = (rows & covered & ~bad).bit_count()
            g = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
            if g > gain:
                best, gain = x, g
        if best is None:
            break
        rule.append(best)
        rows &= literals[best]
    return rule or None


def _prune(rule: list[Literal], literals: dict[Literal, int], rows: int, bad: int) -> Rule:
    """The prefix of the rule with the best (p - n) / (p + n) on held-out rows; the longer one if equal."""

    def worth(k: int) -> float:
        covered = rows
        for x in rule[:k]:
            covered &= literals[x]
        p, n = (covered & bad).bit_count(), (covered & ~bad).bit_count()
        return (p - n) / (p + n) if p + n else -1.0

    return tuple(rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), k))])


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str) -> list:
    """At most MAX_LABELLED (label, statistics) rows; the broadcast side has at most as many ids."""
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_label_id"))
        .agg(F.min(label_col).alias("_label"))
        .orderBy(F.xxhash64("_label_id"), "_label_id")
        .limit(MAX_LABELLED)
    )
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    joined = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_label_id"))
    joined = joined.groupBy("_id", "_label").agg(F.min("_text").alias("_text"))  # of a repeated id, the least text
    values = ratios()
    rows = statistics(joined, "_text").select("_id", "_label", *[c.alias(k) for k, c in values.items()]).collect()
    return [(int(r["_label"]), tuple(r[k] for k in values)) for r in sorted(rows, key=lambda r: r["_id"])]


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional: the first rule that holds rejects, else the document stays."""
    values = ratios()
    out = None
    for rule in rules:
        holds = F.lit(True)
        for x in rule:
            holds = holds & x.column(values)
        out = F.when(holds, False) if out is None else out.when(holds, False)
    return F.lit(True) if out is None else out.otherwise(True)


def apply_quality(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with the five counts, base_failed and kept added."""
    rules = learn(labelled_sample(docs, labels, label_col, id_col, text_col), tuple(ratios()))
    scored = statistics(packed(docs, text=F.col(f"`{text_col}`")), "text")
    counts = {c: F.col(f"_{c}") for c in COUNTS}
    return scored.select(*unpacked(docs, **counts, base_failed=base_failed(), kept=~base_failed() & verdict(rules)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs`` alone.

    Rated rows are written before they are filtered: a filter would work the statistics out again for each mention.
    """
    kept = fresh(docs, "kept")
    return materialise(apply_quality(docs, labels).select(*docs.columns, kept), "quality-rated").where(F.col(kept)).select(*docs.columns)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return apply_quality(docs, labels).drop("text")
