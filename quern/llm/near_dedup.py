"""Operator 9, MinHash near-dedup: SetSketch registers, banded; joint likelihood; exact verification.

A document's set holds its distinct shingles of five words. Its sketch has REGISTERS registers, each an exponential
minimum over the set, spaced exponentially and truncated to a range of integers: registers of a union are the maxima of
registers, and equal registers are likelier the more alike two sets are. Runs of BAND registers are keys; documents that
share a key are candidates. Their Jaccard similarity is estimated jointly from both sketches and set sizes by maximum
likelihood, which rules out far pairs; the rest are confirmed on full sets.

Work is kept linear in a group's size. Equal sets are one class from the start. In a bucket, each class is first
compared with the bucket's smallest member only; buckets whose other members are then all connected are done. In the
rest, each member is compared with the bucket's centre, the member with fewest shingles of its own, which links most of
what can be linked. Exact overlaps with the centre and the counts of rare shingles then bound from below what either of
two members has that the other lacks, so that only pairs of different components are looked at that these bounds allow
to link. The bounds lose no link. A pair at the threshold shares no band with probability (1 - 0.85^8)^32 = 4e-5.

Defined cases: a null or blank text has an empty set, and is linked with nothing; fewer than five words are one shingle;
rows without id are never linked and have no component, but are kept; rows that repeat an id are one document for
linking (all of them are kept or dropped alike); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._common import attach, bloom_flag, member_bloom, packed, unpacked, without
from quern.llm._components import components
from quern.session import materialise, release

SHINGLE = 5
REGISTERS, BAND = 256, 8
#: SetSketch parameters: spacing of register values, rate of the exponential numbers, largest value.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
#: Standard errors of the estimate that a pair may lie under the threshold before it is ruled out without a full look.
MARGIN = 5.0
#: A shingle is rare if it has at most so many holders among the members of open buckets.
RARE = 8
#: Words whose hashes a Python worker remembers, and their bytes at most; longer ones are hashed each time.
CACHE_WORDS, CACHED_BYTES = 200_000, 64

_SEEDS = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, size=(2, REGISTERS), dtype=np.uint64)
_FACTORS, _SHIFTS = _SEEDS[0] * np.uint64(2) + np.uint64(1), _SEEDS[1] * np.uint64(2)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(word) > CACHED_BYTES:
            return xxhash.xxh64_intdigest(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


#: One for all tasks of a Python worker.
_HASHES = _WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of a text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z alone are lowered, ASCII white space alone splits
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.array([*map(_HASHES.__getitem__, words)], np.uint64)
    n = len(h) - SHINGLE + 1
    mixed = h[:n].copy()
    for k in range(1, SHINGLE):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += h[k : n + k]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    mixed.sort()
    keep = np.empty(n, bool)
    keep[0] = True
    np.not_equal(mixed[1:], mixed[:-1], out=keep[1:])
    return mixed[keep]


def minima(items: np.ndarray) -> np.ndarray:
    """Per register, the smallest of the items' hashes."""
    out = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(items), 512):
        block = items[i : i + 512, None] * _FACTORS
        block += _SHIFTS
        np.minimum(out, block.min(axis=0), out=out)
    return out


def registers(least: np.ndarray) -> np.ndarray:
    """Hash minima to SetSketch registers."""
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(exponential, 1e-300)) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def jaccard_estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities of pairs of sketches, rows of ra and rb, given their set sizes."""
    above, below = (ra > rb).sum(axis=1)[:, None], (ra < rb).sum(axis=1)[:, None]
    equal = ra.shape[1] - above - below
    total = na + nb
    u, v = (na / total)[:, None], (nb / total)[:, None]
    grid = np.linspace(0.0, 1.0, 201)[None, :] * np.minimum(u / v, v / u)

    def chance(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1.0)

    plus, minus = chance(u - v * grid), chance(v - u * grid)
    same = np.clip(1 - plus - minus, 1e-12, 1.0)
    return np.take_along_axis(grid, (above * np.log(plus) + below * np.log(minus) + equal * np.log(same)).argmax(axis=1)[:, None], 1)[:, 0]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingles(t) for t in part.column(1).to_pylist()]
            rows = registers(np.stack([minima(s) for s in sets])) if sets else []
            yield pa.record_batch(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([r.tobytes() for r in rows], pa.binary()),
                ],
                names=["id", "n", "set_key", "regs"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            held = [shingles(t).tobytes() for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(held, pa.binary())], names=["id", "items"])


def _likely(threshold: float):
    margin = MARGIN * (threshold * (1 - threshold) / REGISTERS) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                a, b, na, nb, ra, rb = batch.slice(at, 512).columns
                as_rows = lambda c: np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(-1, REGISTERS)
                sizes = [c.to_numpy().astype(np.float64) for c in (na, nb)]
                keep = jaccard_estimate(as_rows(ra), as_rows(rb), *sizes) >= threshold - margin
                keep &= np.minimum(*sizes) >= threshold * np.maximum(*sizes)
                yield pa.record_batch([a.filter(pa.array(keep)), b.filter(pa.array(keep))], names=["a", "b"])

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, size of a's set, of b's, of both's)."""
    for batch in batches:
        out = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            out.append((len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
        counts = np.array(out, np.int64).reshape(-1, 3)
        yield pa.record_batch([batch.column(0), batch.column(1), *map(pa.array, counts.T)], names=["a", "b", "na", "nb", "both"])


def _only(table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of a table whose key is among the one column of ``wanted``; what a Bloom filter rules out isn't shuffled."""
    wanted = wanted.distinct().toDF(key)
    return bloom_flag(table, key, member_bloom(wanted, key), "maybe").where("maybe").drop("maybe").join(wanted, key, "left_semi")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("end"))


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, both) by the full sets. Hot representatives are left to the skew join."""
    held = materialise(_only(sets, "id", _ends(pairs)), "near-held")
    full = lambda x: held.select(F.col("id").alias(x), F.col("items").alias(f"s{x}"))
    both = pairs.select("a", "b").join(full("a"), "a").join(full("b"), "b").select("a", "b", "sa", "sb")
    return materialise(both.mapInArrow(_overlaps, "a long, b long, na long, nb long, both long"), "near-compared")


def _linked(compared: DataFrame, percent: int) -> DataFrame:
    return compared.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _likely_pairs(pairs: DataFrame, cards: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of class representatives that their sketches don't rule out."""
    side = lambda x: cards.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    sketched = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb")
    return materialise(sketched.mapInArrow(_likely(percent / 100), "a long, b long").distinct(), "near-likely")


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def near_components(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component) for the rows of ``docs`` that have a whole number as id."""
    texts = docs.select(F.col(f"`{id_col}`").try_cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null")
    sketches = materialise(
        texts.mapInArrow(_sketches, "id long, n long, set_key binary, regs binary"), "near-sketches"
    )
    keyed = sketches.select("id", "n", F.hex("set_key").alias("set_key"))
    classes = materialise(
        keyed.where("n > 0").groupBy("set_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")).where("size > 1"), "near-classes"
    )
    placed = attach(keyed, classes, "set_key", "size", F.col("id"), sketches.count())
    node = materialise(placed.select("id", "n", F.coalesce("rep", "id").alias("node")), "near-nodes")
    cards = without(sketches.where("n > 0"), node.where("id != node").select("id"), "id").select(F.col("id").alias("rep"), "n", "regs")
    joined = _join_classes(texts, cards, percent)
    release(sketches, classes)
    if joined is None:
        return node.select("id", F.col("n").alias("n_shingles"), F.col("node").alias("component"))
    # class representatives carry the component; the size of a class tells hot ones
    sizes = _only(node, "node", joined.select("node")).groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    labels = materialise(joined.join(sizes, "node"), "near-labels")
    return attach(node, labels, "node", "size", F.col("id"), node.count()).select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component")
    )


def _join_classes(texts: DataFrame, cards: DataFrame, percent: int) -> DataFrame | None:
    """(node, component) for representatives of linked classes; None without any candidates."""
    places = F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1))
    band = lambda i: F.xxhash64(i, F.substring("regs", i * (2 * BAND) + 1, F.lit(2 * BAND)))
    bands = cards.select("rep", F.explode(F.transform(places, band)).alias("key"))
    live = materialise(
        bands.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1"), "near-live"
    )
    shared = bloom_flag(bands, "key", member_bloom(live, "key"), "maybe").where("maybe").drop("maybe")
    members = materialise(shared.join(live, "key").select("key", "rep", "pivot"), "near-members")
    involved = materialise(members.select(F.col("rep").alias("id")).distinct(), "near-involved")
    if involved.isEmpty():
        return None
    cards = materialise(_only(cards, "rep", involved), "near-cards")
    sets = materialise(_only(texts, "id", involved).mapInArrow(_sets, "id long, items binary"), "near-sets")
    pairs = materialise(members.where("rep != pivot").select(*_ordered("rep", "pivot")).distinct(), "near-pairs")
    compared = _compared(_likely_pairs(pairs, cards, percent), sets)
    links = materialise(_linked(compared, percent), "near-links")
    labels = components(links)
    open_ = _open_members(members, labels)
    release(live, compared)
    if open_.isEmpty():
        return labels
    sizes, shared = _rarity(open_, sets)
    centred, seen = _centred(open_, sizes, labels, sets, percent)
    links = materialise(links.unionByName(_linked(seen, percent)).distinct(), "near-links")
    labels = components(links)
    left = _cross_pairs(centred, labels, percent).unionByName(shared).distinct()
    left = materialise(left.join(pairs, ["a", "b"], "left_anti").join(seen, ["a", "b"], "left_anti"), "near-pairs")
    found = _linked(_compared(_likely_pairs(left, cards, percent), sets), percent)
    out = components(links.unionByName(found))
    release(members, involved, cards, sets, pairs, links, labels, open_, sizes, shared, centred, seen, left)
    return out


def _open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, rep, met) of the buckets whose members but for the pivot, which all have met, lie in several components."""
    named = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = materialise(named.select("key", "rep", (F.col("rep") == F.col("pivot")).alias("met"), F.coalesce("component", "rep").alias("component")), "near-labelled")
    several = labelled.where("not met").groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    out = materialise(labelled.join(several.select("key"), "key").drop("component"), "near-open")
    release(labelled)
    return out


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            items = np.frombuffer(held.as_py(), np.int64)
            yield pa.record_batch([pa.array(np.full(len(items), i, np.int64)), pa.array(items)], names=["id", "item"])


def _rarity(open_: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, n, rare), rare being the number of rare shingles in a member's set, those that at most RARE open members
    have; and the pairs (a, b) of members that share a rare shingle. These are few: each shingle has RARE holders at most.
    """
    own = materialise(_only(sets, "id", open_.select("rep")), "near-own")
    items = own.mapInArrow(_items, "id long, item long")
    rare = materialise(
        items.groupBy("item")
        .agg(F.count(F.lit(1)).alias("holders"), F.min("id").alias("low"), F.max("id").alias("high"))
        .where(f"holders <= {RARE}"),
        "near-rare",
    )
    lists = items.join(rare.where("holders > 2").select("item"), "item").groupBy("item").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # RARE ids at most
    lists = materialise(lists.select("ids"), "near-lists")
    shared = (
        lists.select(F.explode("ids").alias("a"), "ids")
        .select("a", F.explode("ids").alias("b"))
        .where("a < b")
        .unionByName(rare.where("holders = 2").select(F.col("low").alias("a"), F.col("high").alias("b")))
        .distinct()
    )
    ones = rare.where("holders <= 2").select(F.explode(F.array_distinct(F.array("low", "high"))).alias("id"))
    counts = ones.unionByName(lists.select(F.explode("ids").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("rare"))
    sizes = own.select("id", (F.octet_length("items") / 8).cast("long").alias("n"))
    out = sizes.join(counts, "id", "left").select(F.col("id").alias("rep"), "n", F.coalesce("rare", F.lit(0)).alias("rare"))
    out, shared = materialise(out, "near-rarity"), materialise(shared, "near-shared")
    release(own, rare, lists)
    return out, shared


def _room(mine: str, other: str, percent: int) -> Column:
    """The most shingles, times (100 + percent), that a set may have besides those of another one that it links with."""
    return (100 + percent) * F.col(mine) - percent * (F.col(mine) + F.col(other))


def _centred(open_: DataFrame, sizes: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(key, rep, n, own, lack) of the members that may link in a bucket, and what was compared for it.

    A component's centre is its member with fewest rare shingles for its size, a bucket's that of the component with its
    own such member. ``lack`` counts what a member lacks of the centre, ``own`` its rare shingles outside the centre, at
    least. Two members that share no rare shingle have at least own + max(0, the other's lack - lack) shingles each that
    the other one hasn't.
    """
    slack = (100 - percent) * F.col("n") - (100 + percent) * F.col("rare")
    order = F.struct(slack.alias("slack"), (-F.col("rep")).alias("rep"))
    placed = sizes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = materialise(placed.withColumn("order", order), "near-placed")
    best = F.max_by(F.struct(F.col("rep").alias("centre"), F.col("rare").alias("centre_rare")), "order").alias("best")
    families = placed.groupBy("component").agg(best).select("component", "best.*")
    rated = materialise(open_.join(placed, "rep"), "near-rated")
    centres = rated.groupBy("key").agg(F.max_by("component", "order").alias("component"), F.count(F.lit(1)).alias("size"))
    centres = materialise(centres.join(families, "component").select("key", "centre", "centre_rare", "size"), "near-centres")
    rated = rated.drop("component", "order")
    rated = rated.where("not met").drop("met")
    near = materialise(attach(rated, centres, "key", "size", F.col("rep"), rated.count()).drop("size"), "near-centred")
    seen = _compared(near.where("rep != centre").select(*_ordered("rep", "centre")).distinct(), sets)
    lacks = seen.select(F.col("a").alias("centre"), F.col("b").alias("rep"), (F.col("na") - F.col("both")).alias("lack")).unionByName(
        seen.select(F.col("b").alias("centre"), F.col("a").alias("rep"), (F.col("nb") - F.col("both")).alias("lack"))
    )
    own = F.greatest(F.lit(0), F.col("rare") - F.when(F.col("rep") == F.col("centre"), F.col("rare")).otherwise(F.col("centre_rare")))
    joined = near.join(lacks, ["rep", "centre"], "left").select("key", "rep", "n", own.alias("own"), F.coalesce("lack", F.lit(0)).alias("lack"))
    joined = materialise(joined, "near-bounds")
    # what a member may link with at best: one that lacks most for its own, of the size that leaves most room
    most = joined.groupBy("key").agg(F.max(F.col("lack") - F.col("own")).alias("gap"), F.min("n").alias("least"), F.max("n").alias("largest"))
    fits = (100 + percent) * F.col("own") <= _room("n", "smallest", percent)
    fits &= (100 + percent) * (F.col("lack") - F.col("gap")) <= _room("largest", "n", percent)
    able = joined.join(most, "key").withColumn("smallest", F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100)))
    able = materialise(able.where(fits).select(*joined.columns), "near-able")
    release(placed, centres, near, joined)
    return able, seen


def _cross_pairs(able: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket in different components that sizes and bounds allow to link."""
    labelled = able.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    labelled = materialise(labelled, "near-labelled")
    several = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    open_ = materialise(labelled.join(several.select("key"), "key"), "near-able")
    side = lambda x: open_.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("rep", "n", "component", "own", "lack")])
    near = (F.col("rep_a") < F.col("rep_b")) & (F.col("component_a") != F.col("component_b"))
    besides = lambda x, y: F.col(f"own_{x}") + F.greatest(F.lit(0), F.col(f"lack_{y}") - F.col(f"lack_{x}"))
    for x, y in (("a", "b"), ("b", "a")):
        near &= (100 + percent) * besides(x, y) <= _room(f"n_{x}", f"n_{y}", percent)
    return side("a").join(side("b"), ["key"]).where(near).select(*_ordered("rep_a", "rep_b"))


def set_sizes(rows: DataFrame, row: str, text: str) -> DataFrame:
    """(row, n) of numbered texts: how many shingles each has."""
    counted = rows.select(F.col(row).alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(_sketches, "id long, n long, set_key binary, regs binary")
    return counted.select(F.col("id").alias(row), "n")


def near_dedup(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_shingles, component_id and kept added. Rows without a whole number as id have a set, but no component."""
    found = materialise(near_components(docs, percent, id_col, text_col).dropDuplicates(["id"]), "near-result")
    keyed = packed(docs, key=F.col(f"`{id_col}`").try_cast("long"), text=F.col(f"`{text_col}`"))
    known = keyed.where("key is not null").join(found, F.col("key") == F.col("id"), "left")
    none = materialise(keyed.where("key is null").withColumn("row", F.monotonically_increasing_id()), "near-no-id")
    sized = none.join(set_sizes(none, "row", "text"), "row").select(*keyed.columns, F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"))
    rows = known.select(*keyed.columns, "n_shingles", "component").unionByName(sized)
    return rows.select(
        *unpacked(
            docs,
            n_shingles=F.coalesce("n_shingles", F.lit(0)),
            component_id=F.col("component"),
            kept=F.coalesce(F.col("component") == F.col("key"), F.lit(True)),
        )
    )


def keep_one(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with the columns of ``docs`` alone; most texts never enter a shuffle."""
    found = near_components(docs, percent, id_col, text_col)
    dropped = found.where("id != component").select(F.col("id").alias(id_col))
    return without(docs, materialise(dropped, "near-dropped"), id_col)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_components(docs, 85)
    null = F.lit(None).cast("long")
    sizes = set_sizes(docs.where("doc_id is null").withColumn("row", F.monotonically_increasing_id()), "row", "text")
    none = sizes.select(null.alias("doc_id"), F.col("n").alias("n_shingles"), null.alias("component_id"), F.lit(True).alias("kept"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.col("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    ).unionByName(none)
