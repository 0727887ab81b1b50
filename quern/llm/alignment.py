"""Operator 12, cross-tokenizer alignment: byte ends of two tokenizations of a whole batch, counted once.

The tokens of many documents stand in one row of bytes. Ends of the tokens of A and of B are counted by byte (bincount);
the text is cut into groups where both end, and every place where either ends closes one link, the stretch of bytes that one
token of A and one of B share. Prefix sums of these marks number tokens, groups and links, and their differences at the
documents' ends give each document its own numbers.

How often an id pair is linked in the whole corpus is a sum by Spark. Pairs that hold at least one in HEAD_PARTS of all
links, so HEAD_PARTS pairs at most, go to the tasks as sorted arrays; links of rarer pairs are joined to their counts, and a
rare pair can't be a hot key. The highest count of a B id is a table of at most as many rows as B has ids.

Defined cases: a null or empty text, and one whose tokens don't give back the bytes of a space and the text, has no tokens,
zeros and an empty digest; null ids, ties and repeated rows are documents of their own and count like others; an empty table
gives an empty result; a very long text is one document in a batch of its own; further columns of the input are not carried.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._words import BothIds, words_of
from quern.session import materialise

TOKENIZERS = ("byte_bpe_50k.json", "piece_bpe_32k.model")
#: Pairs whose counts are sent to the tasks; 16 bytes and a flag each.
HEAD_PARTS = 1 << 20
#: Bytes of texts that are aligned at once, but one text at least.
BATCH_BYTES = 1 << 20
#: More than any id of B: a pair is A's id times this and B's id.
B_IDS = 1 << 15


@dataclass
class Aligned:
    """Documents of a batch: tokens, groups and links of each, and the links and group texts of all in one row."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    #: Link by link, A's id * B_IDS + B's id.
    links: np.ndarray
    #: The written groups, and where each document's end.
    groups: np.ndarray
    group_ends: np.ndarray


def _digits(ids: int) -> np.ndarray:
    """Rows of the decimal digits of 0 .. ids - 1, left-justified, with a zero byte after them."""
    return np.array([str(i) for i in range(ids)], "S6").view(np.uint8).reshape(ids, 6)


@functools.cache
def _tables(names: tuple[str, str]) -> tuple[np.ndarray, ...]:
    """Byte lengths of the tokens of A and B, their digits with each separator, and lengths of these."""
    both, out = words_of(BothIds, names), []
    for vocabulary, separators in ((both.a, b",|"), (both.b, b",;")):
        lengths = np.array([len(t) for t in vocabulary.token_bytes], np.int64)
        digits = _digits(len(lengths))
        width = (digits != 0).sum(1)
        written = []
        for mark in separators:
            rows = digits.copy()
            rows[np.arange(len(rows)), width] = mark
            written.append(rows)
        out += [lengths, np.concatenate(written), width + 1]
    return tuple(out)


def align_batch(ids_a: list[bytes], ids_b: list[bytes], names: tuple[str, str] = TOKENIZERS) -> Aligned:
    """Align documents given by their ids; the tokens of A and B of each document cover the same bytes."""
    len_a, text_a, width_a, len_b, text_b, width_b = _tables(names)
    a, b = (np.frombuffer(b"".join(x), "<u2").astype(np.int64) for x in (ids_a, ids_b))
    n_a, n_b = (np.array([len(x) // 2 for x in ids], np.int64) for ids in (ids_a, ids_b))
    ends_a, ends_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
    total = int(ends_a[-1]) if len(ends_a) else 0
    marks = np.bincount(ends_a, minlength=total + 1) + 2 * np.bincount(ends_b, minlength=total + 1)
    ends = np.flatnonzero(marks)
    is_a, is_b = marks[ends] & 1, marks[ends] >> 1
    cut = is_a & is_b
    before_a, before_b, before_cut = (np.cumsum(x) - x for x in (is_a, is_b, cut))
    # A link per end: the tokens of either side that lie there are those after all that ended before.
    links = a[before_a] * B_IDS + b[before_b] if total else np.zeros(0, np.int64)

    def per_document(sums: np.ndarray) -> np.ndarray:
        """Differences of a running sum at the ends of documents."""
        upto = np.concatenate([[0], sums])[at]
        return np.diff(upto, prepend=0)

    bytes_at = np.concatenate([[0], ends_a])[np.cumsum(n_a)]
    at = np.searchsorted(ends, bytes_at, side="right")
    n_links, n_groups = np.diff(at, prepend=0), per_document(np.cumsum(cut))

    # Written order: of each group, A's tokens and then B's.
    group_a, group_b = before_cut[is_a == 1], before_cut[is_b == 1]
    upto_a = np.cumsum(is_a)[cut == 1]
    upto_b = np.concatenate([[0], np.cumsum(is_b)[cut == 1]])
    place_a = np.arange(len(a)) + upto_b[group_a]
    place_b = np.arange(len(b)) + upto_a[group_b]
    last_a, last_b = cut[is_a == 1], cut[is_b == 1]
    rows = np.empty((len(a) + len(b), 6), np.uint8)
    rows[place_a] = text_a[a + last_a * len(len_a)]
    rows[place_b] = text_b[b + last_b * len(len_b)]
    written = rows.reshape(-1)
    written = written[written != 0]
    widths = np.cumsum(np.concatenate([[0], width_a[a]]))[np.cumsum(n_a)] + np.cumsum(np.concatenate([[0], width_b[b]]))[np.cumsum(n_b)]
    return Aligned(n_a, n_b, n_groups, n_links, links, written, widths)


SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most BATCH_BYTES, or of one row."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > BATCH_BYTES:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def _align(names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = words_of(BothIds, names), TaskContext.get().partitionId() << 33
        for batch in batches:
            sizes = [len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(1)]
            for first, last in _slices(sizes):
                part = batch.slice(first, last - first)
                x = align_batch(*encode.both([t or "" for t in part.column(1).to_pylist()]), names)
                groups, starts = memoryview(x.groups), np.concatenate([[0], x.group_ends[:-1]])
                digests = [hashlib.sha256(groups[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(starts.tolist(), x.group_ends.tolist(), strict=True)]
                raw, upto = x.links.astype("<u4").tobytes(), (4 * np.concatenate([[0], np.cumsum(x.n_links)])).tolist()
                numbers = np.arange(row, row + part.num_rows)
                row += part.num_rows
                yield pa.record_batch(
                    [
                        pa.array(numbers), part.column(0), *(pa.array(v.astype(np.int64)) for v in (x.n_a, x.n_b, x.n_groups, x.n_links)),
                        pa.array(digests, pa.string()), pa.array([raw[s:e] for s, e in zip(upto[:-1], upto[1:], strict=True)], pa.binary()),
                    ],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"],
                )

    return run


def align(docs: DataFrame, tokenizers: tuple[str, str] = TOKENIZERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: a number of the row, doc_id, the counts, the digest of its groups, and its links in order.

    Links are little-endian unsigned 32-bit numbers, A's id * B_IDS + B's id.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_align(tokenizers), SCHEMA)


def _all_links(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of at most BATCH_BYTES of links, or of one document: the links in one row, and how many each has."""
    sizes = [len(x.as_buffer()) for x in batch.column(column)]
    for first, last in _slices(sizes):
        part = batch.slice(first, last - first)
        raw = b"".join(x.as_buffer() for x in part.column(column))
        yield part, np.frombuffer(raw, "<u4").astype(np.int64), np.array(sizes[first:last], np.int64) // 4


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(links, return_counts=True) for _, links, _ in _all_links(batch, 0)]
        if found:
            pairs, at = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([x[1] for x in found]))
            yield pa.record_batch([pa.array(pairs), pa.array(counts.astype(np.int64))], names=["pair", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """How often each pair is linked, and whether that is the highest count of its B id: pair, n, best."""
    sums = aligned.select("links").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    sums = materialise(sums.withColumn("b", F.col("pair") % B_IDS), "align-pairs")
    highest = sums.groupBy("b").agg(F.max("n").alias("highest"))  # a row per id of B, so fewer than B_IDS
    joined = sums.join(F.broadcast(highest), "b")
    return materialise(joined.select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "align-counts")


def _looked_up(head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of.cache_clear()  # a worker that tokenized before holds words that no one asks for any more
        pairs, n, best = head.value
        for batch in batches:
            for part, links, sizes in _all_links(batch, 1):
                upto = np.cumsum(sizes)

                def per_document(values: np.ndarray, upto: np.ndarray = upto) -> np.ndarray:
                    return np.diff(np.concatenate([[0], np.cumsum(values)])[upto], prepend=0).astype(np.int64)

                if len(pairs):
                    at = np.minimum(np.searchsorted(pairs, links), len(pairs) - 1)
                    known = pairs[at] == links
                    sums = per_document(known & best[at]), per_document(np.where(known, n[at], 0))
                else:
                    known, sums = np.zeros(len(links), bool), (np.zeros(len(sizes), np.int64),) * 2
                offsets = np.concatenate([[0], np.cumsum(per_document(~known))]).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(offsets), pa.array(links[~known]))
                yield pa.record_batch([part.column(0), pa.array(sums[0]), pa.array(sums[1]), rare], names=["row", "n_best", "count_sum", "rare"])

    return run


def scored(aligned: DataFrame) -> DataFrame:
    """Per row of a written alignment: n_best and count_sum over its links."""
    spark = aligned.sparkSession
    counts = pair_counts(aligned)
    total = counts.agg(F.sum("n")).first()[0] or 0
    head = counts.where(F.col("n") >= max(1, -(-total // HEAD_PARTS))).orderBy("pair").toArrow()  # HEAD_PARTS rows at most
    arrays = tuple(head.column(c).to_numpy() for c in ("pair", "n", "best"))
    looked = aligned.select("row", "links").mapInArrow(
        _looked_up(spark.sparkContext.broadcast(arrays)), "row long, n_best long, count_sum long, rare array<long>"
    )
    looked = materialise(looked, "align-head")
    tail = looked.select("row", F.explode("rare").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("times"))
    more = tail.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
    )
    plain, rest = looked.where(F.size("rare") == 0).drop("rare"), looked.where(F.size("rare") > 0).drop("rare")
    added = rest.join(more, "row").select("row", (F.col("n_best") + F.col("more_best")).alias("n_best"), (F.col("count_sum") + F.col("more_sum")).alias("count_sum"))
    return plain.unionByName(added)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, group digest and link counts of every document."""
    aligned = materialise(align(spark.read.parquet(f"{sf_dir}/documents.parquet")), "align")
    return aligned.drop("links").join(scored(aligned), "row").drop("row")
