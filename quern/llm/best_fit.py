"""Operator 11, best-fit packing: bounded-space online best-fit, open bins in a bitset keyed by free space.

Each task tokenizes its documents and packs their pieces as they come into OPEN_BINS open bins of CAPACITY tokens. Bit f
of one integer says that some open bin has f tokens free, so the bin that a piece fits best is the lowest set bit from its
length on. If none fits and all bins are open, the fullest closes. A task holds the pieces of its open bins only. What is
still open at a task's end, at most OPEN_BINS bins, meets what FAN_IN other tasks left, and is packed once more in the
same way; only those pieces are shuffled.

Defined cases: a null or empty text is its end token alone; null ids and repeated rows are packed like any other row; a
text of more than CAPACITY tokens is cut into whole bins and a rest, however long it is; equal free spaces go to the bin
that got it last; an empty table gives an empty result; further columns of the input are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._words import LowerWords, words_of
from quern.session import materialise

CAPACITY = 4096
END_ID = 1
OPEN_BINS = 256
#: Tasks whose open bins meet in one task of the second round.
FAN_IN = 64
TOKENIZER = "word_bpe_49k.json"
#: Texts that are encoded together, and pieces of a result batch.
SLICE, OUT_ROWS = 256, 2048

FIELDS = pa.schema(
    [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
        ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_()),
    ]
)
SCHEMA = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, sequence_id long, offset long, open boolean"

#: Document, number, start, length, ids, and their checksum as unsigned 32-bit numbers.
Piece = tuple[int | None, int, int, int, bytes, int]


class Bins:
    """Open bins by free space. Pieces come out with their bin and place once the bin is full or closed."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS):
        self.capacity, self.most = capacity, most
        self.bits, self.by_free, self.held, self.count = 0, [[] for _ in range(capacity + 1)], {}, 0

    def add(self, piece: Piece) -> list[tuple[int, list[Piece]]]:
        """Put a piece into the bin that it fills best; return the bins that this closes."""
        length, closed = piece[3], []
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            own = self._take(free)
            self.held[own].append(piece)
        else:
            if len(self.held) == self.most:
                closed.append(self._close((self.bits & -self.bits).bit_length() - 1))
            free, own = self.capacity, self.count
            self.count += 1
            self.held[own] = [piece]
        left = free - length
        if left:
            self.by_free[left].append(own)
            self.bits |= 1 << left
        else:
            closed.append((own, self.held.pop(own)))
        return closed

    def rest(self) -> list[tuple[int, list[Piece]]]:
        """The bins that are still open."""
        return sorted(self.held.items())

    def _take(self, free: int) -> int:
        own = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        return own

    def _close(self, free: int) -> tuple[int, list[Piece]]:
        own = self._take(free)
        return own, self.held.pop(own)


def _packed(pieces: Iterator[Piece], capacity: int, most: int, turn: int) -> Iterator[pa.RecordBatch]:
    """Rows of all pieces with their sequences: numbers of the task, the bin, and which of the two rounds it is."""
    bins, base, rows = Bins(capacity, most), TaskContext.get().partitionId() << 34, []

    def put(closed: list[tuple[int, list[Piece]]], still_open: bool) -> None:
        for own, content in closed:
            offset = 0
            for piece in content:
                rows.append((*piece, base + 2 * own + turn, offset, still_open))
                offset += piece[3]

    def batch() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FIELDS, strict=True)], schema=FIELDS)
        rows.clear()
        return out

    for piece in pieces:
        put(bins.add(piece), False)
        if len(rows) >= OUT_ROWS:
            yield batch()
    for own in bins.rest():
        put([own], turn == 0)
        if len(rows) >= OUT_ROWS:
            yield batch()
    if rows:
        yield batch()


def _first(tokenizer: str, capacity: int, most: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
        encode, end = words_of(LowerWords, tokenizer), np.array([END_ID], "<u2").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                    ids += end
                    for k, start in enumerate(range(0, len(ids), 2 * capacity)):
                        own = ids[start : start + 2 * capacity]
                        yield doc, k, start // 2, len(own) // 2, own, zlib.crc32(np.frombuffer(own, "<u2").astype("<u4").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(pieces(batches), capacity, most, 0)

    return run


def _again(capacity: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True))
        return _packed(pieces, capacity, most, 1)

    return run


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    tokenizer: str = TOKENIZER,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 16-bit), ids_crc32 (of them as 32-bit ones), sequence_id, offset.

    The checksums come with the pieces: a second function over the result would start further Python workers, and each
    worker that gets a text later remembers words of its own.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    first = materialise(rows.mapInArrow(_first(tokenizer, capacity, open_bins), SCHEMA), "best-fit")
    still_open = first.where("open")
    bins = still_open.where("offset = 0").count()
    tasks = max(1, -(-bins // (FAN_IN * open_bins)))
    shuffled = still_open.drop("open").repartition(tasks).sortWithinPartitions(F.xxhash64("sequence_id", "offset"), "sequence_id", "offset")
    again = shuffled.mapInArrow(_again(capacity, open_bins), SCHEMA)
    return first.where("not open").unionByName(again).drop("open")


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place and the checksum of its ids as unsigned 32-bit numbers."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
