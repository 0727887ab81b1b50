"""Operator 10, packing: mixture-controlled, by deficit round-robin over source queues.

Each source is a queue of tokens. Every window of WINDOW tokens takes its target share
from each queue; what rounding owes a queue is its deficit, carried to the next window. The schedule repeats after a
cycle of windows, so where token number k of a queue goes is arithmetic: partitions know from prefix sums of token counts
where their documents stand in each queue, place them without seeing each other, and deficits carry across windows and
partitions alike. With more than MAX_QUEUES sources, the largest are queues, and groups of the others, of about equal time to
run dry, are queues whose tokens are dealt by the same arithmetic among their members, so every source has its share and
its weight; what a member of a group leaves when it runs dry goes to its group first. When a queue runs dry, its share goes to the others in proportion. Documents are cut wherever a window
ends. Fewer than WINDOW tokens remain in the end; they fill sequences of falling powers of two, so nothing is padded.

Defined cases: a null text is empty, and an empty text still has its end token; a null source is a source of its own;
null ids and repeated rows are packed like any other row; an empty table gives an empty result; further columns of the
input are not carried.
"""

from __future__ import annotations

import base64
import bisect
import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.session import materialise

WINDOW = 2048
END_ID = 1
#: Windows of a full cycle; shares are exact to one in CYCLE * WINDOW.
CYCLE = 32
#: Queues that one schedule deals; more sources than that are dealt by schedules within schedules.
MAX_QUEUES = 64
#: Least tokens of a window of such an inner schedule.
LEAST_WINDOW = 64
#: Words whose ids a Python worker remembers, and their characters in all.
CACHE_WORDS, CACHE_CHARS = 1_000_000, 1 << 25
TOKENIZER = "byte_bpe_50k.json"


class Encoder(dict):
    """Ids of texts as little-endian unsigned 16-bit bytes, equal to what the tokenizer gives for each whole text.

    The vocabulary's pattern never lets a token span a single space or line end between two other characters, so the
    words of a text are encoded alone and remembered: this mapping has the ids of a word after a space, or after a line
    end if the key begins with one. New words of a batch are encoded together from the vocabulary's rank file, which is
    the faster of the two. Texts with other white space or with a special token are encoded whole by the tokenizer.
    """

    def __init__(self, name: str = TOKENIZER):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        ranks = {}
        with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as lines:
            for token, rank in map(bytes.split, lines):
                ranks[base64.b64decode(token)] = int(rank)
        self.words = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.line_end = ranks[b"\n"]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.new: list[str] = []
        self.chars, self.most_words = 0, CACHE_WORDS

    def __missing__(self, word: str) -> bytes:
        self.new.append(word)
        return b""

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self) > self.most_words or self.chars > CACHE_CHARS // CACHE_WORDS * self.most_words:
            self.clear()
            self.chars = 0
        split = []
        for text in texts:
            words = text.replace("\n", " \n").split(" ") if text else []
            if words:
                words[0] = "\n" + words[0]  # so that it doesn't follow a space; the id of the line end goes
            split.append(words)
        out, again = [], []
        for i, words in enumerate(split):
            seen = len(self.new)
            out.append(b"".join(map(self.__getitem__, words))[2:])
            if len(self.new) > seen:
                again.append(i)
        odd = self._learn()
        for i in again:
            if odd and not odd.isdisjoint(split[i]):
                out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u2").tobytes()
            else:
                out[i] = b"".join(map(self.__getitem__, split[i]))[2:]
        return out

    def _learn(self) -> set[str]:
        """Add the new words; return those that can't be encoded alone."""
        new = set(self.new)
        self.new.clear()
        self.chars += sum(map(len, new))
        odd = {w for w in new if len(w.split()) != 1 or len(w) - len(w.strip()) != (w[0] == "\n") or any(t in w for t in self.special)}
        plain = [*(new - odd)]
        if plain:
            text = "".join([w if w[0] == "\n" else f"\n {w}" for w in plain])
            ids = np.array(self.words.encode_ordinary(text), "<u2")
            starts = (2 * np.flatnonzero(ids == self.line_end)).tolist()
            raw = ids.tobytes()
            for w, a, b in zip(plain, starts, [*starts[1:], len(raw)], strict=True):
                self[w] = raw[a:b] if w[0] == "\n" else raw[a + 2 : b]
        return odd


@functools.cache
def encoder(name: str) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(name)


@dataclass
class Phase:
    """Cycles of ``length`` windows from window ``first`` on; cum[q][k] tokens of queue q go before window k of a cycle."""

    first: int
    cycles: int
    length: int
    start: list[int]
    quota: list[int]
    cum: list[list[int]]
    offset: list[list[int]]


@dataclass
class Schedule:
    phases: list[Phase] = field(default_factory=list)
    windows: int = 0
    #: Where the rest begins in each queue, and what comes before it in the rest; sizes of its sequences.
    rest: list[int] = field(default_factory=list)
    rest_offset: list[int] = field(default_factory=list)
    rest_starts: list[int] = field(default_factory=list)
    window: int = WINDOW

    def pieces(self, queue: int, at: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(sequence, offset, length) of the pieces of tokens at .. at + length of a queue."""
        starts = self._starts(queue)
        while length:
            if at >= self.rest[queue]:
                place = self.rest_offset[queue] + at - self.rest[queue]
                k = bisect.bisect_right(self.rest_starts, place) - 1
                take = min(length, self.rest_starts[k + 1] - place)
                yield self.windows + k, place - self.rest_starts[k], take
            else:
                p = self.phases[bisect.bisect_right(starts, at) - 1]
                cum = p.cum[queue]
                cycle, within = divmod(at - p.start[queue], p.quota[queue])
                k = bisect.bisect_right(cum, within) - 1
                take = min(length, cum[k + 1] - within)
                yield p.first + cycle * p.length + k, p.offset[queue][k] + within - cum[k], take
            at += take
            length -= take

    def place(self, sequence: int, offset: int) -> int:
        """Number of a token in the order of sequences."""
        k = sequence - self.windows
        return sequence * self.window + offset if k < 0 else self.windows * self.window + self.rest_starts[k] + offset

    def _starts(self, queue: int) -> list[int]:
        cached = self.__dict__.setdefault("_cached", {})
        if queue not in cached:
            cached[queue] = [p.start[queue] for p in self.phases]
        return cached[queue]


def _shares(total: int, weights: list[float]) -> list[int]:
    """Integers in proportion to weights, with the given sum, by largest remainders."""
    scale = sum(weights)
    exact = [total * w / scale for w in weights]
    out = [int(x) for x in exact]
    order = sorted((q for q, w in enumerate(weights) if w > 0), key=lambda q: (out[q] - exact[q], q))
    for i in range(total - sum(out)):
        out[order[i % len(order)]] += 1
    return out


def _cycle(quota: list[int], length: int, window: int) -> list[list[int]]:
    """Tokens that each window of a cycle takes from each queue: deficits grow by the quota, a token costs ``length``."""
    deficit, taken, rows = [0] * len(quota), [0] * len(quota), []
    for k in range(length):
        deficit = [d + q for d, q in zip(deficit, quota, strict=True)]
        take = [max(0, d // length) for d in deficit]
        if k == length - 1:
            take = [q - t for q, t in zip(quota, taken, strict=True)]
        else:
            order = sorted(range(len(quota)), key=lambda q: (take[q] * length - deficit[q], q))
            for q in order[: window - sum(take)]:
                take[q] += 1
        deficit = [d - t * length for d, t in zip(deficit, take, strict=True)]
        taken = [a + t for a, t in zip(taken, take, strict=True)]
        rows.append(take)
    return rows


def schedule(totals: list[int], weights: list[float] | None = None, window: int = WINDOW) -> Schedule:
    """The whole plan from the tokens of each queue; weights are target shares of tokens, else the shares held."""
    left, done, out = list(totals), [0] * len(totals), Schedule(window=window)
    while sum(left) >= window:
        live = [float(x) if x else 0.0 for x in left]
        if weights is not None and any(w > 0 and x for w, x in zip(weights, left, strict=True)):
            live = [w if x else 0.0 for w, x in zip(weights, left, strict=True)]
        length = CYCLE
        while True:
            quota = _shares(length * window, live)
            cycles = min(x // q for x, q in zip(left, quota, strict=True) if q)
            if cycles or length == 1:
                break
            length //= 2
        if not cycles:  # some queue is about to end: one window takes what it has, and the others make up for it
            quota = [min(q, x) for q, x in zip(quota, left, strict=True)]
            for q in sorted(range(len(left)), key=lambda q: (-live[q], quota[q] - left[q])):
                quota[q] += min(left[q] - quota[q], window - sum(quota))
            cycles = 1
        rows = _cycle(quota, length, window) if length > 1 else [quota]
        cum = [[0] * (length + 1) for _ in totals]
        offset = [[0] * length for _ in totals]
        for k, take in enumerate(rows):
            place = 0
            for q, t in enumerate(take):
                cum[q][k + 1] = cum[q][k] + t
                offset[q][k] = place
                place += t
        out.phases.append(Phase(out.windows, cycles, length, list(done), quota, cum, offset))
        out.windows += cycles * length
        done = [d + cycles * q for d, q in zip(done, quota, strict=True)]
        left = [x - cycles * q for x, q in zip(left, quota, strict=True)]
    out.rest, rest = done, sum(left)
    out.rest_offset = [sum(left[:q]) for q in range(len(left))]
    out.rest_starts = [0]
    for bit in range(window.bit_length(), -1, -1):
        if rest >> bit & 1:
            out.rest_starts.append(out.rest_starts[-1] + (1 << bit))
    return out


@dataclass
class Plan:
    """A schedule whose queues are sources or, at the places in ``inner``, plans of their own."""

    outer: Schedule
    queue: dict[str, int]
    inner: dict[int, Plan]

    def pieces(self, source: str, at: int, length: int) -> Iterator[tuple[int, int, int]]:
        q = self.queue[source]
        if q not in self.inner:
            yield from self.outer.pieces(q, at, length)
            return
        inner = self.inner[q]
        for sequence, offset, n in inner.pieces(source, at, length):
            yield from self.outer.pieces(q, inner.outer.place(sequence, offset), n)


def plan(totals: dict[str, int], weights: dict[str, float] | None = None, window: int = WINDOW) -> Plan:
    """The plan for the tokens of each source; weights of sources that are not given are 0."""
    weight = lambda s: totals[s] if weights is None else weights.get(s, 0.0)
    parts = [[s] for s in sorted(totals)]
    if len(parts) > MAX_QUEUES:
        half = MAX_QUEUES // 2
        ranked = sorted(totals, key=lambda s: (-weight(s), -totals[s], s))
        parts, others = [[s] for s in ranked[:half]], ranked[half:]
        each = -(-len(others) // (half - 1))
        weighted = sorted((s for s in others if weight(s) > 0), key=lambda s: (totals[s] / weight(s), s))
        for some in (weighted, sorted(s for s in others if not weight(s) > 0)):
            parts += [some[i : i + each] for i in range(0, len(some), each)]
    shares = [sum(map(weight, x)) for x in parts]
    scale = sum(shares) or 1
    inner = {}
    for q, x in enumerate(parts):
        if len(x) > 1:
            inner[q] = plan({s: totals[s] for s in x}, weights, min(window, max(LEAST_WINDOW, round(window * shares[q] / scale))))
    outer = schedule([sum(totals[s] for s in x) for x in parts], None if weights is None else shares, window)
    return Plan(outer, {s: q for q, x in enumerate(parts) for s in x}, inner)


def _tokenize(tokenizer: str, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before = encoder(tokenizer), {}
        encode.most_words = remembered
        end = np.array([END_ID], "<u2").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids = [x + end for x in encode(part.column(3).to_pylist())]
                counts, starts = [len(x) // 2 for x in ids], []
                for q, n in zip(part.column(2).to_pylist(), counts, strict=True):
                    starts.append(before.get(q, 0))
                    before[q] = starts[-1] + n
                yield pa.record_batch(
                    [part.column(0), part.column(1), part.column(2), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "queue", "before", "n", "ids"],
                )

    return run


def _cut(plan: Plan):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                out: list[list[int]] = [[] for _ in names]
                columns = [part.column(i).to_pylist() for i in range(4)]
                for doc, queue, at, n, ids in zip(*columns, part.column(4), strict=True):
                    raw = memoryview(np.frombuffer(ids.as_buffer(), "<u2").astype("<u4").tobytes())
                    start = 0
                    for sequence, offset, length in plan.pieces(queue, at, n):
                        crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                        for column, value in zip(out, (doc, start, length, crc, n, sequence, offset), strict=True):
                            column.append(value)
                        start += length
                yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=names)

    return run


def pack(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    tokenizer: str = TOKENIZER,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    remembered: int = CACHE_WORDS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A Python worker remembers the ids of so many words: with fewer, it takes less memory and encodes more words anew.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.spark_partition_id().cast("long").alias("part"),
        key.alias("queue"),
        F.col(text_col).alias("text"),
    )
    schema = "doc_id long, part long, queue string, before long, n long, ids binary"
    tokens = materialise(rows.mapInArrow(_tokenize(tokenizer, remembered), schema), "pack-tokens")
    per_part = materialise(tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")), "pack-parts")
    totals = dict(per_part.groupBy("queue").agg(F.sum("n").alias("n")).collect())  # a row per source
    shares = None if weights is None else {f"s{k}": float(w) for k, w in weights.items()}
    earlier = W.partitionBy("queue").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = per_part.select("queue", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = tokens.join(materialise(bases, "pack-bases"), ["queue", "part"])
    cut = placed.select("doc_id", "queue", (F.col("base") + F.col("before")).alias("at"), "n", "ids")
    return cut.mapInArrow(
        _cut(plan(totals, shares)),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
