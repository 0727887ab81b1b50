"""Batches dealt to parts of nearly equal work: each batch is bounded and dealt by itself, all batches at once.

Largest differencing takes the two states whose parts lie farthest apart, gives the largest part of one the smallest of
the other, and goes on until one state is left. With equal sizes a state starts with one item for each part, so that every part
gets as many. The greedy rule gives each item in turn to the part with the least so far.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _State:
    """Parts of (sum, count, items), the largest first; states that lie farther apart come first."""

    __slots__ = ("parts",)

    def __init__(self, parts: list[tuple[int, int, list]]):
        self.parts = sorted(parts, reverse=True)

    def rank(self) -> tuple:
        return self.parts[0][0] - self.parts[-1][0], self.parts[0]

    def __lt__(self, other: _State) -> bool:
        return self.rank() > other.rank()

    def merged(self, other: _State) -> _State:
        pairs = zip(self.parts, reversed(other.parts), strict=True)
        return _State([(a[0] + b[0], a[1] + b[1], a[2] + b[2]) for a, b in pairs])


def largest_differencing(work: list[int], parts: int, equal_size: bool) -> list[list[int]]:
    """Items by part, each part in rising order."""
    if len(work) < parts or equal_size and len(work) % parts:
        raise ValueError(f"{len(work)} items don't make {parts} parts")
    items = [(w, 1, [(i, w)]) for w, i in sorted((w, i) for i, w in enumerate(work))]
    step = parts if equal_size else 1
    empty = (0, 0, [])
    states = [_State(items[k : k + step] + [empty] * (parts - step)) for k in range(0, len(items), step)]
    heapq.heapify(states)
    while len(states) > 1:
        first = heapq.heappop(states)
        heapq.heapreplace(states, first.merged(states[0]))
    return [sorted(i for i, _ in own) for _, _, own in states[0].parts]


def greedy(work: list[int], parts: int, equal_size: bool) -> list[list[int]]:
    """Items by part. With equal sizes no part gets a second item before all have one."""
    if equal_size and len(work) % parts:
        raise ValueError(f"{len(work)} items don't make {parts} parts")
    heap = [(0, 0, k) for k in range(parts)]
    out: list[list[int]] = [[] for _ in range(parts)]
    for i, w in enumerate(work):
        count, total, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (count + equal_size, total + w, k))
    return out


def micro_batches(work: list[int], parts: int, small_ends: bool = True) -> list[list[int]]:
    """Items by micro-batch of nearly equal work; the light ones stand at both ends, where a pipeline waits."""
    found = largest_differencing(work, parts, False)
    if not small_ends:
        return found
    found.sort(key=lambda own: (sum(work[i] for i in own), own[0] if own else 0), reverse=True)
    return found[::2][::-1] + found[1::2]


def zigzag(work: list[int], own: list[int]) -> list[int]:
    """Items of a part so that work rises to the middle and falls again."""
    order = sorted(own, key=lambda i: (work[i], i))
    return order[::2] + order[1::2][::-1]


def _dealt(deal: Callable[[list[int]], list[list[int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            for number, rows in zip(table.column(0), table.column(1), strict=True):
                keys, work = (rows.values.field(f) for f in ("key", "work"))
                parts = deal(work.to_pylist())
                at = pa.array([i for own in parts for i in own], pa.int64())
                part, place = (pa.array(x, t) for x, t in zip(zip(*[(p, k) for p, own in enumerate(parts) for k in range(len(own))], strict=True), (pa.int32(), pa.int64()), strict=True))
                yield pa.record_batch([pa.repeat(number, len(at)), keys.take(at), part, place], names=["batch", "key", "part", "place"])

    return run


def by_batch(df: DataFrame, batch: str, key: str, work: str, deal: Callable[[list[int]], list[list[int]]]) -> DataFrame:
    """(batch, key, part, place): each batch, in order of key, dealt by a rule from work to lists of items by part.

    A batch is gathered as one row of keys and work, so it must fit a task, which unpacks one batch after the other; a null key
    or null work is an error of the rule.
    """
    listed = df.groupBy(F.col(batch).cast("long").alias("batch")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(key).cast("long").alias("key"), F.col(work).cast("long").alias("work")))).alias("rows")
    )

    return listed.mapInArrow(_dealt(deal), "batch long, key long, part int, place long")


def balanced(df: DataFrame, batch: str, key: str, work: str, parts: int, equal_size: bool = True) -> DataFrame:
    """Parts of nearly equal work of each batch."""
    return by_batch(df, batch, key, work, lambda w: largest_differencing(w, parts, equal_size))


def greedily(df: DataFrame, batch: str, key: str, work: str, parts: int, equal_size: bool = False) -> DataFrame:
    return by_batch(df, batch, key, work, lambda w: greedy(w, parts, equal_size))


def workload(length: int) -> int:
    """What a sequence of a length costs."""
    return 24576 * length + length * length


def capped(df: DataFrame, batch: str, key: str, length: str, cap: int, least: int = 1, multiple: int = 1) -> DataFrame:
    """Micro-batches: as many as the lengths of a batch need under a cap each, ``least`` or more, a multiple of ``multiple``."""

    def deal(lengths: list[int]) -> list[list[int]]:
        if max(lengths) > cap:
            raise ValueError(f"a length of {max(lengths)} is over {cap}")
        parts = max(least, min(len(lengths), -(-sum(lengths) // cap)))
        return micro_batches([workload(n) for n in lengths], -(-parts // multiple) * multiple)

    return by_batch(df, batch, key, length, deal)


def ranked(df: DataFrame, batch: str, key: str, length: str, ranks: int) -> DataFrame:
    """The rows of each batch for every rank, as many for each, in zigzag order of work."""

    def deal(lengths: list[int]) -> list[list[int]]:
        work = [workload(n) for n in lengths]
        return [zigzag(work, own) for own in largest_differencing(work, ranks, True)]

    return by_batch(df, batch, key, length, deal)
