"""Operator 13, ranked lexical search: Fagin's threshold algorithm over impact-sorted lists and a forward index.

One pass over the documents counts what a score needs of the whole corpus: documents, terms, and how many documents hold each
term that some item asks for. A second pass indexes the documents shard by shard, CHUNK_TERMS occurrences of asked terms at
most at a time: for each term its documents by falling impact, and for each document its terms (the forward index). For each
item the lists of its terms are read round-robin from the top, a run of entries each; a document that is new is looked up in the
forward index, which gives its whole score. The sum of the last impacts read is the threshold: no unread document scores
more. Reading stops when it falls strictly below the kth score so far, which also counts what the task's earlier chunks held.
Each task gives an item's k best, and Spark ranks those of all tasks.

Impacts are the integers that scores are sums of, so ties are exact. Items go to the tasks in blocks of BLOCK_TERMS terms, however
many there are; a pass over the documents serves a block.

Defined cases: a null or empty text, or one without terms, is no document and asks for nothing; null document ids rank
last among equal scores; repeated rows are documents, or items, of their own, so the ranks of items that share an id are given for
each; an empty table gives an empty result; very long texts are indexed whole; further columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.session import materialise

TOP = 10
#: Characters that no term has, as a pattern and as bytes; of the letters only A-Z are lowered.
NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Occurrences of asked terms that are indexed at once, one text at least; terms of the items of a block.
CHUNK_TERMS, BLOCK_TERMS = 1 << 21, 1 << 22
#: Entries of each list that the first round reads; each later round reads twice as many.
FIRST_RUN = 16


@dataclass
class Items:
    """A block of items: the number of each asked term, and the terms of each item in one row."""

    number: dict[bytes, int]
    keys: list[int]
    terms: np.ndarray
    ends: np.ndarray
    #: Weights of the terms, documents and terms of the corpus; known after the first pass.
    weights: np.ndarray | None = None
    documents: int = 0
    length: int = 0


def _terms(text: str) -> list[bytes]:
    return text.encode().translate(_TERM_BYTES).split()


def _occurrences(number: dict[bytes, int], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Number of each occurrence of an asked term, how many each text has, and the terms of each text in all."""
    found: list[int] = []
    counts, lengths = [], []
    for text in texts:
        terms = _terms(text) if text else []
        before = len(found)
        found += [n for n in map(number.get, terms) if n is not None]
        counts.append(len(found) - before)
        lengths.append(len(terms))
    return np.array(found, np.int64), np.array(counts, np.int64), lengths


def _totals(shared):
    """Rows (what, n): documents as -1, their terms as -2, and by number the documents that hold each asked term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.number
        holding, documents, length = np.zeros(len(number), np.int64), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found, counts, lengths = _occurrences(number, batch.column(0).slice(at, 512).to_pylist())
                documents += sum(n > 0 for n in lengths)
                length += sum(lengths)
                keys = np.unique(np.repeat(np.arange(len(counts)), counts) * len(number) + found)
                holding += np.bincount(keys % max(len(number), 1), minlength=len(number))
        held = np.flatnonzero(holding)
        what, n = np.concatenate([[-1, -2], held]), np.concatenate([[documents, length], holding[held]])
        yield pa.record_batch([pa.array(what), pa.array(n)], names=["what", "n"])

    return run


class Chunk:
    """Documents of a shard, indexed both ways."""

    def __init__(self, items: Items, ids: list[int | None], found: np.ndarray, counts: np.ndarray, lengths: np.ndarray):
        terms = len(items.number)
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)
        self.null = np.array([i is None for i in ids], bool)
        keys, tf = np.unique(np.repeat(np.arange(len(ids)), counts) * terms + found, return_counts=True)
        doc, term = keys // terms, keys % terms
        norm = 100 - 90 + (90 * lengths * items.documents) // max(items.length, 1)
        impact = items.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[doc]))
        some = impact > 0
        self.doc, self.term, self.impact = doc[some], term[some], impact[some]
        self.row_at = np.searchsorted(self.doc, np.arange(len(ids) + 1))
        order = np.lexsort((-self.impact, self.term))
        self.list_doc, self.list_impact = self.doc[order], self.impact[order]
        self.list_at = np.searchsorted(self.term[order], np.arange(terms + 1))
        self.asked, self.seen = np.zeros(terms, bool), np.zeros(len(ids), bool)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Random access: whole scores of documents for the terms that ``asked`` marks."""
        size = self.row_at[docs + 1] - self.row_at[docs]
        at = np.repeat(self.row_at[docs] - np.cumsum(size) + size, size) + np.arange(size.sum())
        sums = np.concatenate([[0], np.cumsum(np.where(self.asked[self.term[at]], self.impact[at], 0))])
        ends = np.cumsum(size)
        return sums[ends] - sums[ends - size]

    def best(self, terms: np.ndarray, held: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of what earlier chunks held and of this one: scores, ids, null ids."""
        first, last = self.list_at[terms], self.list_at[terms + 1]
        self.asked[terms] = True
        at, run, looked = first.copy(), FIRST_RUN, []
        while True:
            upto = np.minimum(at + run, last)
            size = upto - at
            if not size.any():
                break
            entries = np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())
            docs = self.list_doc[entries]
            docs = np.unique(docs[~self.seen[docs]])
            if len(docs):
                self.seen[docs] = True
                looked.append(docs)
                held = _merged(held, (self.scores(docs), self.ids[docs], self.null[docs]), k)
            at, run = upto, 2 * run
            left = at < last
            threshold = self.list_impact[at[left] - 1].sum()
            if len(held[0]) == k and threshold < held[0][-1]:
                break
        self.asked[terms] = False
        for docs in looked:
            self.seen[docs] = False
        return held


def _merged(held, more, k: int):
    """The k best of both, equal scores by ascending id, null ids last."""
    if len(held[0]) == k:
        able = more[0] >= held[0][-1]
        more = tuple(x[able] for x in more)
    if len(more[0]) > 4 * k:
        least = np.partition(more[0], -k)[-k]
        more = tuple(x[more[0] >= least] for x in more)
    scores, ids, null = (np.concatenate(x) for x in zip(held, more, strict=True))
    order = np.lexsort((ids, null, -scores))[:k]
    return scores[order], ids[order], null[order]


def _searched(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        held, parts, waiting = [none] * len(items.keys), [], 0

        def search() -> None:
            ids, found, counts, lengths = zip(*parts, strict=True)
            chunk = Chunk(items, [i for x in ids for i in x], np.concatenate(found), np.concatenate(counts), np.array([n for x in lengths for n in x], np.int64))
            starts = np.concatenate([[0], items.ends[:-1]])
            for i, (s, e) in enumerate(zip(starts.tolist(), items.ends.tolist(), strict=True)):
                held[i] = chunk.best(items.terms[s:e], held[i], k)
            parts.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found, counts, lengths = _occurrences(items.number, part.column(1).to_pylist())
                parts.append((part.column(0).to_pylist(), found, counts, lengths))
                waiting += len(found) + part.num_rows
                if waiting >= CHUNK_TERMS:
                    search()
                    waiting = 0
        if parts:
            search()
        for first in range(0, len(held), 4096):
            some = held[first : first + 4096]
            keys = np.repeat(np.array(items.keys[first : first + 4096], np.int64), [len(h[0]) for h in some])
            scores, ids, null = (np.concatenate(x) for x in zip(*some, strict=True))
            yield pa.record_batch([pa.array(keys), pa.array(ids, mask=null), pa.array(scores)], names=["key", "doc_id", "score"])

    return run


def _weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _block(rows: list) -> Items:
    number: dict[bytes, int] = {}
    terms = [[number.setdefault(t.encode(), len(number)) for t in row.terms] for row in rows]
    flat = np.array([t for own in terms for t in own], np.int64)
    return Items(number, [row.key for row in rows], flat, np.cumsum([len(own) for own in terms]))


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    lowered = F.translate(F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit("")), UPPER, LOWER)
    asked = items.select(
        F.col(f"`{item_col}`").alias("item_id"), F.array_remove(F.array_distinct(F.split(lowered, NO_TERM)), "").alias("terms")
    )
    asked = materialise(asked.where(F.size("terms") > 0).withColumn("key", F.monotonically_increasing_id()), "search-items")
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = spark.createDataFrame([], "key long, doc_id long, score long")
    for b in range(blocks):
        block = _block(asked.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).select("key", "terms").collect())
        if not block.keys:
            continue
        totals = rows.select("text").mapInArrow(_totals(spark.sparkContext.broadcast(block)), "what long, n long")
        sums = dict(totals.groupBy("what").agg(F.sum("n")).collect())  # a row per asked term of the block, and two
        block.documents, block.length = sums.get(-1, 0), sums.get(-2, 0)
        block.weights = np.array([_weight(block.documents, sums.get(t, 0)) for t in range(len(block.number))], np.int64)
        best = rows.mapInArrow(_searched(spark.sparkContext.broadcast(block), k), "key long, doc_id long, score long")
        found = found.unionByName(best)
    order = W.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = rf"""
WITH read AS (
    SELECT doc_id, row_number() OVER () AS r,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NO_TERM.replace("[", "[^", 1)}') AS terms
    FROM documents
), sized AS (SELECT doc_id, r, terms, len(terms) AS n FROM read WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sized),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NO_TERM.replace("[", "[^", 1)}')) AS term
    FROM benchmark
), tf AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM sized)
    WHERE term IN (SELECT term FROM asked) GROUP BY r, term
), weighed AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total
), impact AS (
    SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // words)))) AS impact
    FROM tf JOIN weighed USING (term) JOIN sized USING (r), total
), scored AS (
    SELECT item_id, r, sum(impact)::BIGINT AS score FROM asked JOIN impact USING (term) GROUP BY item_id, r HAVING sum(impact) > 0
)
SELECT item_id, rank, doc_id, score FROM (
    SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank
    FROM scored JOIN sized USING (r)
) WHERE rank <= {TOP}
"""
