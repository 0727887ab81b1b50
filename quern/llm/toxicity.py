"""Operator 5, toxicity: a linear-chain conditional random field.

The labels say which documents are toxic, not where. Features of words (the word itself and its beginnings) that occur
in more toxic documents of a bounded labelled sample than chance explains (a binomial tail over all features) give each
token of that sample a label: toxic if it has such a feature and stands in a toxic document. Near copies in the sample
count once, by the one of the least id. Equal sequences are fitted once, with their number as weight. A linear-chain field with two states learns weights for the features
and for the transitions from these sequences. Its forward-backward marginals score each token of a document; runs of
tokens over a half are the offending spans, and a logistic curve over the tagged tokens' summed marginals and the largest marginal, fitted to the
documents' labels, is the document's score.

Long runs of words without features are passed in one step, by a power of the transition matrix, so that exact marginals
cost little more than looking words up.

Defined cases: a null or blank text has no tokens and gets the score of a text without findings; labels that are null,
or whose document is missing or has no id, are not learned from; rows with a null id are scored and not held out; rows
that repeat an id are scored each; without toxic labels all scores are 0; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.near_dedup import minima, shingles
from quern.session import materialise

#: Labelled documents that are learned from, at most: those with the smallest hash of their id.
MAX_LABELLED = 10_000
#: What a feature must have: log odds, and so few toxic documents by chance that of all features this many would.
LEAST_ODDS, BY_CHANCE = 2.5, 0.05
#: Tokens of a training sequence, and sequences whose marginals are computed at once.
LENGTH, CHUNK = 24, 4096
PREFIXES = (3, 4, 5, 6)
EPOCHS, RATE, RIDGE = 100, 0.1, 1e-3
#: Tokens on either side of one with features whose marginals are computed too.
REACH = 2
#: Tokens whose weights, and whose features, a Python worker remembers.
CACHE_WORDS, CACHE_FEATURES = 200_000, 1 << 14
_STRIP = "\"'()[]{}<>.,;:!?*_-#%&$|/\\«»“”„‚‘’…¡¿"


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(token: str) -> tuple[str, ...]:
    """The features of a token; those of tokens that aren't very long are remembered."""
    return _features(token) if len(token) <= 64 else _features.__wrapped__(token)


@functools.lru_cache(CACHE_FEATURES)
def _features(token: str) -> tuple[str, ...]:
    word = token.lower().strip(_STRIP)
    if not word:
        return ()
    return (f"w:{word}", *[f"{n}:{word[:n]}" for n in PREFIXES if len(word) > n])


@dataclass
class Field:
    """Weights of a field with states 0 (clean) and 1 (toxic); the curve from marginals to document scores."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    transition: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])
    curve: tuple[float, float, float] = (-20.0, 0.0, 0.0)

    def __post_init__(self) -> None:
        self.cache: dict[str, float | None] = {}
        self.powers: dict[int, np.ndarray] = {}

    def emission(self, token: str) -> float | None:
        """The summed weight of a token's features; None if it has none."""
        found = [w for f in features(token) if (w := self.weights.get(f)) is not None]
        return sum(found) if found else None

    def _gap(self, n: int) -> np.ndarray:
        """The product of n steps over tokens without features, scaled."""
        if n not in self.powers:
            step = np.exp(np.array(self.transition)) * np.array([1.0, math.exp(self.bias)])
            power = np.linalg.matrix_power(step / step.max(), n)
            if len(self.powers) > 20_000:
                self.powers.clear()
            self.powers[n] = power / power.max()
        return self.powers[n]

    def marginals(self, n: int, emissions: dict[int, float]) -> dict[int, float]:
        """P(toxic) of tokens that have features, and of those up to REACH away, in a text of n tokens."""
        places = sorted({p for e in emissions for p in range(max(0, e - REACH), min(n, e + REACH + 1))})
        if not places:
            return {}
        step = np.exp(np.array(self.transition))
        local = [np.array([1.0, math.exp(min(30.0, self.bias + emissions.get(p, 0.0)))]) for p in places]
        # from the last of all tokens back: what follows each place
        after = [np.ones(2)] * len(places)
        follow = self._gap(n - 1 - places[-1]) @ np.ones(2)
        for i in range(len(places) - 1, -1, -1):
            after[i] = follow / follow.max()
            gap = places[i] - (places[i - 1] if i else -1) - 1
            follow = self._gap(gap) @ (step @ (local[i] * after[i])) if i or gap else follow
        out, before = {}, np.array([1.0, math.exp(self.bias)])
        if places[0] > 0:
            before = (before / before.max()) @ self._gap(places[0] - 1) @ step * local[0]
        else:
            before = local[0]
        for i, p in enumerate(places):
            if i:
                before = before @ self._gap(p - places[i - 1] - 1) @ step * local[i]
            before = before / before.max()
            both = before * after[i]
            out[p] = float(both[1] / both.sum())
        return out

    def look_up(self, tokens: list[str]) -> dict[int, float]:
        cache, found = self.cache, {}
        for i, value in enumerate(map(cache.get, tokens, _UNKNOWN)):
            if value is False:
                token = tokens[i]
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                value = self.emission(token)
                if len(token) <= 64:
                    cache[token] = value
            if value is not None:
                found[i] = value
        return found

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int]]]:
        """(score, offending spans as start and length in code points)."""
        tokens = (text or "").split()
        found = self.marginals(len(tokens), self.look_up(tokens))
        total, most = _gauge(found)
        spans = _spans(text or "", tokens, [p for p in sorted(found) if found[p] >= 0.5]) if found else []
        return self.doc_score(total, most), spans

    def doc_score(self, total: float, most: float) -> float:
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(total) + c * most))))


def _gauge(found: dict[int, float]) -> tuple[float, float]:
    """The sum of the marginals of tagged tokens, and the largest of all: many weak hints don't add up to a finding."""
    return sum(m for m in found.values() if m >= 0.5), max(found.values(), default=0.0)


class _Always:
    """An endless supply of False, for map()."""

    def __iter__(self):
        while True:
            yield False


_UNKNOWN = _Always()


def _spans(text: str, tokens: list[str], places: list[int]) -> list[tuple[int, int]]:
    """Places of tokens to spans of the text; neighbours make one span."""
    wanted, out, at, last = set(places), [], 0, -2
    for i, token in enumerate(tokens):
        at = text.index(token, at)
        if i in wanted:
            if i == last + 1:
                out[-1] = (out[-1][0], at + len(token) - out[-1][0])
            else:
                out.append((at, len(token)))
            last = i
        at += len(token)
    return out


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(toxic, text) of the labelled sample; near copies, which share the least hash of a permutation, go."""
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("label_id"))
        .agg(F.max(label_col).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(MAX_LABELLED)
    )
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    joined = texts.join(F.broadcast(chosen), F.col("id") == F.col("label_id"))
    joined = joined.groupBy(F.col("id").cast("long").alias("id"), "toxic").agg(F.min("text").alias("text"))  # of a repeated id, the least text

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [minima(shingles(t))[:3].astype(np.int64) for t in batch.column(2).to_pylist()]
            yield pa.record_batch([*batch.columns, *[pa.array([int(x[k]) for x in least], pa.int64()) for k in range(3)]], names=["id", "toxic", "text", "a", "b", "c"])

    marked = materialise(joined.select("id", "toxic", "text").mapInArrow(hashed, "id long, toxic int, text string, a long, b long, c long"), "toxic-sample")
    heads = _heads(marked.select("id", "a", "b", "c").collect())  # MAX_LABELLED rows at most
    ids = docs.sparkSession.createDataFrame([(i,) for i in heads], "id long")
    return materialise(marked.join(F.broadcast(ids), "id").select("toxic", "text"), "toxic-sample")


def _heads(rows: list) -> list[int]:
    """The least id of each set of rows that are connected by sharing a minimum."""
    parent: dict[int, int] = {}

    def find(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict[tuple[str, int], int] = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        for k in "abc":
            x, y = find(r["id"]), find(first.setdefault((k, r[k]), r["id"]))
            parent[max(x, y)] = min(x, y)
    return sorted({find(i) for i in list(parent)})


def _tail(k: int, n: int, p: float) -> float:
    """The probability of k or more hits in n draws."""
    if p <= 0:
        return 0.0 if k else 1.0
    if p >= 1:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    total, term = 0.0, 1.0
    for i in range(k, n + 1):
        term = math.exp(log(i))
        total += term
        if term < 1e-12 * total:
            break
    return min(1.0, total)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = (Counter(), Counter())
    for batch in batches:
        for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts[1 if toxic else 0].update({f for t in set((text or "").split()) for f in features(t)})
    names = [*counts[1], *(counts[0].keys() - counts[1].keys())]
    for i in range(0, len(names), 10_000):
        part = names[i : i + 10_000]
        yield pa.record_batch([pa.array(part), *[pa.array([c[f] for f in part], pa.int64()) for c in (counts[1], counts[0])]], names=["feature", "toxic", "clean"])


def _sequences(odds: dict[str, float]):
    """Token sequences of the sample: (features, labels), as indexes and 0/1 per token; those with features, and others."""
    index = {f: i for i, f in enumerate(odds)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = (text or "").split()
                rows = [[index[f] for f in features(t) if f in index] for t in tokens]
                out = []
                for at in range(0, len(tokens), LENGTH):
                    part = rows[at : at + LENGTH]
                    if any(part) or at == 0:
                        out.append((part, [int(bool(toxic and r)) for r in part]))
                if out:
                    yield pa.record_batch([pa.array([x[0] for x in out], pa.list_(pa.list_(pa.int32()))), pa.array([x[1] for x in out], pa.list_(pa.int32()))], names=["features", "labels"])

    return run


def _step(theta: np.ndarray, v: int, chunk: tuple) -> np.ndarray:
    """A chunk's part of the gradient of the log likelihood, by forward-backward."""
    mask, labels, worth, at, token, gold = chunk
    n = len(mask)
    unary = np.zeros((n, LENGTH, 2))
    unary[:, :, 1] = theta[v] + np.bincount(token, theta[at], n * LENGTH).reshape(n, LENGTH)
    unary *= mask[:, :, None]
    local, step = np.exp(np.clip(unary, -30, 30)), np.exp(theta[v + 1 :].reshape(2, 2))
    alpha, beta = np.zeros((n, LENGTH, 2)), np.ones((n, LENGTH, 2))
    alpha[:, 0] = local[:, 0] / local[:, 0].sum(1, keepdims=True)
    for j in range(1, LENGTH):
        x = alpha[:, j - 1] @ step * local[:, j]
        x /= x.sum(1, keepdims=True)
        alpha[:, j] = np.where(mask[:, j, None] > 0, x, alpha[:, j - 1])
    for j in range(LENGTH - 2, -1, -1):
        x = (beta[:, j + 1] * local[:, j + 1]) @ step.T
        x /= x.sum(1, keepdims=True)
        beta[:, j] = np.where(mask[:, j + 1, None] > 0, x, 1.0)
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    both = alpha[:, :-1, :, None] * step * (local[:, 1:] * beta[:, 1:])[:, :, None, :]
    both /= both.sum((2, 3), keepdims=True)
    pairs = mask[:, 1:] * worth[:, None]
    error = (labels - gamma[:, :, 1]) * mask * worth[:, None]
    return np.concatenate([np.bincount(at, error.ravel()[token], v), [error.sum()], (gold - (both * pairs[:, :, None, None]).sum((0, 1))).ravel()])


def _chunk(sequences: list[tuple[list[list[int]], list[int], float]]) -> tuple:
    n = len(sequences)
    mask, labels = np.zeros((n, LENGTH)), np.zeros((n, LENGTH), int)
    at, token = [], []
    for i, (rows, marks, _) in enumerate(sequences):
        mask[i, : len(rows)] = 1
        labels[i, : len(marks)] = marks
        for j, row in enumerate(rows):
            at += row
            token += [i * LENGTH + j] * len(row)
    worth = np.array([w for *_, w in sequences], float)
    pairs = mask[:, 1:] * worth[:, None]
    gold = np.array([[(pairs * (labels[:, :-1] == a) * (labels[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    return mask, labels, worth, np.array(at, int), np.array(token, int), gold


def fit_field(names: list[str], sequences: list[tuple[list[list[int]], list[int], float]]) -> Field:
    """Maximise the likelihood of (features, labels, weight) under a ridge penalty, by Adam over all sequences."""
    v, total = len(names), sum(w for *_, w in sequences)
    chunks = [_chunk(sequences[i : i + CHUNK]) for i in range(0, len(sequences), CHUNK)]
    theta = np.zeros(v + 5)
    theta[v] = -3.0
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for epoch in range(1, EPOCHS + 1):
        gradient = sum(_step(theta, v, c) for c in chunks) / total - RIDGE * theta
        m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.999 * m2 + 0.001 * gradient**2
        theta += RATE * (m1 / (1 - 0.9**epoch)) / (np.sqrt(m2 / (1 - 0.999**epoch)) + 1e-8)
    weights = {f: float(w) for f, w in zip(names, theta[:v], strict=True) if abs(w) > 1e-3}
    return Field(weights, float(theta[v]), theta[v + 1 :].reshape(2, 2).tolist())


def fit_curve(rows: list[tuple[int, float, float]]) -> tuple[float, float, float]:
    """Logistic regression of labels on (log1p of the sum, maximum) of marginals, by Newton steps with a small ridge."""
    y = np.array([r[0] for r in rows], float)
    x = np.array([[1.0, math.log1p(r[1]), r[2]] for r in rows])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        w += np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * w)
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Field:
    sample = _sample(docs, labels, id_col, text_col, label_col)
    sizes = {bool(r["toxic"]): r["n"] for r in sample.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(True) or not sizes.get(False):
        return Field(curve=(-30.0 if not sizes.get(True) else 30.0, 0.0, 0.0))
    counts = sample.mapInArrow(_count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = lambda c, n: F.log((F.col(c) + 0.5) / (n - F.col(c) + 0.5))
    counts = materialise(counts, "toxic-features")
    odds = counts.where("toxic >= 2").withColumn("odds", share("toxic", sizes[True]) - share("clean", sizes[False]))
    held = counts.where("toxic >= 2").count()
    base = sizes[True] / (sizes[True] + sizes[False])
    found = odds.where(f"odds >= {LEAST_ODDS}").orderBy(F.desc("odds"), F.desc("toxic"), "feature").collect()  # of the sample's words
    rows = [r for r in found if held * _tail(r["toxic"], r["toxic"] + r["clean"], base) <= BY_CHANCE]
    names = {r["feature"]: r["odds"] for r in rows}
    if not names:
        return Field()
    marked = sample.mapInArrow(_sequences(names), "features array<array<int>>, labels array<int>")
    chosen = marked.groupBy("features", "labels").agg(F.count(F.lit(1)).alias("n")).collect()  # distinct ones of the sample
    chosen = sorted((r["features"], r["labels"], r["n"]) for r in chosen)
    model = fit_field(list(names), chosen)

    def gauge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                tokens = (text or "").split()
                out.append(_gauge(model.marginals(len(tokens), model.look_up(tokens))))
            yield pa.record_batch([batch.column(0), *[pa.array([x[k] for x in out], pa.float64()) for k in (0, 1)]], names=["toxic", "total", "most"])

    gauged = sample.mapInArrow(gauge, "toxic int, total double, most double").collect()
    model.curve = fit_curve([(int(r["toxic"] > 0), r["total"], r["most"]) for r in gauged])
    return model


def score(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, spans): spans are the offending (start, length) in code points."""
    plain = (model.weights, model.bias, model.transition, model.curve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*plain)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [own.score(t) for t in part.column(1).to_pylist()]
                spans = [[{"start": a, "length": b} for a, b in x[1]] for x in found]
                yield pa.record_batch([part.column(0), pa.array([x[0] for x in found], pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,length:int>>")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score(docs, train(docs, labels)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "spans",
    )
