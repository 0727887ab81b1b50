"""Balanced parts and bootstrap, against plain versions."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from quern.operators import balance as B
from quern.operators import resampling as R


def _differenced(work, parts, equal):
    """Largest differencing by sorted lists of states, each a list of parts."""
    order = sorted((w, i) for i, w in enumerate(work))
    size = parts if equal else 1
    key = lambda part: (sum(w for _, w in part), len(part), part)
    states = []
    for k in range(0, len(order), size):
        own = [[(i, w)] for w, i in order[k : k + size]]
        states.append(sorted(own + [[] for _ in range(parts - size)], key=key, reverse=True))
    while len(states) > 1:
        states.sort(key=lambda s: (key(s[0])[0] - key(s[-1])[0], key(s[0])), reverse=True)
        a, b = states.pop(0), states.pop(0)
        states.append(sorted((x + y for x, y in zip(a, reversed(b), strict=True)), key=key, reverse=True))
    return [sorted(i for i, _ in part) for part in states[0]]


@pytest.mark.parametrize("equal", [True, False])
@pytest.mark.parametrize("parts", [1, 2, 4, 8])
def test_largest_differencing(parts, equal):
    rng = np.random.Generator(np.random.PCG64(parts))
    for work in (rng.integers(1, 2000, 64).tolist(), rng.integers(1, 4, 48).tolist(), [5] * 16, list(range(1, 9)), [0, 0, 0, 0, 0, 0, 0, 9]):
        found = B.largest_differencing(work, parts, equal)
        assert found == _differenced(work, parts, equal)
        assert sorted(i for own in found for i in own) == list(range(len(work)))
        assert not equal or {len(own) for own in found} == {len(work) // parts}
    with pytest.raises(ValueError):
        B.largest_differencing([1, 2, 3], 2, True)
    with pytest.raises(ValueError):
        B.largest_differencing([1], 2, False)


def test_differencing_is_closer_than_dealing_there_and_back():
    work = [B.workload(int(n)) for n in np.random.Generator(np.random.PCG64(1)).integers(10, 2000, 512)]
    spread = lambda parts: max(s := [sum(work[i] for i in own) for own in parts]) - min(s)
    order = sorted(range(512), key=lambda i: -work[i])
    snake = [[i for k, i in enumerate(order) if (k % 16 if k % 16 < 8 else 15 - k % 16) == p] for p in range(8)]
    assert spread(B.largest_differencing(work, 8, True)) < spread(snake) / 10


def test_greedy():
    assert B.greedy([5, 3, 3, 1], 2, False) == [[0, 3], [1, 2]] and B.greedy([5, 1, 1, 1], 2, True) == [[0, 3], [1, 2]]
    with pytest.raises(ValueError):
        B.greedy([1, 2, 3], 2, True)


def test_order_of_parts():
    work = [9, 1, 5, 7, 3]
    assert B.zigzag(work, [0, 1, 2, 3, 4]) == [1, 2, 0, 3, 4]
    sums = [sum([10, 20, 30, 40, 50, 60][i] for i in own) for own in B.micro_batches([10, 20, 30, 40, 50, 60], 6)]
    assert sums == [20, 40, 60, 50, 30, 10]


def test_batches_are_dealt_apart(spark):
    rng = np.random.Generator(np.random.PCG64(7))
    rows = [(int(i // 32), int(i), int(n)) for i, n in enumerate(rng.integers(10, 900, 96))]
    df = spark.createDataFrame(rows, "batch long, id long, n long").repartition(5)
    by_batch = defaultdict(list)
    for b, _, n in rows:
        by_batch[b].append(n)
    got = defaultdict(list)
    for r in B.ranked(df, "batch", "id", "n", 4).orderBy("batch", "part", "place").collect():
        got[r.batch, r.part].append(r.key - 32 * r.batch)
    for b, lengths in by_batch.items():
        work = [B.workload(n) for n in lengths]
        assert [got[b, p] for p in range(4)] == [B.zigzag(work, own) for own in _differenced(work, 4, True)]
    capped = B.capped(df, "batch", "id", "n", 2000, least=2, multiple=3).collect()
    assert {(r.batch, r.part) for r in capped} == {(b, p) for b, x in by_batch.items() for p in range(-(-max(2, -(-sum(x) // 2000)) // 3) * 3)}
    assert B.balanced(df.limit(0), "batch", "id", "n", 4).count() == 0
    assert Counter(r.part for r in B.greedily(df, "batch", "id", "n", 4, True).collect()) == Counter({p: 24 for p in range(4)})


def _drawn(values, votes, size, draws, seed):
    """Draw after draw, as lists."""
    state, out = np.random.RandomState(seed), defaultdict(list)
    for _ in range(draws):
        own = [int(i) for i in state.choice(len(values), size=size, replace=True)]
        x = [values[i] for i in own]
        seen = Counter()
        for i in own:
            seen[votes[i]] += 1
        vote = max(seen, key=seen.get)
        out["best"].append(max(x))
        out["worst"].append(min(x))
        out["mean"].append(np.mean(x))
        out["maj"].append(next(values[i] for i in own if votes[i] == vote))
    return {k: (np.mean(v), np.std(v)) for k, v in out.items()}


def test_bootstrap(spark):
    rng = np.random.Generator(np.random.PCG64(8))
    rows = [(p, k, float(rng.integers(0, 5)), "abc"[rng.integers(0, 3)]) for p, n in ((1, 8), (2, 5), (3, 1), (4, 2)) for k in range(n)] + [(2, 9, None, "a"), (5, 0, None, "b")]
    df = spark.createDataFrame(rows, "p long, k long, x double, v string").repartition(3)
    got = {(r.p, r.reducer, r["size"]): (r["mean"], r["std"]) for r in R.bootstrap(df, ["p"], "x", "k", (), ("best", "worst", "mean"), "v", 200, 11).collect()}
    want = {}
    for p in (1, 2, 4):
        values, votes = zip(*[(x, v) for q, _, x, v in rows if q == p and x is not None], strict=True)
        for size in R.sizes_of(len(values)):
            want |= {(p, name, size): pair for name, pair in _drawn(values, votes, size, 200, 11).items()}
    assert got.keys() == want.keys()
    for k, pair in want.items():
        assert got[k] == pytest.approx(pair, abs=1e-12)
    with pytest.raises(ValueError):
        R.bootstrap(df, ["p"], "x", "k", (), ("mode",))
    fixed = R.bootstrap(df, ["p"], "x", "k", (3,), ("median", "std", "sum"), None, 50).collect()
    assert {r.p for r in fixed} == {1, 2, 3, 4} and {r.reducer for r in fixed} == {"median", "std", "sum"}


def test_validation(spark):
    rows = [("s", 1, 0, 1.0, "a"), ("s", 1, 1, 0.0, "b"), ("s", 1, 2, 1.0, "a"), ("s", 2, 0, 0.5, "c"), (None, 3, 0, 2.0, None), (None, 3, 1, 4.0, None)]
    df = spark.createDataFrame(rows, "src string, uid long, k long, x double, v string")
    got = {(r.src, r.metric): r.value for r in R.validation(df, "src", "uid", "x", "k", "v").collect()}
    assert got["s", "mean@3"] == pytest.approx(2 / 3) and got["s", "mean@1"] == 0.5 and ("s", "std@1") not in got and got[None, "std@2"] == 1.0
    drawn = _drawn([1.0, 0.0, 1.0], ["a", "b", "a"], 2, 1000, 42)
    for name in ("best", "worst", "maj"):
        assert (got["s", f"{name}@2/mean"], got["s", f"{name}@2/std"]) == pytest.approx(drawn[name], abs=1e-12)
    assert got[None, "maj@2/mean"] == pytest.approx(got[None, "best@2/mean"] / 2 + got[None, "worst@2/mean"] / 2, abs=0.2)
