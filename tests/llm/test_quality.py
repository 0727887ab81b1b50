"""Operator 4's learner and verdict against a plain version, row by row, and its accuracy on rows it hasn't seen."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import quality as Q

FEATURES = ("words", "mean_word_chars", "symbols_per_word")


def _rows(seed, n, noise):
    """Bad rows are short words with many symbols, or very few words; some labels are turned."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = []
    for _ in range(n):
        v = (float(rng.integers(1, 400)), float(rng.integers(20, 90)) / 10, float(rng.integers(0, 40)) / 100)
        bad = v[0] < 40 or (v[1] < 4.5 and v[2] > 0.2)
        out.append((int(bad == (rng.random() < noise)), v))
    return out


def _holds(literal, v):
    x = v[FEATURES.index(literal[0])]
    return x > literal[2] if literal[1] else x <= literal[2]


def _plain(rows):
    """Sequential covering with lists of rows."""
    numbered = [(i, label, v) for i, (label, v) in enumerate(rows)]
    held = {i for i, _, v in numbered if zlib.crc32(repr((i, v)).encode()) % 3 == 0}
    literals = []
    for f, name in enumerate(FEATURES):
        values = sorted({v[f] for _, v in rows})
        cuts = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
        for cut in cuts[:: max(1, -(-len(cuts) // Q.THRESHOLDS))]:
            literals += [(name, True, cut), (name, False, cut)]
    counts = lambda some: (sum(label == 0 for _, label, _ in some), sum(label != 0 for _, label, _ in some))
    covers = lambda rule, some: [r for r in some if all(_holds(x, r[2]) for x in rule)]
    rules, left, failed = [], numbered, set()
    while len(rules) < Q.MAX_RULES and len(failed) < Q.MAX_FAILURES and counts(left)[0] >= Q.LEAST_COVER:
        grown, rows_ = [], [r for r in left if r[0] not in held]
        while len(grown) < Q.MAX_LITERALS and counts(rows_)[1]:
            p0, n0 = counts(rows_)
            if not p0:
                grown = []
                break
            scored = []
            for x in literals:
                p, n = counts(covers([x], rows_))
                if (grown or x not in failed) and p >= Q.LEAST_COVER // 2:
                    scored.append((p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), x))
            best = max((g for g, _ in scored), default=0.0)
            if best <= 1e-9:
                break
            grown.append(next(x for g, x in scored if g == best))
            rows_ = covers([grown[-1]], rows_)
        if not grown:
            break
        kept_out = [r for r in left if r[0] in held]
        worth = {}
        for k in range(1, len(grown) + 1):
            p, n = counts(covers(grown[:k], kept_out))
            worth[k] = (p - n) / (p + n) if p + n else -1.0
        rule = grown[: max(worth, key=lambda k: (worth[k], k))]
        covered = covers(rule, left)
        seen = [r for r in covered if r[0] in held]
        seen = seen if len(seen) >= 3 else covered
        if len(covered) < Q.LEAST_COVER or counts(seen)[0] < Q.LEAST_PRECISION * len(seen):
            failed.add(rule[0])
            continue
        rules.append(rule)
        left = [r for r in left if r not in covered]
    return rules


@pytest.mark.parametrize(("seed", "n", "noise"), [(1, 240, 0.0), (2, 300, 0.05), (3, 200, 0.15), (4, 60, 0.5), (5, 7, 0.0)])
def test_rules_are_those_of_sequential_covering(seed, n, noise):
    rows = _rows(seed, n, noise)
    assert [[(x.feature, x.above, x.threshold) for x in rule] for rule in Q.learn(rows, FEATURES)] == _plain(rows)


def test_rules_hold_on_rows_they_were_not_learned_from():
    rules = Q.learn(_rows(11, 1500, 0.02), FEATURES)
    fresh = _rows(12, 1000, 0.0)
    rejected = lambda v: any(all(_holds((x.feature, x.above, x.threshold), v) for x in rule) for rule in rules)
    right = sum(rejected(v) == (label == 0) for label, v in fresh)
    assert rules and right >= 0.93 * len(fresh)
    assert sum(rejected(v) for label, v in fresh if label == 1) <= 0.03 * len(fresh)  # clean rows stay


def test_verdict_is_the_first_rule_that_holds(spark):
    rules = Q.learn(_rows(21, 600, 0.05), FEATURES)
    rng = np.random.Generator(np.random.PCG64(22))
    counts = [(int(n), int(n * rng.integers(20, 90) / 10), int(n * rng.integers(0, 40) / 100), 0, 0) for n in rng.integers(0, 400, 300)]
    df = spark.createDataFrame(counts, ", ".join(f"_{c} long" for c in Q.COUNTS))
    values = Q.ratios()
    got = df.select(*[values[f].alias(f) for f in FEATURES], Q.verdict(rules).alias("kept")).collect()
    assert len(rules) >= 2 and {r.kept for r in got} == {True, False}
    for r in got:
        v = tuple(r[f] for f in FEATURES)
        assert r.kept == (not any(all(_holds((x.feature, x.above, x.threshold), v) for x in rule) for rule in rules))
    assert df.select(Q.verdict([]).alias("kept")).agg(F.min("kept")).first()[0] is True


def test_labels_of_one_kind_make_no_rules():
    assert Q.learn([(1, v) for _, v in _rows(1, 50, 0)], FEATURES) == [] == Q.learn([], FEATURES)
