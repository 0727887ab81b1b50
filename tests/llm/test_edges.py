"""Very long texts, ties, repeated rows and empty tables, for operators that other tests leave out."""

import hashlib

import numpy as np
import pytest

from quern.llm import chat, exact_dedup, mixing, packing, quality, toxicity, warc

LONG = "a long text with words, " * 12_000  # 288,000 characters


def test_exact_dedup_of_long_and_repeated_rows(spark):
    rows = [(5, LONG), (5, LONG), (3, LONG.replace(" ", "  ")), (9, LONG + "x"), (7, None), (6, "")]
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3, 3, True), (5, 3, 3, False), (5, 3, 3, False), (6, 6, 2, True), (7, 6, 2, False), (9, 9, 1, True)]


def test_mixing_of_long_and_repeated_rows(spark):
    rows = [(i % 3, LONG if i % 2 else "short", "s", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate int")
    out = mixing.mix(docs, {"s": 1.0}).collect()
    assert out and {r.text for r in out} <= {LONG, "short"} and all(r.rate == 1 for r in out)
    assert sorted(out) == sorted(mixing.mix(docs, {"s": 1.0}).collect())


def test_chats_of_long_turns_and_ties(spark):
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", LONG + "\\<"), (2, 0, "assistant", "same"), (2, 1, "assistant", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(turns)).collect()}
    assert got[1].loss_sha256 == hashlib.sha256((LONG + "\\<").encode()).hexdigest() and got[1].loss_chars == len(LONG) + 2
    assert (got[2].n_turns, got[2].loss_sha256) == (2, hashlib.sha256(b"samesame").hexdigest())
    assert chat.read_back(chat.format_chats(turns.limit(0))).count() == 0


def test_quality_counts_of_long_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, LONG), (1, LONG), (2, "one " * 9)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.apply_quality(docs, labels).collect()
    long = [r for r in rows if r.doc_id == 1]
    assert len(long) == 2 and long[0] == long[1] and (long[0].n_words, long[0].n_repeat_words, long[0].base_failed) == (60_000, 60_000, True)


def test_toxicity_of_long_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, LONG), (1, LONG), (2, None), (3, "")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    scores = [(r.doc_id, r.score) for r in toxicity.score(docs, model).collect()]
    assert sorted(d for d, _ in scores) == [1, 1, 2, 3] and all(s < 0.5 for _, s in scores)
    assert toxicity.score(docs.limit(0), model).count() == 0
    nothing = toxicity.train(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, nothing).count() == 4


def test_archives_of_long_and_repeated_pages(spark):
    rows = [(1, "u", LONG), (2, "v", LONG), (2, "v", LONG), (3, "w", "tiny"), (4, "w", "tiny")]
    index = warc.write_bundles(spark.createDataFrame(rows, "page_id long, url string, html string"), warc.scratch_path(spark, "warc-test"))
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_bundles(index).collect())
    size = len(LONG)
    assert got == [(1, "revisit", 2, size), (2, "response", None, size), (2, "response", None, size), (3, "response", None, 4), (4, "response", None, 4)]


@pytest.mark.parametrize("weights", [None, {"a": 1.0, "b": 1.0}])
def test_packing_of_long_and_repeated_rows(spark, weights):
    rows = [(1, LONG, "a"), (1, LONG, "a"), (2, "short", "b"), (None, None, None)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights).collect()
    by_sequence: dict = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist() and sum(n for _, n in own) <= packing.WINDOW
    tokens = {(p.doc_id, p.doc_tokens) for p in pieces}
    assert len({n for d, n in tokens if d == 1}) == 1
    assert sum(p.length for p in pieces) == 2 * max(n for _, n in tokens) + sum(n for d, n in tokens if d != 1)
