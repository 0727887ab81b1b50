"""Clashing names, long texts, empty tables, families of near copies, opaque pages and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import exact_dedup, html_text, line_dedup, mixing, near_dedup, packing, quality, warc

CLASHES = ("id", "sha", "size", "first", "maybe", "number", "kept", "keep_id", "row", "_row", "rate", "_source", "copy", "component", "node", "key", "rid", "of", "n", "_n_words", "_hashes", "text_", "c0", "_dropped", "n_shingles")


def _text(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


@pytest.fixture(scope="module")
def clashing(spark):
    texts = [_text(i % 7, 40) for i in range(12)] + [None, "", _text(99, 12)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    return docs.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])


def _carried(rows):
    for r in rows:
        assert all(r[c] == f"{c}:{r['doc_id']}" for c in CLASHES)


def test_clashing_names(spark, clashing):
    exact = exact_dedup.exact_dedup(clashing)
    kept = exact_dedup.keep_first(clashing)
    assert kept.columns == clashing.columns and kept.count() == 9
    near, one = near_dedup.near_dedup(clashing), near_dedup.keep_one(clashing)
    assert one.columns == clashing.columns and one.count() == 10  # blank texts are linked with nothing
    lines = line_dedup.line_dedup(clashing)
    mixed = mixing.mix(clashing)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    rated = quality.apply_quality(clashing, labels)
    for out in (exact, kept, near, one, lines, mixed, rated):
        rows = out.select("doc_id", *CLASHES).collect()
        _carried(rows)
    assert {c for c in near.columns} - {*clashing.columns} == {"n_shingles_", "component_id", "kept_"}


def test_empty_tables(clashing):
    none = clashing.limit(0)
    for out in (exact_dedup.exact_dedup(none), near_dedup.near_dedup(none), line_dedup.line_dedup(none), mixing.mix(none), packing.pack(none)):
        assert out.count() == 0


def test_long_texts(spark):
    long = _text(5, 4_000)
    docs = spark.createDataFrame([(0, long, "s"), (1, long + " end", "s"), (2, "x" * 100_000, "s"), (3, _text(6, 30), "s")], "doc_id long, text string, source string")
    found = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 3}
    kept = {r.doc_id: r.kept for r in line_dedup.line_groups(docs).collect()}
    assert kept == {0: True, 1: False, 2: True, 3: True}
    labels = spark.createDataFrame([(0, 1), (3, 0)], "doc_id long, quality int")
    assert {r.doc_id: r.n_words for r in quality.apply_quality(docs, labels).collect()} == {0: 4_000, 1: 4_001, 2: 1, 3: 30}
    pieces = packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert all(r["n"] == r["all"] for r in pieces) and len(pieces) == 4
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    index = warc.write_bundles(pages, warc.scratch_path(spark, "warc-test"))
    assert {r.page_id: r.payload_bytes for r in warc.read_bundles(index).collect()} == {0: len(long), 1: len(long) + 4, 2: 100_000, 3: len(_text(6, 30))}


def test_record_ids_differ(spark):
    pages = spark.createDataFrame([(1, "u", "same")] * 3, "page_id long, url string, html string").coalesce(1)
    index = warc.write_bundles(pages, warc.scratch_path(spark, "warc-test"))
    assert index.select("record_id").distinct().count() == 3


@pytest.mark.parametrize("percent", [80, 85])
def test_family_of_near_copies(spark, percent):
    """Members from 0.6 to 0.98 alike: components as by brute force over all pairs."""
    rng, base = random.Random(percent), _text(1, 150).split()
    texts = []
    for i in range(220):
        words = list(base)
        for at in rng.sample(range(150), rng.randint(0, 9)):
            words[at] = f"w{i}x{at}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [near_dedup.shingles(t) for t in texts]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    got = {r.id: r.component for r in near_dedup.near_components(docs, percent).collect()}
    right = sum(got[i] == label[i] for i in got)
    assert len({*label}) > 20 and right >= 0.99 * len(label), (right, len(label))


def test_opaque_pages():
    """No tag or class tells what is what: weights decide, and without them menus stay."""
    para = ["The first paragraph of it is long, and has a comma. It goes on for a while; then it ends.", "Another one follows. It is, as they say, of a similar length, more or less. So be it."] * 4
    body = "".join(f"<p>{p}</p>" for p in para)
    page = f'<div class="k1"><ul><li>Home</li><li>About us</li><li>Contact</li></ul></div><div class="q7">Buy cheap things now.</div><div class="m3"><h2>The title</h2>{body}</div><div class="z9">Some company</div>'
    whole = " ".join(["The title", *para])
    assert html_text.main_text(page) == whole
    try:
        held = html_text.STRONG_MASS, html_text.STRONG_SHARE
        html_text.STRONG_MASS = html_text.STRONG_SHARE = 0.0
        assert html_text.main_text(page) != whole
    finally:
        html_text.STRONG_MASS, html_text.STRONG_SHARE = held


def _pieces(stage, docs, spark, d):
    return dict(corpus_pipeline.STAGES)[stage](spark, docs, d)


def test_pipeline(spark, tmp_path):
    good = [_text(i, 80) for i in range(60)]
    near = [g + " end" for g in good[:10]]
    junk = ["# | #", None, "a b c"]
    texts = good + good[:5] + near + junk
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    d = str(tmp_path)
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = _pieces("quality_rules", docs, spark, d)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and ids == {*range(75)}
    exact = _pieces("exact_dedup", kept, spark, d)
    assert {r.doc_id for r in exact.collect()} == {*range(60), *range(65, 75)}
    alone = _pieces("near_dedup", exact, spark, d)
    assert {r.doc_id for r in alone.collect()} == {*range(60)} and alone.columns == docs.columns
    mixed = _pieces("mixing", alone, spark, d)
    expected = {(r.doc_id, r.copy) for r in mixing.mix(alone).collect()}
    assert mixed.columns == docs.columns and mixed.count() == len(expected)
    packed = _pieces("packing", mixed, spark, d).collect()
    assert sum(r["length"] for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)
    whole = corpus_pipeline.run(spark, d)
    assert whole.agg(F.sum("length")).first()[0] == sum(r["length"] for r in packed)
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in packed)
    assert all(a[1] + a[2] == b[1] if a[0] == b[0] else b[1] == 0 for a, b in zip(places, places[1:]))


def test_revisits_name_the_record_that_holds_their_payload(spark):
    """By the standard's headers alone: a revisit's WARC-Refers-To is in the index, and its record has the payload."""
    long, other = _text(7, 300), _text(8, 300)
    rows = [(i, f"http://x/{i}", long) for i in range(7)] + [(6, "http://x/again", long), (None, "u", long), (20, "v", other), (21, None, other), (22, "w", "short"), (23, "w", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    index = {r.record_id: r for r in warc.write_bundles(pages, warc.scratch_path(spark, "warc-test")).collect()}
    records = {k: warc.BundleReader(r.bundle).record(r.frame, r.offset) for k, r in index.items()}
    revisits = [h for h, _ in records.values() if h["WARC-Type"] == "revisit"]
    assert len(records) == len(rows) and len(revisits) == 8
    for headers in revisits:
        to, block = records[headers["WARC-Refers-To"].strip("<>")]
        assert to["WARC-Type"] == "response" and to["WARC-Payload-Digest"] == headers["WARC-Payload-Digest"] and to["X-Page-ID"] == headers["X-Refers-To-Page-ID"]
        payload = block.partition(b"\r\n\r\n")[2]
        assert warc.base64.b32encode(warc.hashlib.sha1(payload).digest()).decode() == headers["WARC-Payload-Digest"][5:]


def test_bundles_of_another_attempt_are_left_alone(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "v", "b")], "page_id long, url string, html string").coalesce(1)
    folder = warc.scratch_path(spark, "warc-test")
    first, second = warc.write_bundles(pages, folder), warc.write_bundles(pages.orderBy(F.desc("page_id")), folder)
    for index in (first, second):
        assert {(r.page_id, r.payload_bytes) for r in warc.read_bundles(index).collect()} == {(1, 1), (2, 1)}
    assert first.select("bundle").intersect(second.select("bundle")).count() == 0


def test_targets_are_percent_encoded(spark):
    record = warc.render(1, "http://x/a b é", b"", "00" * 20)
    assert "WARC-Target-URI: http://x/a%20b%E2%80%A8é" in record.decode()


def test_near_sets_without_an_id(spark):
    """A row with a null id, or one that is no whole number, has its set's size, no component, and stays."""
    rows = [(1, _text(9, 20)), (None, _text(9, 20)), (None, None), (2, _text(9, 20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(docs).collect())
    assert got == [(0, 0, None, True), (0, 16, None, True), (1, 16, 1, True), (2, 16, 1, False)]
    named = docs.selectExpr("coalesce(cast(doc_id AS string), 'none') AS doc_id", "text")
    assert sorted((r.doc_id, r.n_shingles, r.kept) for r in near_dedup.near_dedup(named).collect()) == [("1", 16, True), ("2", 16, False), ("none", 0, True), ("none", 16, True)]


def test_near_query_without_an_id(spark, tmp_path):
    rows = [(1, _text(9, 20)), (None, _text(9, 24)), (None, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.op9_near_dedup(spark, str(tmp_path)).collect()}
    assert got == {(1, 16, 1, True), (None, 20, None, True), (None, 0, None, True)}
