"""Operators 11 to 13 against brute force: packing, alignment and search on small tables with nulls, ties and odd texts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quern.llm import _words, alignment, best_fit, search

TEXTS = [
    "Hello world, it's ONE  two\n\nthree\tfour", "", None, "a\nb c", " lead and trail ", "Straße naïve ÉCOLE ﬁ é İI Σ", "12345 don't WE'LL",
    "<|endoftext|> plain <|startoftext|>x", "▁odd▁ one", "x" * 3000 + " end", "日本語 テキスト　混在", "a\x01b \x00 c", "same same same", "same same same",
    "tab\tx\x0by z", "\n", "emoji 😀 text", "<s> </s> <0x41>", "a b\n c", "word\r\nnext",
]


def _docs(spark, texts=TEXTS):
    rows = [(i if i != 12 else None, t, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, sequence_id int")


@pytest.fixture(scope="module")
def prose():
    rng = np.random.Generator(np.random.PCG64(5))
    syllables = ["th", "on", "er", "an", "é", "ion", "st", "ou", "Q", "'s"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 5)))
    return [" ".join(word() for _ in range(int(n))) + "." for n in rng.integers(1, 400, 150)]


def test_words_are_encoded_as_whole_texts(prose):
    texts = [t for t in TEXTS if t] + prose
    lower = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = _words.LowerWords("word_bpe_49k.json")(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [lower.encode(t, add_special_tokens=False).ids for t in texts]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    got = _words.BytePairs("byte_bpe_50k.json")(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [plain.encode(f" {t}", add_special_tokens=False).ids for t in texts]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = _words.Pieces("piece_bpe_32k.model")(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [model.encode(t) for t in texts]


def test_vocabulary_of_word_ends_merges_as_the_fast_library_does():
    """Each token with a word's end comes out whole, as the tokenizer gives it, or in the same parts."""
    slow, fast = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), _words.LowerWords("word_bpe_49k.json")
    words = sorted({t.removesuffix("</w>") for t in slow.get_vocab() if t.endswith("</w>") and t.isascii()} - {""})
    got = fast.encode(words)
    want = [e.ids for e in slow.encode_batch(words, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == want


def _plain_bins(lengths, capacity, most):
    """Bounded-space best-fit with lists."""
    open_bins, closed = [], []  # [free, last touched, own pieces]
    for turn, n in enumerate(lengths):
        fits = [b for b in open_bins if b[0] >= n]
        if fits:
            own = min(fits, key=lambda b: (b[0], -b[1]))
        else:
            if len(open_bins) == most:
                fullest = min(open_bins, key=lambda b: (b[0], -b[1]))
                open_bins.remove(fullest)
                closed.append(fullest)
            own = [capacity, turn, []]
            open_bins.append(own)
        own[0], own[1] = own[0] - n, turn
        own[2].append(turn)
        if not own[0]:
            open_bins.remove(own)
            closed.append(own)
    return sorted(b[2] for b in closed), sorted(b[2] for b in open_bins)


@pytest.mark.parametrize("most", [1, 3, 16])
def test_bins_are_bounded_space_best_fit(most):
    rng = np.random.Generator(np.random.PCG64(most))
    lengths = [int(x) for x in rng.integers(1, 65, 500)] + [64, 1, 63, 64]
    bins, closed = best_fit.Bins(64, most), []
    for i, n in enumerate(lengths):
        closed += bins.add((i, 0, 0, n, b""))
        assert len(bins.held) <= most
        assert bins.bits == sum(1 << f for f, own in enumerate(bins.by_free) if own)
    own = lambda x: sorted([p[0] for p in content] for _, content in x)
    assert (own(closed), own(bins.rest())) == _plain_bins(lengths, 64, most)


@pytest.mark.parametrize(("capacity", "most"), [(4096, 256), (32, 2)])
def test_packing_places_every_id_once(spark, prose, capacity, most):
    texts = [*TEXTS, *prose, " ".join(["long"] * 9000)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for t in texts)
    rows = best_fit.pack(_docs(spark, texts).repartition(5), capacity, most).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    got = Counter()
    for own in by_doc.values():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and all(r.length == capacity for r in own[:-1])
        assert [r.start for r in own] == [capacity * k for k in range(len(own))]
        got[tuple(i for r in own for i in np.frombuffer(r.ids, "<u2").tolist())] += 1
    assert got == want
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and sum(r.length for r in own) <= capacity
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= 1.08 * total / capacity + most + 1
    if capacity == 4096:  # tasks' open bins meet once more: at most one sequence is under half full
        assert sum(sum(r.length for r in own) <= capacity // 2 for own in by_sequence.values()) <= 1


def test_packing_query(spark, tmp_path, prose):
    _docs(spark, prose).write.parquet(f"{tmp_path}/documents.parquet")
    rows = best_fit.op11_best_fit(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in rows:
        if r.doc_id is not None:
            ids = tokenizer.encode(prose[r.doc_id], add_special_tokens=False).ids + [1]
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in rows) == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in prose)
    assert best_fit.pack(_docs(spark).limit(0)).count() == 0


def _plain_alignment(texts):
    """Groups and links of each text token by token, and the counts of all pairs."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    letters = _words._byte_letters()
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    bytes_a = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab().items() if all(c in letters for c in t)}
    out = []
    for text in texts:
        ids_a, ids_b = a.encode(f" {text or ''}", add_special_tokens=False).ids, b.encode(text or "")
        own_a = [bytes_a[i] for i in ids_a]
        own_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        raw = f" {text}".encode()
        if not text or b"".join(own_a) != raw or b"".join(own_b) != raw:
            out.append(([], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in own_a]).tolist(), np.cumsum([len(x) for x in own_b]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            first_a, first_b = i, j
            i, j = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((ids_a[first_a:i], ids_b[first_b:j]))
        links = [
            (x, y)
            for x, e, n in zip(ids_a, ends_a, own_a, strict=True)
            for y, f, m in zip(ids_b, ends_b, own_b, strict=True)
            if max(e - len(n), f - len(m)) < min(e, f)
        ]
        out.append((ids_a, ids_b, groups, links))
    return out, Counter(p for x in out for p in x[3])


@pytest.mark.parametrize("head_parts", [1 << 20, 8, 1])
def test_alignment(spark, tmp_path, prose, monkeypatch, head_parts):
    monkeypatch.setattr(alignment, "HEAD_PARTS", head_parts)
    texts = TEXTS + [t[:300] for t in prose[:40]]
    want, counts = _plain_alignment(texts)
    highest: dict[int, int] = defaultdict(int)
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    expected = Counter()
    for i, (ids_a, ids_b, groups, links) in enumerate(want):
        written = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if ids_a else ""
        best = sum(counts[p] == highest[p[1]] for p in links)
        expected[(i if i != 12 else None, len(ids_a), len(ids_b), len(groups), len(links), best, sum(counts[p] for p in links), digest)] += 1
    _docs(spark, texts).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = alignment.op12_alignment(spark, str(tmp_path)).collect()
    got = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows)
    assert got == expected
    assert sum(1 for x in want if not x[0]) >= 3  # null, empty, and one whose bytes differ


def test_alignment_of_a_batch_is_that_of_its_documents(spark, prose, monkeypatch):
    encode = _words.words_of(_words.BothIds, alignment.TOKENIZERS)
    ids = encode.both([*prose, "", *prose[:3]])
    whole = alignment.align_batch(*ids)
    alone = [alignment.align_batch([x], [y]) for x, y in zip(*ids, strict=True)]
    assert whole.links.tolist() == [n for one in alone for n in one.links.tolist()]
    assert whole.n_groups.tolist() == [one.n_groups[0] for one in alone]
    assert whole.groups.tobytes() == b"".join(one.groups.tobytes() for one in alone)
    empty = alignment.align(_docs(spark).limit(0))
    assert empty.count() == 0 and alignment.scored(empty).count() == 0


def test_alignment_of_a_long_text(spark):
    text = "the onesen erblest " * 60_000
    docs = spark.createDataFrame([(1, text), (2, text[:19])], "doc_id long, text string")
    rows = {r.doc_id: r for r in alignment.align(docs).collect()}
    assert rows[1].n_links == len(rows[1].links) // 4 and rows[1].n_a > 59_999 * rows[2].n_links / 2
    assert rows[1].n_groups >= 180_000


def _plain_search(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans(search.UPPER, search.LOWER)
    terms = [(i, term.findall((t or "").translate(lower))) for i, t in docs]
    terms = [(i, own) for i, own in terms if own]
    n, length = len(terms), sum(len(own) for _, own in terms)
    df = Counter(t for _, own in terms for t in set(own))
    out = []
    for item, text in items:
        asked, scores = set(term.findall((text or "").translate(lower))), []
        for i, own in terms:
            tf, m, score = Counter(own), 100 - 90 + (90 * len(own) * n) // length, 0
            for t in asked & tf.keys():
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize(("chunk", "block", "run"), [(1 << 21, 1 << 22, 16), (500, 40, 1), (1, 1 << 22, 3)])
def test_search(spark, prose, monkeypatch, chunk, block, run):
    monkeypatch.setattr(search, "BLOCK_TERMS", block)
    docs = [(i if i != 12 else None, t) for i, t in enumerate([*TEXTS, *prose, prose[3], prose[3]])]
    docs += [(3, "Word WORD wörd"), (5000, " ".join(prose)), (5001, None)]
    items = [(1, prose[3]), (2, prose[7].upper()), (3, None), (4, "no such thing at all"), (5, "same"), (6, "Σ İ ñ tab"), (None, "hello same"), (8, "...")]
    items += [(9, prose[5][:40]), (10, "same")]
    monkeypatch.setattr(search, "CHUNK_TERMS", chunk)
    monkeypatch.setattr(search, "FIRST_RUN", run)
    got = search.search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    rank = lambda x: sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert rank((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == rank(_plain_search(docs, items))


def test_search_stops_early_and_in_ties(spark):
    """One chunk by hand: few entries are read, and equal scores at the threshold are not lost."""
    texts = ["rare common"] * 30 + ["common " * 5 + str(i) for i in range(3000)]
    number = {b"rare": 0, b"common": 1}
    items = search.Items(number, [0], np.array([0, 1]), np.array([2]), np.array([500, 3]), 3030, 30 * 2 + 3000 * 6)
    found, counts, lengths = search._occurrences(number, texts)
    chunk = search.Chunk(items, list(range(len(texts)))[::-1], found, counts, np.array(lengths))
    looked = []
    scores = chunk.scores
    chunk.scores = lambda docs: (looked.extend(docs.tolist()), scores(docs))[1]
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    best = chunk.best(items.terms, none, 10)
    assert best[1].tolist() == list(range(3000, 3010)) and len(set(best[0].tolist())) == 1
    assert len(looked) < 200 and not chunk.seen.any() and not chunk.asked.any()


def test_search_of_empty_tables(spark):
    docs, items = (spark.createDataFrame([(1, "a b")], f"{c} long, text string") for c in ("doc_id", "item_id"))
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0
    assert search.search(docs, items).collect()[0].asDict() == {"item_id": 1, "rank": 1, "doc_id": 1, "score": 2 * 287 * (1_000_000_000 // (1000 + 800))}


def test_best_fit_starts_one_python_worker_a_task(spark):
    from quern.llm.best_fit import op11_best_fit

    plan = op11_best_fit(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # the second round's; the first is written before


def test_remembered_words_are_bounded():
    from quern.llm._words import LowerWords, words_of
    from quern.llm.packing import TOKENIZER, encoder

    assert words_of(LowerWords, "word_bpe_49k.json").most_words <= 500_000
    encode = encoder(TOKENIZER)
    before, encode.most_words = encode.most_words, 100
    texts = [" ".join(f"w{i}x{k}" for k in range(80)) for i in range(6)]
    small = [encode([t])[0] for t in texts]
    assert len(encode) <= 100 + 80
    encode.most_words = before
    assert small == encode(texts)


def test_toxicity_remembers_few_features():
    from quern.llm import toxicity

    assert toxicity._features.cache_info().maxsize <= 1 << 14 and toxicity.CACHE_WORDS <= 200_000
