"""The corpus operators on small tables: brute force, round trips, nulls, ties, empty tables and clashing names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import chat, exact_dedup, html_text, line_dedup, mixing, near_dedup, packing, quality, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], DOCS)


def _words(seed, n):
    rng = np.random.Generator(np.random.PCG64(seed))
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(n)]


def test_exact(spark):
    rows = [(1, "a  b", 5), (1, "a b", 6), (None, "a\tb", 7), (None, None, 1), (3, "", 2), (4, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = {(r.doc_id, r.text): (r.keep_id, r.group_size, r.kept_) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got[(1, "a  b")] == (1, 3, True) and got[(1, "a b")] == (1, 3, False) and got[(None, "a\tb")] == (1, 3, False)
    assert got[(None, None)] == (3, 2, False) and got[(4, "x")] == (4, 1, True)
    assert sorted(r.doc_id for r in exact_dedup.keep_first(docs).collect()) == [1, 3, 4]
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_mixing(spark):
    docs = _docs(spark, ["x" * 10] * 400, "big").unionByName(_docs(spark, ["y" * 10, None] * 50, None))
    out = mixing.mix(docs, {"big": 1.0}).collect()
    assert all(r.source == "big" for r in out) and 420 < len(out) < 600  # 4500 of 4000 characters
    again = mixing.mix(docs, {"big": 1.0}).collect()
    assert sorted(out) == sorted(again)
    assert mixing.mix(docs.limit(0)).count() == 0
    mean = spark.range(20000).select(mixing.poisson_inverse(F.lit(2.5), mixing.uniform(F.lit(1), F.col("id"))).alias("n"))
    row = mean.agg(F.avg("n").alias("m"), F.var_pop("n").alias("v")).first()
    assert abs(row.m - 2.5) < 0.05 and abs(row.v - 2.5) < 0.12


def test_chat(spark):
    hard = "\\<|end|>\\n<|start|>user<|message|><\\|"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (1, 2, None, None), (2, 0, "user", "q"), (3, 0, "assistant", "é"), (3, 1, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat.format_chats(turns)
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    for conv in (1, 2, 3):
        own = [((r[2] or ""), (r[3] or "")) for r in rows if r[0] == conv]
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        loss = "".join(b for a, b in own if a == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert examples.where("conv_id = 1").count() == 2 and examples.where("conv_id = 3").count() == 2
    assert chat.read_back(chat.format_chats(turns.limit(0))).count() == 0


def _statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    places = defaultdict(list)
    for i in range(len(w) - 4):
        places[tuple(w[i : i + 5])].append(i)
    covered = {p for v in places.values() if len(v) > 1 for i in v for p in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    good = [" ".join(_words(i, 60)) for i in range(120)]
    bad = [" | ".join(_words(1000 + i, 60)) for i in range(60)]
    odd = [None, "", " \n ", "a b c d e f a b c d e x\n\nl\nl\n", "x " * 40, "é" * 3 + "\x0b#"]
    docs = _docs(spark, good + bad + odd).withColumn("kept", F.lit(1))
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(180)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.apply_quality(docs, labels).collect()}
    for i, t in enumerate(good + bad + odd):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _statistics(t), t
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert all(got[i].kept_ for i in range(120)) and not any(got[i].kept_ for i in range(120, 186))
    assert quality.apply_quality(docs.limit(0), labels.limit(0)).count() == 0


def test_toxicity(spark):
    texts = [" ".join(_words(i, 40)) for i in range(200)]
    labels = []
    for i in range(200):
        if i % 4 == 0:
            words = texts[i].split()
            words[7], words[20] = "Vilewort", "vileness,"
            texts[i] = " ".join(words)
        labels.append((i, int(i % 4 == 0)))
    docs = _docs(spark, texts + [None, ""])
    table = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, table)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all((got[i].score >= 0.5) == (i % 4 == 0) for i in range(202) if i != 200)
    assert got[200].score < 0.5 and got[201].score == got[200].score
    span = got[0].spans[0]
    assert texts[0][span.start : span.start + span.length].startswith("Vile")
    assert all(r.score == 0 or r.score < 1e-9 for r in toxicity.score(docs, toxicity.train(docs, table.where("toxic = 0"))).collect())


def test_marginals_are_exact():
    field = toxicity.Field({}, -1.0, [[0.5, -0.3], [0.2, 0.1]])
    emissions, n = {2: 3.0, 9: 1.5}, 14
    step = np.exp(np.array(field.transition))
    local = np.array([[1.0, np.exp(field.bias + emissions.get(i, 0.0))] for i in range(n)])
    alpha, beta = np.zeros((n, 2)), np.ones((n, 2))
    alpha[0] = local[0]
    for i in range(1, n):
        alpha[i] = alpha[i - 1] @ step * local[i]
    for i in range(n - 2, -1, -1):
        beta[i] = step @ (local[i + 1] * beta[i + 1])
    exact = (alpha * beta)[:, 1] / (alpha * beta).sum(1)
    for place, p in field.marginals(n, emissions).items():
        assert abs(p - exact[place]) < 1e-9, place


def test_lines(spark):
    base = " ".join(_words(1, 30))
    docs = _docs(spark, [f"{base}\nother line here", f"x\n{base.upper()}  \nx", base[:-1] + "q", None, "", "\n\n"])
    rows = line_dedup.line_groups(docs).collect()
    got = {(r.doc_id, r.line_no): r.kept for r in rows}
    assert got == {(0, 0): True, (0, 1): True, (1, 0): True, (1, 1): False, (1, 2): False, (2, 0): got[(2, 0)]}
    out = {r.doc_id: (r.text, r.n_dropped_lines) for r in line_dedup.line_dedup(docs).collect()}
    assert out[1] == ("x", 2) and out[3] == (None, 0) and out[5] == ("\n\n", 0)
    assert line_dedup.line_groups(docs.limit(0)).count() == 0


def test_fuzzy_lines_against_brute_force(spark):
    vocabulary, rng = _words(5, 3000), np.random.default_rng(5)
    lines, pairs = [], []
    for n, changed in ((2, 0), (3, 0), (8, 1), (12, 1), (20, 1), (20, 2), (40, 1), (100, 3)):
        for _ in range(30):
            a = [str(w) for w in rng.choice(vocabulary, n)]
            b = list(a)
            for i in rng.choice(n, changed, replace=False):
                b[i] = str(rng.choice(vocabulary))
            a, b = " ".join(a), " ".join(b)
            b = b if changed else b[:-2] + "#" + b[-1:]
            if a != b and _edits(a, b) * 100 <= 20 * max(len(a), len(b)):
                pairs.append((len(lines), len(lines) + 1))
                lines += [a, b]
    assert len(pairs) > 150
    first = {r.doc_id: r.first_doc_id for r in line_dedup.line_groups(_docs(spark, lines)).collect()}
    missed = [lines[a] for a, b in pairs if first[a] != first[b]]
    assert len(missed) <= 0.02 * len(pairs), missed
    assert not [x for x in missed if len(x) < line_dedup.TINY]


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_html():
    page = '<div class="menu">a b</div><article><h1>T &amp; U</h1><p>One <b>tw</b>o, three. <p>Four<div class=comments>x</div></article><footer>f</footer>'
    assert html_text.main_text(page) == "T & U One two, three. Four"
    assert [html_text.main_text(x) for x in (None, "", " ", "<p>", "<script>x</script>")] == [""] * 5
    assert html_text.main_text("<p>cut <a hre") == "cut"


def test_html_class_words():
    for name in ("post category-news tag-python", "site has-sidebar", "layout no-sidebar", "no-comments post", "article-body social-policy", "legal-news"):
        for tag in ("div", "article", "section"):
            assert html_text.main_text(f'<{tag} class="{name}"><p>The text.</p></{tag}>') == "The text.", (tag, name)
    assert html_text.main_text('<article class="related"><p>The text.</p></article>') == "The text."
    assert html_text.main_text('<div class="widget"><p>Most of the text of the page.</p></div><p>.</p>').startswith("Most of the text")
    assert html_text.main_text('<div class="ad">More text than the article has.</div><article><p>Text.</p></article>') == "Text."
    assert html_text.main_text('<div class="widget"><main><p>Text.</p></main></div><p hidden>x</p>') == "Text."
    page = '<p>The text of the page, long enough.</p>'
    for name in ("ad", "x site-footer", "main_menu", "navbar", "social-share"):
        assert html_text.main_text(f'<div class="{name}">a b</div>{page}') == "The text of the page, long enough.", name


def test_html_without_article():
    long = "A long text, with signs. " * 40
    whole = " ".join(f"Title lead {long}".split())
    assert html_text.main_text(f"<body><h1>Title</h1><p>lead</p><div><p>{long}</p></div></body>") == whole
    split = f"<body><section><p>{long}</p></section><div><p>A short part.</p></div></body>"
    assert html_text.main_text(split) == " ".join(f"{long} A short part.".split())
    assert html_text.main_text(f"<body><nav>x</nav><h1>Title</h1><div><p>lead</p><div><p>{long}</p></div></div></body>") == whole


def test_warc(spark, tmp_path):
    rows = [(1, "u\n", None), (2, None, "x" * 1000), (3, "h", "x" * 1000), (None, "h", "x" * 1000), (4, "h", "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write_bundles(pages, f"file://{tmp_path}/a")
    got = {r.page_id: r for r in warc.read_bundles(index).collect()}
    for i, _, text in rows:
        payload = (text or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
    assert {i: got[i].refers_to for i in got} == {1: None, 2: 3, 3: None, None: 3, 4: None}
    for r in index.collect():
        assert warc.BundleReader(r.bundle).record(r.frame, r.offset)[0]["WARC-Record-ID"] == f"<{r.record_id}>"
    assert warc.read_bundles(warc.write_bundles(pages.limit(0), f"file://{tmp_path}/b")).count() == 0


def test_near(spark):
    texts = []
    for g in range(12):
        words = _words(g, 120)
        for c in range(5):
            own = list(words)
            for k in range(c):
                own[(17 * k + 31 * c) % 120] = f"new{g}{c}{k}"
            texts.append(" ".join(own))
    texts += [texts[0].upper(), None, "", "a b", "A  b", "a b c"]
    sets = []
    for t in texts:
        w = [x.lower() for x in (t or "").split()]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((top[i], top[j]))
                top = [a if x == b else x for x in top]
    got = {r.id: r for r in near_dedup.near_components(_docs(spark, texts), 85).collect()}
    assert [got[i].component for i in range(len(texts))] == top
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert sorted(r.doc_id for r in near_dedup.keep_one(_docs(spark, texts), 85).collect()) == sorted(set(top))


def test_jaccard_estimate():
    rng = np.random.Generator(np.random.PCG64(5))
    items = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = items[:2000], items[500:2500]
    ra, rb = (near_dedup.registers(near_dedup.minima(x))[None] for x in (a, b))
    assert abs(near_dedup.jaccard_estimate(ra, rb, np.array([2000.0]), np.array([2000.0]))[0] - 0.6) < 0.12


def test_packing(spark):
    from tokenizers import Tokenizer

    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    texts = [None, "", "a  b\n\nc", "x<|endoftext|>y z", " lead", "tab\tx", *[" ".join(_words(i, 300)) for i in range(30)]]
    docs = _docs(spark, texts, "s").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "big").when(F.col("doc_id") == 4, None).otherwise("small"))
    pieces, places = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs).collect():
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at & (at - 1) == 0
    assert packing.pack(docs.limit(0)).count() == 0


def test_schedule_fills_windows_to_target():
    plan = packing.schedule([300_000, 100_000, 7], [0.5, 0.5, 0.0])
    first = Counter()
    for q in (0, 1):
        for sequence, _, length in plan.pieces(q, 0, 50_000):
            if sequence < 20:
                first[q] += length
    assert abs(first[0] - first[1]) <= 20


@pytest.mark.parametrize("weighted", [True, False])
def test_packing_gives_each_of_many_sources_its_share(spark, weighted):
    pytest.importorskip("public_tokenizers")
    docs = _docs(spark, [" ".join(_words(i, 60)) for i in range(1200)]).withColumn("source", F.concat(F.lit("d"), F.col("doc_id") % 150))
    weights = {f"d{k}": float(1 + k % 2 * 3) for k in range(149)} if weighted else None  # d149 has none
    rows = packing.pack(docs, weights).collect()
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())
    spans = defaultdict(list)
    for r in rows:
        spans[r.sequence_id].append((r.offset, r.length))
    for x in spans.values():
        ends = [0]
        for offset, length in sorted(x):
            assert offset == ends[-1]
            ends.append(offset + length)
    early, total = Counter(), 0
    for r in rows:
        if r.sequence_id < 32:
            early[f"d{r.doc_id % 150}"] += r.length
            total += r.length
    assert total == 32 * packing.WINDOW
    held = Counter()
    for d, n in {r.doc_id: r.doc_tokens for r in rows}.items():
        held[f"d{d % 150}"] += n
    share = weights or held
    for k in range(150):
        want = share.get(f"d{k}", 0) / sum(share.values()) * total
        assert abs(early[f"d{k}"] - want) <= 12 + 0.03 * want, (k, early[f"d{k}"], want)


def test_plan_recurses_and_honours_tail_weights():
    totals = {f"s{k:05}": 40 + k % 7 for k in range(5000)}
    made = packing.plan(totals, {"s04999": 1.0})
    seen = np.zeros(sum(totals.values()), int)
    for s, n in totals.items():
        for sequence, offset, length in made.pieces(s, 0, n):
            at = made.outer.place(sequence, offset)
            seen[at : at + length] += 1
    assert (seen == 1).all()
    assert [x[0] for x in made.pieces("s04999", 0, totals["s04999"])] == [0]


def test_edits_without_common_ends(spark):
    """Leaving out common words at both ends changes no edit distance; word by word there are never fewer edits."""
    import random

    from quern.llm import line_dedup

    deal = random.Random(4)
    words = ["a", "ab", "abc", "b", "ba"]
    lines = [" ".join(deal.choices(words, k=deal.randint(1, 7))) for _ in range(60)] + ["ab ab", "ab ab ab", "x"]
    rows = [(i, i, j, s, t) for i, s in enumerate(lines) for j, t in enumerate(lines) if i != j]
    pairs = spark.createDataFrame([(r[1], r[2]) for r in rows], "a long, b long")
    texts = spark.createDataFrame(list(enumerate(lines)), "uid long, norm string")
    whole = spark.createDataFrame(rows, "k long, a long, b long, s string, t string").selectExpr("a", "b", "s", "t", "levenshtein(s, t) as d")
    for exact in (True, False):
        compared = line_dedup._compared(pairs, texts, 1, exact).join(whole, ["a", "b"]).collect()
        assert len(compared) == len(rows)
        for r in compared:
            within = r["d"] <= r["allowed"]
            assert (r["edits"] == r["d"] if exact else r["d"] <= r["edits"] <= r["allowed"]) if within else r["edits"] == -1


def test_edits_of_long_lines_between_common_places(spark):
    """Edits between places where both lines say the same are never fewer than they are, and seldom more where lines may match."""
    import random

    from quern.llm import line_dedup

    deal, rows = random.Random(7), []
    vocabulary = _words(7, 400) + ["\u00e9t\u00e9", "\u00df", "\u4e2d\u6587", "\U0001f600x"]
    for n, rate in [(n, r) for n in (22, 60, 200) for r in (0.02, 0.1, 0.2, 0.3, 1)] * 4:
        a = [str(deal.choice(vocabulary)) for _ in range(n)]
        b = [x for w in a for x in ([w] if deal.random() > rate else deal.choice([[], [str(deal.choice(vocabulary))], [w, str(deal.choice(vocabulary))]]))]
        rows.append((2 * len(rows), 2 * len(rows) + 1, " ".join(a), " ".join(b)))
    pairs = spark.createDataFrame([r[:2] for r in rows], "a long, b long")
    texts = spark.createDataFrame([x for r in rows for x in ((r[0], r[2]), (r[1], r[3]))], "uid long, norm string")
    whole = spark.createDataFrame(rows, "a long, b long, s string, t string").selectExpr("*", "levenshtein(s, t) as d")
    both = whole.withColumn("most", F.floor(F.greatest(F.length("s"), F.length("t")) * 0.2).cast("int"))
    near = 0
    for r in both.withColumn("n", line_dedup._by_places(F.col("s"), F.col("t"), F.col("most"))).collect():
        assert r.n >= r.d or r.n > r.most
        near += r.d <= r.most and r.n <= 1.1 * r.d + 3
    found = line_dedup._compared(pairs, texts).join(whole, ["a", "b"]).collect()
    for r in found:
        assert r.d <= r.edits <= r.allowed if r.d <= r.allowed else r.edits == -1, (r.d, r.edits, r.allowed)
    hits = [r for r in found if r.d <= r.allowed]
    assert len(found) == len(rows) and len(hits) > 20 and near > 0.9 * len(hits)
    for r in line_dedup._compared(pairs, texts, 2, exact=True).join(whole, ["a", "b"]).collect():
        assert r.edits == (r.d if r.d <= 2 * r.allowed else -1)


def test_line_signatures_stay_where_their_texts_are(spark):
    """A signature holds 80 bytes of numbers, not its keys, and is made without a shuffle of its sums and minima."""
    lines = [" ".join(_words(n, 5 + n)) for n in range(40)] + ["ab", "Ä b\u00e7"]
    texts = spark.createDataFrame([(i, len(x), x) for i, x in enumerate(lines)], "cid long, n_chars int, norm string").repartition(4, "cid")
    for grams in line_dedup._grams(texts):
        made = line_dedup._slim(line_dedup.signatures(grams))
        assert made.columns == ["cid", "kind", "n_chars", "sim", *[f"p{i}" for i in range(line_dedup.BINS // 2)]]
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1  # that of the texts
        hashes = {}
        for r in grams.collect():
            hashes.setdefault(r.cid, []).append(r.h)
        for r in made.collect():
            own = hashes[r.cid]
            sim = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in own) > len(own))
            least = [min(h ^ (((i << 60) ^ (i * 0x9E3779B97F4A7)) - (1 << 64 if i >= 8 else 0)) for h in own) & line_dedup.HALF for i in range(line_dedup.BINS)]
            assert r.sim & (1 << 64) - 1 == sim
            assert [x >> s & line_dedup.HALF for x in (r[f"p{i}"] for i in range(line_dedup.BINS // 2)) for s in (0, 32)] == least


def test_normal_form_of_lines(spark):
    texts = [" A  b\tc ", "\u00c4\x0b\x0cB", "a b", "\r", "", None, "x\u00a0 y", "a \t"]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(line_dedup.normalise(F.col("t")).alias("n")).collect()]
    assert got == ["a b c", "\u00e4 b", "a b", "", "", None, "x\u00a0 y", "a"]


def test_lines_are_compared_in_bounded_batches(spark, monkeypatch):
    """No table of texts holds more lines than a batch of pairs has, and all pairs are compared as at once."""
    from quern.session import materialise

    pairs = materialise(spark.range(0, 400, 2, 2).selectExpr("id as a", "id + 1 as b"), "pairs")
    texts = materialise(spark.range(0, 400, 1, 3).selectExpr("id as uid", "concat(repeat('a', int(id % 40)), 'bcd', id) as norm"), "texts")
    at_once = sorted(line_dedup._compared(pairs, texts).collect())
    assert len(at_once) == 200
    sizes = []

    def noted(df, name):
        out = materialise(df, name)
        sizes.extend([out.count()] if name == "line-texts" else [])
        return out

    monkeypatch.setattr(line_dedup, "materialise", noted)
    monkeypatch.setattr(line_dedup, "FEW_PAIRS", 50, raising=False)
    assert sorted(line_dedup._compared(pairs, texts).collect()) == at_once
    # batches are dealt by hash, so one may be a little larger
    assert len(sizes) == 4 and sum(sizes) == 400 and max(sizes) < 200


def test_pairs_of_open_buckets_come_in_bounded_batches(spark, monkeypatch):
    """A large bucket is split too; together the batches have each pair of different components once."""
    rows = [(key, (cid, 100), cid // 2, 10 * key) for key in range(3) for cid in range(10 * key, 10 * key + 30)]
    placed = spark.createDataFrame(rows, "key long, me struct<cid: long, n_chars: int>, component long, main long")
    labels = spark.createDataFrame([(cid, cid // 2) for cid in range(50)], "node long, component long")
    seen = spark.createDataFrame([], "a long, b long, allowed int, edits int")
    monkeypatch.setattr(line_dedup, "FEW_PAIRS", 200, raising=False)
    batches = [sorted(batch.collect()) for batch in line_dedup._cross(placed, labels, seen, 200)]
    assert len(batches) > 3 and max(map(len, batches)) < 600
    of = [range(10 * key, 10 * key + 30) for key in range(3)]
    assert sorted(tuple(x) for batch in batches for x in batch) == sorted({(x, y) for r in of for x in r for y in r if x < y and x // 2 != y // 2})
