"""Operator 7 on the given pages, on the same pages without telling names, and with comments of readers."""

import random
import re

import duckdb
import pytest

from quern.llm import html_text

RENAMED = {"article": "x1", "nav": "x2", "footer": "x3", "header": "x4", "aside": "x5", "section": "x6"}


@pytest.fixture(scope="module")
def pages():
    return [h or "" for (h,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()]


def _article(page):
    """The text between the tags of the article, with blocks at h1 and p."""
    inner = page.split("<article>", 1)[1].split("</article>", 1)[0]
    blocks = [html_text.html_entities.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b))) for b in re.split(r"</?(?:h1|p)\b[^>]*>", inner)]
    return " ".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def _opaque(page):
    for tag, name in RENAMED.items():
        page = re.sub(rf"<{tag}(?=[ >])", f'<div class="{name}"', page).replace(f"</{tag}>", "</div>")
    return page.replace('class="ad"', 'class="x7"')


def _commented(page, text):
    draw, words = random.Random(len(page)), text.split()
    comments = "".join(f"<div class=\"y8\"><p>{' '.join(draw.choices(words, k=12))}. {' '.join(draw.choices(words, k=6))}.</p></div>" for _ in range(2))
    at = page.rfind('<div class="x3"')
    return f'{page[:at]}<div class="y9">{comments}</div>{page[at:]}'


def test_given_pages(pages):
    assert [html_text.main_text(p) for p in pages] == [_article(p) for p in pages]


def test_weights_decide_on_the_given_pages(pages, monkeypatch):
    """Without thresholds menus and adverts stay; without the prior of marked elements some do."""
    whole = [html_text.main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "STRONG_SHARE", 0.0)
    monkeypatch.setattr(html_text, "STRONG_MASS", 0.0)
    monkeypatch.setattr(html_text, "LEAST_SHARE", 0.0)
    monkeypatch.setattr(html_text, "LEAST_HOME", 0.0)
    assert sum(html_text.main_text(p) != w for p, w in zip(pages, whole, strict=True)) > 0.9 * len(pages)
    monkeypatch.undo()
    monkeypatch.setattr(html_text, "MARKED_PRIOR", 1.0)
    assert any(html_text.main_text(p) != w for p, w in zip(pages, whole, strict=True))


def test_pages_without_telling_names(pages):
    """The thresholds were chosen on pages of even number of a larger table; these are of odd number."""
    some = [(p, _article(p)) for p in pages[1::2]]
    assert sum(html_text.main_text(_opaque(p)) == t for p, t in some) >= 0.95 * len(some)


def test_comments_of_readers(pages):
    """Paragraphs in a container of their own go where the article is longer than they are."""
    some = [(p, t) for p in pages[1::2] if len(t := _article(p)) > 1500]
    assert len(some) > 30
    assert sum(html_text.main_text(_commented(_opaque(p), t)) == t for p, t in some) >= 0.95 * len(some)


def test_links_and_notices():
    text = "A paragraph of the article, with some length. It has two sentences."
    linked = '<div class="k"><p><a href="/x">A list of links, which is as long as the text is. It has two.</a></p></div>'
    assert html_text.main_text(f'{linked}<div class="m"><p>{text}</p><p>{text}</p></div>') == f"{text} {text}"
    assert html_text.main_text(f'<div class="m"><p>{text}</p><p>{text}</p><p>© 2024 Someone. All rights, as they say, are kept.</p></div>') == f"{text} {text}"
    assert html_text.main_text(f'<article><p>{text}</p><ul><li>one</li><li>b</li></ul><aside>More to read, here.</aside></article>') == f"{text} one b"


def test_long_and_repeated_pages(spark):
    long = "Some words of a sentence, and more. " * 20_000
    pages = spark.createDataFrame([(1, "u", f"<p>{long}</p>"), (1, "u", f"<p>{long}</p>"), (None, None, None)], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.n_chars) for r in html_text.extract(pages).collect())
    assert got == [(0, 0), (1, len(long) - 1), (1, len(long) - 1)]
    assert html_text.extract(pages.limit(0)).count() == 0
