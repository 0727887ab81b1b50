"""Operator 7, HTML extraction: tag-path ratios.

A page's text nodes are grouped by their root-to-leaf tag path, a tag with another class being another step. Each path
has the ratios of its text length and of its punctuation to its number of nodes; both are smoothed along the page, so that
a short node among long ones gains, and fused into one weight per path, less the share of its text that is links. Tags, roles and words of
classes that mark navigation, headers, footers, adverts, comments and so on are a prior that lowers a weight; a named article
raises it. Paths over STRONG_SHARE of the page's mean weight and STRONG_MASS of its text are strong. What holds them is the article:
their parents, and named articles around them, if these hold LEAST_HOME of what the largest does. Other paths stay inside the
article, or as headings and paragraphs of what encloses it, with no class between, from LEAST_SHARE of the mean weight on. Scripts, styles, forms and
hidden elements are no text at all.

Defined cases: null, empty and white-space pages, and pages without any text, give an empty text; broken markup (tags
never closed, text after a cut-off tag) is read as far as it goes; a null id or url is carried; repeated rows are
extracted each; an empty table gives an empty result. Added columns whose names are taken get a trailing underscore.
"""

from __future__ import annotations

import html as html_entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Least weight of a path inside the article, against the page's mean.
LEAST_SHARE = 0.015
#: Least weight, and weight times text, of a strong path, against the page's mean and sum.
STRONG_SHARE, STRONG_MASS = 0.5, 0.2
#: Least mass of a container, against the largest, for it to be a part of the article.
LEAST_HOME = 0.35
#: Weights of a node's neighbours, one and two places away, against its own in smoothing.
KERNEL = (0.35, 0.1)
#: What a marked element does to the weights in it, and what a named article does.
MARKED_PRIOR, NAMED_BONUS = 0.01, 4.0

# fixed values: tags of HTML by role, and words that mark boilerplate
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
SKIPPED = frozenset(
    "head title script style noscript template form button select option textarea iframe object svg canvas audio video dialog input".split()
)
BOILERPLATE = frozenset("nav header footer aside menu".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe")
ARTICLE = frozenset("article main".split())
MARKED = re.compile(
    r"ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|side|aside|footer|foot|header|"
    r"masthead|comments?|replies|reply|disqus|cookies?|consent|notices?|alert|popup|modal|overlay|share|sharing|social|related|"
    r"recommend\w*|newsletter|subscribe|subscription|login|signup|search|widget|toolbar|pagination|pager|tags?|legal|copyright",
    re.I,
)
#: Words of layout that a marking class may have besides: site-footer is marked, but not has-sidebar or category-news.
LAYOUT = frozenset(
    "area bar block bottom box buttons column container content global group inner item items left links list main mobile outer "
    "panel primary right row secondary section site sticky top unit wrap wrapper".split()
)
#: What a notice of copyright begins with.
NOTICES = ("©", "(c) ", "Copyright ")
MARKED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
#: What an opening tag ends, if it is still open since the last container.
_CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_BLOCKS_END_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "nav ol pre section table ul".split()
)
_SCOPES = frozenset("html body div article main section ul ol dl table td th blockquote nav header footer aside form figure".split())
#: Tags that hold running text of their own: weak paths that end in one stay wherever they lie.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?、。，；：！？…]")


def _says_boilerplate(value: str) -> bool:
    """Whether a class or id has a token all of whose parts mark boilerplate or layout, and one boilerplate."""
    for token in value.split():
        parts = [x for x in re.split("[-_]+", token) if x]
        marking = [MARKED.fullmatch(x) is not None for x in parts]
        if any(marking) and all(m or x.lower() in LAYOUT for m, x in zip(marking, parts, strict=True)):
            return True
    return False


def _marked(tag: str, attributes: str) -> str:
    """'surely' for what is no text by tag or hidden; 'tag' by tag or role; 'named' by a class or id alone, which never marks an
    article; else ''."""
    if tag in SKIPPED:
        return "surely"
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return "tag" if tag in BOILERPLATE else ""
    out = "tag" if tag in BOILERPLATE else ""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "surely"
        if name == "role" and value.lower() in MARKED_ROLES:
            out = "tag"
        if not out and name in ("class", "id") and tag not in ("html", "body") and tag not in ARTICLE and _says_boilerplate(value):
            out = "named"
    return out


def _step(tag: str, attributes: str) -> str:
    """A step of a path: the tag and its class."""
    m = _CLASS.search(attributes) if "class" in attributes else None
    return f"{tag}.{m[1] or m[2] or m[3] or ''}" if m else tag


def _tag(step: str) -> str:
    return step.partition(".")[0]


class Node(NamedTuple):
    """A block of text: its path, whether it lies in a marked element, and the share of it that is links."""

    path: tuple[str, ...]
    text: str
    marked: bool
    links: float


def text_nodes(page: str) -> list[Node]:
    """The blocks of a page in order.

    Inline tags aren't part of a path and don't end a block. An element that only its class or id marks isn't marked if it holds
    the page's <main>, or most of its text while no article or main that isn't marked has any.
    """
    # of each open element its tag, whether it is no text, its number if it is marked by name (-1 if by tag, else 0), its step
    stack: list[tuple[str, bool, int, str]] = []
    out: list[tuple[tuple[str, ...], str, tuple[int, ...], float]] = []
    named, cleared = 0, {0}
    pending: list[str] = []
    hidden, at, end, link, linked = 0, 0, len(page), False, 0

    def flush() -> None:
        nonlocal linked
        if pending:
            text = " ".join(html_entities.unescape("".join(pending)).split())
            if text:
                out.append((tuple(x for *_, x in stack), text, tuple(n for _, _, n, _ in stack if n), min(1.0, linked / len(text))))
            pending.clear()
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal hidden
        while len(stack) > k:
            hidden -= stack.pop()[1]

    while at < end:
        m = _TOKEN.search(page, at)
        if not hidden:
            pending.append(page[at : m.start() if m else end])
            linked += link and len(pending[-1].strip())
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        link = not m[1] if tag == "a" else link
        mark = "" if m[1] else _marked(tag, m[3])
        if tag in INLINE and not mark:
            continue
        if tag == "br":
            if not hidden:
                pending.append(" ")
            continue
        if tag in INLINE or tag in VOID:  # a marked inline element hides what it holds
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if mark in ("surely", "tag") or not close or 2 * (close.start() - at) < end:
                at = close.end() if close else at
            continue
        flush()
        if m[1]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if k is not None:
                pop_to(k)
            continue
        ends = _CLOSES.get(tag) or ({"p"} if tag in _BLOCKS_END_P else ())
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in ends:
                pop_to(k)
            elif stack[k][0] in _SCOPES:
                break
        if tag in RAW:
            close = _RAW_END[tag].search(page, at)
            at = close.end() if close else end
            continue
        if m[3].rstrip().endswith("/") and tag not in _SCOPES and tag != "p":
            continue
        if tag == "main":
            cleared.update(n for _, _, n, _ in stack)
        named += mark == "named"
        stack.append((tag, mark == "surely", {"named": named, "tag": -1}.get(mark, 0), _step(tag, m[3])))
        hidden += mark == "surely"
    flush()
    held: dict[int, int] = defaultdict(int)
    for _, text, within, _ in out:
        for n in within:
            held[n] += len(text)
    total = sum(len(text) for _, text, _, _ in out)
    if not any(cleared.issuperset(within) and any(_tag(x) in ARTICLE for x in path) for path, _, within, _ in out):
        cleared.update(n for n, chars in held.items() if 2 * chars > total)
    cleared.discard(-1)
    return [Node(path, text, not cleared.issuperset(within) or text.startswith(NOTICES), links) for path, text, within, links in out]


def _smooth(values: list[float]) -> list[float]:
    n, out = len(values), []
    for i, v in enumerate(values):
        total, weight = v, 1.0
        for d, k in enumerate(KERNEL, 1):
            for j in (i - d, i + d):
                if 0 <= j < n:
                    total += k * values[j]
                    weight += k
        out.append(total / weight)
    return out


def path_weights(nodes: list[Node]) -> dict[tuple, float]:
    """The fused weight of each path, marked blocks being paths of their own."""
    chars, signs, links, count = defaultdict(int), defaultdict(int), defaultdict(float), defaultdict(int)
    keys = [(n.path, n.marked) for n in nodes]
    for key, node in zip(keys, nodes, strict=True):
        chars[key] += len(node.text)
        signs[key] += len(_PUNCTUATION.findall(node.text))
        links[key] += node.links * len(node.text)
        count[key] += 1
    lengths = _smooth([chars[k] / count[k] for k in keys])
    dots = _smooth([signs[k] / count[k] for k in keys])
    weight: dict[tuple, float] = defaultdict(float)
    for key, length, dot in zip(keys, lengths, dots, strict=True):
        weight[key] += math.sqrt(length * (1 + dot)) / count[key]
    for key in weight:
        path, marked = key
        named = any(_tag(x) in ARTICLE for x in path)
        weight[key] *= (1 - links[key] / chars[key]) * (MARKED_PRIOR if marked else NAMED_BONUS if named else 1.0)
    return weight


def main_text(page: str | None) -> str:
    nodes = text_nodes(page or "")
    if not nodes:
        return ""
    weight = path_weights(nodes)
    chars: dict[tuple, int] = defaultdict(int)
    for n in nodes:
        chars[n.path, n.marked] += len(n.text)
    total = sum(weight[k] * c for k, c in chars.items())
    mean = total / sum(chars.values())
    strong = {k for k, c in chars.items() if weight[k] >= STRONG_SHARE * mean and weight[k] * c >= STRONG_MASS * total}
    strong = strong or {k for k in chars if weight[k] >= LEAST_SHARE * mean}  # text all in small pieces
    parents = {path[:-1] for path, _ in strong}
    around = {path[: k + 1] for path, _ in strong for k, x in enumerate(path) if _tag(x) in ARTICLE}
    mass: dict[tuple[str, ...], float] = defaultdict(float)
    for (path, marked), c in chars.items():
        for k in range(len(path) + 1):
            mass[path[:k]] += weight[path, marked] * c
    largest = max(mass[p] for p in parents)
    parents = {p for p in parents if mass[p] >= LEAST_HOME * largest}
    homes = {p for p in parents | around if p and _tag(p[-1]) not in ("html", "body") and mass[p] >= LEAST_HOME * largest}
    enclosing = {p[:k] for p in parents for k in range(len(p) + 1)}

    def kept(path: tuple[str, ...], marked: bool) -> bool:
        key = path, marked
        if key in strong and path[:-1] in parents:
            return True
        if weight[key] < LEAST_SHARE * mean:
            return False
        if not path or path in enclosing or any(path[:k] in homes for k in range(len(path) + 1)):
            return True
        outside = next(k for k in range(len(path) + 1) if path[:k] not in enclosing) - 1
        return _tag(path[-1]) in _PROSE and not any("." in x for x in path[outside:-1])

    return " ".join(n.text for n in nodes if kept(n.path, n.marked))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with text and n_chars added."""
    from quern.llm._common import fresh

    carried = [c for c in pages.columns if c != html_col]
    text_name, chars_name = fresh(pages.drop(html_col), "text"), fresh(pages.drop(html_col), "n_chars")
    rows = pages.select(*carried, html_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    at = len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = [main_text(x) for x in part.column(at).to_pylist()]
                yield pa.record_batch(
                    [*part.columns[:at], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*carried, text_name, chars_name],
                )

    return rows.mapInArrow(run, f"{schema}, `{text_name}` string, `{chars_name}` long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
