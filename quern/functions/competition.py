"""Competition papers: items of a TeX list, solutions of a shortlist, titles, figures, and letters of an answer."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.answers import over
from quern.functions.strings import strip

# The labels, divider and figure marks that the papers use.
ITEM = re.compile(r"\\item\s*\[([AB])(?:--)?(\d)\]\s*")
LINKED = re.compile(r"\[([ACGN])(\d{1,2})\.\]\(#page-\d+-\d+\)")
PLAIN = re.compile(r"^(?:#{2,4}\s+)?([ACGN])(\d{1,2})\.(?:\s|$)", re.MULTILINE)
HEADED = re.compile(r"^#{3,4}\s+([ACGN])(\d{1,2})\b(?:\s+[ACGN]\d{1,2})?\s*$", re.MULTILINE)
SOLVED = re.compile(r"\b(?:Solution|Answer|Comment|Proof)\.")
DIVIDER = re.compile(r"^#+\s*Solutions(?:\b[^\n]*)?$", re.MULTILINE | re.IGNORECASE)
FIGURE = r"(?i:\[/?asy\]|\\begin\{asy\})|\\begin\{tikzpicture\}|\\includegraphics\b|!\[[^\]]*\]\([^)]+\)"
DRAWING = ["unitsize(", "draw(", "dot(", "filldraw(", "pair ", "label(", "MP("]
UNWANTED = ["I understand", "A through J", "A through E", "A through D"]
LINE_ENDS = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

PIECES = "array<struct<label:string,body:string>>"


def _between(text: str, marks: list[re.Match], after: bool) -> list[tuple[str, str]]:
    """(label, what lies up to the next mark), with or without the mark itself."""
    ends = [m.start() for m in marks[1:]] + [len(text)]
    return [(m[1] + m[2], text[m.end() if after else m.start() : end].strip()) for m, end in zip(marks, ends, strict=False)]


def tex_items(tex: str | None) -> list[tuple[str, str]] | None:
    r"""Labelled items between the first \begin{itemize} and the last \end{itemize}; null where there are none.

    Of a repeated label the last body counts, in the place of the first.
    """
    _, begun, rest = (tex or "").partition("\\begin{itemize}")
    body, ended, _ = rest.rpartition("\\end{itemize}")
    marks = list(ITEM.finditer(body)) if begun and ended else []
    return list(dict(_between(body, marks, after=True)).items()) or None


def shortlist_solutions(text: str | None) -> list[tuple[str, str]] | None:
    """Solutions by label; null where there are none.

    After a divider, linked labels count, or else plain ones. Without a divider, headings or plain labels do, whichever
    are more; of a label's occurrences the longest is taken, and only if it has the words of a solution.
    """
    text = text or ""
    if cut := DIVIDER.search(text):
        rest = text[cut.end() :]
        for pattern in (LINKED, PLAIN):
            if marks := list(pattern.finditer(rest)):
                return _between(rest, marks, after=False)
        return None
    marks = max((list(p.finditer(text)) for p in (HEADED, PLAIN)), key=len)
    longest: dict[str, str] = {}
    for label, body in _between(text, marks, after=False):
        if len(body) > len(longest.get(label, "")):
            longest[label] = body
    found = [(k, longest[k]) for k in sorted(longest, key=lambda k: (k[0], int(k[1:]))) if SOLVED.search(longest[k])]
    return found or None


def without_title(content: Column) -> Column:
    """Without a first line that begins with "# Putnam "; line ends are made alike."""
    lines = strip(F.regexp_replace(content, LINE_ENDS, "\n"))
    return strip(F.regexp_replace(lines, r"\A# Putnam [^\n]*", ""))


def has_figure(text: Column) -> Column:
    """A figure's markup, or two of the words of a drawing; false for no text."""
    words = [F.contains(F.lower(text), F.lit(w)).cast("int") for w in DRAWING]
    return F.coalesce(text.rlike(FIGURE) | (sum(words[1:], words[0]) >= 2), F.lit(False))


def cleansed_letter(prediction: Column, options: Column) -> Column:
    """The first letter of an option that stands alone in a prediction, else an empty text."""
    for phrase in UNWANTED:
        prediction = F.replace(prediction, F.lit(phrase), F.lit(""))
    found = F.regexp_extract_all(prediction, F.lit(r"\b([A-Z])\b"), 1)
    allowed = F.filter(found, lambda x: F.ascii(x) < 65 + F.size(options))
    return F.coalesce(F.get(allowed, F.lit(0)), F.lit(""))


def pieces(rule: Callable[[str | None], list[tuple[str, str]] | None]) -> Callable[..., Column]:
    """A rule that cuts a text into (label, body) as a column function."""
    return over(lambda text: None if (found := rule(text)) is None else [{"label": k, "body": v} for k, v in found], PIECES)
