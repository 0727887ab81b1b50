"""Graders of mathematical answers: text, numbers, tuples, intervals, equations and formulas, each in its order."""

from __future__ import annotations

import math
import re
from functools import lru_cache

from quern.functions.answers import either, math_normal, parse_number, split_commas
from quern.functions.symbolic import identical, number, read, same_equation, same_expression, variables

# Units and words that an answer may carry, and brackets of tuples.
UNITS = ("degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard", "liter")
SCALES = {"million": "*10^6", "billion": "*10^9", "trillion": "*10^12"}
BRACKETS = "()[]"
#: Notations that are compared as text alone, and letters that a compared pair may have.
TEXT_ONLY = re.compile(r"\^\{|\^\(|\^[0-9]+\^|\^[0-9][0-9]+")
MOST_LETTERS = 2
FONTS = r"\\(?:text|textbf|textit|textrm|mathrm|mathbf)\{([^}]*)\}"
INTERVAL = re.compile(r"([(\[])(.+),(.+)([)\]])")
SCREEN = str.maketrans({"√": "sqrt", "π": "pi", "∞": "inf", "∪": "U", "·": "*", "×": "*"})


def _float(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _whole(text: str) -> bool:
    value = _float(_without_thousands(text))
    return value is not None and math.isfinite(value) and abs(value - round(value)) <= 1e-7


def _without_thousands(text: str) -> str:
    """Without commas before three digits that no digit follows, from the right of a number on."""
    while (shorter := re.sub(r"(\d),(\d\d\d)($|\D)", r"\1\2\3", text)) != text:
        text = shorter
    return text


def latex_as_text(text: str) -> str:
    """Fractions, roots and marks of LaTeX in plain signs."""
    text = re.sub(r"\\[dt]?frac", r" \\frac", text).translate(SCREEN)
    while (out := re.sub(r"\\frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", r"\1/\2", text)) != text:
        text = out
    text = re.sub(r"\\sqrt\s*\{([^{}]*)\}", r"sqrt(\1)", text)
    text = re.sub(FONTS, r"\1", text)
    for command, sign in ((r"\\pi\b", "pi"), (r"\\(?:cdot|times)\b", "*"), (r"\\infty\b", "inf"), (r"\\cup\b", "U"), (r"\\(?:left|right)\b", ""), (r"\\[,;:! ]", "")):
        text = re.sub(command, sign, text)
    return text.strip()


def plain_answer(text: str) -> str:
    """An answer in lower case without units, currency and percent signs; whole numbers as such, mixed ones as sums."""
    whole = re.fullmatch(r"\\text\{(.+?)\}", text)
    text = whole[1] if whole else text
    text = re.sub(r"\\?[$%]", "", text).replace(" or ", " , ").replace(" and ", " , ")
    for word, power in SCALES.items():
        text = text.replace(word, power)
    for unit in UNITS:
        text = text if unit not in text else re.sub(rf"{unit}(?:es)?s? *(?:\^[0-9]+)?", "", text)
    text = re.sub(r"\^ *\\circ", "", text)
    text = text[1:-1] if text[:1] == "{" and text[-1:] == "}" else text
    text = re.sub(r",\\! *", "", text)
    text = str(round(float(text))) if (value := _float(text)) is not None and math.isfinite(value) and abs(value - round(value)) <= 1e-7 else text
    text = latex_as_text(text) if "\\" in text else text
    text = re.sub(r"- *", "-", text)
    text = re.sub(r"([0-9]) +([0-9])", r"\1+\2", text).lower()
    return str(int(float(text.replace(",", "")))) if _whole(text) else text


def elements(text: str) -> list[str]:
    """The parts of a tuple or interval, or the text as the only one."""
    text = _without_thousands(text)
    if len(text) > 2 and text[0] in BRACKETS and text[-1] in BRACKETS and not set(text[1:-1]) & set(BRACKETS):
        return [x.strip() for x in text[1:-1].split(",")]
    return [text] if text else []


def _same_part(truth: str, given: str) -> bool:
    fraction = re.compile(r"-?[0-9]+.?/0*[1-9][0-9]*.?")
    if fraction.fullmatch(truth) and fraction.fullmatch(given):
        return truth == given  # a fraction must be reduced as the truth is
    if _whole(truth) != _whole(given):
        return False
    both = f"({truth})-({given})"
    letters = {c for c in both.replace("sqrt", "").replace("frac", "") if c.isalpha()}
    if len(letters) > MOST_LETTERS or TEXT_ONLY.search(both):
        return False
    return same_expression(truth, given) is True


def graded(given: str | None, truth: str | None) -> bool | None:
    """Equal in normal form, or part by part as formulas; whole numbers and fractions must be written as the truth is.

    False without an answer, null without a truth.
    """
    if truth is None:
        return None
    if given is None:
        return False
    if math_normal(given) == math_normal(truth):
        return True
    left, right = plain_answer(truth), plain_answer(given)
    if left == right:
        return True
    if not right:
        return False
    wanted, found = elements(left), elements(right)
    if len(wanted) != len(found) or len(wanted) > 1 and (left[0], left[-1]) != (right[0], right[-1]):
        return False
    return bool(wanted) and all(map(_same_part, wanted, found))


def _digits(text: str) -> float | None:
    return _float(text.replace("{,}", "") if "{,}" in text else text.replace(",", ""))


def _bare(text: str, pi: float) -> str:
    """Without a leading dollar sign, a percent sign or a base; with a value for pi."""
    if re.match(r"\$\d+(?:\.\d+)?", text):
        return text[1:]
    if re.fullmatch(r"\d+(?:\.\d+)?\\?%", text):
        return re.sub(r"\\?%", "", text)
    if "_" in text and (value := _float(text.split("_")[0])) is not None and math.isfinite(value):
        text = str(int(value))
    if "\\pi" in text:
        text = re.sub(r"(?<=\d)\\pi", f"*{pi}", text).replace("\\pi", f"1*{pi}")
        value = number(text)
        text = text if value is None else repr(value)
    return text


def close_enough(given: str | None, truth: str | None, percent: bool = True, tolerance: float = 1e-4, pi: float = math.pi) -> bool | None:
    """Equal as text, else as numbers within a relative tolerance (also as percentages), else part by part, matrix by matrix,
    or as formulas and equations. Null if either is missing."""
    if given is None or truth is None:
        return None
    a, b = _bare(given, pi), _bare(truth, pi)
    if a.strip().lower() == b.strip().lower() or a.replace(" ", "") == b.replace(" ", ""):
        return True
    x, y = _digits(a), _digits(b)
    if x is not None and y is not None:
        return any(math.isclose(z, x, rel_tol=tolerance) for z in ((y / 100, y, y * 100) if percent else (y,)))
    a, b = a.strip(), b.strip()
    if not a:
        return False
    if _unbracketed(a, b):
        return True
    again = lambda p, q: len(p) == len(q) and all(close_enough(u, v, percent, tolerance, pi) for u, v in zip(p, q, strict=True))
    if (rows := _matrix(a)) and (others := _matrix(b)):
        return len(rows) == len(others) and all(again(p, q) for p, q in zip(rows, others, strict=True))
    if len(a) > 1 and a[:1] in "([" and a[-1:] in ")]" and (a[0], a[-1]) == (b[:1], b[-1:]) and again(split_commas(a[1:-1]), split_commas(b[1:-1])):
        return True
    if a.startswith("Point") and b[:1] == "(" and b[-1:] == ")" and again(split_commas(a[a.find("(") + 1 : -1]), split_commas(b[1:-1])):
        return True
    if "," in a and "," in b and len(left := split_commas(a)) == len(right := split_commas(b)) > 1:
        return again(left, right)
    if same_expression(a, b) or same_equation(a, b):
        return True
    x, y = number(a), number(b)
    return x is not None and y is not None and math.isclose(x, y, rel_tol=tolerance)


def _unbracketed(a: str, b: str) -> bool:
    if a[:1] == "[" and a[-1:] == "]" and b[:1] != "(" or a[:1] == "(" and a[-1:] == ")" and b[:1] != "[":
        a, b = a.strip("[]()"), b.strip("[]()")
    bare = lambda t: re.sub(r"[{}()]", "", t)
    return bare(a) == bare(b)


def _matrix(text: str) -> list[list[str]] | None:
    """Rows of a LaTeX matrix or of nested lists."""
    if found := re.fullmatch(r"\\begin\{[pb]matrix\}(.*)\\end\{[pb]matrix\}", text, re.S):
        return [[cell.strip() for cell in row.split("&")] for row in re.split(r"\\\\", found[1]) if row.strip()]
    text = text[len("Matrix(") : -1] if text.startswith("Matrix(") and text.endswith(")") else text
    if text[:2] == "[[" and text[-2:] == "]]":
        return [split_commas(row.strip().strip("[]")) or [] for row in split_commas(text[1:-1])]
    return None


@lru_cache(maxsize=64)  # a cascade cleans the same two texts several times
def clean_latex(text: str) -> str:
    """Without dollar signs around it, fonts, spacing, sizes, a percent sign or an ordinal's ending."""
    text = text.strip()
    text = text[1:-1].strip() if len(text) > 1 and text[0] == text[-1] == "$" else text
    text = re.sub(r"\\frac\s*([^{])\s*([^{])", r"\\frac{\1}{\2}", text.replace("\\dfrac", "\\frac"))
    text = re.sub(r"([_^])\{([^}])\}", r"\1\2", text)
    text = re.sub(r"\\?%$", "", re.sub(FONTS, r"\1", text))
    text = re.sub(r"\^\{?(?:st|nd|rd|th)\}?(?:\s+(?:grade|place|row))?$", "", text, flags=re.IGNORECASE)
    return " ".join(text.replace("\\left", "").replace("\\right", "").replace("\\,", " ").split())


def near_number(given: str, truth: str, precision: float = 1e-4) -> bool | None:
    """Numbers, also as percentages, within a relative precision; null if either is none."""
    p, g = parse_number(given), parse_number(truth)
    if p is None or g is None:
        return None
    return abs(p) < precision if g == 0 else abs(p - g) / max(abs(g), 1e-15) < precision


def interval_equal(given: str | None, truth: str | None) -> bool | None:
    """Equal brackets, and ends that are equal as text or nearly so as numbers; null if either is no interval."""
    if given is None or truth is None:
        return None
    p, g = (INTERVAL.fullmatch(clean_latex(x).replace(" ", "").replace("\\infty", "oo")) for x in (given, truth))
    if not p or not g:
        return None
    return (p[1], p[4]) == (g[1], g[4]) and all(p[i] == g[i] or near_number(p[i], g[i]) is True for i in (2, 3))


def judged(given: str | None, truth: str | None, kind: str | None = "", precision: float = 1e-4) -> bool | None:
    """Text, numbers, then intervals, equations and formulas. Several truths stand between semicolons and must all be met.

    True or false by the first rule that says so, else null: only intervals, equations' forms and the number of parts can be
    wrong for sure.
    """
    if given is None or truth is None or not given.strip():
        return None
    given, truth, kind = given.strip(), truth.strip(), (kind or "").lower()
    if ";" in truth:
        wanted = [x.strip() for x in truth.split(";")]
        found = split_commas(given)
        found = found if len(found) == len(wanted) else [x.strip() for x in given.split(";")]
        if len(found) != len(wanted):
            return False
        parts = [judged(p, g, kind, precision) for p, g in zip(found, wanted, strict=True)]
        return True if all(parts) else False if False in parts else None
    p, g = clean_latex(given).lower(), clean_latex(truth).lower()
    if re.sub(r"\s+", "", p) == re.sub(r"\s+", "", g) or near_number(given, truth, precision):
        return True
    if kind == "interval" and (verdict := interval_equal(given, truth)) is not None:
        return verdict
    p, g = clean_latex(given), clean_latex(truth)
    if (kind == "equation" or "=" in given and "=" in truth) and same_equation(p, g):
        return True
    if same_expression(p, g):
        return True
    x, y = number(p), number(g)
    return True if x is not None and y is not None and abs(x - y) < 1e-6 else None


def symbolic(given: str | None, truth: str | None) -> bool | None:
    """The verdict by formulas alone: equations, tuples and intervals part by part, expressions; null if either can't be read."""
    if given is None or truth is None or not given.strip():
        return None
    p, g = clean_latex(given), clean_latex(truth)
    if p == g and (read(p) is not None or "=" in p):
        return True
    left, right = p.split("="), g.split("=")
    if len(left) == len(right) == 2:
        return same_equation(p, g)
    if len(left) == 2 and len(right) == 1 and (tree := read(left[0])) is not None and tree[0] == "v":
        p = left[1]  # an answer may name what it is the value of
    if p[:1] in "([" and g[:1] in "([" and p[-1:] in ")]" and g[-1:] in ")]" and "," in p and "," in g:
        inner, other = split_commas(p[1:-1]), split_commas(g[1:-1])
        if (p[0], p[-1]) != (g[0], g[-1]) or len(inner) != len(other):
            return False
        parts = [symbolic(x, y) for x, y in zip(inner, other, strict=True)]
        return False if False in parts else None if None in parts else True
    trees = read(p), read(g)
    if None in trees:
        return None
    verdict = identical(*trees)
    if verdict is False and not variables(trees[0]) | variables(trees[1]) and (x := number(p)) is not None and (y := number(g)) is not None:
        return math.isclose(x, y, rel_tol=1e-6)
    return verdict


def verified(given: str | None, truth: str | None, kind: str | None = "") -> bool | None:
    """True if either the formulas or the cascade say so, else false if either does, else null."""
    if given is None or truth is None or not given.strip():
        return None
    return either(symbolic(given, truth), judged(given, truth, kind))
