"""Formulas and graders of mathematics: generated trees against exact arithmetic, and worked cases."""

import math
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.functions import grading as G
from quern.functions import symbolic as S

# --- formulas


def _trees():
    leaf = st.one_of(st.integers(0, 12).map(lambda n: ("n", Fraction(n))), st.sampled_from("xyz").map(lambda v: ("v", v)))

    def grow(inner):
        return st.one_of(
            st.tuples(st.sampled_from("+-*/"), inner, inner),
            inner.map(lambda t: ("neg", t)),
            st.tuples(st.just("^"), inner, st.integers(-2, 3).map(lambda n: ("n", Fraction(n)))),
        )

    return st.recursive(leaf, grow, max_leaves=9)


def _latex(t):
    if t[0] == "n":
        return str(t[1]) if t[1] >= 0 else f"({t[1]})"
    if t[0] == "v":
        return t[1]
    if t[0] == "neg":
        return f"(-{_latex(t[1])})"
    if t[0] == "/":
        return rf"\frac{{{_latex(t[1])}}}{{{_latex(t[2])}}}"
    if t[0] == "^":
        return f"({_latex(t[1])})^{{{t[2][1]}}}"
    return f"({_latex(t[1])} {'\\cdot' if t[0] == '*' else t[0]} {_latex(t[2])})"


def _plain(t):
    if t[0] in "nv":
        return f"({t[1]})"
    if t[0] == "neg":
        return f"(-{_plain(t[1])})"
    if t[0] == "^":
        return f"({_plain(t[1])}**({t[2][1]}))"
    return f"({_plain(t[1])}{t[0]}{_plain(t[2])})"


def _at(t, point):
    """The value of a tree in fractions; None where it has none."""
    if t[0] == "n":
        return t[1]
    if t[0] == "v":
        return point[t[1]]
    values = [_at(x, point) for x in t[1:] if isinstance(x, tuple)]
    if None in values:
        return None
    a, b = values[0], values[-1]
    if t[0] == "/":
        return a / b if b else None
    if t[0] == "^":
        return (a ** int(b)) if a or b > 0 else None
    return {"+": a + b, "-": a - b, "*": a * b, "neg": -a}[t[0]]


@settings(max_examples=250, deadline=None)
@given(_trees())
def test_notations_of_a_tree_agree(t):
    points = [{v: Fraction(n, d) for v, n, d in zip("xyz", (7, 11, 13), ds, strict=True)} for ds in ((2, 3, 5), (17, 19, 23))]
    if all(_at(t, p) is not None for p in points):
        assert S.same_expression(_latex(t), _plain(t)) in (True, None)
        assert S.same_expression(_latex(t), f"{_plain(t)}+1") in (False, None)


@settings(max_examples=250, deadline=None)
@given(_trees(), _trees())
def test_verdicts_are_those_of_exact_arithmetic(a, b):
    """Values at a grid of fractions tell different formulas apart; equal ones agree at all of it."""
    verdict = S.same_expression(_latex(a), _latex(b))
    grid = [{"x": Fraction(i, 7), "y": Fraction(j, 11), "z": Fraction(k, 13)} for i, j, k in ((1, 2, 3), (-5, 9, 4), (8, -3, 17), (23, 31, -6), (40, 5, 29), (-50, -7, 61))]
    pairs = [(x, y) for p in grid if (x := _at(a, p)) is not None and (y := _at(b, p)) is not None]
    if verdict is True:
        assert all(x == y for x, y in pairs)
    elif verdict is False:
        assert not pairs or any(x != y for x, y in pairs)


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("x+1", "1+x"), (r"\frac{1}{2}x", "x/2"), (r"\frac12 x", "0.5x"), ("(x+1)^2", "x^2+2x+1"), ("-x^2", "-(x^2)"), ("2^{-1}", "1/2"), (r"\sqrt{8}", r"2\sqrt{2}"),
        (r"\sqrt[3]{27}", "3"), (r"\sin^2 x+\cos^2 x", "1"), (r"\ln(e^2)", "2"), (r"\log_{2} 8", "3"), ("e^{x}e^{y}", "e^{x+y}"), (r"x_1 + x_{12}", "x_{12}+x_1"), (r"2\pi r", r"r \cdot 2 \pi"),
        ("1,234", "1234"), ("5!", "120"), ("|{-3}|", "3"), (r"\left(\frac{a}{b}\right)^2", "a^2/b^2"), ("sqrt(2)/2", "1/sqrt(2)"), (r"\tan x", r"\frac{\sin x}{\cos x}"), ("2(3+4)", "14"),
        (r"\dfrac{x}{y}", "x/y"), ("x**2", "xx"), ("1 - -1", "2"), (r"\sinh x", r"\frac{e^x-e^{-x}}{2}"), ("a/b/c", "a/(bc)"), ("2^3^2", "2^9"), (r"\sqrt 2", "2^{1/2}"),
    ],
)
def test_equal_formulas(a, b):
    assert S.same_expression(a, b) is True


@pytest.mark.parametrize(
    ("a", "b"), [("x+1", "x-1"), (r"\sqrt{x^2}", "x"), ("0.333", "1/3"), ("x^2", "2x"), (r"\sin 2x", r"2\sin x"), ("ab", "a+b"), ("2", "3"), (r"\log x^2", r"2\log x"), ("x", "y"), ("1e", "1")]
)
def test_different_formulas(a, b):
    assert S.same_expression(a, b) is False


@pytest.mark.parametrize(
    "text",
    ["", None, "the answer", "x +", "(x", "x)", "1 2", "2^{101}", "2^{-2000}", "x" * 300, "(" * 60 + "x" + ")" * 60, r"\unknown{x}", r"\frac{1}", "[1,2)", "x=1", r"\text{yes}", "1/", "_x"],
)
def test_what_is_no_formula(text):
    assert S.read(text) is None and S.same_expression(text, "1") is None


def test_no_value_anywhere():
    assert S.same_expression("1/0", "1/0") is None and S.same_expression("1/(x-x)", "2") is None
    assert S.same_expression("0^0", "1") is None and S.number("1/0") is None and S.number(r"\sqrt{-1}") is None


def test_equations():
    same = [("y=2x+1", "2x-y+1=0"), ("x=1", "2x=2"), ("x^2+y^2=4", r"\frac{x^2}{4}+\frac{y^2}{4}=1"), ("y=x", "-x=-y"), (r"y=\sin x", r"2y=2\sin x")]
    assert all(S.same_equation(a, b) for a, b in same)
    assert not any(S.same_equation(a, b) for a, b in [("y=2x", "y=3x"), ("x=1", "x=2"), ("x^2=1", "x=1"), (r"y=\sin x", r"y=\cos x")])
    assert S.same_equation("x", "x=1") is None and S.same_equation("1=1", "2=2") is None and S.same_equation("a=b=c", "a=b") is None


# --- graders


@pytest.mark.parametrize(
    ("answer", "truth", "verdict"),
    [
        ("1,000", "1000", True), (r"\frac{1}{2}", "1/2", True), ("2/4", "1/2", False), ("x+1", "1+x", True), ("10 cm", "10", True), ("3.0", "3", True), ("3.5", "3", False), ("6/2", "3", False), ("5 million", "5*10^6", True),
        ("(1,2)", "(1, 2)", True), ("(1,x+y)", "(1, y+x)", True), ("[1,2)", "(1,2)", False), ("(1,2,3)", "(1,2)", False), ("7 3/4", "7+3/4", True), ("a+b+c", "c+b+a", False), ("", "1", False), (None, "1", False), ("1", None, None),
        (r"2\sqrt{2}", "sqrt(8)", True), (r"\text{yes}", "YES", True), (r"90^\circ", "90", True), ("x^{2}", "x*x", False), ("50\\%", "50", True), ("$12", "12", True), ("(0,1]", "(0,1)", False),
    ],
)
def test_graded(answer, truth, verdict):
    assert G.graded(answer, truth) is verdict


@pytest.mark.parametrize(
    ("answer", "truth", "verdict"),
    [
        ("0.5", "50", True), ("50%", "50", True), ("3.14159", r"\pi", True), (r"2\pi", "6.2832", True), ("1{,}000", "1000", True), ("2", "3", False), ("[1, 2]", "[1,2.00001]", True), ("(1,2)", "(1,3)", False), ("x=1", "1=x", True),
        ("1, 2", "1,2.0", True), ("Point(1, 2)", "(1,2)", True), ("[[1,2],[3,4]]", r"\begin{pmatrix} 1 & 2 \\ 3 & 4 \end{pmatrix}", True), ("[[1,2],[3,5]]", r"\begin{pmatrix}1&2\\3&4\end{pmatrix}", False),
        ("{x}", "x", True), (r"\frac{1}{3}", "0.33333", True), (r"\frac{1}{3}", "0.4", False), ("x+y", "y+x", True), ("x+y", "x-y", False), ("", "x", False), (None, "1", None), ("101_2", "101", True), ("(x)", "x", True),
    ],
)
def test_close_enough(answer, truth, verdict):
    assert G.close_enough(answer, truth) is verdict


def test_close_enough_without_percentages_and_with_another_pi():
    assert G.close_enough("0.5", "50", percent=False) is False
    assert G.close_enough("3.14", r"\pi") is False and G.close_enough("3.14", r"\pi", pi=3.14) is True
    assert G.close_enough("1.02", "1", tolerance=0.05) is True


@pytest.mark.parametrize(
    ("answer", "truth", "kind", "verdict"),
    [
        ("2", "3", "", None), ("2.00001", "2", "", True), ("62.5%", "0.625", "", True), (r"\dfrac{1}{2}", r"\frac12", "", True), ("(0, 1)", r"\left(0,1\right)", "Interval", True), ("(0, 1]", "(0,1)", "Interval", False),
        ("(0,1]", "(0,1)", "", None), (r"(-\infty, 5.00001]", r"(-\infty,5]", "interval", True), ("y=2x", "2y=4x", "", True), ("y=2x", "y=3x", "Equation", None), ("1, 2", "1;2", "", True), ("1", "1;2", "", False),
        ("1;x+1", "1;1+x", "", True), ("1;3", "1;2", "", None), ("12^{th}", "12", "", True), ("x+1", "1+x", "", True), (r"\sqrt{4}", "2", "", True), (r"\text{Yes}", "yes", "", True), ("", "1", "", None), (None, "1", "", None),
        ("0.00001", "0", "", True), ("a b", "ab", "", True), (r"1{,}0", "x", "", None), (r"\frac{22}{7}", r"\pi", "", None),
    ],
)
def test_judged(answer, truth, kind, verdict):
    assert G.judged(answer, truth, kind) is verdict


@pytest.mark.parametrize(
    ("answer", "truth", "verdict"),
    [
        ("2", "3", False), ("x+1", "1+x", True), ("some words", "others", None), ("x=5", "5", True), ("x=4", "5", False), ("(1,x+1)", "(1,1+x)", True), ("(1,2)", "[1,2)", False), (r"\frac{1}{3}", "0.3333333", True),
        ("y=x+1", "x-y+1=0", True), ("1;2", "2;1", None), ("  ", "1", None), ("50\\%", "50", True), ("(1,2)", "(1,word here)", None),
    ],
)
def test_verified(answer, truth, verdict):
    assert G.verified(answer, truth) is verdict


def test_intervals():
    assert G.interval_equal(r"$\left[0, \infty\right)$", "[0,oo)") is True
    assert G.interval_equal(r"[\dfrac12, 1)", r"[\frac{1}{2},1)") is True and G.interval_equal("[0,1)", "[0,2)") is False
    assert G.interval_equal("0,1", "[0,1]") is None and G.interval_equal(None, "[0,1]") is None


def test_number():
    assert S.number(r"\frac{3}{4}") == 0.75 and math.isclose(S.number(r"2\pi"), 2 * math.pi) and S.number("x") is None
