r"""Whether two formulas are equal: LaTeX or plain notation, read into a tree and tested at random points.

Formulas of rational operations are compared exactly, in whole numbers modulo the prime 2^61 - 1: two different ones of degree
d agree at a random point with probability d / 2^61. Roots, powers with other exponents and functions are compared in complex
numbers, with arguments on all sides of zero, so sqrt(x^2) is not x. Work is bounded: a formula of more than MOST_SIGNS signs,
MOST_DEPTH brackets or an exponent over MOST_EXPONENT is not read, and a comparison that can't be made answers null.
"""

from __future__ import annotations

import cmath
import math
import random
import re
from collections.abc import Callable
from fractions import Fraction
from functools import lru_cache

MOST_SIGNS, MOST_DEPTH, MOST_EXPONENT = 256, 40, 100
PRIME = (1 << 61) - 1
#: Points of an exact and of a complex test; relative distance of equal and of surely different values.
EXACT_POINTS, POINTS, NEAR, FAR = 3, 8, 1e-9, 1e-6

# Names of functions, constants and signs.
FUNCTIONS = ("arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "sqrt", "sin", "cos", "tan", "cot", "sec", "csc", "log", "exp", "ln")
SKIPPED = ("left", "right", "displaystyle", "quad", "limits", "big", "Big")
SIGNS = {"cdot": "*", "times": "*", "div": "/", "lbrace": "{", "rbrace": "}", "lvert": "|", "rvert": "|"}
#: Commands that name a variable.
LETTERS = "alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi rho sigma tau upsilon phi varphi chi psi omega Gamma Delta Theta Lambda Xi Sigma Phi Psi Omega ell hbar".split()

_SIGN = re.compile(rf"\s*(?:(\d+(?:\.\d+)?|\.\d+)|\\([a-zA-Z]+)|({'|'.join(FUNCTIONS)}|pi)(?![a-zA-Z])|([a-zA-Z])|(\*\*|[-+*/^(){{}}\[\]|!_=]))")
_TOGETHER = re.compile(r"\\[a-zA-Z]+|[a-zA-Z]{3,}")
_MUTE = re.compile(r"\\[,;:! ]|\\\$|\$|~|\\(?:quad|qquad)\b")

Tree = tuple


class Unread(ValueError):
    """The text is no formula that can be read."""


class Undefined(ArithmeticError):
    """No value at this point."""


def _signs(text: str) -> list[tuple[str, str]]:
    text = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", _MUTE.sub(" ", text)).replace("\\%", "").strip()
    text = re.sub(r"\\[dt]?frac\s*(\d)\s*(\d)", r"\\frac{\1}{\2}", text)
    for word in _TOGETHER.findall(text):
        if word[0] != "\\" and not any(word.startswith(f) or word.endswith(f) for f in (*FUNCTIONS, "pi")):
            raise Unread(word)  # prose, and not a product of letters
    out, at = [], 0
    while at < len(text):
        found = _SIGN.match(text, at)
        if not found or len(out) > MOST_SIGNS:
            raise Unread(text[at : at + 20])
        at = found.end()
        number, command, name, letter, sign = found.groups()
        if number:
            out.append(("number", number))
        elif command or name:
            word = command or name
            if word in SIGNS:
                out.append(("sign", SIGNS[word]))
            elif word in FUNCTIONS or word in ("frac", "dfrac", "tfrac", "pi"):
                out.append(("name", "frac" if word.endswith("frac") else word))
            elif word in LETTERS:
                out.append(("letter", word))
            elif word not in SKIPPED:
                raise Unread(word)
        elif letter:
            out.append(("letter", letter))
        else:
            out.append(("sign", "^" if sign == "**" else sign))
    return out


class _Reader:
    """Sums of products of powers, from left to right."""

    CLOSE = {"(": ")", "{": "}", "[": "]", "|": "|"}

    def __init__(self, signs: list[tuple[str, str]]):
        self.signs, self.at, self.depth, self.bars = signs, 0, 0, 0

    def sign(self) -> str | None:
        kind, value = self.signs[self.at] if self.at < len(self.signs) else ("", "")
        return value if kind == "sign" else None

    def take(self, *wanted: str) -> str | None:
        if (sign := self.sign()) in wanted:
            self.at += 1
            return sign
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise Unread(f"{wanted} is missing")

    def sum(self) -> Tree:
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise Unread("too deep")
        minus = False
        while sign := self.take("+", "-"):
            minus ^= sign == "-"
        out = ("neg", self.product()) if minus else self.product()
        while sign := self.take("+", "-"):
            minus = sign == "-"
            while again := self.take("+", "-"):
                minus ^= again == "-"
            out = ("-" if minus else "+", out, self.product())
        self.depth -= 1
        return out

    def starts_factor(self) -> bool:
        if self.at >= len(self.signs):
            return False
        sign = self.sign()
        return sign is None or sign in "({[" or sign == "|" and not self.bars

    def product(self) -> Tree:
        out = self.power()
        while True:
            sign = self.take("*", "/")
            if sign:
                minus = bool(self.take("-"))
                right = self.power()
                out = (sign, out, ("neg", right) if minus else right)
            elif self.starts_factor():
                if self.signs[self.at][0] == "number" and self.signs[self.at - 1][0] == "number":
                    raise Unread("two numbers")
                out = ("*", out, self.power())
            else:
                return out

    def power(self) -> Tree:
        out = self.base()
        while True:
            if self.take("!"):
                out = ("f", "factorial", out)
            elif self.take("^"):
                out = ("^", out, self.exponent())
            else:
                return out

    def exponent(self) -> Tree:
        if self.take("-"):
            return ("neg", self.exponent())
        self.take("+")
        return self.power() if self.sign() != "{" else self.bracket()

    def bracket(self) -> Tree:
        opened = self.take(*self.CLOSE)
        if not opened:
            raise Unread("a bracket is missing")
        self.bars += opened == "|"
        inner = self.sum()
        self.need(self.CLOSE[opened])
        self.bars -= opened == "|"
        return ("f", "abs", inner) if opened == "|" else inner

    def base(self) -> Tree:
        if self.at >= len(self.signs):
            raise Unread("ends early")
        kind, value = self.signs[self.at]
        if kind == "sign":
            return self.bracket()
        self.at += 1
        if kind == "number":
            return ("n", Fraction(value))
        if kind == "letter":
            if self.take("_"):
                value = f"{value}_{self.index()}"
            return ("c", "e") if value == "e" else ("v", value)
        if value == "pi":
            return ("c", "pi")
        if value == "frac":
            return ("/", self.bracket(), self.bracket())
        return self.function(value)

    def index(self) -> str:
        braced, parts = self.take("{"), []
        while self.at < len(self.signs) and self.signs[self.at][0] != "sign":
            parts.append(self.signs[self.at][1])
            self.at += 1
            if not braced:
                break
        if braced:
            self.need("}")
        if not parts:
            raise Unread("no index")
        return "".join(parts)

    def function(self, name: str) -> Tree:
        root, low, raised = None, None, None
        if name == "sqrt" and self.take("["):
            root = self.sum()
            self.need("]")
        if name == "log" and self.take("_"):
            low = self.bracket() if self.sign() == "{" else self.base()
        if name != "sqrt" and self.take("^"):
            raised = self.exponent()
        inner = self.bracket() if self.sign() in ("(", "{", "[", "|") else self.power()
        if name == "sqrt":
            out = ("^", inner, ("/", ("n", Fraction(1)), root or ("n", Fraction(2))))
        elif low is not None:
            out = ("/", ("f", "ln", inner), ("f", "ln", low))
        else:
            out = ("f", name, inner)
        return ("^", out, raised) if raised is not None else out


@lru_cache(maxsize=64)  # a grader reads the same two texts several times
def read(text: str | None) -> Tree | None:
    """The tree of a formula; null if it can't be read."""
    try:
        reader = _Reader(_signs(text or ""))
        out = reader.sum()
        return out if reader.at == len(reader.signs) and _bounded(out) else None
    except (Unread, ValueError, ZeroDivisionError):
        return None


def _parts(tree: Tree) -> list[Tree]:
    return [x for x in tree[1:] if isinstance(x, tuple)]


def _bounded(tree: Tree) -> bool:
    if tree[0] == "^" and (power := constant(tree[2])) is not None and abs(power) > MOST_EXPONENT:
        return False
    return all(map(_bounded, _parts(tree)))


def constant(tree: Tree) -> Fraction | None:
    """The value of a formula of numbers and the four operations."""
    if tree[0] == "n":
        return tree[1]
    if tree[0] in ("+", "-", "*", "/", "neg"):
        values = [constant(x) for x in _parts(tree)]
        if None in values:
            return None
        a, b = values[0], values[-1]
        if tree[0] == "/":
            return a / b if b else None
        return -a if tree[0] == "neg" else a + b if tree[0] == "+" else a - b if tree[0] == "-" else a * b
    return None


def variables(tree: Tree) -> set[str]:
    return {tree[1]} if tree[0] == "v" else set().union(*map(variables, _parts(tree)))


def rational(tree: Tree) -> bool:
    """Whether there are only the four operations and whole powers."""
    if tree[0] in ("c", "f"):
        return False
    if tree[0] == "^":
        power = constant(tree[2])
        return power is not None and power.denominator == 1 and rational(tree[1])
    return all(map(rational, _parts(tree)))


def _exact(tree: Tree, point: dict[str, int]) -> int:
    """A rational formula's value modulo PRIME."""
    kind = tree[0]
    if kind == "n":
        return tree[1].numerator * pow(tree[1].denominator, -1, PRIME) % PRIME
    if kind == "v":
        return point[tree[1]]
    a = _exact(tree[1], point)
    if kind == "neg":
        return -a % PRIME
    if kind == "^":
        power = int(constant(tree[2]))
        if not a and power <= 0:
            raise Undefined
        return pow(a, power, PRIME)
    b = _exact(tree[2], point)
    if kind == "/":
        if not b:
            raise Undefined
        return a * pow(b, -1, PRIME) % PRIME
    return (a + b if kind == "+" else a - b if kind == "-" else a * b) % PRIME


def _factorial(x: complex) -> complex:
    if x.imag or x.real != int(x.real) or not 0 <= x.real <= 170:
        raise Undefined
    return complex(math.factorial(int(x.real)))


_COMPLEX: dict[str, Callable[[complex], complex]] = {
    "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "sinh": cmath.sinh, "cosh": cmath.cosh, "tanh": cmath.tanh, "exp": cmath.exp, "ln": cmath.log, "log": cmath.log,
    "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "cot": lambda x: 1 / cmath.tan(x), "sec": lambda x: 1 / cmath.cos(x), "csc": lambda x: 1 / cmath.sin(x),
    "abs": lambda x: complex(abs(x)), "factorial": _factorial,
}


def _value(tree: Tree, point: dict[str, complex]) -> complex:
    kind = tree[0]
    if kind == "n":
        return complex(tree[1])
    if kind == "v":
        return point[tree[1]]
    if kind == "c":
        return complex(math.pi if tree[1] == "pi" else math.e)
    values = [_value(x, point) for x in _parts(tree)]
    a, b = values[0], values[-1]
    if kind == "f":
        return _COMPLEX[tree[1]](a)
    if kind == "neg":
        return -a
    if kind == "^" and not a:
        if b.real <= 0:
            raise Undefined
        return 0j
    return a + b if kind == "+" else a - b if kind == "-" else a * b if kind == "*" else a / b if kind == "/" else a**b


def _values(trees: tuple[Tree, ...], names: list[str], points: int, exact: bool) -> list[tuple]:
    """Values of formulas at the same random points, where all have one."""
    draw, out = random.Random(20), []
    for _ in range(2 * points if names else 1):
        point = {n: draw.randrange(1, PRIME) if exact else cmath.rect(draw.uniform(0.3, 2.5), draw.uniform(-math.pi, math.pi)) for n in names}
        try:
            values = tuple(_exact(t, point) if exact else _value(t, point) for t in trees)
            if exact or all(cmath.isfinite(v) for v in values):
                out.append(values)
        except (ArithmeticError, ValueError):
            pass
        if len(out) == points:
            break
    return out


@lru_cache(maxsize=64)
def identical(a: Tree, b: Tree) -> bool | None:
    """Whether two formulas are equal wherever both are defined; null if no point tells."""
    names = sorted(variables(a) | variables(b))
    if rational(a) and rational(b):
        values = _values((a, b), names, EXACT_POINTS, True)
        return all(x == y for x, y in values) if values else None
    values = _values((a, b), names, POINTS, False)
    distances = [abs(x - y) / max(1.0, abs(x), abs(y)) for x, y in values]
    if distances and max(distances) > FAR:
        return False
    enough = len(distances) >= (POINTS // 2 if names else 1)
    return True if enough and max(distances) < NEAR else None


def same_expression(a: str | None, b: str | None) -> bool | None:
    """Whether two texts are the same formula; null if either is none."""
    trees = read(a), read(b)
    return None if None in trees else identical(*trees)


def number(text: str | None) -> float | None:
    """The real value of a formula without variables."""
    tree = read(text)
    if tree is None or variables(tree):
        return None
    found = _values((tree,), [], 1, False)
    return found[0][0].real if found and abs(found[0][0].imag) < NEAR * max(1.0, abs(found[0][0])) else None


def same_equation(a: str | None, b: str | None) -> bool | None:
    """Whether two equations say the same, one difference of sides being a real multiple of the other; null if either is none."""
    zeros = []
    for text in (a, b):
        sides = (text or "").split("=")
        trees = [read(s) for s in sides]
        if len(trees) != 2 or None in trees:
            return None
        zeros.append(("-", *trees))
    names = sorted(set().union(*map(variables, zeros)))
    exact = all(map(rational, zeros))
    values = _values(tuple(zeros), names, EXACT_POINTS if exact else POINTS, exact)
    if not values:
        return None
    if exact:
        (x, y), rest = values[0], values[1:]
        return None if not (x or y) else bool(x and y) and all(x * w % PRIME == y * v % PRIME for v, w in rest)
    if all(max(abs(x), abs(y)) < NEAR for x, y in values):
        return None
    if any(min(abs(x), abs(y)) < NEAR for x, y in values):
        return False
    ratios = [x / y for x, y in values]
    return all(abs(r - ratios[0]) <= FAR * abs(r) for r in ratios) and abs(ratios[0].imag) <= FAR * abs(ratios[0])
