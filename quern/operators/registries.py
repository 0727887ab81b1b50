"""Extension points: functions registered by a unique name, and the seam that picks a scorer for a row.

Verifiers and scorers are column functions of (prediction, truth): a verifier gives 1, 0 or null, a scorer any figure. A
reward manager is a function from DataFrame to DataFrame that adds ``reward``.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import answers as X
from quern.functions import strings as S


class Registry(dict):
    """Functions by name; a name that is taken or unknown is an error."""

    def __init__(self, what: str):
        super().__init__()
        self.what = what

    def add(self, name: str):
        def keep(f: Callable) -> Callable:
            if name in self:
                raise ValueError(f"{self.what} {name!r} exists")
            self[name] = f
            return f

        return keep

    def __missing__(self, name: str):
        raise ValueError(f"unknown {self.what} {name!r}; known: {sorted(self)}")


VERIFIERS = Registry("verifier")
SCORERS = Registry("scorer")
REWARD_MANAGERS = Registry("reward manager")

VERIFIERS.add("aime")(lambda p, t: S.same_integer(p, t).cast("double"))
VERIFIERS.add("math")(lambda p, t: X.over(X.math_equal, "boolean")(p, t).cast("double"))
SCORERS.add("length_ratio")(lambda p, t: F.least(F.length(p), F.length(t)) / F.greatest(F.length(p), F.length(t), F.lit(1)))


def from_file(path: str, name: str, kind: str = "double") -> Callable[..., Column]:
    """A row function of a Python file as a column function; the function travels with the plan, executors need no file."""
    spec = importlib.util.spec_from_file_location("reward_function", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no function {name!r}")
    return X.over(getattr(module, name), kind)


def by_source(source: Column, rules: Mapping[str, Callable[..., Column]], *columns: Column, default: Callable[..., Column] | None = None) -> Column:
    """The rule of a row's data source; the default, else null, for other sources."""
    out = default(*columns) if default else F.lit(None).cast("double")
    for name, rule in rules.items():
        out = F.when(source == name, rule(*columns)).otherwise(out)
    return out


def seam(verifier: Column, is_choice: Column, prediction: Column, truth: Column, verifiers: Mapping[str, Callable[..., Column]] = VERIFIERS) -> Column:
    """(score, route): a named verifier first, then the letter of a choice question, then the general comparison."""
    named = verifier.isin(*verifiers)
    checked = by_source(verifier, dict(verifiers), prediction, truth)
    letter = S.same_choice(prediction, truth).cast("double")
    general = F.coalesce(S.same_general(prediction, truth), F.lit(False)).cast("double")
    choice = F.coalesce(is_choice, F.lit(False))
    score = F.when(F.coalesce(named, F.lit(False)), checked).when(choice, letter).otherwise(general)
    route = F.when(F.coalesce(named, F.lit(False)), F.lit("verifier")).when(choice, F.lit("choice")).otherwise(F.lit("general"))
    return F.struct(score.alias("score"), route.alias("route"))


@REWARD_MANAGERS.add("naive")
def naive(df: DataFrame, score: str = "score", mask: str = "mask") -> DataFrame:
    """The score at the last token that counts."""
    return df.withColumn("reward", F.when(F.aggregate(mask, F.lit(0), lambda a, x: a + x) > 0, F.coalesce(score, F.lit(0.0))).otherwise(0.0))


@REWARD_MANAGERS.add("overlong")
def overlong(df: DataFrame, score: str = "score", mask: str = "mask", longest: int = 6, buffer: int = 3, factor: float = 1.0) -> DataFrame:
    """As naive, less a penalty that grows over the last ``buffer`` tokens of the longest answer."""
    tokens = F.aggregate(mask, F.lit(0), lambda a, x: a + x)
    over = tokens - (longest - buffer)
    return naive(df, score, mask).withColumn("reward", F.col("reward") + F.least(-over / F.lit(buffer) * factor, F.lit(0.0)))


@REWARD_MANAGERS.add("rejecting")
def rejecting(df: DataFrame, score: str = "score", mask: str = "mask") -> DataFrame:
    """As naive; rows without a score are left out, as after a failed remote call."""
    return naive(df.where(F.col(score).isNotNull()), score, mask)
