"""State that a loop keeps from batch to batch: what each question scored in every loop, and which questions are used up.

The state of a key lies in Spark's state store under the stream's checkpoint, version by version with the batches: a batch
that runs again after a failure starts from the version before it, so it ends in the same state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Loops with a score before a question can be used up.
LEAST_LOOPS = 3


def curriculum(stream: DataFrame, key: str, loop: str, score: str, low: float, high: float, least: int = LEAST_LOOPS) -> DataFrame:
    """(key, loop, mean, history, status): the mean score of a question in a loop and over its loops so far.

    A question is used up as soon as it has ``least`` loops and a mean over them of ``low`` or under, or ``high`` or over; its
    history is then forgotten, and later rows of it are passed over. Rows without a score count in no mean. All rows of a
    loop must come in one batch, and loops in order.
    """
    kind = next(f.dataType.simpleString() for f in stream.schema if f.name == key)
    rows = stream.where(F.col(key).isNotNull()).select(key, F.col(loop).cast("long").alias("loop"), F.col(score).cast("double").alias("score"))

    def fold(name: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        used, loops, total = state.get if state.exists else (False, 0, 0.0)
        out = []
        means = pd.concat(list(frames)).groupby("loop")["score"].mean().sort_index()
        for number, mean in means.items():
            if used or pd.isna(mean):
                continue
            loops, total = loops + 1, total + float(mean)
            history = total / loops
            used = loops >= least and (history <= low or history >= high)
            out.append((name[0], int(number), float(mean), history, "used" if used else "kept"))
            if used:
                loops, total = 0, 0.0
        state.update((used, loops, total))
        yield pd.DataFrame(out, columns=[key, "loop", "mean", "history", "status"])

    return rows.groupBy(key).applyInPandasWithState(
        fold, f"`{key}` {kind}, loop long, mean double, history double, status string", "used boolean, loops long, total double", "append", "NoTimeout"
    )
