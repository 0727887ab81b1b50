"""Which checkpoints of a run are meant, and which there are."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import SparkSession

_RANGE = re.compile(r"(\d+)-(\d+)")
_STEP = re.compile(r"global_step_(\d+)")


def parse(spec: int | str | Iterable[int] | None) -> list[int] | None:
    """The numbers that a text, a number or a list names, in order and once each.

    Texts are single numbers and ranges "0-5" with both ends, between commas; or "0:20", with both ends, or "0:20:5", without
    the last. Square brackets around all are left out.
    """
    if spec is None:
        return None
    if isinstance(spec, int):
        return [spec]
    if not isinstance(spec, str):
        found = list(spec)
        if len(found) == 1 and isinstance(found[0], str):
            return parse(found[0])
    else:
        text = spec.strip()
        text = text[1:-1] if text[:1] == "[" and text[-1:] == "]" else text
        parts = [x.strip() for x in text.split(",") if x.strip()]
        if ":" in text:
            bounds = [int(x) for x in text.split(":")]
            if len(bounds) not in (2, 3):
                raise ValueError(f"{spec!r} is no start:stop or start:stop:step")
            found = list(range(*bounds) if len(bounds) == 3 else range(bounds[0], bounds[1] + 1))
        else:
            found = []
            for part in parts:
                ends = _RANGE.fullmatch(part)
                found += range(int(ends[1]), int(ends[2]) + 1) if ends else [int(part)]
    if not found:
        raise ValueError(f"{spec!r} names no checkpoint")
    return sorted(set(found))


def discover(spark: SparkSession, folder: str) -> list[int]:
    """The steps of a run's folder, wherever Spark can read it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(m[1]) for n in names if (m := _STEP.fullmatch(n)))
