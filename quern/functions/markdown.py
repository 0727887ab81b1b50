"""Markdown to chunks: split by headers, then oversize parts by paragraph, sentence and force; small ones go."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST, LEAST = 4096, 200
#: Characters of texts whose chunks leave as one batch.
HELD_CHARS = 1 << 20
Count = Callable[[str], int]


def estimate(text: str) -> int:
    return max(1, len(text) // 4)


def sections(text: str) -> list[tuple[dict[str, str], str]]:
    """(headers, body) of each part between headers of levels 1 to 3; fenced code holds no headers.

    Lines are stripped, blank ones end a block, and blocks under the same headers are joined by two blanks and a line end.
    """
    text = re.sub(r'<span id="page-\d+-\d+"></span>', "", text)
    out: list[tuple[dict[str, str], str]] = []
    headers: dict[str, str] = {}
    block: list[str] = []
    fence = ""

    def flush() -> None:
        if block:
            body = "\n".join(block)
            block.clear()
            if out and out[-1][0] == headers:
                body = out.pop()[1] + "  \n" + body
            out.append((headers, body))

    for line in text.split("\n"):
        bare = line.strip()
        bare = bare if bare.isprintable() else "".join(filter(str.isprintable, bare))
        if fence:
            fence = "" if bare.startswith(fence) else fence
        elif bare.startswith("~~~") or bare.startswith("```") and bare.count("```") == 1:
            fence = bare[:3]
        if not fence and (m := re.match(r"(#{1,3})(?: (.*))?$", bare)):
            flush()
            level = len(m[1])
            headers = {k: v for k, v in headers.items() if int(k[-1]) < level} | {f"Header {level}": (m[2] or "").strip()}
        elif bare or fence:
            block.append(bare)
        else:
            flush()
    flush()
    return out


def _packed(parts: list[str], joint: str, most: int, weigh: Count, end: str = "") -> list[str]:
    """Neighbours joined as long as the sum of their counts allows."""
    out, held, total = [], [], 0
    for part in parts:
        n = weigh(part)
        if held and total + n > most:
            out.append(joint.join(held) + end)
            held, total = [], 0
        held.append(part)
        total += n
    return out + [joint.join(held) + end] * bool(held)


def by_sentence(text: str, most: int, count: Count = estimate) -> list[str]:
    return _packed(text.split(". "), ". ", most, lambda s: count(s + "."), ".")


def by_paragraph(text: str, most: int, count: Count = estimate) -> list[str]:
    """Paragraphs packed; one that is too large alone goes by sentence."""
    out, run = [], []
    for para in [*text.split("\n\n"), None]:
        if para is not None and count(para) <= most:
            run.append(para)
            continue
        if run:
            out += _packed(run, "\n\n", most, count)
            run = []
        if para is not None:
            out += by_sentence(para, most, count)
    return out


def by_force(text: str, most: int, count: Count = estimate) -> list[str]:
    """Cut after closed brackets, at commas, at blanks, else by so many characters, less and less until all fit."""
    for pattern, joint in ((r"(?<=\))\s*[,;]\s*", ", "), (r",\s+", ", "), (r"\s+", " ")):
        parts = re.split(pattern, text)
        if len(parts) > 1:
            packed = _packed(parts, joint, most, count)
            if all(count(p) <= most for p in packed):
                return packed
    size = max(100, most * 2)
    while True:
        cut = [p for i in range(0, len(text), size) if (p := text[i : i + size]).strip()]
        if size == 100 and size * 2 // 3 <= 50 or size <= 50 or all(count(p) <= most for p in cut):
            return cut
        size = size * 2 // 3 if size * 2 // 3 > 50 else 100
        if size == 100:
            return [p for i in range(0, len(text), size) if (p := text[i : i + size]).strip()]


def bounded(text: str, most: int = MOST, count: Count = estimate) -> list[str]:
    """A part in pieces of at most ``most`` tokens."""
    if count(text) <= most:
        return [text]
    return [p for part in by_paragraph(text, most, count) for p in ([part] if count(part) <= most else by_force(part, most, count))]


def chunk(df: DataFrame, text: str, key: str, most: int = MOST, least: int = LEAST) -> DataFrame:
    """(key, chunk, headers, page_content, token_count) of the chunks of ``least`` tokens or more, numbered from 0 before
    small ones go. A null text has none."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string())
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        sizes = pa.array([estimate(r[3]) for r in rows], pa.int64())
        return pa.record_batch([*columns, sizes], names=["key", "chunk", "headers", "page_content", "token_count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py() or ""
                rows += [(k, i, list(h.items()), p) for i, (h, p) in enumerate((h, p) for h, body in sections(text) for p in bounded(body, most))]
                held += len(text)
                if held > HELD_CHARS:
                    yield made(rows)
                    rows, held = [], 0
            yield made(rows)

    out = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(
        run, "key long, chunk int, headers map<string,string>, page_content string, token_count long"
    )
    return out.where(F.col("token_count") >= least) if least > 0 else out
