"""Questions out of generated text: escapes, JSON spans, validation, normal form."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The brute search for JSON in a broken wrapper starts at so many braces at most, in texts up to this length.
MOST_BRACES, MOST_CHARS = 8, 16_384
_ESCAPE = re.compile(r"\\(\\|.)")


def fix_escapes(text: str) -> str:
    """Backslashes of LaTeX doubled: before b, f, n, r or t with a letter of ASCII after it, and before all that isn't an
    escape of one letter (so before u too). Pairs of backslashes and real escapes stay."""

    def one(m: re.Match) -> str:
        what, after = m[1], text[m.end() : m.end() + 1]
        command = what in "bfnrt" and after.isascii() and after.isalpha()
        return m[0] if what in '\\"/bfnrt' and not command else "\\\\" + what

    return _ESCAPE.sub(one, text)


def brace_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the outermost balanced braces, those within double-quoted strings not counted."""
    spans, depth, start = [], 0, 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*(?:"|\Z)|\\.|[{}]', text, re.S):
        if m[0] == "{":
            start = m.start() if depth == 0 else start
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if not depth:
                spans.append((start, m.end()))
    return spans


def _loads(text: str):
    for form in (fix_escapes(text), text):
        try:
            return json.loads(form)
        except (json.JSONDecodeError, RecursionError):
            continue
    return None


def thinking_and_json(text: str | None, valid=None) -> tuple[str | None, dict | None, str | None]:
    """What is thought, the last valid JSON object (else the last of all), and what is wrong with it."""
    if not text:
        return None, None, "empty_response"
    thought = re.search(r"<think>(.*?)</think>", text, re.S)
    thinking = thought[1].strip() if thought else None
    bare = re.sub(r"<think>.*?</think>", "", text, flags=re.S)
    bare = re.sub(r"```\s*", "", re.sub(r"```json\s*", "", bare)).strip()
    if not bare:
        return thinking, None, "no_json_content"
    if "{" not in bare:
        return thinking, None, "no_json_object"
    found = [x for a, b in brace_spans(bare) if (x := _loads(bare[a:b])) is not None]
    if not found and len(bare) <= MOST_CHARS:
        ends = [m.end() for m in re.finditer("}", bare)]
        for start in [m.start() for m in re.finditer("{", bare)][:MOST_BRACES]:
            found += next(([x] for end in reversed(ends) if end > start and (x := _loads(bare[start:end])) is not None), [])
    if not found:
        return thinking, None, "truncated_json" if bare.count("{") > bare.count("}") else "invalid_json"
    good = [x for x in found if valid is None or valid(x)]
    return (thinking, good[-1], None) if good else (thinking, found[-1], "missing_required_fields")


def as_text(value, lists: bool = False) -> str | None:
    """Strings, numbers, the only value of an object, and where allowed a list of scalars, as a string."""
    if isinstance(value, str):
        return value
    if isinstance(value, int | float):
        return str(value)
    if lists and isinstance(value, list) and all(isinstance(x, str | int | float) for x in value):
        return " ".join(map(str, value))
    if isinstance(value, dict) and len(value) == 1:
        (only,) = value.values()
        return str(only) if isinstance(only, str | int | float) else None
    return None


def as_choices(value) -> list[str] | None:
    """A list, or an object by letters up to the first that is missing, as strings."""
    if isinstance(value, dict):
        taken = []
        for letter in LETTERS:
            if letter not in value and letter.lower() not in value:
                break
            taken.append(value.get(letter, value.get(letter.lower())))
        value = taken
    if not isinstance(value, list):
        return None
    texts = [as_text(x) for x in value]
    return None if None in texts else texts


def _open(question: dict) -> bool:
    return str(question.get("benchmark_type") or "").strip().lower() == "qa_open" or question.get("choices") == []


def well_formed(question) -> bool:
    """Question and truth are there, with four to eight choices or none and the open type."""
    if not isinstance(question, dict) or "question_text" not in question or "ground_truth" not in question:
        return False
    choices = as_choices(question.get("choices"))
    return 4 <= len(choices) <= 8 if choices else _open(question)


def parse_question(text: str | None) -> dict | None:
    """A question in normal form; None if it can't be read."""
    _, question, wrong = thinking_and_json(text, well_formed)
    if question is None or wrong:
        return None
    asked, truth = as_text(question.get("question_text"), lists=True), as_text(question.get("ground_truth"))
    if asked is None or truth is None:
        return None
    choices = as_choices(question.get("choices"))
    if choices:
        if truth and truth not in choices:
            truth = next((c for c in choices if c.strip().lower() == truth.strip().lower()), truth)
        kind = str(question.get("benchmark_type") or "qa_mcq")
        return {"question_text": asked, "ground_truth": truth, "choices": choices, "is_mcq": True, "benchmark_type": kind, "data_source": str(question.get("data_source") or ""), "answer_type": None}
    answer_type = question.get("answer_type")
    return {
        "question_text": asked, "ground_truth": truth, "choices": [], "is_mcq": False, "benchmark_type": str(question.get("benchmark_type") or "qa_open"),
        "data_source": str(question.get("data_source") or "math"), "answer_type": None if answer_type is None else str(answer_type),
    }


PARSED = "question_text string, ground_truth string, choices array<string>, is_mcq boolean, benchmark_type string, data_source string, answer_type string, reject_reason string"


def parse_questions(df: DataFrame, text: str, doc: str, row: str) -> DataFrame:
    """(row, doc, question_id, parsed_ok, ... of PARSED): reject_reason says why a row has no question."""
    names = [c.split()[0] for c in PARSED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            out = []
            for value in batch.column(2).to_pylist():
                q = parse_question(value)
                wrong = None
                if q is None:
                    wrong = "failed_parse"
                elif not q["question_text"].strip():
                    wrong = "empty_question"
                elif not q["ground_truth"].strip() or q["is_mcq"] and q["ground_truth"] not in q["choices"]:
                    wrong = "invalid_ground_truth"
                out.append(dict.fromkeys(names) | ({} if wrong else q) | {"reject_reason": wrong})
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array([o[n] for o in out], t) for n, t in zip(names, types, strict=True)]], names=["row", "doc", *names])

    slim = df.select(F.col(row).cast("long").alias("row"), F.col(doc).cast("string").alias("doc"), F.col(text).alias("text"))
    parsed = slim.mapInArrow(run, f"row long, doc string, {PARSED}")
    ok = F.col("reject_reason").isNull()
    return parsed.withColumn("parsed_ok", ok).withColumn("question_id", F.when(ok, question_id(F.col("doc"), F.col("row"), F.col("question_text"))))


def question_id(doc: Column, row: Column, text: Column) -> Column:
    return F.concat_ws("_", F.lit("gen"), doc.cast("string"), row.cast("string"), F.substring(F.md5(text), 1, 8))


def format_choices(text: Column, choices: Column) -> Column:
    """The question and its choices, one a line, by letters."""
    lines = F.transform(choices, lambda c, i: F.concat(F.substring(F.lit(LETTERS), i + 1, F.lit(1)), F.lit(") "), c))
    return F.concat_ws("\n", F.concat(F.lit("Question: "), text), F.array_join(lines, "\n"))


def truth_letter(choices: Column, truth: Column) -> Column:
    """The letter of a truth that is a choice's text, or a letter already."""
    at = F.array_position(F.transform(choices, lambda c: F.lower(F.trim(c))), F.lower(F.trim(truth)))
    bare = F.upper(F.trim(truth))
    letter = F.when(at > 0, F.substring(F.lit(LETTERS), at.cast("int"), F.lit(1)))
    own = (F.length(bare) == 1) & (F.instr(F.lit(LETTERS), bare) > 0) & (F.instr(F.lit(LETTERS), bare) <= F.size(choices))
    return F.coalesce(letter, F.when(own, bare))
