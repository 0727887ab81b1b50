"""Text of answers: extraction, normalisation and comparison, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: a decimal number as Python's float() reads it, without signs of type
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
# fixed value: LaTeX commands that only wrap text
WRAPPER = r"(?s)^\\(?:text|textbf|textit|textrm|mathrm|mathbf|mathit|operatorname)\{(.+)\}$"
# fixed value: units that may follow an answer of AIME
UNIT_SUFFIX = r"\s*(?:\\?(?:\^\\?circ|°)|\\%|%|\\text\{[^}]*\}|\\mathrm\{[^}]*\})\s*$"
# fixed value: the white space that Python's strip() removes, as far as one byte goes
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def strip(text: Column) -> Column:
    """White space of all kinds off both ends."""
    return F.btrim(text, F.lit(BLANKS))


def number(text: Column) -> Column:
    """The number a text is, else null."""
    return F.when(strip(text).rlike(NUMBER), strip(text).try_cast("double"))


def strip_wrappers(text: Column) -> Column:
    """Wrapping commands peeled off until none is left: as many rounds as the text has opening braces suffice."""
    rounds = F.sequence(F.lit(0), F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit(""))))
    return F.aggregate(rounds, strip(text), lambda out, _: strip(F.regexp_replace(out, WRAPPER, "$1")))


def same_choice(predicted: Column, truth: Column) -> Column:
    return F.coalesce(F.upper(strip(predicted)) == F.upper(strip(truth)), F.lit(False))


def same_general(predicted: Column, truth: Column) -> Column:
    """Equal as numbers (42.0 = 42) or as trimmed lower-case text; a null prediction is wrong."""
    a, b = number(predicted), number(truth)
    text = F.lower(strip(predicted)) == F.lower(strip(truth))
    return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), a == b).otherwise(text), F.lit(False))


def text_key(text: Column) -> Column:
    """Lower case, without punctuation, runs of white space as one space."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(text)), r"(?U)[^\w\s]", ""), r"(?U)\s+", " ")


def squad(text: Column) -> Column:
    """Lower case, punctuation and articles out, white space squeezed."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def exact_match(prediction: Column, golden: Column, normal=squad) -> Column:
    return F.exists(golden, lambda g: normal(g) == normal(prediction))


def substring_match(prediction: Column, golden: Column, normal=squad) -> Column:
    return F.exists(golden, lambda g: F.contains(normal(prediction), normal(g)))


def last_group(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern's last match; null without any."""
    found = F.regexp_extract_all(text, F.lit(pattern), group)
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def last_answer_block(text: Column) -> Column:
    return F.trim(last_group(text, r"(?s)<answer>(.*?)</answer>"))


def grade_school_answer(text: Column, method: str = "strict") -> Column:
    """From the last 300 characters: the number after the last ####, or the last number at all."""
    tail = F.right(text, F.lit(300))
    if method == "strict":
        return F.replace(last_group(tail, r"#### (\-?[0-9.,]+)"), F.lit(","), F.lit(""))
    found = F.filter(F.regexp_extract_all(tail, F.lit(r"(\-?[0-9.,]+)"), 1), lambda x: x != ".")
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def choice_letter(text: Column) -> Column:
    """The letter A-J: after "answer is", else after the last "Answer:" of a line, else the last that stands alone."""
    return F.upper(
        F.coalesce(
            first_group(text, r"(?i)answer is\s+\(?([A-J])\)?"),
            first_group(text, r".*[aA]nswer:\s*([A-J])"),
            last_group(text, r"\b([A-J])\b"),
        )
    )


def same_integer(predicted: Column, truth: Column) -> Column:
    """Equal after cutting units and decimals off (3.7 matches 3); equal text where one is no number; null for no answer."""
    bare = lambda x: F.regexp_replace(strip(x), UNIT_SUFFIX, "")
    p, t = bare(predicted), bare(truth)
    a, b = number(p).try_cast("bigint"), number(t).try_cast("bigint")
    return F.when(p != "", F.when(a.isNotNull() & b.isNotNull(), a == b).otherwise(p == t))


def canonical_percent(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\%", "/100"), r"(?<=\d)%", "/100")


def opener(text: Column) -> Column:
    """The class of a response's first words: alright, to, others."""
    head = F.ltrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS))
    return F.when(head.startswith("alright"), "alright").when(head.startswith("to "), "to").otherwise("others")


def benchmark_name(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.json$", "")


def code_block(text: Column) -> Column:
    """The last fenced Python block, else the whole text."""
    return F.trim(F.coalesce(last_group(text, r"(?s)```(?:python|py)\s*\n(.*?)```"), text))


def tool_calls(text: Column, schema: str = "name string, arguments map<string,string>") -> Column:
    """The calls in all <tool_call> blocks; what isn't valid JSON goes."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), 1)
    return F.filter(F.transform(found, lambda x: F.from_json(x, schema)), lambda c: c.isNotNull() & c["name"].isNotNull())


def verdict(text: Column) -> Column:
    """INCORRECT outranks CORRECT; neither is null."""
    upper = F.upper(text)
    return F.when(upper.rlike(r"\bINCORRECT\b"), False).when(upper.rlike(r"\bCORRECT\b"), True)


def numbers_equal(predicted: Column, truth: Column, precision: float) -> Column:
    """Relative tolerance, strict; absolute where the truth is 0."""
    relative = F.abs(predicted - truth) / F.greatest(F.abs(truth), F.lit(1e-15)) < precision
    return F.when(truth == 0, F.abs(predicted) < precision).otherwise(relative)


def fraction(value: Column) -> Column:
    """A percentage over 1 as a fraction."""
    return F.when(value > 1, value / 100).otherwise(value)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def token_count(text: Column) -> Column:
    """Words and single signs."""
    return F.regexp_count(text, F.lit(r"(?U)\w+|[^\w\s]"))


def noninformative(problem: Column, answer: Column) -> Column:
    """Whether an answer only restates its problem: empty, equal, contained, or with under 30 characters more."""

    def bare(x: Column) -> Column:
        marks = F.regexp_replace(x, r"</?(?:sup|sub|b|i|em|strong)>|[*_`#]", "")
        return F.lower(F.trim(F.regexp_replace(marks, r"\s+", " ")))

    q, a = bare(problem), bare(answer)
    inside = (F.length(a) >= 12) & F.contains(q, a)
    restated = (q != "") & F.contains(a, q) & (F.length(a) - F.length(q) < 30)
    return (a == "") | (a == q) | inside | restated


def search_score(text: Column, truths: Column, format_score: float = 0.0, score: float = 1.0, most_tags: int = 10) -> Column:
    """The score of the last answer block that is one of the truths in squad form, a quarter of it if there are more than
    ``most_tags`` opening or closing tags; ``format_score`` for another block, 0 without any."""
    answer = last_answer_block(text)
    right = F.exists(truths, lambda t: squad(t) == squad(answer))
    tags = F.greatest(*[F.regexp_count(text, F.lit(x)) for x in ("<answer>", "</answer>")])
    return F.when(answer.isNull(), 0.0).when(~right, format_score).when(tags > most_tags, score / 4).otherwise(score)


def without_tool_calls(text: Column) -> Column:
    """The text without its <tool_call> blocks, whatever they hold."""
    return F.regexp_replace(text, r"(?s)<tool_call>(.*?)</tool_call>", "")


def seed_examples(questions: Column) -> Column:
    """Numbered examples of an array of (question_text, choices, ground_truth), with letters before the choices."""
    choice = lambda c, j: F.concat(F.lit("  "), F.char(F.lit(65) + j), F.lit(") "), c)
    shown = lambda q, i: F.concat(
        F.lit("Example "), (i + 1).cast("string"), F.lit(":\nQuestion: "), q["question_text"], F.lit("\nChoices:\n"), F.array_join(F.transform(q["choices"], choice), "\n"), F.lit("\nAnswer: "), q["ground_truth"]
    )
    return F.array_join(F.transform(questions, shown), "\n\n")
