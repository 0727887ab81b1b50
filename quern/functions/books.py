"""Books in Markdown: an outline of sections with their chapters and labels, numbered items, and what they pair up from.

A book is read in one pass over its lines per section; what it gives are flat rows, which ``operators.pairing`` matches by
joins. Headings inside a fence are text. A number of a book's nested sections hold the same lines, so rows come in the order
of sections, and the first of equal keys counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

# The headings, labels, item marks and figures that books are printed with.
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*\s*$")
BOLD = re.compile(r"^\*\*(.+?)\*\*$")
FENCE = "```"
LEVELS = r"introductory|advanced|beginning|intermediate|challenging|harder|easier|sample|review|warm[-\s]?up"
NUMBER = r"\d+(?:\.\d+)*"
EXERCISES = re.compile(
    rf"^\s*(?:§\s*)?(?:{NUMBER}[.):]?\s+)?(?:Part\s+[IVX0-9]+[:.]?\s+)?(?:(?:{LEVELS}|proposed)\s+)?"
    r"(?:exercises?|problems?|practice\s+(?:problems?|exercises?)|(?:exercise|problem)\s+set|testing\s+questions?)"
    rf"(?:\s+and\s+(?:exercises?|problems?))?(?:\s*{NUMBER})?(?:\s*[A-Z]|\s*\(\s*[A-Z]\s*\)?)?\s*[:.]?\s*$",
    re.IGNORECASE,
)
ANSWERS = re.compile(
    rf"^\s*(?:§\s*)?(?:{NUMBER}[.):]?\s+|Part\s+[IVX0-9]+[:.]?\s+)?(?:"
    r"answers?(?:\s+(?:to|for|and|key)\b.*)?\s*[:.]?\s*$|solutions?(?:\s+(?:to|for|manual)\b.*)?\s*[:.]?\s*$"
    r"|hints?\s+(?:to|and|for)\b.*$|hints?\s*[:.]?\s*$|suggestions?\b.*\b(?:solutions?|answers?|hints?)\b.*$"
    r"|answer\s+key.*$|selected\s+(?:answers?|solutions?)\b.*$|brief\s+answers?\b.*$)",
    re.IGNORECASE,
)
CHAPTER = re.compile(
    rf"^\s*(?:chapter\s+({NUMBER})|lecture\s+({NUMBER})|solutions?\s+to\s+test(?:ing)?\s+questions?\s+\(?({NUMBER})\)?)\b", re.IGNORECASE
)
NUMBERED = re.compile(rf"^\s*({NUMBER})[.):]?\s+[A-Z]")
LABEL = re.compile(rf"\b({LEVELS})\b|\((?:\d+-)?([A-B])(?:\)|(?=\s*$))", re.IGNORECASE)
NAMED_ITEM = re.compile(rf"^(?:[-*+]\s+)?(?:\*\*)?(?:Problem|Exercise|Solution)\s+({NUMBER})[.)\]:]?(?:\*\*)?(?:\s+|$)", re.IGNORECASE)
ITEM = re.compile(rf"^(?:[-*+]\s+)?(?:\*\*)?(?:<sup>)?({NUMBER})(?:</sup>)?[.)\]](?:\*\*)?(?:\s|$)")
GLUED = re.compile(r"(?<=[.?!)\]])[ \t]+(?=(\d+)\.[ \t]+[A-Z(])")
#: Digits of a glued number that needs no item before it; longer ones may be years.
GLUED_DIGITS = 3
HEADED_PROBLEM = re.compile(rf"^problems?\s+({NUMBER})\b", re.IGNORECASE)
HEADED_ANSWER = re.compile(rf"^(?:solutions?|answers?)\s+({NUMBER})\b", re.IGNORECASE)
INLINE = re.compile(r"^[ \t]{0,3}(?:\*\*|__)?(?:(?:Example|Problem|Exercise)s?\s+)?(\d+\.\d+(?:\.\d+)*)\.?(?:\*\*|__)?[ \t]+(?=\S)")
INLINE_SINGLE = re.compile(r"^[ \t]{0,3}(?:\*\*|__)?(?:(?:Example|Problem|Exercise)s?\s+)?(\d{1,3})\.(?:\*\*|__)?[ \t]+(?=\S)")
SOLVED_LINE = re.compile(
    r"^[ \t]{0,3}(?:\*\*|__)?(?:Solution|Proof|Answer)s?(?:\s*\([^)]{0,20}\))?\s*[.:]?\s*(?:\*\*|__)?\s*$"
    r"|^[ \t]{0,3}(?:\*\*|__)?(?:Solution|Proof|Answer)s?\b[.:]?(?:\*\*|__)?[ \t]+(?=\S)",
    re.IGNORECASE,
)
PAPER_ITEM = re.compile(r"^[ \t]{0,3}(?:[-*+][ \t]+)?(\d{1,3})[ \t]*[).\]]?[ \t]+(?=\D)")
PAPER_SOLVED = re.compile(r"(?:(?<=^)|(?<=\s))\*{0,2}(?:Solution|Proof)s?\s*\d{0,2}\s*\*{0,2}\s*[.:]\s*(?=\S)", re.IGNORECASE)
PAPER_GROUP = re.compile(r"\b(?:Olympiad|Competition|Selection\s*Test|Team\s*Selection|Tournament)\b", re.IGNORECASE)
PAPER_YEAR = re.compile(r"^\*{0,2}\s*(?:(?:19|20)\d\d)\b\s*(?:\([^)]*\))?")
PAPER_PART = re.compile(r"^\*{0,2}\s*(?:Part\s+[IVX0-9]+\b|(?:First|Second|Third|Fourth)\s*Day\b)", re.IGNORECASE)
PAPER_SOLUTION = re.compile(r"^\s*(?:Solution|Proof)s?\b", re.IGNORECASE)
KINDS = "(Contest|Shortlisted|Longlisted|Selected)"
YEARLY_ANSWERS = re.compile(rf"^\d+(?:\.\d+)?\s+Solutions?\s+to\s+the\s+{KINDS}\s+Problems\s+of\s+IMO\s+((?:19|20)\d\d)\b", re.IGNORECASE)
YEARLY_PROBLEMS = re.compile(rf"^\d+\.\d+\.\d+\s+(?:Some\s+)?{KINDS}\s+Problems\b", re.IGNORECASE)
YEARLY = re.compile(r"^\d+\.\d+\s+The\s+\S.*\bIMO\b", re.IGNORECASE)
YEAR = re.compile(r"(?:19|20)\d\d")
DAY = re.compile(r"^\*{0,2}(?:First|Second|Third|Fourth)\s+Day\*{0,2}\s*$", re.IGNORECASE)
SPAN = re.compile(r"</?span[^>]*>")
PAGE_HEADING = re.compile(r"^#{1,6}[ \t]+\*\*\d{1,3}\.[ \t]+.*?[A-Za-z].*?[ \t]+\d{1,4}\*\*[ \t]*$", re.MULTILINE)
PROMOTED_ITEM = re.compile(r"^#{3,6}[ \t]+(\d{1,3}[.)\]][ \t]+\S.*)$", re.MULTILINE)
#: Least headed pairs, inline problems and problems of a paper that are taken for a layout; least lengths of a paper's pair.
LEAST_PAIRS = LEAST_INLINE = LEAST_PAPER = 3
LEAST_CHARS = 15
#: Numbers of a paper rise by this at most.
PAPER_STEP = 3


@dataclass
class Section:
    """What stands between a heading and the next one of its level or above."""

    kind: str
    level: int
    title: str
    chapter: str | None
    label: str | None
    lines: list[str]
    #: An answer section that took in chapters of its own level.
    wrapper: bool


def title_of(line: str) -> tuple[int, str] | None:
    """Level and text of a heading, without bold marks around it."""
    found = HEADING.match(line)
    if not found:
        return None
    text = found[2].strip()
    bold = BOLD.match(text)
    return len(found[1]), bold[1].strip() if bold else text


def without_artifacts(text: str) -> str:
    """Without span tags and running page headings; items that were made headings are items again."""
    return PROMOTED_ITEM.sub(r"\1", PAGE_HEADING.sub("", SPAN.sub("", text)))


def label_of(title: str) -> str | None:
    found = LABEL.search(title)
    return (found[1] or found[2]).lower().replace(" ", "-") if found else None


def kind_of(title: str) -> str:
    return "exercise" if EXERCISES.match(title) else "answer_key" if ANSWERS.match(title) else "normal"


def _named(title: str) -> str | None:
    found = CHAPTER.match(title)
    return found and (found[1] or found[2] or found[3])


def open_lines(lines: Iterable[str]) -> Iterator[tuple[str, bool]]:
    """Each line and whether it stands open, that is, neither in a fence nor as its mark."""
    fenced = False
    for line in lines:
        mark = line.startswith(FENCE)
        fenced ^= mark
        yield line, not mark and not fenced


def sections(text: str) -> list[Section]:
    """The sections of a book in order of their headings; each inherits the chapter of the headings before it.

    Headings of exercises and answers are no chapters, and a bare number is one on the two top levels only. An answer section
    that names a lecture is of that chapter.
    """
    lines = without_artifacts(text).splitlines()
    heads = [(i, *found) for i, (line, is_open) in enumerate(open_lines(lines)) if is_open and (found := title_of(line))]
    kinds = [kind_of(title) for _, _, title in heads]
    ends, inherited, following, current = [], [], [len(heads)] * len(heads), None
    stack: list[int] = []
    for k, (_, level, title) in enumerate(heads):
        while stack and heads[stack[-1]][1] >= level:
            following[stack.pop()] = k
        stack.append(k)
        inherited.append(current)
        if kinds[k] == "normal":
            number = NUMBERED.match(title) if level <= 2 else None
            current = _named(title) or (number[1] if number else current)
    out = []
    for k, (at, level, title) in enumerate(heads):
        end = following[k]
        while kinds[k] == "answer_key" and end < len(heads) and heads[end][1] == level and kinds[end] == "normal" and (CHAPTER.match(heads[end][2]) or NUMBERED.match(heads[end][2])):
            end = following[end]
        ends.append(end)
        named = CHAPTER.match(title) if kinds[k] == "answer_key" else None
        body = lines[at + 1 : heads[end][0] if end < len(heads) else len(lines)]
        chapter = named[3] if named and named[3] else inherited[k]
        out.append(Section(kinds[k], level, title, chapter, label_of(title), _stripped(body), end != following[k]))
    return out


def _stripped(lines: list[str]) -> list[str]:
    return "\n".join(lines).strip().splitlines()


def numbered_items(lines: Iterable[str]) -> list[tuple[str, str]]:
    """(number, body) of the items that begin a line, or follow the end of a sentence with a number and a capital.

    A number of more than GLUED_DIGITS digits does so only right after the item whose number is one less.
    """
    found: list[tuple[str, list[str]]] = []

    def single() -> Iterator[str]:
        for line in lines:
            begin = 0
            for m in GLUED.finditer(line):
                if len(m[1]) > GLUED_DIGITS:
                    # what is before the mark may begin the item that this one follows
                    own = _item(line[begin : m.start()])
                    before = own[1] if own else found[-1][0] if found else ""
                    if m[1] != _next(before):
                        continue
                yield line[begin : m.start()]
                begin = m.end()
            yield line[begin:]

    for line, is_open in open_lines(single()):
        mark = _item(line) if is_open else None
        if mark:
            found.append((mark[1], [line[mark.end() :]]))
        elif found:
            found[-1][1].append(line)
    return _bodies(found)


def _item(line: str) -> re.Match | None:
    return None if HEADING.match(line) else NAMED_ITEM.match(line) or ITEM.match(line)


def _next(number: str) -> str | None:
    """The whole number after one, as text; None after others."""
    return str(int(number) + 1) if number.isdecimal() else None


def _bodies(found: list[tuple[str, list[str]]]) -> list[tuple[str, str]]:
    return [(num, body) for num, own in found if (body := "\n".join(own).strip())]


Entry = tuple[str | None, str | None, str, str]


def answers(section: Section) -> list[Entry]:
    """(chapter, label, number, body) of an answer section: headings inside it change the chapter or the label.

    A wrapper's items that bear a dotted number once also count for no chapter.
    """
    runs: list[tuple[str | None, str | None, list[str]]] = [(section.chapter, section.label, [])]
    for line, is_open in open_lines(section.lines):
        found = title_of(line) if is_open else None
        if found:
            named, number = CHAPTER.match(found[1]), NUMBERED.match(found[1])
            label = label_of(found[1])
            if named or number:
                runs.append((_named(found[1]) if named else number[1], section.label, []))
                continue
            if label is not None and label != runs[-1][1]:
                runs.append((runs[-1][0], label, []))
                continue
        runs[-1][2].append(line)
    out = [(chapter, label, num, body) for chapter, label, own in runs for num, body in numbered_items(own)]
    if section.wrapper:
        items = numbered_items(section.lines)
        times = Counter(num for num, _ in items)
        out += [(None, section.label, num, body) for num, body in items if times[num] == 1 and "." in num]
    return out


def headed_pairs(section: Section) -> tuple[list[Entry], list[Entry]]:
    """Problems and answers that stand under headings of their own; alternative answers to a number come joined.

    Nothing unless LEAST_PAIRS numbers have both.
    """
    marks: list[tuple[bool, str, list[str]]] = []
    for line, is_open in open_lines(section.lines):
        found = title_of(line) if is_open else None
        problem = found and HEADED_PROBLEM.match(found[1])
        answer = found and not problem and HEADED_ANSWER.match(found[1])
        if problem or answer:
            marks.append((bool(problem), (problem or answer)[1], []))
        elif marks:
            marks[-1][2].append(line)
    if len({n for p, n, _ in marks if p} & {n for p, n, _ in marks if not p}) < LEAST_PAIRS:
        return [], []
    problems, solved = [], {}
    for is_problem, num, own in marks:
        if body := "\n".join(own).strip():
            if is_problem:
                problems.append((None, section.label, num, body))
            else:
                solved.setdefault(num, []).append(body)
    return problems, [(None, section.label, num, "\n\n".join(bodies)) for num, bodies in solved.items()]


def _until_answers(lines: list[str], pattern: re.Pattern) -> list[tuple[str, list[str]]]:
    """Items by a pattern up to a heading of answers; other headings belong to the item before them."""
    found: list[tuple[str, list[str]]] = []
    for line, is_open in open_lines(lines):
        title = title_of(line) if is_open else None
        if title and ANSWERS.match(title[1]):
            break
        mark = pattern.match(line) if is_open and not title else None
        if mark:
            found.append((mark[1], [line[mark.end() :]]))
        elif found:
            found[-1][1].append(line)
    return found


def inline_problems(section: Section) -> list[Entry]:
    """Problems that prose numbers on its way: by numbers of two parts or more, else by single ones if two are solved there."""
    found = _until_answers(section.lines, INLINE)
    if len(found) < LEAST_INLINE and sum(SOLVED_LINE.match(x) is not None for x in section.lines) >= 2:
        single = _until_answers(section.lines, INLINE_SINGLE)
        found = single if len(single) >= LEAST_INLINE else found
    return [(section.chapter, section.label, num, body) for num, body in _bodies(found)] if len(found) >= LEAST_INLINE else []


def own_answer(body: str) -> tuple[str, str] | None:
    """A problem's text cut at its first line that begins a solution, after the first; null if either part is empty."""
    lines = body.splitlines()
    for i, (line, is_open) in enumerate(open_lines(lines)):
        mark = SOLVED_LINE.match(line) if i and is_open else None
        if mark:
            question, answer = "\n".join(lines[:i]).strip(), "\n".join([line[mark.end() :], *lines[i + 1 :]]).strip()
            return (question, answer) if question and answer else None
    return None


def paper_pairs(text: str) -> list[tuple[str, str, str, str]]:
    """(heading, number, problem, solution) of a collection of papers: competition, year and part head runs of problems with
    their solutions inside.

    Of the numbers in a run the longest chain counts that rises by PAPER_STEP at most; the earliest of equal chains does.
    """
    out: list[tuple[str, str, str, str]] = []
    at: list[str | None] = [None, None, None]
    run: list[str] = []

    def close() -> None:
        if at[0]:
            heading = " ".join(x for x in at if x)
            out.extend((heading, *pair) for pair in _paper_run(run))
        run.clear()

    plain = lambda x: re.sub(r"\s+", " ", x)
    for line in text.splitlines():
        found = title_of(line)
        title = found[1].strip() if found else None
        if title is None or PAPER_SOLUTION.match(title):
            run.append(line if title is None else title)
            continue
        close()
        year, part = PAPER_YEAR.match(title), PAPER_PART.match(title)
        if PAPER_GROUP.search(title) and not year:
            at = [plain(title), None, None]
        elif year:
            at = [at[0], plain(year[0]).strip(), None]
        elif part:
            at = [at[0], at[1], plain(part[0]).strip()]
    close()
    return out


def _paper_run(lines: list[str]) -> Iterator[tuple[str, str, str]]:
    marks = [(i, int(m[1])) for i, (line, is_open) in enumerate(open_lines(lines)) if is_open and (m := PAPER_ITEM.match(line))]
    # From the last mark on: the chain of a mark goes on with the next one whose number is higher by a step.
    nearest: dict[int, int] = {}
    follows, length = [-1] * len(marks), [1] * len(marks)
    for k in range(len(marks) - 1, -1, -1):
        after = [nearest[n] for n in range(marks[k][1] + 1, marks[k][1] + PAPER_STEP + 1) if n in nearest]
        if after:
            follows[k] = min(after)
            length[k] = 1 + length[follows[k]]
        nearest[marks[k][1]] = k
    if not marks or max(length) < LEAST_PAPER:
        return
    chain, k = [], length.index(max(length))
    while k >= 0:
        chain.append(marks[k])
        k = follows[k]
    for (first, num), end in zip(chain, [i for i, _ in chain[1:]] + [len(lines)], strict=True):
        own = "\n".join(lines[first:end])
        own = own[PAPER_ITEM.match(own).end() :]
        solved = PAPER_SOLVED.search(own)
        if solved:
            question, answer = own[: solved.start()].strip(), own[solved.end() :].strip()
            if min(len(question), len(answer)) >= LEAST_CHARS:
                yield str(num), question, answer


def yearly(text: str) -> tuple[list[Entry], list[Entry]]:
    """Problems and answers of a compendium whose two parts agree in year, kind and number alone."""
    problems: list[Entry] = []
    solved: list[Entry] = []
    year, into, key, run = None, problems, None, []

    def close() -> None:
        if key is not None:
            into.extend((*key, num, body) for num, body in numbered_items([x for x in run if not DAY.match(x.strip())]))
        run.clear()

    for line in without_artifacts(text).splitlines():
        found = title_of(line)
        if not found:
            run.append(line)
            continue
        close()
        key, title = None, found[1].strip()
        answer, problem = YEARLY_ANSWERS.match(title), YEARLY_PROBLEMS.match(title)
        if answer:
            into, key = solved, (answer[2], answer[1].lower())
        elif problem and year:
            into, key = problems, (year, problem[1].lower())
        elif not problem and YEARLY.match(title) and (years := YEAR.findall(title)):
            year = years[-1]
    close()
    return problems, solved


#: A row of a book: its role, chapter, label, number, text, and the answer that the text itself holds.
ROW = ("role", "chapter", "label", "num", "body", "question", "answer")
Row = tuple[str | None, ...]


def _row(role: str, entry: Entry, pair: tuple[str, str] | None = None) -> Row:
    return role, *entry, *(pair or (None, None))


def book_rows(text: str | None) -> Iterator[Row]:
    """All that a book's problems and answers can come from, in order; the sections counted by rows without a number.

    Headed pairs, where a book has problems and answers under headings, replace the ordinary ones. Inline problems are taken
    if there are no other problems, or no answers. Rows are made as they are asked for.
    """
    own = sections(text or "")
    yield from (_row(f"{s.kind}_section", (s.chapter, s.label, None, s.title)) for s in own)
    headed = [headed_pairs(s) for s in own if s.kind == "answer_key"]
    problems, solved = [p for x in headed for p in x[0]], [a for x in headed for a in x[1]]
    if not (problems and solved):
        problems = [(s.chapter, s.label, *item) for s in own if s.kind == "exercise" for item in numbered_items(s.lines)]
        solved = [a for s in own if s.kind == "answer_key" for a in answers(s)]
    inline = [p for s in own if s.kind == "normal" for p in inline_problems(s)] if not problems or not solved else []
    del own
    for role, found in (("problem", problems), ("inline", inline)):
        yield from (_row(role, p, own_answer(p[3])) for p in found)
    yield from (_row("answer", a) for a in solved)
    del headed, problems, solved, inline
    yield from (_row("paper", (heading, None, num, ""), (q, a)) for heading, num, q, a in paper_pairs(text or ""))
    for role, found in zip(("yearly_problem", "yearly_answer"), yearly(text or ""), strict=True):
        yield from (_row(role, entry) for entry in found)


def volume_rows(text: str | None, solutions: bool) -> Iterator[Row]:
    """The same of one of two volumes: exercises of the book, or the items of all sections of its solutions."""
    wanted = [s for s in sections(text or "") if solutions or s.kind == "exercise"]
    kind, role = ("answer_key_section", "answer") if solutions else ("exercise_section", "problem")
    yield from (_row(kind, (s.chapter, s.label, None, s.title)) for s in wanted)
    yield from (_row(role, (s.chapter, s.label, *item)) for s in wanted for item in numbered_items(s.lines))
