"""Books: outlines, items, layouts and pairs, by worked cases."""

import tracemalloc

import pyarrow as pa
import pytest

from quern.functions import books as K
from quern.operators import pairing as P
from quern.session import materialise


def _outline(text):
    return [(s.kind, s.level, s.title, s.chapter, s.label) for s in K.sections(text)]


def test_outline():
    text = "\n".join(
        [
            "# **Chapter 2** ##", "## 3 Introductory Problems", "1. a", "### Remarks", "```", "# Chapter 9", "```", "# 4. The Next", "## Lecture 5.1 (B)", "## Testing Questions (A",
            "### 7 Deep", "## Answers", "# Solutions to Testing Questions (6)", "##nothing", "####### x",
        ]
    )
    assert _outline(text) == [
        ("normal", 1, "Chapter 2", None, None), ("exercise", 2, "3 Introductory Problems", "2", "introductory"), ("normal", 3, "Remarks", "2", None),
        ("normal", 1, "4. The Next", "2", None), ("normal", 2, "Lecture 5.1 (B)", "4", "b"), ("exercise", 2, "Testing Questions (A", "5.1", "a"),
        ("normal", 3, "7 Deep", "5.1", None), ("answer_key", 2, "Answers", "5.1", None), ("answer_key", 1, "Solutions to Testing Questions (6)", "6", None),
    ]
    assert K.sections("") == [] == K.sections("no heading\n1. x")


@pytest.mark.parametrize(
    "title",
    ["Exercises", "Problems:", "5.3 Exercises", "§2.1 Problems", "Part II: Advanced Problems", "Warm-up exercises", "Practice problems", "Problem Set 4", "Exercises and Problems", "testing question (b", "Proposed Problems 1.2"],
)
def test_exercise_titles(title):
    assert K.kind_of(title) == "exercise"


@pytest.mark.parametrize(
    ("title", "kind"),
    [
        ("Answers to Odd Problems", "answer_key"), ("Solution", "answer_key"), ("Solutions manual", "answer_key"), ("Hints", "answer_key"), ("Hints and such", "answer_key"),
        ("Suggestions, solutions, and answers", "answer_key"), ("Answer Key A", "answer_key"), ("Selected solutions", "answer_key"), ("Part II Solutions", "answer_key"), ("Brief answer x", "answer_key"),
        ("Solutions of Chapter 2", "normal"), ("Problems of the day", "normal"), ("Solution 4", "normal"), ("Hinting", "normal"), ("The exercises", "normal"),
    ],
)
def test_other_titles(title, kind):
    assert K.kind_of(title) == kind


def test_artifacts_go():
    text = '# <span id="p-1"></span>**Chapter 1**\n#### **4. Solutions to Problems 85**\n#### 19. Let x\n## 20. Stays\n#### Problem 3'
    assert K.without_artifacts(text).split("\n") == ["# **Chapter 1**", "", "19. Let x", "## 20. Stays", "#### Problem 3"]


def test_wrapper_takes_in_chapters():
    text = "# Solutions to Problems\nfirst\n# 2 Divisors\n**2.1.1.** a\n3. b\n# Chapter 3\n3. c\n2.1.2) d\n# Other\n9. z"
    own = K.sections(text)[0]
    assert own.wrapper and "9. z" not in own.lines
    assert K.answers(own) == [("2", None, "2.1.1", "a"), ("2", None, "3", "b"), ("3", None, "3", "c"), ("3", None, "2.1.2", "d"), (None, None, "2.1.1", "a"), (None, None, "2.1.2", "d")]


def test_items():
    lines = ["lost", "1. a", " 2. sub", "- **5.1.2.** b", "## 3. head", "* 4) c", "<sup>6</sup>. d", "Exercise 7: e", "1.5 no", "8.", "9. ", "f", "```", "10. g", "```", "11] h. 12. (i) 13. no. x = 5. Then"]
    assert K.numbered_items(lines) == [
        ("1", "a\n 2. sub"), ("5.1.2", "b\n## 3. head"), ("4", "c"), ("6", "d"), ("7", "e\n1.5 no"), ("9", "f\n```\n10. g\n```"), ("11", "h."), ("12", "(i) 13. no. x = 5. Then"),
    ]


def test_labels_inside_answers():
    section = K.sections("# Lecture 3\n# Answers (A)\n1. one\n## Part (3-B)\n1. two\n## Remark\n## Chapter 4\n1. three")[1]
    assert K.answers(section) == [("3", "a", "1", "one"), ("3", "b", "1", "two\n## Remark"), ("4", "a", "1", "three")]


def _headed(n):
    return "# Solutions to Advanced Problems\n" + "\n".join(f"#### Problem {i} [X]\nask {i}\n#### Solution {i}, Alternative 1\nyes {i}\n#### Solution {i}, Alternative 2\nor {i}" for i in range(1, n + 1))


def test_headed_pairs():
    assert K.headed_pairs(K.sections(_headed(2))[0]) == ([], [])
    problems, solved = K.headed_pairs(K.sections(_headed(3))[0])
    assert problems[1] == (None, "advanced", "2", "ask 2") and solved[2] == (None, "advanced", "3", "yes 3\n\nor 3")


def test_inline_problems_and_own_answers():
    text = "# Chapter 1\n**1.1.1.** a\nSolution. b\n1.1.2 c\n## sub\nExample 1.1.3. d\n**Proof**\ne\n## Hints\n1.1.4 f"
    found = K.inline_problems(K.sections(text)[0])
    assert [x[2:] for x in found] == [("1.1.1", "a\nSolution. b"), ("1.1.2", "c\n## sub"), ("1.1.3", "d\n**Proof**\ne")]
    assert [K.own_answer(x[3]) for x in found] == [("a", "b"), None, ("d", "e")]
    single = "# T\n1. a\nSolution: x\n2. b\nProof. y\n3. c"
    assert [x[2] for x in K.inline_problems(K.sections(single)[0])] == ["1", "2", "3"]
    assert K.inline_problems(K.sections(single.replace("Proof. y", "so y"))[0]) == []
    assert K.own_answer("Solution. a\nb") is None and K.own_answer("a\n```\nSolution.\n```") is None and K.own_answer("a\nAnswer:") is None
    assert K.own_answer("a\nSolution (first).\nb") == ("a", "b") and K.own_answer("a\nsolutions exist") == ("a", "exist")


PAPER = """# Preface
1. not this. Solution. as no competition came
# China  Olympiad
## 2010 (Fujian) Tests
### Part II
1. Find all the numbers x. Solution. There are none of them.
2 Show that this is true
#### Solution 1. It is so because it is.
(5) remark
9. a stray number
4) Prove the third claim here. **Proof**. As it was shown before.
## 2011
1. only one. Solution. so not taken here.
"""


def test_papers():
    found = K.paper_pairs(PAPER)
    assert [x[:2] for x in found] == [("China Olympiad 2010 (Fujian) Part II", n) for n in "124"]
    assert found[0][2:] == ("Find all the numbers x.", "There are none of them.")
    assert found[1][3].startswith("It is so because it is.\n(5) remark\n9. a stray")
    assert K.paper_pairs(PAPER.replace("Olympiad", "Book")) == []


def test_chain_of_a_paper_is_the_longest():
    """Chains from every start, one by one."""
    numbers = [3, 1, 2, 9, 4, 3, 5, 10, 11, 1, 8]
    lines = [f"{n}. problem number {n} of it. Solution. the answer is {k} here" for k, n in enumerate(numbers)]
    best: list = []
    for s in range(len(numbers)):
        run = [s]
        for k in range(s + 1, len(numbers)):
            if 0 < numbers[k] - numbers[run[-1]] <= K.PAPER_STEP:
                run.append(k)
        best = run if len(run) > len(best) else best
    assert [x[0] for x in K._paper_run(lines)] == [str(numbers[k]) for k in best]


def _compendium(n):
    problems = "\n".join(f"{i}. ask {i}" for i in range(1, n + 1))
    solved = "\n".join(f"{i}. told of {i}" for i in range(2, n + 2))
    return f"## 3.1 The First IMO Here, 1959\n### 3.1.1 Contest Problems\n**First Day**\n{problems}\n## 4.1 Solutions to the Contest Problems of IMO 1959\n{solved}\n# Index\n1. x"


def test_yearly():
    problems, solved = K.yearly(_compendium(3))
    assert problems == [("1959", "contest", str(i), f"ask {i}") for i in (1, 2, 3)]
    assert [x[2] for x in solved] == ["2", "3", "4"]


INLINE_BOOK = "# Chapter 3\n3.1.1 a\nProof. b\n3.1.2 c\n3.1.3 d"
NESTED = "# Problems\n1. outer\n## Sample Problems\n1. inner\n1. later\n# Answers\n1. first told\n1. second told"
FALLING = """# Book
## Solutions
1. by no chapter, as it comes first
2. two
# Chapter 1
## Problems
1. ask one
2. ask two with ![x](y)
3. ask three
4. ask three
## Advanced Problems
1. ask hard
5. own
Solution. told here
# Answers to all
3. it is three
## Chapter 1
4. ask three
### Advanced
1. it is hard
"""


@pytest.fixture(scope="module")
def extracted(spark):
    """Pairs by book, and the counts of each."""
    texts = [FALLING, None, "", "plain text", _headed(3) + "\n# Problems\n1. stray", INLINE_BOOK, PAPER, _compendium(11), _compendium(10), PAPER + "\n# Problems\n1. a\nSolution. b", NESTED]
    rows = P.read_books(spark.createDataFrame(list(enumerate(texts)), "book int, text string"), "book", "text")
    pairs, stats = P.extract(materialise(rows, "books"))
    found = sorted((r.book, r.layout, r.chapter, r.label, r.num, r.question, r.answer) for r in pairs.fillna("-", ["chapter", "label"]).collect())
    return {b: [x[1:] for x in found if x[0] == b] for b in range(len(texts))}, {r.book: r.asDict() for r in stats.collect()}


def test_pairs_fall_back_step_by_step(extracted):
    found, stats = extracted
    assert found[0] == [
        ("ordinary", "1", "-", "1", "ask one", "by no chapter, as it comes first"),
        ("ordinary", "1", "-", "3", "ask three", "it is three"),
        ("ordinary", "1", "advanced", "1", "ask hard", "it is hard"),
        ("ordinary", "1", "advanced", "5", "own", "told here"),
    ]
    want = {"exercise_sections": 2, "answer_sections": 2, "problems": 6, "answers": 6, "matched": 4, "dropped_figure": 1, "dropped_noninformative": 1, "unmatched": 0, "inline": 0, "papers": 0}
    assert stats[0] == {"book": 0} | want and not stats.keys() & {1, 2, 3} and not any(found[b] for b in (1, 2, 3))


def test_layouts_give_way(extracted):
    found, stats = extracted
    assert found[4] == [("ordinary", "-", "advanced", str(i), f"ask {i}", f"yes {i}\n\nor {i}") for i in (1, 2, 3)]
    assert found[5] == [("ordinary", "-", "-", "3.1.1", "a", "b")] and stats[5]["inline"] == 3 and stats[5]["unmatched"] == 2
    assert [x[3] for x in found[6]] == ["1", "2", "4"] and {x[0] for x in found[6]} == {"papers"} and stats[6]["papers"] == 3
    assert len(found[7]) == 10 and found[7][0][:3] == ("yearly", "1959", "contest")
    assert stats[7]["matched"] == 10 and stats[7]["answers"] == 22  # headings of its answers are an answer section too
    assert found[8] == [] and [x[0] for x in found[9]] == ["ordinary"]


def test_repeated_keys(extracted):
    """Of equal keys the first counts, also where a section holds another."""
    found, _ = extracted
    assert [x[1:] for x in found[10]] == [("-", "-", "1", "outer\n## Sample Problems", "first told"), ("-", "sample", "1", "inner", "first told")]


def test_volumes(spark):
    first = "# Chapter 1\n## Exercises\n1. one?\n2. two?\n# Exercises\n1. again"
    second = "# Chapter 1\n## Notes\n1. told a\n# Chapter 2\n2. told b"
    docs = spark.createDataFrame([("x", first, second), ("y", first, None), ("z", None, second)], "book string, p string, s string")
    pairs, stats = P.extract(materialise(P.read_volumes(docs, "book", "p", "s"), "volumes"))
    # A section bears the chapter of the headings before it, so "2" of chapter 2 stands under chapter 1.
    assert sorted((r.chapter, r.num, r.question, r.answer) for r in pairs.collect()) == [("1", "1", "one?", "told a"), ("1", "2", "two?", "told b")]
    assert {r.book: (r.problems, r.answer_sections, r.unmatched) for r in stats.collect()} == {"x": (2, 3, 0), "y": (2, 0, 2), "z": (0, 3, 0)}


def test_glued_numbers_of_four_digits_follow_their_item():
    text = "999. Find a. 1000. Find b. 1001. Find c, of 1999. The year 2001. And more.\n5. Go (on) 1002. Not next.\nProblem 1998: So it was. 1999. Next (1) 2000. Last."
    assert K.numbered_items(text.splitlines()) == [
        ("999", "Find a."), ("1000", "Find b."), ("1001", "Find c, of 1999. The year 2001. And more."), ("5", "Go (on) 1002. Not next."),
        ("1998", "So it was."), ("1999", "Next (1)"), ("2000", "Last."),
    ]


def test_books_of_a_batch_are_read_one_by_one():
    text = "# Chapter 1\n## Problems\n" + "\n".join(f"{i}. Find part {i} of the whole." for i in range(1, 1001))
    batch = pa.record_batch([pa.array([f"b{i}" for i in range(40)]), pa.array([text] * 40)], names=["book", "text"])
    tracemalloc.start()
    rows = sum(out.num_rows for out in P._read(lambda t: K.volume_rows(t, False))(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert rows == 40 * 1001 and peak < 4
