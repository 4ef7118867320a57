import random

import pytest
from pyspark.sql import functions as F

from funclab.functions import responses

ANSWERS = [
    # answer, analysis, label, asks for lines
    ("1. Analysis: Vulnerable", "Vulnerable", 1, True),
    ("1. Analysis: Non-Vulnerable", "Non-Vulnerable", 0, False),
    ("1. ANALYSIS:  vulnerable \nMore.", "vulnerable", 1, True),
    ("1. Analysis: Vulnerable.", "Vulnerable.", 1, False),
    ("analysis: it is non-vulnerable, I think\nanalysis: Vulnerable", "it is non-vulnerable, I think", 0, False),
    # No marker: the text from the ninth character on counts as the analysis.
    ("Non-Vulnerable", "erable", 1, False),
    ("It is a Non-Vulnerable function", "Non-Vulnerable function", 0, False),
    ("", "", 1, False),
    ("Analysis:", "", 1, False),
    ("Analysis:\nVulnerable", "", 1, False),
    ("Limit token exceeded", "ken exceeded", 1, False),
]


def test_answers(spark):
    df = spark.createDataFrame([(i, a) for i, (a, *_) in enumerate(ANSWERS)], "i int, a string")
    a = F.col("a")
    got = df.select(
        "i",
        responses.extract_analysis(a),
        responses.response_label(a),
        responses.line_question_gate(a),
        responses.extract_analysis(a, strict_marker=True),
        responses.response_label(a, strict_marker=True),
    ).collect()
    for i, analysis, label, gate, strict, strict_label in sorted(map(tuple, got)):
        text, *want = ANSWERS[i]
        assert [analysis, label, gate] == want, text
        marked = "analysis:" in text.lower()
        assert (strict, strict_label) == ((want[0], want[1]) if marked else (None, None)), text


def pieces(answer):
    for line in answer.strip().split("\n"):
        if line.count("`"):
            yield line.partition("`")[2].partition("`")[0].strip()
        elif ": " in line:
            yield line.partition(": ")[2].strip()


def located(answer, code):
    """First free line per piece, by trying the lines one after the other."""
    sources = dict(enumerate(line.strip() for line in code.split("\n")))
    found = []
    for piece in pieces(answer):
        fits = [i for i, s in sources.items() if (piece in s or piece[: len(s)] == s) and i not in found]
        found += fits[:1]
    return found


CASES = [
    ("Line number 1: `b = 2`", "a\n b = 2;\nc"),
    ("Line number 1: b = 2;\nLine 3: b = 2;", "b = 2;\nx\nb = 2;"),
    ("Line 0: `a`", "z\n\na"),  # an empty line is a prefix of any piece
    ("``", "a\nb"),  # an empty piece fits any line
    ("nothing here", "a\nb"),
    ("", "a"),
    ("`unclosed", "unclosed"),
    ("x: `a` and `b`", "b\na"),
    ("a: b: c", "b: c"),
]


@pytest.mark.parametrize("answer, code", CASES)
def test_locate_cases(spark, answer, code):
    df = spark.createDataFrame([(answer, code)], "a string, c string")
    assert df.select(responses.locate_lines(F.col("a"), F.col("c"))).first()[0] == located(answer, code)


def test_locate_random(spark):
    rng = random.Random(3)
    words = ["a", "b", "ab", " ", "", "x = 1;", "é"]
    rows = []
    for i in range(1500):
        code = "\n".join(rng.choice(words) + rng.choice(words) for _ in range(rng.randint(1, 7)))
        answer = "\n".join(
            rng.choice(["Line 1: ", "", "x", "n: `"]) + rng.choice(words) + rng.choice(["", "`", " "]) for _ in range(rng.randint(0, 6))
        )
        rows.append((i, answer, code))
    df = spark.createDataFrame(rows, "i int, a string, c string")
    got = dict(map(tuple, df.select("i", responses.locate_lines(F.col("a"), F.col("c"))).collect()))
    wrong = [(a, c, got[i], located(a, c)) for i, a, c in rows if got[i] != located(a, c)]
    assert not wrong, wrong[:3]


def test_null_answer_locates_nothing(spark):
    df = spark.createDataFrame([(None, "a\nb")], "a string, c string")
    assert df.select(responses.locate_lines(F.col("a"), F.col("c"))).first()[0] == []


def test_index_of_lines_agrees_with_trying_them(spark):
    rng = random.Random(5)
    words = ["a", "b", "ab", " ", "", "x = 1;", "é", "}"]
    for _ in range(3000):
        code = "\n".join(rng.choice(words) + rng.choice(words) for _ in range(rng.randint(1, 12)))
        answer = "\n".join(rng.choice(["Line 1: ", "n: `"]) + rng.choice(words) + rng.choice(["", "`"]) for _ in range(rng.randint(0, 15)))
        index = responses.LineIndex([line.strip() for line in code.split("\n")])
        assert [i for i in map(index.take, pieces(answer)) if i is not None] == located(answer, code), (answer, code)


def test_many_lines_of_a_long_text(spark):
    rng = random.Random(6)
    lines = [f"  call_{rng.randrange(900)}(x, {rng.randrange(9)});" if i % 5 else rng.choice(["", "}", "{ //"]) for i in range(2_000)]
    answer = "\n".join(f"Line number {i}: `{lines[i].strip()}`" for i in sorted(rng.sample(range(2_000), 500)))
    df = spark.createDataFrame([(answer, "\n".join(lines)), ("1: `x`", "x"), (None, "a")], "a string, c string")
    got = [r[0] for r in df.select(responses.locate_lines(F.col("a"), F.col("c"))).collect()]
    assert got == [located(answer, "\n".join(lines)), [0], []]
