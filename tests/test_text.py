import pytest
from pyspark.sql import functions as F

from funclab.functions import text


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("value", ["", "a", "\u00a0 a\u2003\n", "\x1c\t", " \u00e9 ", "a b", "\ufeffa"])
def test_strip_is_python_strip(spark, value):
    assert one(spark, text.strip(F.col("v")), v=value) == value.strip()


@pytest.mark.parametrize("value", ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\r", "a\x0bb\x85c\u2028d", "a\nb"])
def test_source_lines_are_splitlines(spark, value):
    got = one(spark, text.source_lines(text.unify_line_breaks(F.col("v"))), v=value)
    assert got == value.splitlines()


@pytest.mark.parametrize(
    "index, expected",
    [("0,2", "a/~/c"), ("2, 1", "c/~/ b"), ("", ""), ("  ", ""), (None, ""), ("9", None), ("-1", None), ("x", None), ("0,9", None)],
)
def test_flaw_lines(spark, index, expected):
    frame = spark.createDataFrame([("a\n b\nc", index)], "code string, ids string")
    assert frame.select(text.flaw_lines(F.col("code"), F.col("ids"))).first()[0] == expected


def test_flaw_lines_strict(spark):
    frame = spark.createDataFrame([("a\nb", "7")], "code string, ids string")
    with pytest.raises(Exception, match="bad flaw line list"):
        frame.select(text.flaw_lines(F.col("code"), F.col("ids"), strict=True)).collect()


def test_the_two_ways_to_count_listed_lines(spark):
    frame = spark.createDataFrame([("1,2",), ("1,,2",), ("",), (None,), (",",)], "m string")
    got = frame.select(text.count_mod_lines(F.col("m")), text.count_listed_lines(F.col("m"))).collect()
    assert [tuple(r) for r in got] == [(2, 2), (2, 3), (0, 1), (0, 0), (0, 2)]


def test_parsers(spark):
    frame = spark.createDataFrame([("5.0, 7", "[3, 1]"), ("4", "[]"), (None, None)], "a string, b string")
    got = frame.select(text.parse_line_list(F.col("a")), text.parse_ranking(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [([5, 7], [3, 1]), ([4], []), ([], None)]


def test_language_names(spark):
    assert one(spark, text.norm_lang(F.col("v")), v="C++") == "cpp"
    assert one(spark, text.norm_lang(F.col("v")), v="Rust") == "rust"
    assert one(spark, text.title_lang(F.col("v")), v="kOTLIN") == "Kotlin"
    assert one(spark, text.lines_of_code(F.col("v")), v="a\n\nb\n") == 4


def test_rounding_goes_by_the_binary_value(spark):
    values = [0.0, 0.005, 0.015, 0.045, 0.125, 0.285, 0.29, 0.375, 0.995, 1.005, 2.675, 2.665, 100.0, 12345.675, 0.99999, 7.125]
    values += [s / n for n in (3, 8, 40, 200, 1000) for s in range(1, 700, 7)]
    for places in (2, 4):
        got = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.rounded(F.col("v"), places).alias("r")).collect()
        assert [r.r for r in got] == [round(r.v, places) for r in got]
