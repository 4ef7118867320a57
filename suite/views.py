"""Function tables, results and chats derived from the driver's tables.

Documents stand in for functions and their toxic label for the vulnerable label; everything made
up on top comes from md5, so that SQL can build the same views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funclab import config
from funclab.functions.hashing import draw_int
from funclab.functions.prompts import verdict
from funclab.functions.text import lines_of_code, split_lines
from funclab.operators.finetune import fine_tuning_chats
from funclab.operators.preprocess import preprocess
from funclab.plans.settle import each_number, settle_table

CONFIGURATION = "data_with_comments_single_before_change"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def as_language(lang):
    return (
        F.when(lang == "en", "rust").when(lang == "fr", "kotlin").when(lang == "de", "swift").otherwise("cpp")
    )


def _mod(n, *parts):
    return F.pmod(draw_int(*parts), F.lit(n))


def v_raw(spark, sf) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    doc, n = F.col("doc_id"), lines_of_code(F.col("text"))
    ids = F.filter(F.sequence(F.lit(0), n - 1), lambda i: _mod(3, "mod", doc, i) == 0)
    listed = F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")
    mod_lines = F.when(F.col("toxic") == 1, F.coalesce(F.nullif(listed, F.lit("")), F.lit("0")))
    return docs.join(labels, "doc_id").select(
        doc.alias("row_id"),
        as_language(F.col("lang")).alias("language"),
        F.col("source").alias("repo_url"),
        F.col("text").alias("code"),
        F.col("toxic").alias("label"),
        F.when(_mod(10, "before", doc) == 0, "False").otherwise("True").alias("before_change"),
        F.when(_mod(8, "added", doc) == 0, "true").otherwise("False").alias("added_only"),
        mod_lines.alias("mod_lines"),
    )


def v_clean(spark, sf) -> DataFrame:
    return preprocess(v_raw(spark, sf)).withColumn("configuration", F.lit(CONFIGURATION))


def v_code(spark, sf) -> DataFrame:
    """Function texts with comments and comment-like strings added to some lines."""

    def line(text, i):
        pick = _mod(6, "code", F.col("row_id"), i)
        more = (
            F.when(pick == 0, F.lit(" // note"))
            .when(pick == 1, F.lit(" /* a\n b */"))
            .when(pick == 2, F.lit(' "h//t"'))
            .when(pick == 3, F.lit(" /* x // y */ z"))
            .otherwise(F.lit(""))
        )
        return F.concat(text, more)

    raw = v_raw(spark, sf).select("row_id", "language", F.col("code").alias("plain"))
    code = F.array_join(F.transform(split_lines(F.col("plain")), line), "\n")
    return raw.select("row_id", "language", code.alias("processed_func"))


# Ends of lines, as (text, the text without comments, the same with chr(1) on each line in place of a comment).
MARK = "\x01"
NESTED = {
    "rust": [
        (" /* a /* b // c */ d */ z", "  z", f" {MARK} z"),
        (' let s = r#"// "no" /* x */"#; // y', ' let s = r#"// "no" /* x */"#; ', f' let s = r#"// "no" /* x */"#; {MARK}'),
        (" let c = '\"'; // \"", " let c = '\"'; ", f" let c = '\"'; {MARK}"),
        (' b"//" /* m\n n */', ' b"//" \n', f' b"//" {MARK}\n{MARK}'),
    ],
    "kotlin": [
        (' val u = "${f("http://x")}/y" // c', ' val u = "${f("http://x")}/y" ', f' val u = "${{f("http://x")}}/y" {MARK}'),
        (
            ' val u = "${a { b { c { d { e("//x") } } } }}//" + v // c',
            ' val u = "${a { b { c { d { e("//x") } } } }}//" + v ',
            f' val u = "${{a {{ b {{ c {{ d {{ e("//x") }} }} }} }}}}//" + v {MARK}',
        ),
        (
            ' val u = "${f(\n "//x" /* k */\n)} // in" // out',
            ' val u = "${f(\n "//x" /* k */\n)} // in" ',
            f' val u = "${{f(\n "//x" /* k */\n)}} // in" {MARK}',
        ),
        (' val t = """${g("//")} "// """" // c', ' val t = """${g("//")} "// """" ', f' val t = """${{g("//")}} "// """" {MARK}'),
        (" val q = '\"' // \"", " val q = '\"' ", f" val q = '\"' {MARK}"),
        (' val w = "${a // in\n}" + b', ' val w = "${a \n}" + b', f' val w = "${{a {MARK}\n}}" + b'),
    ],
    "swift": [
        (' let u = "\\(f("http://x"))/y" // c', ' let u = "\\(f("http://x"))/y" ', f' let u = "\\(f("http://x"))/y" {MARK}'),
        (
            ' let u = "\\(a(b(c(d(e("//x"))))))//" + v /* c /* d */ */ + w',
            ' let u = "\\(a(b(c(d(e("//x"))))))//" + v  + w',
            f' let u = "\\(a(b(c(d(e("//x"))))))//" + v {MARK} + w',
        ),
        (" let r = #/http://x/# // c", " let r = #/http://x/# ", f" let r = #/http://x/# {MARK}"),
        (' let s = #"\\(no // " \\#(f("//")) "# // c', ' let s = #"\\(no // " \\#(f("//")) "# ', f' let s = #"\\(no // " \\#(f("//")) "# {MARK}'),
        (
            ' let t = """\n \\(f(\n "//"))\n // in\n""" // c',
            ' let t = """\n \\(f(\n "//"))\n // in\n""" ',
            f' let t = """\n \\(f(\n "//"))\n // in\n""" {MARK}',
        ),
        (' let w = "\\(a // in\n)" + b', ' let w = "\\(a \n)" + b', f' let w = "\\(a {MARK}\n)" + b'),
    ],
    "cpp": [
        (' auto s = R"x(// "a" )" )x"; /* y */', ' auto s = R"x(// "a" )" )x"; ', f' auto s = R"x(// "a" )" )x"; {MARK}'),
        (" char c = '\"'; // \"", " char c = '\"'; ", f" char c = '\"'; {MARK}"),
        (" #include <a.h> // x", "  ", f" {MARK} {MARK}"),
        (" // one \\\n two", " \n", f" {MARK}\n{MARK}"),
        (" using namespace std; z", "  z", f" {MARK} z"),
    ],
}
#: Signs that a line of a document loses, so that only its end holds any.
SIGNS = "\"'/\\#$*{}();`\r"


def v_nested(spark, sf) -> DataFrame:
    """Function texts whose lines end in nested comments, and in strings that hold code and comment signs."""
    ends = F.create_map(*[x for lang, list_ in NESTED.items() for x in (F.lit(lang), F.array(*[F.lit(p[0]) for p in list_]))])

    def line(text, i):
        end = F.get(F.element_at(ends, F.col("language")), _mod(8, "nest", F.col("row_id"), i).cast("int"))
        return F.concat(F.translate(text, SIGNS, "_" * len(SIGNS)), F.coalesce(end, F.lit("")))

    raw = v_raw(spark, sf).select("row_id", "language", F.col("code").alias("plain"))
    code = F.array_join(F.transform(split_lines(F.col("plain")), line), "\n")
    return raw.select("row_id", "language", code.alias("processed_func"))


def v_results(spark, sf, run_by_run: bool = False) -> DataFrame:
    """Six models' results on every clean row in each of ten experiments.

    As answers of a model come run by run, ``run_by_run`` stores the rows once and gives each run
    tasks of its own, which hold rows of few languages; the rows are the same. They are stored in
    order of their texts, so that what is alike is packed together.
    """
    row = F.col("row_id")
    lines = split_lines(F.col("processed_func"))
    picked = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: _mod(4, "pick", row, i) == 0)
    drawn = F.array_sort(F.transform(picked, lambda i: F.struct(draw_int("pick", row, i).alias("h"), i.alias("i"))))
    once = v_clean(spark, sf).withColumn("_order", drawn["i"]).withColumn("_lines", lines)

    def shown(i):
        text = F.get("_lines", i)
        quoted = F.concat(F.lit("Line number "), i.cast("string"), F.lit(": `"), text, F.lit("`"))
        plain = F.concat(F.lit("Line number "), i.cast("string"), F.lit(": "), text)
        return F.when(i % 2 == 0, quoted).otherwise(plain)

    once = once.withColumn("_shown", F.transform("_order", shown)).drop("_lines")
    models = F.array(*[F.lit(m) for m in config.MODELS])
    if run_by_run:
        stored = settle_table(once.hint("rebalance", "language").sortWithinPartitions("language", "processed_func"), "result-rows", compression="zstd")
        number, n = F.col("_number"), len(config.MODELS)
        runs = each_number(stored, 10 * n, "_number").withColumns({"experiment": F.floor(number / n).cast("int"), "model": F.get(models, number % n)})
    else:
        runs = once.withColumn("experiment", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("model", F.explode(models))

    key = [F.col("model"), F.col("experiment"), row]
    wrong = _mod(5, "flip", *key) == 0
    answers = ~F.col("model").startswith("linevul")
    start = (_mod(3, "start", *key) + 1).cast("int")
    said = F.when(wrong, 1 - F.col("target")).otherwise(F.col("target"))
    runs = runs.withColumn("prediction", said)
    word, say = verdict(F.col("prediction")), _mod(6, "say", *key)
    spoken = (
        F.when(say == 0, F.concat(F.lit("1. Analysis: "), word))
        .when(say == 1, F.lower(F.concat(F.lit("1. analysis: "), word)))
        .when(say == 2, F.concat(F.lit("1. Analysis: "), word, F.lit("\nThe code reads input.")))
        .when(say == 3, F.concat(F.lit("1. Analysis: "), word, F.lit(".")))
        .when(say == 4, word)
        .otherwise(F.concat(F.lit("Sure. ANALYSIS:  "), word, F.lit(" ")))
    )
    listed = F.array_join(F.slice("_shown", start, F.size("_shown")), "\n")
    return runs.select(
        "language",
        "configuration",
        "experiment",
        "model",
        "row_id",
        "processed_func",
        "target",
        "prediction",
        "flaw_line_index",
        F.when(answers, spoken).alias("func_response"),
        F.when(answers & (F.col("prediction") == 1), listed).when(answers, F.lit("")).alias("line_response"),
        F.when(~answers, F.slice("_order", start, F.size("_order"))).alias("line_ranking"),
        F.when(~answers, lines_of_code(F.col("processed_func"))).alias("num_lines"),
        F.when(~answers, F.when(F.col("target") == 1, F.size(F.split("flaw_line_index", ","))).otherwise(0)).alias("num_flaw_lines"),
    )


def v_skips(spark, sf) -> DataFrame:
    """A skip list: about a third of the experiments of each language."""
    languages = v_clean(spark, sf).select("language", "configuration").distinct()
    runs = languages.withColumn("experiment", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return runs.where(_mod(3, "skip", F.col("language"), F.col("experiment")) == 0)


def v_chats(spark, sf) -> DataFrame:
    return fine_tuning_chats(v_clean(spark, sf))


def v_chat_lines(spark, sf) -> DataFrame:
    """Chat records as JSON lines, with each kind of format error in some of them."""
    m = F.col("messages")
    bad = _mod(9, "bad", F.col("row_id"))
    ok = lambda i: F.to_json(F.get(m, F.lit(i)))
    user = F.get(m, F.lit(1))["content"]

    def record(*messages):
        parts = [p for msg in messages for p in (F.lit(", "), msg)][1:]
        return F.concat(F.lit('{"messages": ['), *parts, F.lit("]}"))

    extra = F.to_json(F.struct(F.lit("user").alias("role"), user.alias("content"), F.lit(1).alias("weight")))
    blank = F.lit('{"role": "user", "content": ""}')
    line = (
        F.when(bad == 0, F.lit("[1, 2]"))
        .when(bad == 1, F.lit('{"messages": []}'))
        .when(bad == 2, record(ok(0), ok(1), F.lit('{"role": "assistant"}')))
        .when(bad == 3, record(ok(0), extra, ok(2)))
        .when(bad == 4, record(ok(0), ok(1), F.lit('{"role": "bot", "content": "yes"}')))
        .when(bad == 5, record(ok(0), blank, ok(2)))
        .when(bad == 6, record(ok(0), ok(1)))
        .when(bad == 7, F.lit('{"note": "x"}'))
        .otherwise(record(ok(0), ok(1), F.lit('{"role": "assistant", "content": 5}')))
    )
    return v_chats(spark, sf).select("row_id", line.alias("value"))


def v_named_lines(spark, sf) -> DataFrame:
    """Chat records as JSON lines in which some speakers have names, and lines that are no records."""
    pick = _mod(6, "named", F.col("row_id"))
    m = [F.get("messages", F.lit(i)) for i in range(3)]
    user = F.concat(F.lit("user_"), (F.col("row_id") % 5).cast("string"))

    def message(i, name=None):
        said = [m[i]["role"].alias("role"), m[i]["content"].alias("content")]
        return F.to_json(F.struct(*said, *([name.alias("name")] if name is not None else [])))

    def record(*messages):
        parts = [p for msg in messages for p in (F.lit(", "), msg)][1:]
        return F.concat(F.lit('{"messages": ['), *parts, F.lit("]}"))

    line = (
        F.when(pick == 0, record(message(0), message(1), message(2)))
        .when(pick == 1, record(message(0), message(1, user), message(2)))
        .when(pick == 2, record(message(1, user), message(2, F.lit("bot one"))))
        .when(pick == 3, F.lit("[1]"))
        .when(pick == 4, F.concat(F.lit('{"messages": [1, '), message(1), F.lit("]}")))
        .otherwise(F.concat(F.lit('{"messages": ['), message(0)))
    )
    return v_chats(spark, sf).select("row_id", line.alias("value"))
