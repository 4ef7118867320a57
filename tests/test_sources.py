import csv
import gzip
import os

import pytest
from pyspark.sql import functions as F

from funclab.operators import preprocess, results, sampling
from funclab.plans.settle import each_number
from funclab.schemas import CLEAN_WITH_KEYS, MESSAGES, RUN_KEYS, VARIANTS, require_columns
from funclab.sources import readers, writers

AWKWARD = ["  indent\n\tx = \"a, b\"\n", 'say ""hi""', "a\\b\\n", "é ü", " ", "trailing  ", "c\r\nd", '"', "\\\"", "plain"]


def test_csv_keeps_code_as_it_is(spark, tmp_path):
    rows = [(i, "rust", code, i % 2, "1,2" if i % 2 else None, "x" if i % 2 else None) for i, code in enumerate(AWKWARD)]
    df = spark.createDataFrame(rows, CLEAN_WITH_KEYS)
    writers.write_clean(df, f"{tmp_path}/clean")
    back = readers.read_clean_csv(spark, f"{tmp_path}/clean", CLEAN_WITH_KEYS)
    assert sorted(map(tuple, back.collect())) == rows


def write_file(path, header, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([header, *rows])


def test_reading_a_tree_of_experiment_files(spark, tmp_path):
    header = ["processed_func", "target", "flaw_line_index", "flaw_line"]
    for lang in ("kotlin", "swift"):
        for e in (0, 1):
            for variant in ("train", "val"):
                rows = [[f"{lang} {e}\n{variant} {i}", i % 2, "0", "x"] for i in range(3)]
                write_file(f"{tmp_path}/{lang}/cfg/{e}/{variant}.csv", header, rows)
    got = readers.read_experiment_csv(spark, str(tmp_path))
    assert got.count() == 24 and got.select("row_id").distinct().count() == 24
    for r in got.collect():
        assert r.processed_func.startswith(f"{r.language} {r.experiment}\n{r.variant} ") and r.configuration == "cfg"
    one = got.where("language = 'swift' and experiment = 1 and variant = 'val'").orderBy("row_id").collect()
    assert [r.processed_func[-1] for r in one] == ["0", "1", "2"]


def test_a_file_with_other_columns_is_refused(spark, tmp_path):
    write_file(f"{tmp_path}/a.csv", ["target", "processed_func"], [[1, "x"]])
    with pytest.raises(Exception, match="header"):
        readers.read_clean_csv(spark, f"{tmp_path}/a.csv", "processed_func string, target int").collect()


def test_reading_result_files_of_both_kinds(spark, tmp_path):
    base = f"{tmp_path}/rust/cfg/4"
    answers = ["processed_func", "target", "flaw_line_index", "flaw_line", "GPT Prediction", "GPT Func Level", "GPT Line Level", "Prompt"]
    write_file(f"{base}/gpt_few_shot.csv", answers, [["a\nb", 1, "1", "b", 1, "1. Analysis: Vulnerable", "Line 1: `b`", "p"]])
    rankings = ["processed_func", "flaw_line_index", "y_preds", "y_trues", "LineVul Line Level", "num_flaw_lines", "num_lines"]
    write_file(f"{base}/linevul_oversampling.csv", rankings, [["a\nb", "1", True, 1, "[1, 0]", 1, 2], ["c", "", False, 0, "[]", 0, 1]])
    both = results.normalise_results(
        readers.read_result_csv(spark, str(tmp_path), ranking=False), readers.read_result_csv(spark, str(tmp_path), ranking=True)
    )
    rows = sorted(both.collect(), key=lambda r: (r.model, -r.target))
    assert [(r.model, r.experiment, r.target, r.prediction) for r in rows] == [
        ("gpt_few_shot", 4, 1, 1),
        ("linevul_oversampling", 4, 1, 1),
        ("linevul_oversampling", 4, 0, 0),
    ]
    assert rows[0].line_response == "Line 1: `b`" and rows[1].line_ranking == [1, 0] and rows[1].num_lines == 2


def test_experiments_round_trip_and_pruning(spark, clean, tmp_path):
    exps = sampling.experiments(clean, sampling.experiment_list(spark, [(0, 0), (1, 1)]))
    writers.write_experiments(exps, f"{tmp_path}/e")
    back = readers.read_experiments(spark, f"{tmp_path}/e")
    assert back.select(*exps.columns).exceptAll(exps).count() == 0 and back.count() == exps.count()
    assert {r.variant for r in back.select("variant").distinct().collect()} == set(VARIANTS)
    plan = back.where("experiment = 1 and variant = 'train'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(experiment" in plan


def test_results_and_chats_round_trip(spark, tmp_path):
    rows = [("rust", "c", 0, "m", i, f"x\n {i}", "secret") for i in range(5)]
    df = spark.createDataFrame(rows, "language string, configuration string, experiment int, model string, row_id int, processed_func string, prompt string")
    writers.write_results(df, f"{tmp_path}/r", save_prompt=False)
    assert os.path.isdir(f"{tmp_path}/r/language=rust/configuration=c/experiment=0/model=m")
    schema = "row_id int, processed_func string"
    back = spark.read.options(**{**readers.CSV_OPTIONS, "enforceSchema": "true"}).schema(schema + ", " + ", ".join(f"{k} string" for k in RUN_KEYS)).csv(f"{tmp_path}/r")
    assert "prompt" not in back.columns and sorted(r.processed_func for r in back.collect()) == [f"x\n {i}" for i in range(5)]
    chats = spark.createDataFrame([([("user", 'é "q"\n')],)], f"messages {MESSAGES}")
    writers.write_chat_jsonl(chats, f"{tmp_path}/j")
    assert readers.read_chat_lines(spark, f"{tmp_path}/j").first().value == '{"messages":[{"role":"user","content":"é \\"q\\"\\n"}]}'


def test_language_files(spark, clean, tmp_path):
    raw = clean.select(F.col("processed_func").alias("code"), F.col("target").alias("label"))
    for name in ("Kotlin", "Swift"):
        raw.write.parquet(f"{tmp_path}/{name}_data.parquet")
    got = readers.read_language_files(spark, str(tmp_path), ["kotlin", "swift"])
    assert sorted(map(tuple, got.groupBy("language").count().collect())) == [("kotlin", 120), ("swift", 120)]
    assert got.select("row_id").distinct().count() == 240


RAW = "row_id int, language string, repo_url string, code string, label string, before_change string, added_only string, mod_lines string"


def test_preprocess(spark):
    rows = [
        (1, "k", "u", "a\nb", "1", "True", "False", "1"),
        (2, "k", "u", "a\nb", "1", "TRUE", "true", "1"),  # only added lines: dropped
        (3, "k", "u", "a\nb", "0", "true", "true", None),
        (4, "k", "u", "a\nb", "1", "False", None, "1"),  # after the change: dropped
        (5, "k", "u", "a\nb", "1", None, None, "1"),  # null is false: dropped
        (6, "k", "u", "a\nb", "bad", "no", None, "1"),  # a bad label in a dropped row does no harm
        (7, "k", "u", "a\nb", "1", "true", None, None),
    ]
    got = preprocess.preprocess(spark.createDataFrame(rows, RAW)).orderBy("row_id").collect()
    assert [(r.row_id, r.target, r.flaw_line_index, r.flaw_line) for r in got] == [(1, 1, "1", "b"), (3, 0, None, ""), (7, 1, None, "")]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        preprocess.preprocess(spark.createDataFrame([(6, "k", "u", "a", "bad", "true", None, "1")], RAW)).collect()


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="mod_lines"):
        preprocess.preprocess(spark.createDataFrame([(1, "k", "c", 1, "t", "t")], "row_id int, language string, code string, label int, before_change string, added_only string"))
    with pytest.raises(ValueError, match="x, y"):
        require_columns(spark.range(1), ["id", "x", "y"])


def test_reviewed_rows_are_dropped(spark, clean):
    listed = spark.createDataFrame([(3,), (5,), (999,)], "row_id long")
    left = preprocess.single_function_only(clean, listed)
    assert left.count() == 118 and left.where(F.col("row_id").isin(3, 5)).count() == 0


def test_raw_parquet_by_name(spark, clean, tmp_path):
    clean.write.parquet(f"{tmp_path}/Kotlin_data.parquet")
    assert spark.range(1).select(readers.raw_file_name(F.lit("kotlin"))).first()[0] == "Kotlin_data.parquet"
    got = readers.read_raw_parquet(spark, f"{tmp_path}/Kotlin_data.parquet", {"code": "processed_func", "label": "target"})
    assert got.columns == ["code", "label"] and got.count() == 120


def test_a_tree_of_files_of_two_shapes(spark, tmp_path):
    four, two = ["processed_func", "target", "flaw_line_index", "flaw_line"], ["processed_func", "target"]
    for e in (0, 1):
        write_file(f"{tmp_path}/kotlin/with lines+1/{e}/train.csv", four, [[f"k {e}\n{i}, \"q\"", i % 2, "0", "x"] for i in range(3)])
        write_file(f"{tmp_path}/kotlin/data_original/{e}/train.csv", two, [[f"o {e} {i}", i % 2] for i in range(2)])
        write_file(f"{tmp_path}/kotlin/data_original/{e}/notes.csv", ["remark"], [["not an experiment"]])
    got = readers.read_experiment_tree(spark, str(tmp_path))
    rows = got.collect()
    assert len(rows) == 10 and len({r.row_id for r in rows}) == 10
    assert {(r.language, r.configuration, r.experiment, r.variant) for r in rows} == {("kotlin", c, e, "train") for c in ("with lines+1", "data_original") for e in (0, 1)}
    for r in rows:
        plain = r.configuration == "data_original"
        assert r.processed_func.startswith(f"{'o' if plain else 'k'} {r.experiment}") and (r.flaw_line, r.flaw_line_index) == ((None, None) if plain else ("x", "0"))
    one = sorted((r for r in rows if r.configuration != "data_original" and r.experiment == 1), key=lambda r: r.row_id)
    assert [r.processed_func for r in one] == [f"k 1\n{i}, \"q\"" for i in range(3)]
    with pytest.raises(ValueError, match="no CSV file"):
        readers.read_result_tree(spark, str(tmp_path))


def test_result_files_are_told_apart_by_their_columns(spark, tmp_path):
    answers = ["processed_func", "target", "flaw_line_index", "flaw_line", "GPT Prediction", "GPT Func Level", "GPT Line Level"]
    rankings = ["processed_func", "flaw_line_index", "y_preds", "y_trues", "LineVul Line Level", "num_flaw_lines", "num_lines"]
    write_file(f"{tmp_path}/language=rust/configuration=c/experiment=4/model=gpt_few_shot/part-0.csv", answers, [["a\nb", 1, "1", "b", 1, "1. Analysis: Vulnerable", "Line 1: `b`"]])
    # One family of files may also have the prompts.
    write_file(f"{tmp_path}/rust/c/5/gpt_default.csv", [*answers, "Prompt"], [["c", 0, "", "", 0, "1. Analysis: Non-Vulnerable", "", "p"]])
    write_file(f"{tmp_path}/rust/c/4/linevul_oversampling.csv", rankings, [["a\nb", "1", True, 1, "[1, 0]", 1, 2]])
    both = results.normalise_results(*readers.read_result_tree(spark, str(tmp_path))).collect()
    assert sorted((r.language, r.configuration, r.experiment, r.model, r.target, r.prediction) for r in both) == [
        ("rust", "c", 4, "gpt_few_shot", 1, 1),
        ("rust", "c", 4, "linevul_oversampling", 1, 1),
        ("rust", "c", 5, "gpt_default", 0, 0),
    ]


def test_chat_records_are_typed_and_bad_lines_kept(spark, tmp_path):
    lines = [
        '{"messages": [{"role": "user", "content": "a\\nb", "name": "bob"}, {"role": "assistant", "content": "c", "weight": 1}]}',
        '{"messages": [{"role": "user", "content": 5}, {"content": null, "name": ["x"]}], "other": 1}',
        '{"messages": []}',
        '{"messages": [1]}',
        '{"messages": {"role": "user"}}',
        '{"messages": [{"role": "user"',
        "[1]",
        "5",
        '"text"',
        "no json",
    ]
    (tmp_path / "chats.jsonl").write_text("\n".join(lines))
    rows = readers.read_chat_records(spark, f"{tmp_path}/chats.jsonl").collect()
    good = sorted((tuple(map(tuple, r.messages)) for r in rows if r.messages is not None), key=str)
    assert good == [(("user", "a\nb", "bob"), ("assistant", "c", None)), (("user", None, None), (None, None, None))]
    assert sorted(r.bad_line for r in rows if r.bad_line is not None) == sorted(lines[2:])
    assert all((r.messages is None) != (r.bad_line is None) for r in rows)


def test_packed_result_files_are_read_as_plain_ones(spark, tmp_path):
    rows = [("rust", "c", 4, m, i, f"x\n {i}", 1, "1", "Vulnerable", "a", "b") for m in ("gpt_few_shot", "gpt_zero_shot") for i in range(3)]
    names = [*RUN_KEYS, "row_id", "processed_func", "target", "flaw_line_index", "GPT Prediction", "GPT Func Level", "GPT Line Level"]
    types = ["string", "string", "int", "string", "bigint", "string", "int", "string", "string", "string", "string"]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {t}" for n, t in zip(names, types)))
    for gather in (True, False):
        root = f"{tmp_path}/{gather}"
        writers.write_csv(df, root, RUN_KEYS, gather=gather, compression="gzip")
        files = [f for _, _, found in os.walk(root) for f in found if f.startswith("part-")]
        assert files and all(f.endswith(".csv.gz") for f in files)
        back = readers.read_tree(spark, root, RUN_KEYS).select(*names)
        assert sorted(map(tuple, back.collect())) == sorted(rows)
    folder = f"{tmp_path}/named/rust/c/4"
    os.makedirs(folder)
    with gzip.open(f"{folder}/gpt_few_shot.csv.gz", "wt") as f:
        f.write('row_id,GPT Prediction\n7,"Vul\nnerable"\n')
    (one,) = readers.read_tree(spark, f"{tmp_path}/named", RUN_KEYS).collect()
    assert (one.language, one.experiment, one.model, one.row_id, one["GPT Prediction"]) == ("rust", 4, "gpt_few_shot", 7, "Vul\nnerable")
    (one,) = readers.read_result_csv(spark, f"{tmp_path}/named", ranking=False, schema="row_id bigint, `GPT Prediction` string").collect()
    assert (one.model, one.row_id) == ("gpt_few_shot", 7)


def test_result_files_packed_by_zstd_are_read_whole(spark, tmp_path):
    """Such a file can't be read from the middle, however small the share of a task is."""
    names = [*RUN_KEYS, "row_id", "processed_func", "GPT Prediction"]
    texts = ["".join(chr(33 + (i * i * k + i // 7) % 90) + "\n" * (i % 40 == 0) for i in range(2_000)) for k in range(1, 41)]
    rows = [("rust", "c", 4, m, i, text, "1") for m in ("gpt_few_shot", "gpt_zero_shot") for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "language string, configuration string, experiment int, model string, row_id bigint, processed_func string, `GPT Prediction` string")
    writers.write_csv(df, f"{tmp_path}/z", RUN_KEYS, compression="zstd")
    writers.write_csv(df, f"{tmp_path}/g", RUN_KEYS, compression="gzip")
    size = {}
    for root in ("z", "g"):
        files = [f"{d}/{f}" for d, _, found in os.walk(f"{tmp_path}/{root}") for f in found if f.startswith("part-")]
        assert len(files) == 2 and all(f.endswith({"z": ".csv.zstd", "g": ".csv.gz"}[root]) for f in files)
        size[root] = sum(map(os.path.getsize, files))
    assert size["z"] < 0.9 * size["g"] and size["z"] > 4_000
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        back = readers.read_tree(spark, f"{tmp_path}/z", RUN_KEYS).select(*names)
        assert sorted(map(tuple, back.collect())) == sorted(rows)
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "1000"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_results_are_packed_by_zstd_and_found_by_their_names(spark, tmp_path):
    rows = [("rust", "c", 0, "gpt_few_shot", i, f"x\n {i}", "secret") for i in range(5)]
    df = spark.createDataFrame(rows, "language string, configuration string, experiment int, model string, row_id bigint, processed_func string, prompt string")
    writers.write_results(df, f"{tmp_path}/r", save_prompt=False)
    (file,) = [f"{d}/{f}" for d, _, found in os.walk(f"{tmp_path}/r") for f in found if f.startswith("part-")]
    assert file.endswith(".csv.zstd")
    for ending in ("zstd", "zst"):
        folder = f"{tmp_path}/{ending}/rust/c/0"
        os.makedirs(folder)
        with open(file, "rb") as a, open(f"{folder}/gpt_few_shot.csv.{ending}", "wb") as b:
            b.write(a.read())
        back = readers.read_result_csv(spark, f"{tmp_path}/{ending}", ranking=False, schema="row_id bigint, processed_func string").collect()
        assert sorted((r.experiment, r.model, r.row_id, r.processed_func) for r in back) == [(0, "gpt_few_shot", i, f"x\n {i}") for i in range(5)]


def test_headers_are_found_without_sorting_lines(spark, tmp_path, monkeypatch):
    """Many small files would share a task; each one's first line is its header, and no line is moved or sorted."""
    for k in range(30):
        write_file(f"{tmp_path}/kotlin/c/{k}/train.csv", ["processed_func", "target"] if k % 2 else ["remark"], [["a\nb"] * (1 + k % 2)] * 3)
    (tmp_path / "kotlin/c/30").mkdir()
    (tmp_path / "kotlin/c/30/train.csv").write_text("")
    plans, collect = [], type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or collect(self))
    found = readers._files_by_header(spark, str(tmp_path))
    assert {c: len(f) for c, f in found.items()} == {("processed_func", "target"): 15, ("remark",): 15}
    assert plans and not any(x in plan for plan in plans for x in ("Exchange", "Sort", "Aggregate"))


def test_writing_rows_where_they_lie(spark, tmp_path):
    """A number's rows lie in tasks of its own, and writing them shuffles nothing and loses nothing."""
    spark.range(100).selectExpr("id row_id", "cast(id as string) text").write.parquet(f"{tmp_path}/stored")
    each = each_number(spark.read.parquet(f"{tmp_path}/stored"), 5, "experiment")
    placed = each.withColumn("task", F.spark_partition_id())
    assert sorted(map(tuple, placed.groupBy("experiment").count().collect())) == [(k, 100) for k in range(5)]
    assert placed.groupBy("task").agg(F.count_distinct("experiment").alias("n")).where("n > 1").count() == 0
    plan = each._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    writers.write_csv(each, f"{tmp_path}/out", ["experiment"], gather=False)
    assert spark.read.options(**readers.CSV_OPTIONS | {"enforceSchema": "true"}).schema("row_id int, text string, experiment int").csv(f"{tmp_path}/out").distinct().count() == 500
