from funclab import config
from funclab.operators import fewshot
from funclab.operators.finetune import fine_tuning_chats


def experiments(spark):
    rows = [
        (i, "Rust", "cfg", e, "train" if i < 60 else "test", int(i % 4 == 1), f"fn f{i}() {{ {{x}} }}")
        for i in range(80)
        for e in (0, 1)
    ]
    schema = "row_id long, language string, configuration string, experiment int, variant string, target int, processed_func string"
    return spark.createDataFrame(rows, schema).repartition(5)


def expected_prompt(code):
    shown = [(i, 1) for i in range(60) if i % 4 == 1][:9] + [(i, 0) for i in range(60) if i % 4 != 1][:1]
    block = "".join(
        config.DEMONSTRATION_TEXT.format(
            i=n, func_before=f"fn f{i}() {{ {{x}} }}", analysis="Vulnerable" if t else "Non-Vulnerable"
        )
        + "\n"
        for n, (i, t) in enumerate(shown, 1)
    )
    return config.FEW_SHOT_TEXT.format(language="rust", new_source_code=code, code_demonstrations=block)


def test_examples_and_few_shot_prompts(spark):
    df = experiments(spark)
    examples = fewshot.few_shot_examples(df.where("variant = 'train'"))
    got = [(r.example, r.row_id, r.target) for r in examples.where("experiment = 1").orderBy("example").collect()]
    assert got == [(n, 4 * n - 3, 1) for n in range(1, 10)] + [(10, 0, 0)]
    prompts = fewshot.few_shot_prompts(df.where("variant = 'test'"), fewshot.few_shot_blocks(examples)).collect()
    assert len(prompts) == 40
    assert all(r.prompt == expected_prompt(r.processed_func) for r in prompts)


def test_no_examples(spark):
    df = experiments(spark)
    none = fewshot.few_shot_blocks(fewshot.few_shot_examples(df.where("variant = 'train'"), max_vul=0, max_non_vul=0))
    row = fewshot.few_shot_prompts(df.where("variant = 'test'"), none).first()
    assert row.prompt == config.FEW_SHOT_TEXT.format(language="rust", new_source_code=row.processed_func, code_demonstrations="")


def test_zero_shot_and_training_texts(spark):
    df = experiments(spark)
    row = fewshot.zero_shot_prompts(df).first()
    assert row.prompt == config.TASK_TEXT.format(language="rust", new_source_code=row.processed_func)
    for row in fine_tuning_chats(df.limit(9)).collect():
        verdict = "Vulnerable" if row.target == 1 else "Non-Vulnerable"
        assert [(m.role, m.content) for m in row.messages] == [
            ("system", "You are an expert Rust programmer"),
            ("user", config.TASK_TEXT.format(language="Rust", new_source_code=row.processed_func)),
            ("assistant", f"1. Analysis: {verdict}"),
        ]


def test_examples_go_by_the_order_of_the_frame(spark):
    rows = [(i, "c", "cfg", e, i % 2, f"f{i}", f"{(i * 7919 + e) % 10007:032x}") for i in range(400) for e in range(3)]
    schema = "row_id long, language string, configuration string, experiment int, target int, processed_func string, order_key string"
    df = spark.createDataFrame(rows, schema).repartition(6)
    got = fewshot.few_shot_examples(df, max_vul=30, max_non_vul=7).collect()
    for e in range(3):
        mine = sorted((r for r in rows if r[3] == e), key=lambda r: r[6])
        want = [r[0] for r in mine if r[4] == 1][:30] + [r[0] for r in mine if r[4] == 0][:7]
        assert [r.row_id for r in sorted((g for g in got if g.experiment == e), key=lambda g: g.example)] == want


def test_many_examples_rank_no_class_in_one_task(spark):
    """Only rows of the bucket that holds the last example, and chosen ones, are ranked."""
    df = spark.range(60_000).selectExpr(
        "id AS row_id", "'c' AS language", "'x' AS configuration", "0 AS experiment", "int(id % 3 > 0) AS target", "'t' AS processed_func", "md5(string(id)) AS order_key"
    )
    got = fewshot.few_shot_examples(df, max_vul=5_000, max_non_vul=12)
    keys = [r.order_key for r in got.orderBy("example").collect()]
    assert len(keys) == 5_012 and keys[:5_000] == sorted(keys[:5_000]) and keys[5_000:] == sorted(keys[5_000:])
    assert keys[4_999] == df.where("target = 1").orderBy("order_key").limit(5_000).agg({"order_key": "max"}).first()[0]
