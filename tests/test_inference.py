import pytest
from pyspark.sql import functions as F

from funclab.operators import inference
from funclab.plans.runs import few_shot_run, fine_tuned_run, training_chats


class Flaky:
    def __init__(self, failures, error=ConnectionError):
        self.left, self.error, self.calls = failures, error, 0

    def __call__(self):
        self.calls += 1
        if self.left:
            self.left -= 1
            raise self.error()
        return "ok"


def test_retry():
    waits = []
    retry = inference.Retry(attempts=4, longest_wait=3, sleep=waits.append)
    assert retry(Flaky(3)) == "ok"
    assert len(waits) == 3 and all(0 <= w <= m for w, m in zip(waits, (1, 2, 3)))
    call = Flaky(4)
    with pytest.raises(ConnectionError):
        retry(call)
    assert call.calls == 4
    call = Flaky(1, ValueError)
    with pytest.raises(ValueError):
        retry(call)
    assert call.calls == 1


def model(messages, name):
    """Vulnerable for v, failing for f (at once) and g (in the second turn)."""
    code = messages[1]["content"].split("\n")[0]
    assert messages[0] == {"role": "system", "content": "You are an expert rust programmer"}
    if code.startswith("f"):
        raise ValueError("no")
    if len(messages) == 4:
        assert messages[2]["content"] == "1. Analysis: Vulnerable" and "Line number" in messages[3]["content"]
        if code.startswith("g"):
            raise ValueError("no")
        return f" Line number 0: `{code}` {name}\n"
    return "1. Analysis: Vulnerable \n" if code[0] in "vg" else "1. Analysis: Non-Vulnerable"


def test_batch_predict(spark):
    rows = [(1, "v1"), (2, "n"), (3, "f"), (4, "g")]
    df = spark.createDataFrame([(i, c, f"{c}\nrest", "Rust", "m") for i, c in rows], "row_id int, code string, prompt string, language string, model string")
    done = inference.batch_predict(df, model).drop("code", "language", "model").orderBy("row_id").collect()
    assert [tuple(r) for r in done] == [
        (1, "v1\nrest", "1. Analysis: Vulnerable", "Line number 0: `v1` m", 1),
        (2, "n\nrest", "1. Analysis: Non-Vulnerable", "", 0),
        (3, "", "Limit token exceeded", "", 1),
        (4, "", "Limit token exceeded", "", 1),
    ]


def test_each_row_is_asked_once(spark):
    """Filters and several uses of the answer must not ask again."""
    asked = spark.sparkContext.accumulator(0)

    def count(messages, name):
        asked.add(1)
        return "1. Analysis: Non-Vulnerable"

    df = spark.range(50).select(F.col("id").cast("string").alias("prompt"), F.lit("rust").alias("language"), F.lit("m").alias("model"))
    done = inference.batch_predict(df, count).where("prediction = 0 and func_response <> ''")
    assert done.withColumn("again", F.length("func_response")).count() >= 0
    asked_before = asked.value
    assert len(done.withColumn("again", F.length("func_response")).collect()) == 50
    assert asked.value - asked_before == 50


def always(messages, name):
    return f"1. Analysis: Non-Vulnerable {len(messages[1]['content'])} {name}"


def test_runs(spark, clean):
    variants = F.when(F.col("row_id") % 5 == 0, "test").otherwise("train")
    exps = clean.withColumn("experiment", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("variant", variants)
    few = few_shot_run(exps, always, "base", max_vul=2).collect()
    tuned = fine_tuned_run(exps, always, "ft:1").collect()
    assert len(few) == len(tuned) == 48
    assert all(r.model == "base" and "### Example 3\n" in r.prompt and r.prediction == 0 for r in few)
    assert all(r.model == "ft:1" and "### Example" not in r.prompt for r in tuned)
    assert all(r.func_response.endswith(f" {len(r.prompt)} {r.model}") for r in few + tuned)
    assert training_chats(exps).count() == 192 and training_chats(exps, 1).count() == 0


def test_attach_by_key(spark):
    rows = spark.createDataFrame([(i, i * 2) for i in range(20)], "row_id int, v int").repartition(5)
    answers = spark.createDataFrame([(i, f"a{i}") for i in range(20)], "row_id int, a string").repartition(3)
    assert all(r.a == f"a{r.row_id}" and r.v == 2 * r.row_id for r in inference.attach_predictions(rows, answers).collect())


def test_repeated_answers_are_refused(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, language string")
    schema = "row_id long, model string, prediction int, v int"
    several = spark.createDataFrame([(1, "m", 1, 5), (1, "n", 0, 6)], schema)
    got = inference.attach_predictions(rows, several)
    assert got.columns == ["language", "row_id", "model", "prediction", "v"] or got.columns == ["row_id", "language", "model", "prediction", "v"]
    assert sorted((r.row_id, r.model or "", r.prediction, r.v) for r in got.collect()) == [(1, "m", 1, 5), (1, "n", 0, 6), (2, "", None, None)]
    with pytest.raises(Exception, match="several answers for 1/m"):
        inference.attach_predictions(rows, several.unionByName(several.where("model = 'm'"))).collect()


class Counted:
    """Counts its calls for each prompt, stops at some, and fails at others."""

    def __init__(self, calls, stop=lambda n: False, fail=lambda n: False):
        self.calls, self.stop, self.fail = calls, stop, fail

    def __call__(self, messages, name):
        n = int(messages[1]["content"])
        if self.stop(n):
            raise inference.StopAsking()
        self.calls.add([n])
        if self.fail(n):
            raise ValueError(f"no {n}")
        return "1. Analysis: Non-Vulnerable"


class Listed:
    def zero(self, value):
        return []

    def addInPlace(self, a, b):
        a += b
        return a


def asked_rows(spark, n=60):
    return spark.range(n).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("prompt"), F.lit("rust").alias("language"), F.lit("m").alias("model"))


@pytest.mark.parametrize("at_once", [1, 5])
def test_a_stopped_run_goes_on_where_it_ended(spark, tmp_path, at_once):
    from funclab.plans.runs import answered

    calls = spark.sparkContext.accumulator([], Listed())
    rows, path = asked_rows(spark).repartition(3), f"{tmp_path}/answers"
    first = answered(rows, Counted(calls, stop=lambda n: n % 20 == 13), path, at_once=at_once)
    some = first.where("func_response is not null").count()
    assert 0 < some < 60 and len(calls.value) == some
    done = answered(rows, Counted(calls, fail=lambda n: n == 13), path, at_once=at_once).collect()
    assert sorted(calls.value) == list(range(60))
    assert {r.row_id: r.error for r in done if r.error} == {13: "ValueError: no 13"}
    assert all(r.attempt == 1 and (r.prediction, r.func_response) == ((1, "Limit token exceeded") if r.row_id == 13 else (0, "1. Analysis: Non-Vulnerable")) for r in done)
    # Nothing is left to ask, unless rows whose call failed are to be asked again.
    assert answered(rows, Counted(calls), path).count() == 60 and len(calls.value) == 60
    again = {r.row_id: r for r in answered(rows, Counted(calls), path, failed_again=True).collect()}
    assert calls.value[60:] == [13] and again[13].attempt == 2 and again[13].error is None and again[13].prediction == 0


def test_calls_at_once_keep_the_order_and_their_number(spark):
    import threading
    import time

    open_, most, lock = [0], [0], threading.Lock()

    def slow(turns, name):
        with lock:
            open_[0] += 1
            most[0] = max(most[0], open_[0])
        time.sleep(0.02 * (int(turns[0]) % 3))
        with lock:
            open_[0] -= 1
        return turns[0]

    sent = [f'["{k}"]' if k % 7 else None for k in range(40)]
    got = inference._answer_all(sent, ["m"] * 40, slow, inference.Retry(), 4, threading.Event())
    assert [text for _, text, _ in got] == [str(k) if k % 7 else None for k in range(40)]
    assert 1 < most[0] <= 4
