import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from funclab.functions.tokens import PIECES, python_counter
from funclab.operators import finetune

GOOD = {"messages": [{"role": r, "content": "a b"} for r in ("system", "user", "assistant")]}
LINES = [
    json.dumps(GOOD),
    "[1]",
    '"text"',
    "not json {",
    "{}",
    '{"messages": null}',
    '{"messages": []}',
    '{"messages": [{"role": "user"}]}',
    '{"messages": [{"content": "x"}, {"role": "assistant", "content": "x", "name": "n"}]}',
    '{"messages": [{"role": "assistant", "content": 5, "weight": 1}]}',
    '{"messages": [{"role": "assistant", "content": null}, {"role": "bot", "content": ""}]}',
    '{"messages": [{"role": null, "content": "x"}]}',
]
EXPECTED = {
    "data_type": 3,
    "missing_messages_list": 3,
    "message_missing_key": 2,
    "message_unrecognized_key": 1,
    "unrecognized_role": 3,
    "missing_content": 4,
    "example_missing_assistant_message": 2,
}


def test_format_errors(spark):
    lines = spark.createDataFrame([(line,) for line in LINES], "value string")
    got = {r.error: r.n_errors for r in finetune.chat_format_errors(lines).collect()}
    assert got == EXPECTED


def test_no_errors_gives_zeros(spark):
    lines = spark.createDataFrame([(json.dumps(GOOD),)], "value string")
    assert {r.n_errors for r in finetune.chat_format_errors(lines).collect()} == {0}


def chats(spark):
    rows = [
        (0, [("system", "you are", None), ("user", "x = 1;", "bob"), ("assistant", "no, thanks", None)]),
        (1, [("user", "é", None)]),
        (2, [("assistant", "", None), ("assistant", "a_b c", None)]),
    ]
    return spark.createDataFrame(rows, "row_id int, messages array<struct<role string, content string, name string>>")


def tokens(text):
    return len(re.findall(PIECES, text))


def expected_facts(messages):
    total = 3 + sum(3 + tokens(m.role) + tokens(m.content) + (tokens(m.name) + 1 if m.name else 0) for m in messages)
    return len(messages), total, sum(tokens(m.content) for m in messages if m.role == "assistant")


@pytest.mark.parametrize("counter", ["default", "python"])
def test_chat_facts(spark, counter):
    df = chats(spark)
    extra = {"counter": python_counter(tokens)} if counter == "python" else {}
    got = {r.row_id: r for r in finetune.chat_facts(df, **extra).collect()}
    for row in df.collect():
        r = got[row.row_id]
        assert (r.n_messages, r.n_tokens, r.n_assistant_tokens) == expected_facts(row.messages)
    assert [got[i].has_user for i in range(3)] == [True, True, False]


def test_turns_give_the_facts_of_records(spark):
    records = chats(spark).withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"], m["content"])))
    turns = records.select("row_id", F.explode("messages").alias("m")).select("row_id", "m.role", "m.content")
    a = finetune.chat_facts(records)
    b = finetune.turn_facts(turns, "row_id").select(*a.columns)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_roles_stats_and_overview(spark):
    facts = finetune.chat_facts(chats(spark))
    assert tuple(finetune.chat_missing_roles(facts).first()) == (2, 1)
    rows = facts.collect()
    for r in finetune.chat_length_stats(facts).collect():
        values = [getattr(x, finetune.MEASURES[r.measure]) for x in rows]
        want = [min(values), max(values), np.mean(values), np.median(values), np.quantile(values, 0.1), np.quantile(values, 0.9)]
        assert np.allclose([r["min"], r["max"], r["mean"], r["median"], r["p10"], r["p90"]], want)
    first = finetune.chat_overview(chats(spark)).first()
    assert first.n_examples == 3 and first.first_messages[0].content == "you are"


@pytest.mark.parametrize("n, epochs", [(1, 25), (5, 20), (33, 3), (34, 3), (8333, 3), (8334, 2), (20000, 1), (30000, 1)])
def test_epochs(spark, n, epochs):
    facts = spark.range(n).select(F.lit(5000).cast("long").alias("n_tokens"))
    row = finetune.fine_tune_cost(facts).first()
    assert (row.n_examples, row.n_too_long, row.n_epochs) == (n, n, epochs)
    assert row.n_charged_tokens == epochs * 4096 * n


def test_cost_of_nothing(spark):
    row = finetune.fine_tune_cost(spark.range(0).select(F.col("id").alias("n_tokens"))).first()
    assert (row.n_examples, row.n_billing_tokens) == (0, 0)
