"""Asking a model about every row. The caller gives the function that makes one call."""

from __future__ import annotations

import json
import random
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funclab.config import DEFAULT_TEMPLATE, FAILED_CALL_TEXT
from funclab.functions.batches import slices
from funclab.functions.prompts import line_question_messages, question_messages
from funclab.functions.responses import line_question_gate, response_label
from funclab.functions.text import strip

# predict(messages, model) -> answer text
Predict = Callable[[list, str], str]


@dataclass(frozen=True)
class Retry:
    """Up to ``attempts`` calls, with a random wait that may double each time."""

    attempts: int = 10
    longest_wait: float = 60.0
    retry_on: tuple = (ConnectionError, TimeoutError)
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, call):
        for attempt in range(1, self.attempts + 1):
            try:
                return call()
            except self.retry_on:
                if attempt == self.attempts:
                    raise
                self.sleep(random.uniform(0, min(self.longest_wait, 2.0 ** (attempt - 1))))


class StopAsking(Exception):
    """For a model function to raise where no further call can succeed, as when a quota is used up."""


#: Bytes of questions that a task holds at a time with their answers, unless one question has more.
SLICE_BYTES = 1 << 20
_ANSWER = pa.struct([("ok", pa.bool_()), ("text", pa.string()), ("error", pa.string())])

#: What stands in place of an error for a row that was not asked about, or not to the end.
NOT_ASKED = "not asked"


def _answer_all(sent, models, predict, retry, at_once, stopped):
    """(ok, text, error) of each question, in the order of the questions; ok is null where none was asked."""

    def one(question):
        body, name = question
        if body is None:
            return True, None, None
        if stopped.is_set():
            return None, None, NOT_ASKED
        turns = json.loads(body)
        try:
            return True, retry(lambda: predict(turns, name)), None
        except StopAsking:
            stopped.set()
            return None, None, NOT_ASKED
        except Exception as error:  # one bad row must not fail the job
            return False, None, f"{type(error).__name__}: {error}"

    questions = list(zip(sent, models))
    if at_once <= 1:
        return [one(q) for q in questions]
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(one, questions))


def ask(messages: Column, model: Column, predict: Predict, retry: Retry = Retry(), at_once: int = 1) -> Column:
    """The model's answer as ``struct<ok, text, error>``; null messages are not sent and give null text.

    Only the messages go to Python. The column is marked as non-deterministic, so the plan never
    evaluates it twice for one row. A task keeps up to ``at_once`` calls open, each in a thread with
    its own retries, and answers keep the order of the rows; repartition the rows for more tasks,
    and lower ``spark.sql.execution.arrow.maxRecordsPerBatch`` for slow models. After ``StopAsking`` a
    task makes no further call, and ``ok`` is null for what it leaves out.
    """

    @F.arrow_udf("struct<ok:boolean,text:string,error:string>")
    def call(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        stopped = threading.Event()
        for sent, models in slices(batches, SLICE_BYTES):
            answers = _answer_all(sent.to_pylist(), models.to_pylist(), predict, retry, at_once, stopped)
            yield pa.array([dict(zip(_ANSWER.names, answer)) for answer in answers], _ANSWER)

    return call.asNondeterministic()(F.to_json(messages), model)


def batch_predict(rows: DataFrame, predict: Predict, model="model", prompt="prompt", language="language", retry: Retry = Retry(), template=DEFAULT_TEMPLATE, error: str | None = None, at_once: int = 1) -> DataFrame:
    """Add ``func_response``, ``line_response`` and ``prediction``.

    Lines are asked for in a second call, only where the first answer is plainly "vulnerable". A
    row whose call fails counts as vulnerable and loses its prompt; what went wrong is kept in the
    column named by ``error``, if any. A row that a stopped task left out keeps its prompt and has
    null answers. Write the result before using it twice, or the model is asked twice; ``plans.runs``
    has runs that write it and go on where they ended.
    """
    first = rows.withColumn("_a", ask(question_messages(F.col(prompt), F.col(language), template), F.col(model), predict, retry, at_once))
    first = first.withColumn("_answer", strip(F.col("_a.text")))
    gate = F.col("_a.ok") & line_question_gate(F.col("_answer"))
    more = line_question_messages(F.col(prompt), F.col("_answer"), F.col(language), template)
    second = first.withColumn("_b", ask(F.when(gate, more), F.col(model), predict, retry, at_once))
    asked = F.col("_a.ok").isNotNull() & F.col("_b.ok").isNotNull()
    failed = ~(F.col("_a.ok") & F.col("_b.ok"))
    done = (
        second.withColumn("func_response", F.when(asked, F.when(failed, F.lit(FAILED_CALL_TEXT)).otherwise(F.col("_answer"))))
        .withColumn("line_response", F.when(asked, F.when(failed, F.lit("")).otherwise(F.coalesce(strip(F.col("_b.text")), F.lit("")))))
        .withColumn("prediction", F.when(asked, F.when(failed, F.lit(1)).otherwise(response_label(F.col("_answer")))))
        .withColumn(prompt, F.when(asked & failed, F.lit("")).otherwise(F.col(prompt)))
    )
    if error:
        done = done.withColumn(error, F.coalesce(F.col("_a.error"), F.col("_b.error")))
    return done.drop("_a", "_b", "_answer")


ANSWER_KEYS = ("language", "configuration", "experiment", "variant", "row_id")


#: What tells answers of several runs to one row apart.
RUN_COLUMNS = ("experiment", "variant", "model")


def attach_predictions(rows: DataFrame, answers: DataFrame, on=None) -> DataFrame:
    """Put answers beside their rows by key, never by position; a row without an answer stays.

    Without ``on``, by those of the experiment keys and ``row_id`` that both sides have. Answers of
    several runs (experiment, variant or model that rows do not have) give a row each; two answers
    of one run to one key are an error, as either could be the right one.
    """
    keys = list(on) if on else [k for k in ANSWER_KEYS if k in rows.columns and k in answers.columns]
    one = [*keys, *[c for c in RUN_COLUMNS if c in answers.columns and c not in keys]]
    rest = [c for c in answers.columns if c not in one]
    # Grouped by the keys of the join first, so the join needs no other shuffle of the answers.
    grouped = answers.groupBy(*one).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(F.lit(0).alias("_"), *rest)).alias("_rest"))
    named = F.concat_ws("/", *[F.col(c).cast("string") for c in one])
    repeated = F.raise_error(F.concat(F.lit("several answers for "), named)).cast("boolean")
    checked = grouped.where(F.when(F.col("_n") > 1, repeated).otherwise(F.lit(True)))
    # In the order that a join of the two tables gives.
    right = checked.select(*one, *[F.col("_rest")[c].alias(c) for c in rest])
    left = [rows[c] for c in rows.columns if c not in keys]
    return rows.join(right, keys, "left").select(*keys, *left, *[right[c] for c in answers.columns if c not in keys])
