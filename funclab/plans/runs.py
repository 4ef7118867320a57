"""Whole runs: experiments in, model answers out, for every experiment at once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funclab.config import DEFAULT_TEMPLATE, NO_BALANCING, SUFFIXES
from funclab.operators.fewshot import few_shot_blocks, few_shot_examples, few_shot_prompts, zero_shot_prompts
from funclab.operators.finetune import fine_tuning_chats
from funclab.operators.inference import NOT_ASKED, Predict, Retry, batch_predict
from funclab.schemas import RUN_KEYS

#: Keys of an answer, as far as the questions have them, and what is kept of it.
QUESTION_KEYS = [*RUN_KEYS, "variant", "row_id"]
ANSWER_COLUMNS = ["func_response", "line_response", "prediction", "error", "attempt"]


def training_chats(experiments: DataFrame, balance_mode: int = NO_BALANCING, template=DEFAULT_TEMPLATE) -> DataFrame:
    """Fine-tuning records of the training frame that a balance mode selects."""
    variant = "train" if balance_mode == NO_BALANCING else "train" + SUFFIXES[balance_mode]
    return fine_tuning_chats(experiments.where(F.col("variant") == variant), template=template)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of answers, of all attempts; None before the first run."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _last_answers(stored: DataFrame, keys) -> DataFrame:
    """The last attempt of each question."""
    last = F.max(F.struct("attempt", *[c for c in ANSWER_COLUMNS if c != "attempt"])).alias("_last")
    return stored.groupBy(*keys).agg(last).select(*keys, *[F.col("_last")[c].alias(c) for c in ANSWER_COLUMNS])


def answered(questions: DataFrame, predict: Predict, path: str, retry: Retry = Retry(), template=DEFAULT_TEMPLATE, at_once: int = 1, failed_again: bool = False) -> DataFrame:
    """Questions with their answers, asking only where the table at ``path`` has none yet.

    ``questions`` has ``prompt``, ``language``, ``model`` and a ``row_id``, and is told apart by those
    of QUESTION_KEYS that it has; no key may be null. New answers are added to the table, with the
    text of an error where a call failed; that counts as answered, unless ``failed_again`` asks once
    more. Where a task was stopped (``StopAsking``) the rest of its rows is left for the next run,
    so over two runs each row is asked about once. Rows still without an answer have nulls.
    """
    spark, keys = questions.sparkSession, [k for k in QUESTION_KEYS if k in questions.columns]
    stored = _stored(spark, path)
    left = questions.withColumn("_before", F.lit(0))
    if stored is not None:
        known = _last_answers(stored, keys)
        tries = known.select(*keys, F.col("attempt").alias("_tries"), "error")
        settled = F.col("_tries").isNotNull() & (F.col("error").isNull() | F.lit(not failed_again))
        left = questions.join(tries, keys, "left").where(~settled)
        left = left.withColumn("_before", F.coalesce("_tries", F.lit(0))).drop("_tries", "error")
    new = batch_predict(left, predict, retry=retry, template=template, error="error", at_once=at_once)
    new = new.where(F.coalesce(F.col("error"), F.lit("")) != NOT_ASKED).withColumn("attempt", F.col("_before") + 1)
    new.select(*keys, *ANSWER_COLUMNS).write.mode("append").parquet(path)
    return questions.join(_last_answers(spark.read.parquet(path), keys), keys, "left")


def _run(questions, predict, answers, retry, template, at_once):
    if answers:
        return answered(questions, predict, answers, retry, template, at_once)
    return batch_predict(questions, predict, retry=retry, template=template, at_once=at_once)


def few_shot_run(experiments: DataFrame, predict: Predict, model: str, max_vul=9, max_non_vul=1, retry: Retry = Retry(), template=DEFAULT_TEMPLATE, answers: str | None = None, at_once: int = 1) -> DataFrame:
    """Ask about each test row with examples from its experiment's training rows.

    With ``answers``, the path of a table, the run keeps what it is told and goes on where it ended.
    """
    train = experiments.where(F.col("variant") == "train")
    blocks = few_shot_blocks(few_shot_examples(train, max_vul=max_vul, max_non_vul=max_non_vul), template=template)
    test = experiments.where(F.col("variant") == "test")
    prompts = few_shot_prompts(test, blocks, template=template).withColumn("model", F.lit(model))
    return _run(prompts, predict, answers, retry, template, at_once)


def fine_tuned_run(experiments: DataFrame, predict: Predict, model: str, retry: Retry = Retry(), template=DEFAULT_TEMPLATE, answers: str | None = None, at_once: int = 1) -> DataFrame:
    """Ask a tuned model about each test row, without examples; ``answers`` as above."""
    test = experiments.where(F.col("variant") == "test")
    prompts = zero_shot_prompts(test, template=template).withColumn("model", F.lit(model))
    return _run(prompts, predict, answers, retry, template, at_once)
