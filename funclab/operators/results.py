"""Model results in one shape, and the sets and totals taken from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funclab.config import OVERLAP_MODELS, RANKING_FAMILY, SUFFIXES
from funclab.functions.text import parse_ranking
from funclab.plans.settle import lookup_join, settle, settle_table
from funclab.schemas import EXPERIMENT_KEYS, RUN_KEYS

_COMMON = [*RUN_KEYS, "row_id", "processed_func", "flaw_line_index"]


def gives_answers(model: Column) -> Column:
    """True for models that answer in text, false for the line ranking family."""
    return ~model.contains(RANKING_FAMILY)


def as_label(text: Column) -> Column:
    """1 for ``1`` and ``true``, 0 for everything else; the forms a result file may hold."""
    low = F.lower(text.cast("string"))
    return F.when(low.isin("1", "1.0", "true"), F.lit(1)).otherwise(F.lit(0))


def normalise_results(answers: DataFrame, rankings: DataFrame) -> DataFrame:
    """Both result file formats on one schema."""
    from_answers = answers.select(
        *_COMMON,
        F.col("target").cast("int").alias("target"),
        as_label(F.col("GPT Prediction")).alias("prediction"),
        F.col("GPT Func Level").alias("func_response"),
        F.col("GPT Line Level").alias("line_response"),
        *([F.col("Prompt").alias("prompt")] if "Prompt" in answers.columns else []),
    )
    from_rankings = rankings.select(
        *_COMMON,
        F.col("y_trues").cast("int").alias("target"),
        as_label(F.col("y_preds")).alias("prediction"),
        parse_ranking(F.col("LineVul Line Level")).alias("line_ranking"),
        F.col("num_lines").cast("int").alias("num_lines"),
        F.col("num_flaw_lines").cast("int").alias("num_flaw_lines"),
    )
    return from_answers.unionByName(from_rankings, allowMissingColumns=True)


def func_key(code: Column) -> Column:
    """Identity of a function text; joins and groups move this in place of the text."""
    return F.sha2(code, 256)


def true_positives(results: DataFrame, by=tuple(RUN_KEYS)) -> DataFrame:
    """Distinct function texts a model rightly called vulnerable."""
    hits = results.where((F.col("target") == 1) & (F.col("prediction") == 1))
    return hits.select(*by, func_key(F.col("processed_func")).alias("func_key")).distinct()


def model_overlap(results: DataFrame, models=tuple(OVERLAP_MODELS), by=tuple(EXPERIMENT_KEYS)) -> DataFrame:
    """Function texts that every listed model rightly called vulnerable, per experiment.

    Each model is one bit, so the sets meet in one grouped pass with merging before the shuffle.
    """
    bit = F.lit(0)
    for i, name in enumerate(models):
        bit = F.when(F.col("model") == name, F.lit(1 << i)).otherwise(bit)
    hits = results.where((F.col("target") == 1) & (F.col("prediction") == 1) & F.col("model").isin(*models))
    seen = hits.groupBy(*by, func_key(F.col("processed_func")).alias("func_key")).agg(F.bit_or(bit).alias("_seen"))
    return seen.where(F.col("_seen") == (1 << len(models)) - 1).drop("_seen")


def overlap_semi_join(results: DataFrame, overlap: DataFrame | None, by=tuple(EXPERIMENT_KEYS)) -> DataFrame:
    """Rows whose function is in the overlap of their experiment; every row when there is none given.

    An experiment without overlap keeps no row.
    """
    if overlap is None:
        return results
    keyed = results.withColumn("func_key", func_key(F.col("processed_func")))
    known = settle_table(overlap.select(*by, "func_key"), "overlap")
    return lookup_join(keyed, known, [*by, "func_key"], "left_semi").drop("func_key")


def experiment_totals(results: DataFrame, model="linevul_undersampling", by=tuple(EXPERIMENT_KEYS)) -> DataFrame:
    """Lines and flawed lines of each experiment's test set, as one named model reports them."""
    one = results.where(F.col("model") == model)
    return one.groupBy(*by).agg(
        F.sum("num_lines").alias("total_lines"), F.sum("num_flaw_lines").alias("total_flaw_lines")
    )


def complement(ids: Column, n_experiments: int = 10) -> Column:
    """The experiment ids that are not in ``ids``, in order; null counts as none.

    Ids go up to ``n_experiments``, or to the highest one given where that is more.
    """
    given = F.coalesce(ids, F.array().cast("array<int>"))
    last = F.greatest(F.lit(n_experiments - 1), F.coalesce(F.array_max(given), F.lit(0)))
    return F.array_sort(F.array_except(F.sequence(F.lit(0), last), given))


def include_experiments(skips: DataFrame, by=("language", "configuration"), n_experiments: int = 10) -> DataFrame:
    """Per configuration, the ids left after the skip list; the list is as short as the ids."""
    listed = skips.groupBy(*by).agg(F.array_sort(F.collect_set("experiment")).alias("skip_experiments"))
    return listed.withColumn("include_experiments", complement(F.col("skip_experiments"), n_experiments))


def without_skipped(rows: DataFrame, skips: DataFrame | None, by=tuple(EXPERIMENT_KEYS)) -> DataFrame:
    """Drop rows of experiments on the skip list."""
    if skips is None:
        return rows
    return lookup_join(rows, settle(skips.select(*by).distinct()), by, "left_anti")


def suffix_name(balance_mode: Column) -> Column:
    names = F.lit(SUFFIXES[2])
    for mode in (1, 0):
        names = F.when(balance_mode == mode, F.lit(SUFFIXES[mode])).otherwise(names)
    return names


def run_name(model: Column, n_examples: Column, default_model: str = "gpt-3.5-turbo") -> Column:
    """Default name of a result set: few-shot with its number of examples, fine-tuned, or plain."""
    few = F.concat(F.lit("gpt_few_shot_"), n_examples.cast("string"))
    tuned = F.when(model != default_model, F.lit("gpt_fine_tuning")).otherwise(F.lit("gpt_default"))
    return F.when(n_examples.isNotNull(), few).otherwise(tuned)
