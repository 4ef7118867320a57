"""Means over experiments, and the matrix of all configurations and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funclab.operators.linelevel import LINE_METRICS, line_metrics
from funclab.operators.metrics import FUNC_METRICS, func_metrics
from funclab.operators.results import complement, without_skipped
from funclab.schemas import RUN_KEYS

SCORE_KEYS = ["language", "configuration", "model"]


def _means(per_run, metrics, by, *extra):
    return per_run.groupBy(*by).agg(
        F.array_sort(F.collect_list("experiment")).alias("include_experiments"),
        *[F.avg(m).alias(m) for m in metrics],
        *extra,
    )


def avg_func_metrics(results: DataFrame, skips: DataFrame | None = None, by=tuple(SCORE_KEYS)) -> DataFrame:
    """Mean function scores over the experiments present, and those whose F1 is 0."""
    per_run = func_metrics(without_skipped(results, skips), RUN_KEYS)
    zero = F.array_sort(F.collect_list(F.when(F.col("f1") == 0, F.col("experiment"))))
    return _means(per_run, FUNC_METRICS, by, zero.alias("zero_f1_experiments"))


def avg_line_metrics(results: DataFrame, totals: DataFrame, overlap: DataFrame | None = None, skips: DataFrame | None = None, by=tuple(SCORE_KEYS), ifa_places: int | None = None) -> DataFrame:
    """Mean line scores over the experiments present; ``ifa_places`` rounds each run's IFA before the mean."""
    per_run = line_metrics(without_skipped(results, skips), totals, overlap, ifa_places=ifa_places)
    return _means(per_run, LINE_METRICS, by)


def with_absent_experiments(means: DataFrame, n_experiments: int = 10, included="include_experiments") -> DataFrame:
    """Add the ids that a mean lacks, skipped or never run; means divide by those present."""
    return means.withColumn("absent_experiments", complement(F.col(included), n_experiments))


def score_matrix(results: DataFrame, totals: DataFrame, overlap: DataFrame | None = None, skips: DataFrame | None = None, by=tuple(SCORE_KEYS), ifa_places: int | None = None) -> DataFrame:
    """Function and line means side by side, one row per configuration and model.

    Function scores average every experiment; line scores leave out the skipped ones and say which
    ones they kept.
    """
    by = list(by)
    func = avg_func_metrics(results, None, by).withColumnRenamed("include_experiments", "func_experiments")
    line = avg_line_metrics(results, totals, overlap, skips, by, ifa_places).withColumnRenamed("include_experiments", "line_experiments")
    return func.join(line, by, "left").orderBy(*by)
