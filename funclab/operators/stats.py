"""Counts and sums that describe a data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funclab.functions.text import count_listed_lines, count_mod_lines, lines_of_code


def class_distribution(rows: DataFrame, by=(), target="target") -> DataFrame:
    return rows.groupBy(*by, target).agg(F.count(F.lit(1)).alias("n_rows"))


def split_distribution(experiments: DataFrame, by=("language", "configuration", "experiment", "variant"), target="target") -> DataFrame:
    """Class counts per data set, one column per class."""
    counts = experiments.groupBy(*by).agg(
        F.count_if(F.col(target) == 0).alias("non_vulnerable"),
        F.count_if(F.col(target) == 1).alias("vulnerable"),
    )
    return counts


def dataset_stats(raw: DataFrame, by=("language",), approximate: bool = False) -> DataFrame:
    """Projects, lines of code, and modified lines per language."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    sums = raw.groupBy(*by).agg(
        distinct("repo_url").alias("n_projects"),
        F.sum(lines_of_code(F.col("code"))).alias("n_lines"),
        F.sum(count_mod_lines(F.col("mod_lines"))).alias("n_vul_lines"),
    )
    return sums.withColumn("n_non_vul_lines", F.col("n_lines") - F.col("n_vul_lines"))


#: Relative error of a distinct count is about 1.04 / sqrt(2 ** LOG_K); rank error of a quantile about 2.3 / K ** 0.9.
LOG_K, K = 12, 400


def dataset_sketches(raw: DataFrame, by=("language",), log_k=LOG_K, k=K) -> DataFrame:
    """What is needed to tell distinct projects and the spread of lengths of any union of groups.

    A row for each group, of a few kilobytes however large the group is, to be stored and merged
    later (``merged_sketches``); sums are exact. New data is added by sketching it alone. A null
    project or code counts for nothing.
    """
    loc = lines_of_code(F.col("code")).cast("bigint")
    return raw.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.sum(loc).alias("n_lines"),
        F.sum(count_mod_lines(F.col("mod_lines"))).alias("n_vul_lines"),
        F.hll_sketch_agg("repo_url", F.lit(log_k)).alias("projects"),
        F.kll_sketch_agg_bigint(loc, F.lit(k)).alias("lengths"),
    )


def merged_sketches(sketches: DataFrame, by=(), log_k=LOG_K, k=K) -> DataFrame:
    """Sketches of unions of groups; their schema is that of ``sketches``, so they can be merged again."""
    return sketches.groupBy(*by).agg(
        F.sum("n_records").alias("n_records"),
        F.sum("n_lines").alias("n_lines"),
        F.sum("n_vul_lines").alias("n_vul_lines"),
        F.hll_union_agg("projects").alias("projects"),
        F.kll_merge_agg_bigint("lengths", F.lit(k)).alias("lengths"),
    )


def sketched_stats(sketches: DataFrame, by=(), quantiles=(0.1, 0.5, 0.9)) -> DataFrame:
    """The figures that sketches hold: ``n_projects`` and a length for each of ``quantiles`` are estimates."""
    lengths = F.array(*[F.kll_sketch_get_quantile_bigint("lengths", F.lit(float(q))) for q in quantiles])
    return sketches.select(
        *by,
        "n_records",
        "n_lines",
        "n_vul_lines",
        F.hll_sketch_estimate("projects").alias("n_projects"),
        lengths.alias("length_quantiles"),
    )


def loc_summary(raw: DataFrame, by=("language",), code_col="code", label_col="label", mod_lines_col="mod_lines") -> DataFrame:
    """Records per class, listed flaw lines and mean lines of code."""
    return raw.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if(F.col(label_col) == 1).alias("n_vul_records"),
        F.count_if(F.coalesce(F.col(label_col) != 1, F.lit(True))).alias("n_non_vul_records"),
        F.sum(count_listed_lines(F.col(mod_lines_col))).alias("n_vul_lines"),
        F.avg(lines_of_code(F.col(code_col))).alias("mean_loc"),
    )
