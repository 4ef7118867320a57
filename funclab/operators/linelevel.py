"""Scores per line: Top-k, IFA, Effort@20%Recall and Recall@1%LOC.

``line_facts`` reduces each true positive to a few numbers. It holds the costly part (finding the
quoted lines in the source), so ``line_metrics`` writes it down once and reads it for every score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funclab.functions.responses import locate_lines
from funclab.functions.text import lines_of_code, parse_line_list, rounded
from funclab.operators.metrics import ratio
from funclab.operators.results import gives_answers, overlap_semi_join
from funclab.plans.settle import lookup_join, settle, settle_table
from funclab.schemas import EXPERIMENT_KEYS, RUN_KEYS

TOP_K = (1, 3, 5, 10)
RECALL_SHARE = 0.2
LOC_SHARE = 0.01
# A run without any true positive.
WORST_IFA = 100.0

LINE_METRICS = [*[f"top_{k}_accuracy" for k in TOP_K], "ifa", "effort_at_20_recall", "recall_at_1_loc"]


def _share_of(total: Column, share: float) -> Column:
    """The share rounded down; shares are doubles, as ``0.2`` has no exact form."""
    return (total.cast("double") * F.lit(share)).cast("bigint")


def predicted_lines() -> Column:
    located = locate_lines(F.col("line_response"), F.col("processed_func"))
    ranking = F.coalesce("line_ranking", F.array().cast("array<int>"))
    return F.when(gives_answers(F.col("model")), located).otherwise(ranking)


def line_facts(results: DataFrame, totals: DataFrame, by=tuple(RUN_KEYS), exp=tuple(EXPERIMENT_KEYS)) -> DataFrame:
    """One narrow row per true positive.

    ``hit_at`` lists the 1-based places of right lines among the predicted ones, and
    ``n_hits_in_cut`` counts distinct right lines within the first 1% of the experiment's lines.
    """
    hits = results.where((F.col("target") == 1) & (F.col("prediction") == 1)).select(
        *by,
        "row_id",
        lines_of_code(F.col("processed_func")).alias("loc"),
        parse_line_list(F.col("flaw_line_index")).alias("_truth"),
        predicted_lines().alias("_said"),
    )
    cut = totals.select(*exp, _share_of(F.col("total_lines"), LOC_SHARE).alias("_cut"))
    joined = lookup_join(hits, settle(cut), exp, "left")
    place = F.transform("_said", lambda line, i: F.when(F.array_contains("_truth", line), i + 1))
    in_cut = F.slice("_said", F.lit(1), F.least(F.coalesce("_cut", F.lit(0)), F.size("_said")).cast("int"))
    return joined.select(
        *by,
        "row_id",
        "loc",
        F.size("_said").alias("n_said"),
        F.array_compact(place).alias("hit_at"),
        F.size(F.array_intersect(in_cut, "_truth")).alias("n_hits_in_cut"),
    )


def _first_hit():
    return F.get("hit_at", F.lit(0))


def _topk_columns():
    tests = {k: F.coalesce(_first_hit() <= k, F.lit(False)) for k in TOP_K}
    return [F.avg(test.cast("double")).alias(f"top_{k}_accuracy") for k, test in tests.items()]


def _ifa_column(places=None):
    clean = F.coalesce(_first_hit() - 1, F.when(F.col("n_said") > 0, F.col("n_said")).otherwise(F.col("loc")))
    mean = F.avg(clean)
    return (mean if places is None else rounded(mean, places)).alias("ifa")


def _total(name: str, exp) -> Column:
    """A total of the experiment; without one there is no score, and a zero would look perfect."""
    said = F.concat(F.lit(f"no {name} for "), F.concat_ws("/", *[F.col(c).cast("string") for c in exp]))
    return F.coalesce(F.col(name).cast("double"), F.raise_error(said).cast("double"))


def topk_accuracy(facts: DataFrame, by=tuple(RUN_KEYS)) -> DataFrame:
    """Share of true positives with a right line among the first k predicted ones."""
    return facts.groupBy(*by).agg(*_topk_columns())


def ifa(facts: DataFrame, by=tuple(RUN_KEYS), places: int | None = None) -> DataFrame:
    """Mean number of clean lines read before the first right one.

    Without a right line all predicted lines count, and without any predicted line the function.
    With ``places`` each run's mean is rounded, before any mean over runs.
    """
    return facts.groupBy(*by).agg(_ifa_column(places))


def recall_at_loc(facts: DataFrame, totals: DataFrame, by=tuple(RUN_KEYS), exp=tuple(EXPERIMENT_KEYS)) -> DataFrame:
    found = facts.groupBy(*by).agg(F.sum("n_hits_in_cut").alias("_found"))
    share = ratio(F.col("_found").cast("double"), _total("total_flaw_lines", exp))
    return found.join(totals, list(exp), "left").select(*by, share.alias("recall_at_1_loc"))


def _within():
    return (F.col("_low").isNull() | (F.col("_at") > F.col("_low"))) & (F.col("_high").isNull() | (F.col("_at") <= F.col("_high")))


def _goal_ranges(narrow: DataFrame, spans: DataFrame, by, ranges) -> DataFrame:
    """Cut the span of each run into ranges of equal numbers of rows, and keep the one that reaches the goal.

    The cuts are quantiles of a sketch that tasks fill and that is merged, so the ranges are even
    however the order is spread, but for the error of the sketch.
    """
    rows = lookup_join(narrow, spans, by, spread="_at").where(_within())
    shares = [k / ranges for k in range(1, ranges)]
    cuts = rows.groupBy(*by).agg(F.array_distinct(F.percentile_approx("_at", shares, ranges * 100)).alias("_cuts"))
    cuts = settle(cuts)
    placed = lookup_join(rows.select(*by, "_at", "n_said", "hit_at"), cuts, by, spread="_at")
    placed = placed.withColumn("_range", F.size(F.filter("_cuts", lambda cut: cut < F.col("_at"))))
    sums = placed.groupBy(*by, "_range").agg(
        F.sum(F.size("hit_at")).alias("_hits"), F.sum("n_said").alias("_said"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda name: F.coalesce(F.sum(name).over(before), F.lit(0))
    sums = sums.select(*by, "_range", F.struct("_range", "_n", upto("_hits").alias("_hits"), upto("_said").alias("_said")).alias("_here"))
    both = sums.join(spans.withColumnRenamed("_n", "_n_span"), by).where(F.col("_hits_before") + F.col("_here._hits") < F.col("_goal"))
    carried = ["_goal", "_low", "_high", "_hits_before", "_said_before", "_n_span"]
    last = both.groupBy(*by, *carried).agg(F.max("_here").alias("_here")).join(cuts, by)
    at, n = F.col("_here._range"), F.col("_here._n")
    return last.select(
        *by,
        "_goal",
        F.coalesce(F.get("_cuts", at - 1), F.col("_low")).alias("_low"),
        F.coalesce(F.get("_cuts", at), F.col("_high")).alias("_high"),
        (F.col("_hits_before") + F.col("_here._hits")).alias("_hits_before"),
        (F.col("_said_before") + F.col("_here._said")).alias("_said_before"),
        # Rows that all stand at one place cannot be told apart: no further cut.
        F.when(n < F.col("_n_span"), n).otherwise(F.lit(0)).alias("_n"),
    )


def effort_lines(facts: DataFrame, totals: DataFrame, by=tuple(RUN_KEYS), exp=tuple(EXPERIMENT_KEYS), order="row_id", buckets=64, bound=8_192) -> DataFrame:
    """Predicted lines read, in row order, until 20% of the flawed lines are found.

    A run of more than ``bound`` rows is cut into ``buckets`` by quantiles of ``order``, these are
    summed, and only the one in which the goal is reached goes on, cut again while it is over the
    bound. So at most about ``bound`` rows of a run are put in order together. ``facts`` and
    ``totals`` are stored tables.
    """
    by = list(by)
    goals = totals.select(*exp, _share_of(F.col("total_flaw_lines"), RECALL_SHARE).alias("_goal")).where("_goal > 0")
    none, zero = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
    spans = facts.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).join(goals, list(exp))
    spans = settle(spans.select(*by, "_goal", none.alias("_low"), none.alias("_high"), zero.alias("_hits_before"), zero.alias("_said_before"), "_n"))
    narrow = facts.select(*by, F.col(order).cast("bigint").alias("_at"), "n_said", "hit_at")
    ready = spans.where(F.col("_n") <= bound)
    while not (wide := spans.where(F.col("_n") > bound)).isEmpty():
        spans = settle(_goal_ranges(narrow, wide, by, max(buckets, 2)))
        ready = ready.unionByName(spans.where(F.col("_n") <= bound))
    inside = lookup_join(narrow, settle(ready.drop("_n")), by, spread="_at").where(_within())
    above = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    found = F.col("_hits_before") + F.coalesce(F.sum(F.size("hit_at")).over(above), F.lit(0))
    read = (
        F.when(F.col("_found") >= F.col("_goal"), 0)
        .when(
            F.col("_found") + F.size("hit_at") >= F.col("_goal"),
            F.get("hit_at", (F.col("_goal") - F.col("_found") - 1).cast("int")),
        )
        .otherwise(F.col("n_said"))
    )
    return (
        inside.withColumn("_found", found)
        .groupBy(*by)
        .agg((F.max("_said_before") + F.sum(read)).alias("effort_lines"))
    )


def effort_at_recall(facts: DataFrame, totals: DataFrame, by=tuple(RUN_KEYS), exp=tuple(EXPERIMENT_KEYS)) -> DataFrame:
    """Effort lines over all lines of the experiment; 0 where 20% of its flawed lines is less than one."""
    runs = facts.select(*by).distinct().join(totals, list(exp), "left")
    effort = runs.join(effort_lines(facts, totals, by, exp), list(by), "left")
    share = ratio(F.col("effort_lines").cast("double"), _total("total_lines", exp))
    return effort.select(*by, share.alias("effort_at_20_recall"))


def line_metrics(results: DataFrame, totals: DataFrame, overlap: DataFrame | None = None, by=tuple(RUN_KEYS), exp=tuple(EXPERIMENT_KEYS), ifa_places: int | None = None) -> DataFrame:
    """All line scores per run, over true positives (within ``overlap``, when given).

    ``ifa`` is rounded to ``ifa_places``, if given. Runs without any true positive are listed with the worst values.
    An experiment without totals is an error.
    """
    by, exp = list(by), list(exp)
    totals = settle(totals)
    facts = settle_table(line_facts(overlap_semi_join(results, overlap, exp), totals, by, exp), "line-facts")
    scores = facts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_true_positives"),
        *_topk_columns(),
        _ifa_column(ifa_places),
        F.sum("n_hits_in_cut").alias("_in_cut"),
    )
    runs = results.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
    joined = (
        runs.join(scores, by, "left").join(effort_lines(facts, totals, by, exp), by, "left").join(totals, exp, "left")
    )
    number = lambda name: F.col(name).cast("double")
    return joined.select(
        *by,
        F.coalesce("n_true_positives", F.lit(0)).alias("n_true_positives"),
        *[F.coalesce(f"top_{k}_accuracy", F.lit(0.0)).alias(f"top_{k}_accuracy") for k in TOP_K],
        F.coalesce("ifa", F.lit(WORST_IFA)).alias("ifa"),
        ratio(number("effort_lines"), _total("total_lines", exp)).alias("effort_at_20_recall"),
        ratio(number("_in_cut"), _total("total_flaw_lines", exp)).alias("recall_at_1_loc"),
    )
