"""Few-shot examples and prompts for every experiment at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funclab.config import DEFAULT_TEMPLATE
from funclab.functions.prompts import demonstration, few_shot_prompt, zero_shot_prompt
from funclab.operators.sampling import ORDER
from funclab.plans.ranks import exact_rank, key_cuts, prefix_digits
from funclab.plans.settle import lookup_join, settle, settle_table
from funclab.schemas import EXPERIMENT_KEYS


def _sortable(order: Column, kind: str) -> Column:
    """A column of one of the usual types as text that sorts like it."""
    if kind == "string":
        return order
    shifted = order.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))
    return F.lpad(F.lower(F.hex(shifted)), 16, "0")


def few_shot_examples(train: DataFrame, by=tuple(EXPERIMENT_KEYS), max_vul=9, max_non_vul=1, target="target", order=None, key="row_id") -> DataFrame:
    """The first rows of each class in the frame's order: vulnerable ones first, numbered from 1.

    ``order`` is the frame's own order (``order_key``) where it carries one, else ``key``. It must
    not repeat inside a class. The place at which the first rows end is found by bucket counts, as
    for a split, so however many are asked for, no class comes together in one task; random keys
    keep those buckets even. Only the chosen ids are ranked, and they fetch their texts.
    """
    by, order = list(by), order or (ORDER if ORDER in train.columns else key)
    kind = dict(train.dtypes)[order]
    ids = train.select(*by, target, key, _sortable(F.col(order), kind).alias("_order"))
    limit = F.when(F.col(target) == 1, F.lit(max_vul)).when(F.col(target) == 0, F.lit(max_non_vul)).otherwise(0)
    sizes = settle(ids.groupBy(*by, target).agg(F.count(F.lit(1)).alias("_n")))
    taken = settle(sizes.select(*by, target, F.least("_n", limit.cast("bigint")).alias("rank")).where("rank > 0"))
    largest = sizes.agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
    cuts = settle(key_cuts(ids, [*by, target], "_order", taken, prefix_digits(largest)).drop("rank"))
    first = lookup_join(ids, cuts, [*by, target], spread=key).where(F.col("_order") <= F.col("cut")).drop("cut")
    ranked = exact_rank(settle_table(first, "few-shot"), [*by, target], "_order", name="_at", digits=prefix_digits(max(max_vul, max_non_vul)))
    ahead = settle(taken.where(F.col(target) == 1).select(*by, F.col("rank").alias("_ahead")))
    ranked = lookup_join(ranked, ahead, by, "left", spread=key)
    number = F.col("_at") + F.when(F.col(target) == 1, F.lit(0)).otherwise(F.coalesce("_ahead", F.lit(0)))
    chosen = ranked.select(*by, key, "_order", number.cast("int").alias("example"))
    # A redrawn row may be in a frame several times, so its place goes with its key.
    texts = train.withColumn("_order", _sortable(F.col(order), kind))
    return lookup_join(texts, settle_table(chosen, "few-shot-chosen"), [*by, key, "_order"], spread=key).drop("_order")


def few_shot_blocks(examples: DataFrame, by=tuple(EXPERIMENT_KEYS), code="processed_func", target="target", template=DEFAULT_TEMPLATE) -> DataFrame:
    """One text per experiment: its demonstrations in order. The list per group is as short as the examples."""
    shown = demonstration(F.col("example"), F.col(code), F.col(target), template).alias("text")
    listed = F.array_sort(F.collect_list(F.struct("example", shown)))
    return examples.groupBy(*by).agg(F.array_join(listed["text"], "").alias("block"))


def few_shot_prompts(test: DataFrame, blocks: DataFrame, by=tuple(EXPERIMENT_KEYS), code="processed_func", language="language", template=DEFAULT_TEMPLATE, key="row_id") -> DataFrame:
    """Add ``prompt`` to the test rows of every experiment; one without examples gets the bare frame."""
    joined = lookup_join(test, settle(blocks), by, "left", spread=key)
    prompt = few_shot_prompt(F.coalesce("block", F.lit("")), F.col(code), F.col(language), template)
    return joined.withColumn("prompt", prompt).drop("block")


def zero_shot_prompts(rows: DataFrame, code="processed_func", language="language", template=DEFAULT_TEMPLATE) -> DataFrame:
    return rows.withColumn("prompt", zero_shot_prompt(F.col(code), F.col(language), template))
