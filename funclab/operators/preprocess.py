"""Raw function table to clean function table."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funclab.functions.text import flaw_lines
from funclab.schemas import require_columns

RAW_COLUMNS = ["before_change", "label", "added_only", "code", "mod_lines"]


# ``true`` in every mixture of cases.
SPELLINGS = ["".join(letters) for letters in product(*zip("true", "TRUE"))]


def text_flag(column: Column) -> Column:
    """The text ``true`` in any case; null is false."""
    return F.coalesce(F.lower(column.cast("string")) == "true", F.lit(False))


def flag_rows(raw: DataFrame, name: str) -> DataFrame:
    """Rows whose flag is true, as a filter that a Parquet scan can use."""
    if dict(raw.dtypes)[name] == "boolean":
        return raw.where(F.col(name))
    if dict(raw.dtypes)[name] == "string":
        return raw.where(F.col(name).isin(SPELLINGS))
    return raw.where(text_flag(F.col(name)))


def preprocess(raw: DataFrame, keep=("row_id", "language"), strict: bool = False) -> DataFrame:
    """Keep states before a change, drop vulnerable rows that only added lines, pick flaw lines."""
    require_columns(raw, [*keep, *RAW_COLUMNS])
    before = flag_rows(raw, "before_change")
    # A label that is missing or no number fails the job, but only in a row that is kept.
    missing = F.raise_error(F.lit("a row before a change has no label")).cast("int")
    label = F.when(text_flag(F.col("before_change")), F.coalesce(F.col("label").cast("int"), missing))
    kept = before.where(~((label == 1) & text_flag(F.col("added_only"))))
    flaw = F.when(label == 1, flaw_lines(F.col("code"), F.col("mod_lines"), strict)).otherwise(F.lit(""))
    return kept.select(
        *keep,
        F.col("code").alias("processed_func"),
        label.alias("target"),
        F.col("mod_lines").alias("flaw_line_index"),
        flaw.alias("flaw_line"),
    )


def of_class(clean: DataFrame, value: int, target="target") -> DataFrame:
    return clean.where(F.col(target) == value)


def single_function_only(clean: DataFrame, multi_function_ids: DataFrame, key="row_id") -> DataFrame:
    """Drop the rows a reviewer listed as holding more than one function."""
    return clean.join(multi_function_ids.select(key), key, "left_anti")
