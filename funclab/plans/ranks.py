"""Exact order statistics without a window over a whole group.

``row_number()`` over one class puts the class into one task. Here the sort key is cut into
buckets by its first digits: the buckets are counted, the counts are summed up in order, and only
rows inside one bucket are sorted together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funclab.plans.settle import lookup_join, settle

# About how many rows are sorted together, and the most digits: a million buckets per group.
ROWS_PER_BUCKET = 8_192
MAX_DIGITS = 5

# Sorts after every hex key, and before it: "everything" and "nothing" as cuts.
AFTER_ALL = "g"
BEFORE_ALL = ""


def prefix_digits(largest_group: int) -> int:
    """How many hex digits make a bucket, so that buckets are small and not more than needed."""
    digits = 1
    while digits < MAX_DIGITS and largest_group > ROWS_PER_BUCKET * 16**digits:
        digits += 1
    return digits


def _bucket_counts(rows, by, key, digits):
    bucket = F.substring(key, 1, digits).alias("_bucket")
    counts = rows.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket"))
    return counts.withColumn("_before", upto - F.col("_n"))


def key_cuts(rows: DataFrame, by, key, wanted: DataFrame, digits: int) -> DataFrame:
    """The k-th smallest key of each group; ``digits`` as from ``prefix_digits``.

    ``wanted`` is small and holds the group columns and ``rank`` (1-based, several per group
    allowed); the answer adds ``cut``. Keys must not repeat inside a group.
    """
    counts = _bucket_counts(rows, by, key, digits)
    hits = (
        counts.join(wanted, by)
        .where((F.col("_before") < F.col("rank")) & (F.col("rank") <= F.col("_before") + F.col("_n")))
        .select(*by, "_bucket", "rank", (F.col("rank") - F.col("_before")).alias("_local"))
    )
    bucketed = rows.withColumn("_bucket", F.substring(key, 1, digits))
    near = lookup_join(bucketed, settle(hits), [*by, "_bucket"], spread=key)
    order = Window.partitionBy(*by, "rank").orderBy(key)
    return (
        near.withColumn("_at", F.row_number().over(order))
        .where(F.col("_at") == F.col("_local"))
        .select(*by, "rank", F.col(key).alias("cut"))
    )


def exact_rank(rows: DataFrame, by, key, name="rank", *, digits: int) -> DataFrame:
    """Add the 1-based rank of each row inside its group, in key order."""
    counts = _bucket_counts(rows, by, key, digits).drop("_n")
    bucketed = rows.withColumn("_bucket", F.substring(key, 1, digits))
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(key))
    return (
        bucketed.join(counts, [*by, "_bucket"])
        .withColumn(name, F.col("_before") + inside)
        .drop("_bucket", "_before")
    )
