"""Seeded draws that any engine can repeat: md5 of ``tag:seed:key``.

``rand()`` depends on partitioning and on task retries, so a lost executor could change a split.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _joined(parts):
    return F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def draw_key(*parts) -> Column:
    """32 hex digits that sort like a random number."""
    return F.md5(_joined(parts))


def draw_int(*parts) -> Column:
    """A non-negative 60-bit integer."""
    return F.conv(F.substring(F.md5(_joined(parts)), 1, 15), 16, 10).cast("bigint")
