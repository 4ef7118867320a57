"""Name a computed value inside one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    A column used inside a lambda is computed again on every call of the lambda; a lambda
    variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
