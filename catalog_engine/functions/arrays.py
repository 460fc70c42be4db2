"""Helper for array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    Inside a lambda every mention of an outer expression is evaluated again for each element; bound as the variable of a
    one-element ``transform`` it is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
