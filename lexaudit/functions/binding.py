"""Values computed once: used often inside an expression, or opened to rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once: higher-order functions otherwise evaluate it at every use."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def opened(rows: DataFrame, array: Column, name: str, *keep: str | Column) -> DataFrame:
    """keep and a row for each element of the array, as name; null elements are left out.

    An inner explode lets the optimizer filter by the array's size, which computes the array, and all
    that it is made of, once more for each condition; the outer one is filtered by its elements.
    """
    return rows.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())
