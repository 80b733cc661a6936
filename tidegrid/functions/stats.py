"""Null-aware aggregates and row-wise means."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_mean(col: str | Column) -> Column:
    """Mean that is null as soon as one input is null (Spark's ``avg`` skips them)."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(F.count(col) == F.count(F.lit(1)), F.avg(col))


def row_mean(*cols: str) -> Column:
    """Mean across columns of one row; null if any of them is null."""
    return reduce(lambda a, b: a + b, [F.col(c) for c in cols]) / F.lit(float(len(cols)))


def missing_cells(*cols: str) -> Column:
    """Number of null cells over all rows of the given columns."""
    one_row = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in cols])
    return F.coalesce(F.sum(one_row), F.lit(0).cast("long"))


def any_missing(*cols: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
