"""Small helpers for totals and shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row, as a scalar subquery (no join)."""
    row = one.select(F.struct(*one.columns)).scalar()
    return df.withColumn("_row", row).select(*df.columns, "_row.*")


def with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """Add whole-table aggregates to every row."""
    return attach(df, df.agg(*[c.alias(n) for n, c in totals.items()]))


def with_group_totals(df: DataFrame, keys: Sequence[str], **totals: Column) -> DataFrame:
    """Add per-group aggregates to every row by aggregate and join (map-side combined, skew-splittable)."""
    return df.join(df.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()]), list(keys))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def share(cond: Column) -> Column:
    """Share of rows where ``cond`` holds."""
    return F.avg(cond.cast("double"))


def tally(cond: Column) -> Column:
    """Number of rows where ``cond`` holds."""
    return F.count(F.when(cond, 1))
