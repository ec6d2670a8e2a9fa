"""Checked joins, paired conditions and set selections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def checked_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], validate: str = "many_to_one", how: str = "inner"
) -> DataFrame:
    """Join that raises when ``validate`` ("one_to_one", "many_to_one", "one_to_many") does not hold.

    Each probe is one map-side combined count that stops at the first duplicate.
    """
    keys = list(keys)
    if validate in ("one_to_one", "many_to_one") and not duplicate_keys(right, keys).isEmpty():
        raise ValueError(f"duplicate keys {keys} on the right side")
    if validate in ("one_to_one", "one_to_many") and not duplicate_keys(left, keys).isEmpty():
        raise ValueError(f"duplicate keys {keys} on the left side")
    return left.join(right, keys, how)


def uncovered(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left keys that the right side lacks (coverage loss of a join)."""
    return left.select(*keys).distinct().join(right, list(keys), "left_anti")


def lookup_label(facts: DataFrame, dim: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Facts with their label; raises when any is missing."""
    out = facts.join(dim.select(*keys, label), list(keys), "left")
    if not out.where(F.col(label).isNull()).isEmpty():
        raise ValueError(f"missing {label}")
    return out


def with_match_reason(series: DataFrame, maps: DataFrame, offsets: DataFrame, stats: DataFrame, min_matched: int) -> DataFrame:
    """Every series with the first reason it cannot be used, or NULL.

    ``stats`` has series_id, num_matched and std of its residuals.
    """
    at = (
        series.join(maps.select("map_id", F.lit(True).alias("_map")), "map_id", "left")
        .join(offsets.select("map_id", "offset_ms"), "map_id", "left")
        .join(stats.select("series_id", "num_matched", "std"), "series_id", "left")
    )
    reason = (
        F.when(F.col("_map").isNull(), "no_map")
        .when(F.col("offset_ms").isNull(), "no_offset")
        .when(F.coalesce(F.col("num_matched"), F.lit(0)) < min_matched, "too_few_matches")
        .when(F.col("std") == 0, "zero_variance")
    )
    return at.select("series_id", "map_id", reason.alias("reason"))


def paired_conditions(df: DataFrame, keys: Sequence[str], condition: str, names: Mapping[str, str], values: Sequence[str]) -> DataFrame:
    """Wide control/candidate pairs by conditional aggregation: one shuffle, only complete pairs.

    ``names`` maps a condition value to its suffix; keys x condition must be unique.
    """
    aggs = [F.count(F.when(F.col(condition) == c, 1)).alias("_n_" + s) for c, s in names.items()]
    for c, s in names.items():
        aggs += [F.max(F.when(F.col(condition) == c, F.col(v))).alias(f"{v}_{s}") for v in values]
    complete = F.lit(True)
    for s in names.values():
        complete = complete & (F.col("_n_" + s) == 1)
    wide = df.where(F.col(condition).isin(*names)).groupBy(*keys).agg(*aggs).where(complete)
    return wide.drop(*["_n_" + s for s in names.values()])


def label_deltas(df: DataFrame, keys: Sequence[str], label: str, values: Sequence[str]) -> DataFrame:
    """value(label 1) - value(label 0) per pair; both labels required."""
    aggs = [
        (F.max(F.when(F.col(label) == 1, F.col(v))) - F.max(F.when(F.col(label) == 0, F.col(v)))).alias(v + "_delta") for v in values
    ]
    both = F.count_distinct(label).alias("_labels")
    return df.groupBy(*keys).agg(*aggs, both).where(F.col("_labels") == 2).drop("_labels")


def select_disjoint(
    cohort: DataFrame, design: DataFrame, needed: int, group: str = "map_id", unit: str = "series_id"
) -> tuple[DataFrame, str]:
    """Rows disjoint from the design by group; by unit only when fewer than ``needed`` remain."""
    by_group = cohort.join(design.select(group).distinct(), group, "left_anti")
    if by_group.limit(needed).count() >= needed:
        return by_group, "group_disjoint"
    return cohort.join(design.select(unit).distinct(), unit, "left_anti"), "unit_disjoint"


def select_assigned(grid: DataFrame, assignment: DataFrame, unit: str = "series_id", value: str = "alpha") -> DataFrame:
    """Grid rows at the assigned value of each unit; raises when a unit has none."""
    chosen = grid.join(assignment.select(unit, value), [unit, value])
    if not assignment.select(unit).join(chosen, unit, "left_anti").isEmpty():
        raise ValueError("an assignment has no grid row")
    return chosen


def complete_grid(units: DataFrame, column: str, values: Column, outcomes: DataFrame, keys: Sequence[str], fill: Mapping[str, int]) -> DataFrame:
    """Units x values (a short literal array) with their outcomes, missing ones filled."""
    full = units.withColumn(column, F.explode(values))
    return full.join(outcomes, list(keys), "left").fillna(dict(fill))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids present in both sets; an empty answer means no leakage."""
    return a.select(key).intersect(b.select(key))
