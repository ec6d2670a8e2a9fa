"""Data-quality gates; each returns its violations, so an empty answer passes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsemark.operators.joins import duplicate_keys


def label_pairs(df: DataFrame, keys: Sequence[str], label: str, expected: Sequence[int] = (0, 1)) -> DataFrame:
    """Keys whose rows are not exactly one per expected label."""
    one_each = F.lit(True)
    for v in expected:
        one_each = one_each & (F.count(F.when(F.col(label) == v, 1)) == 1)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), one_each.alias("_ok")).where(
        ~F.col("_ok") | (F.col("rows") != len(expected))
    ).drop("_ok")


def missing_conditions(df: DataFrame, unit: Sequence[str], condition: str, expected: Sequence[str]) -> DataFrame:
    """Units that lack one of the expected conditions."""
    have = df.where(F.col(condition).isin(*expected)).groupBy(*unit).agg(F.count_distinct(condition).alias("conditions"))
    return have.where(F.col("conditions") < len(expected))


def unexpected_count(df: DataFrame, expected: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") != expected)


def not_finite(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows with a NULL, NaN or infinite value in a feature column."""
    bad = F.array_compact(
        F.array(
            *[
                F.when(F.col(c).isNull() | F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")), F.lit(c))
                for c in columns
            ]
        )
    )
    return df.select(*keys, bad.alias("columns")).where(F.size("columns") > 0)


def varying(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys over which a column that must be constant takes several values (min/max, map-side combined)."""
    aggs = []
    for c in columns:
        aggs += [F.min(c).alias("_lo_" + c), F.max(c).alias("_hi_" + c)]
    changed = F.array_compact(F.array(*[F.when(F.col("_lo_" + c) != F.col("_hi_" + c), F.lit(c)) for c in columns]))
    return df.groupBy(*keys).agg(*aggs).select(*keys, changed.alias("columns")).where(F.size("columns") > 0)


def totals_mismatch(
    parts: DataFrame, parent: DataFrame, keys: Sequence[str], sums: Mapping[str, str], tolerance: float = 1e-9
) -> DataFrame:
    """Keys whose part sums differ from the parent's column, or that one side lacks."""
    keys = list(keys)
    got = parts.groupBy(*keys).agg(*[F.sum(p).alias("_p_" + c) for c, p in sums.items()])
    both = parent.select(*keys, *sums).join(got, keys, "full")
    off = F.array_compact(
        F.array(*[F.when(~F.coalesce(F.abs(F.col(c) - F.col("_p_" + c)) <= tolerance, F.lit(False)), F.lit(c)) for c in sums])
    )
    return both.select(*keys, off.alias("columns")).where(F.size("columns") > 0)


def expression_violations(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break a rule, with the rule names (a NULL outcome counts as broken)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]))
    return df.select(*keys, broken.alias("rules")).where(F.size("rules") > 0)


def diagnostics(checks: Mapping[str, tuple[DataFrame, int]]) -> DataFrame:
    """(check, value, expected, ok) from one-row counts of violation tables."""
    out = None
    for name, (df, expected) in checks.items():
        row = df.agg(F.count(F.lit(1)).alias("value")).select(
            F.lit(name).alias("check"), "value", F.lit(expected).cast("long").alias("expected"), (F.col("value") == expected).alias("ok")
        )
        out = row if out is None else out.unionByName(row)
    return out


def drift(recomputed: DataFrame, stored: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float) -> DataFrame:
    """Rows whose recomputed values differ from the stored ones by more than ``tolerance``, or are missing on a side."""
    keys = list(keys)
    a = recomputed.select(*keys, *columns)
    b = stored.select(*keys, *[F.col(c).alias("_s_" + c) for c in columns])
    gaps = [F.abs(F.col(c) - F.col("_s_" + c)) for c in columns]
    worst = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull() | F.col("_s_" + c).isNull()
    return a.join(b, keys, "full").select(*keys, F.when(~missing, worst).alias("max_gap"), missing.alias("missing")).where(
        F.col("missing") | (F.col("max_gap") > tolerance)
    )


def dataset_gate(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Duplicate keys of a table whose columns must be exactly ``columns`` (raises otherwise)."""
    if df.columns != list(columns):
        raise ValueError(f"columns {df.columns} differ from {list(columns)}")
    return duplicate_keys(df, keys)
