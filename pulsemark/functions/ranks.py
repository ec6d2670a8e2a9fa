"""Exact ranks, quantiles and rank-based AUC through value histograms.

Every operator first combines equal values (map-side), then takes prefix sums
over the sorted distinct values with ``with_order``; no group is gathered in one
task and no global unpartitioned window is used.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsemark.functions.ordered import hot_keys, with_order


def value_prefix(
    df: DataFrame, keys: Sequence[str], value: str, weights: Mapping[str, Column], hot: DataFrame | None | str = "auto"
) -> DataFrame:
    """Histogram of ``value`` per key: summed weights ``w``, ``w_before`` (strictly smaller values), ``w_total``.

    A key's rows bound its distinct values, so the cheap row count per key is looked at
    first; the distinct values themselves are counted only when some key has many rows.
    """
    rows = df.where(F.col(value).isNotNull())
    hist = rows.groupBy(*keys, value).agg(*[F.sum(e).alias(n) for n, e in weights.items()])
    if keys and isinstance(hot, str) and hot_keys(rows, keys) is None:
        hot = None
    return with_order(
        hist,
        keys,
        [value],
        prefix={n + "_before": F.col(n) for n in weights},
        total={n + "_total": F.col(n) for n in weights},
        hot=hot,
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    weight: Column | None = None,
    hot: DataFrame | None | str = "auto",
) -> DataFrame:
    """Linear-interpolation quantiles per key (NULLs skipped), one column per entry of ``probs``."""
    by = list(keys)
    placed = value_prefix(df, by, value, {"_n": F.lit(1) if weight is None else weight}, hot)
    lo = F.col("_n_before")
    hi = F.col("_n_before") + F.col("_n")
    picks, outs = [], []
    for name, p in probs.items():
        at = (F.col("_n_total") - 1) * F.lit(float(p))
        below, above = F.floor(at), F.ceil(at)
        picks.append(F.max(F.when((lo <= below) & (below < hi), F.col(value))).alias(name + "_lo"))
        picks.append(F.max(F.when((lo <= above) & (above < hi), F.col(value))).alias(name + "_hi"))
        picks.append(F.max(at - below).alias(name + "_t"))
        outs.append(
            (F.col(name + "_lo") + (F.col(name + "_hi") - F.col(name + "_lo")) * F.col(name + "_t"))
            .cast("double")
            .alias(name)
        )
    return placed.groupBy(*by).agg(*picks).select(*by, *outs)


def with_average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the 1-based average rank of ``value`` within ``keys`` (NULL values get NULL)."""
    ranks = value_prefix(df, keys, value, {"_n": F.lit(1)}).select(
        *keys, value, (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(name)
    )
    # rows without a value need no partner, and would all meet in one partition
    known, unknown = df.where(F.col(value).isNotNull()), df.where(F.col(value).isNull())
    ranked = known.join(ranks, [*keys, value]).select(*df.columns, name)
    return ranked.unionByName(unknown.withColumn(name, F.lit(None).cast("double")))


def rank_auc(
    df: DataFrame,
    keys: Sequence[str],
    score: str,
    label: str,
    weight: Column | None = None,
    name: str = "auc",
    hot: DataFrame | None | str = "auto",
) -> DataFrame:
    """Mann-Whitney AUC per key, ties counted half; NULL when a class is absent."""
    w = F.lit(1) if weight is None else weight
    positive = F.when(F.col(label) == 1, w).otherwise(0)
    negative = F.when(F.col(label) == 0, w).otherwise(0)
    runs = value_prefix(df, keys, score, {"_pos": positive, "_neg": negative}, hot)
    wins = F.sum(F.col("_pos").cast("double") * (F.col("_neg_before") + F.col("_neg") / 2))
    p, n = F.sum("_pos"), F.sum("_neg")
    return runs.groupBy(*keys).agg(
        p.cast("long").alias("n_pos"), n.cast("long").alias("n_neg"), F.try_divide(wins, p.cast("double") * n).alias(name)
    )
