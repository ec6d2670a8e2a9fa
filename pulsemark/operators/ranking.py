"""Ranks, percentiles, categories and bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsemark.functions.dims import attach, with_group_totals, with_totals
from pulsemark.functions.ordered import with_order, with_position
from pulsemark.functions.ranks import exact_quantiles, value_prefix, with_average_rank

# fixed values: category labels and their upper percentile bounds
CATEGORIES = (("Very Poor", 25.0), ("Poor", 50.0), ("Good", 75.0), ("Very Good", None))
INSUFFICIENT = "INSUFFICIENT_MAP_REPLAYS"
EDGE_DIGITS = 9  # interpolated edges are rounded so that a value equal to an edge compares equal


def group_percentile(df: DataFrame, group: str, value: str) -> DataFrame:
    """Add group_size and percentile: (average rank - 1)/(n - 1)*100, 50 for a single row."""
    ranked = with_average_rank(df, [group], value, "_r")
    sized = with_group_totals(ranked, [group], group_size=F.count(F.lit(1)))
    pct = F.when(F.col("group_size") <= 1, F.lit(50.0)).otherwise(
        F.try_divide(F.col("_r") - 1.0, F.col("group_size") - 1.0) * 100.0
    )
    return sized.withColumn("percentile", pct).drop("_r")


def category(percentile: Column) -> Column:
    out = None
    for name, bound in CATEGORIES:
        if bound is None:
            return out.otherwise(name)
        out = F.when(percentile < bound, name) if out is None else out.when(percentile < bound, name)
    raise AssertionError


def performance_groups(df: DataFrame, group: str, value: str, minimum: int) -> DataFrame:
    """Percentile and category where the group has at least ``minimum`` rows, else the insufficient label."""
    at = group_percentile(df, group, value)
    enough = F.col("group_size") >= minimum
    return at.withColumn("category", F.when(enough, category(F.col("percentile"))).otherwise(INSUFFICIENT)).withColumn(
        "percentile", F.when(enough, F.col("percentile"))
    )


def equal_count_bins(df: DataFrame, order: Sequence[str], bins: int, name: str) -> DataFrame:
    """Equal-frequency bin 0..bins-1 of the first-come rank (integer edges)."""
    placed = with_totals(with_position(df, [], order, "_rank"), _n=F.count(F.lit(1)))
    at = F.ceil(F.col("_rank") * bins / F.greatest(F.col("_n") - 1, F.lit(1))) - 1
    return placed.withColumn(name, F.greatest(F.lit(0), at).cast("long")).drop("_rank", "_n")


def quantile_edges(df: DataFrame, value: str, bins: int) -> DataFrame:
    """One row with the array of ``bins + 1`` exact quantile edges."""
    names = {f"e{i:03d}": i / bins for i in range(bins + 1)}
    edges = exact_quantiles(df, [], value, names)
    return edges.select(F.array(*[F.round(F.col(n), EDGE_DIGITS) for n in names]).alias("edges"))


def with_edges(df: DataFrame, edges: DataFrame) -> DataFrame:
    """Attach the one-row edges array."""
    return attach(df, edges)


def quantile_bins(df: DataFrame, value: str, bins: int, name: str) -> DataFrame:
    """Bins between the distinct quantile edges, right-closed, lowest value included."""
    at = with_edges(df, quantile_edges(df, value, bins))
    below = F.size(F.filter(F.array_distinct("edges"), lambda e: e < F.col(value)))
    return at.withColumn(name, F.greatest(F.lit(0), below - 1).cast("long")).drop("edges")


def fixed_bins(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed label: the first edge not below the value."""
    out = None
    for e, label in zip(edges, labels):
        out = F.when(value <= e, label) if out is None else out.when(value <= e, label)
    return out.otherwise(F.when(value.isNotNull(), labels[len(edges)]))


def reference_bins(df: DataFrame, reference: DataFrame, value: str, bins: int, name: str) -> DataFrame:
    """Bins by another set's quantile edges: the number of inner edges not above the value."""
    at = with_edges(df, quantile_edges(reference, value, bins))
    inner = F.slice("edges", 2, bins - 1)
    return at.withColumn(name, F.size(F.filter(inner, lambda e: e <= F.col(value))).cast("long"))


def median_normalised(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """value / group median, NULL where the median is 0."""
    medians = exact_quantiles(df, keys, value, {"_median": 0.5})
    return df.join(medians, list(keys)).withColumn(
        name, F.try_divide(F.col(value), F.nullif(F.col("_median"), F.lit(0.0)))
    ).drop("_median")


def distinct_per_group(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return with_group_totals(df, keys, **{name: F.count_distinct(value)})


def group_share(counts: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Share of a count in its group's total."""
    total = counts.groupBy(*keys).agg(F.sum(value).alias("_t"))
    return counts.join(total, list(keys)).withColumn(name, F.try_divide(F.col(value).cast("double"), F.col("_t"))).drop("_t")


def adjacent_errors(bits: DataFrame, config: str = "config_id", hot="auto") -> DataFrame:
    """Bits with the previous bit's error flag in the same configuration."""
    return with_order(bits, [config], ["bit_index"], prev={"prev_error": F.col("is_error")}, hot=hot)


def independence(bits: DataFrame, hot="auto") -> DataFrame:
    """One row: lag-1 Pearson of errors, observed and independent joint frequency, their ratio, pair count."""
    pairs = adjacent_errors(bits, hot=hot)
    a = F.when(F.col("prev_error").isNotNull(), F.col("prev_error"))
    b = F.when(F.col("prev_error").isNotNull(), F.col("is_error"))
    cov = F.avg(a * b) - F.avg(a) * F.avg(b)
    spread = F.sqrt((F.avg(a) - F.avg(a) * F.avg(a)) * (F.avg(b) - F.avg(b) * F.avg(b)))
    p = F.avg(F.col("is_error").cast("double"))
    seen = F.avg(a * b)
    return pairs.agg(
        F.count(F.lit(1)).alias("total_bits"),
        F.sum("is_error").alias("bit_errors"),
        p.alias("error_rate"),
        F.try_divide(cov, spread).alias("lag1_error_correlation"),
        seen.alias("observed_pair_frequency"),
        (p * p).alias("expected_pair_frequency"),
        F.try_divide(seen, p * p).alias("observed_to_expected"),
        F.count(a).alias("adjacent_pairs"),
    )


def conditional_independence(bits: DataFrame, hot="auto") -> DataFrame:
    """One row: observed adjacent error pairs against the series' own squared rates."""
    per = adjacent_errors(bits, hot=hot).groupBy("config_id").agg(
        F.count("prev_error").alias("_pairs"),
        F.sum(F.col("prev_error") * F.col("is_error")).alias("_both"),
        F.avg(F.col("is_error").cast("double")).alias("_rate"),
    )
    seen, expected = F.sum("_both"), F.sum(F.col("_pairs") * F.col("_rate") * F.col("_rate"))
    return per.agg(
        seen.alias("observed_pairs"),
        expected.alias("expected_pairs"),
        F.try_divide(seen.cast("double"), expected).alias("observed_to_expected"),
        F.sum("_pairs").alias("adjacent_pairs"),
    )


NEAR_TIE = 0.03  # median distances closer than this decide nothing


def score_percentiles(scores: DataFrame, first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """Percentile of each score in two reference sets, and which of the two it resembles.

    Inside both interquartile ranges is ambiguous, inside one resembles that set; outside both the nearer median is
    leant to, unless the distances differ by less than NEAR_TIE.  All three sides go into one value histogram, whose
    prefix sums answer every score at once.
    """
    sides = [scores.select(F.col(value).alias("_v"), F.lit(0).alias("_a"), F.lit(0).alias("_b"))]
    sides.append(first.select(F.col(value).alias("_v"), F.lit(1).alias("_a"), F.lit(0).alias("_b")))
    sides.append(second.select(F.col(value).alias("_v"), F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    runs = value_prefix(sides[0].unionByName(sides[1]).unionByName(sides[2]), [], "_v", {"_na": F.col("_a"), "_nb": F.col("_b")})
    at = runs.select(
        "_v",
        (100.0 * (F.col("_na_before") + F.col("_na")) / F.col("_na_total")).alias("first_percentile"),
        (100.0 * (F.col("_nb_before") + F.col("_nb")) / F.col("_nb_total")).alias("second_percentile"),
    )
    out = scores.select(key, F.col(value).alias("_v")).join(at, "_v")
    for name, side in (("first", first), ("second", second)):
        out = attach(out, exact_quantiles(side, [], value, {f"{name}_q25": 0.25, f"{name}_median": 0.5, f"{name}_q75": 0.75}))
    v = F.col("_v")
    inside = {n: (v >= F.col(f"{n}_q25")) & (v <= F.col(f"{n}_q75")) for n in ("first", "second")}
    away = {n: F.abs(v - F.col(f"{n}_median")) for n in ("first", "second")}
    verdict = (
        F.when(inside["first"] & inside["second"], "ambiguous")
        .when(inside["first"], "first_like")
        .when(inside["second"], "second_like")
        .when(F.abs(away["first"] - away["second"]) < NEAR_TIE, "atypical")
        .when(away["first"] < away["second"], "lean_first")
        .otherwise("lean_second")
    )
    quartiles = [f"{n}_{q}" for n in ("first", "second") for q in ("q25", "median", "q75")]
    return out.select(key, v.alias(value), "first_percentile", "second_percentile", *quartiles, verdict.alias("verdict"))


def position_of(df: DataFrame, key: str, value: str, chosen) -> DataFrame:
    """One key in a distribution: z score (sample SD), ascending rank, share of keys at or below."""
    at = attach(df, df.where(F.col(key) == chosen).agg(F.max(value).alias("_mine")))
    v, m = F.col(value), F.col("_mine")
    return at.agg(
        F.max(m).alias("value"),
        F.try_divide(F.max(m) - F.avg(v), F.stddev_samp(v)).alias("z"),
        (F.count(F.when(v < m, 1)) + 1).alias("ascending_rank"),
        F.avg((v <= m).cast("double")).alias("share_at_or_below"),
    )
