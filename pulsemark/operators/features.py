"""Gap-aware statistics and features of residual series.

Residuals are whole milliseconds inside a hit window, so a series has at most a
few hundred distinct values however long it is: the exact ``percentile``
aggregate keeps one counter per distinct value and combines map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsemark.functions.ordered import with_neighbours, with_order
from pulsemark.functions.ranks import exact_quantiles

SERIES = ["series_id"]
# fixed values: the feature names and their groups
LAGS = (1, 2, 4, 8)
QUARTERS = (1, 2, 3, 4)
QUANTILES = (10, 25, 50, 75, 90)
BASELINE = ("variance", "excess_kurtosis", "autocorrelation_lag1")
GLOBAL = ("skewness", "iqr", "mean_absolute_residual") + tuple(f"quantile_{q}" for q in QUANTILES)
TEMPORAL = (
    "autocorrelation_lag2",
    "autocorrelation_lag4",
    "autocorrelation_lag8",
    "mean_absolute_first_difference",
    "variance_first_difference",
    "sign_change_rate",
)
QUARTER_STATISTICS = ("variance", "autocorrelation_lag1", "mean_absolute_residual")
POSITION = tuple(f"quarter_{q}_{s}" for q in QUARTERS for s in QUARTER_STATISTICS)
FULL = BASELINE + GLOBAL + TEMPORAL + POSITION
FEATURE_SETS = {
    "baseline": BASELINE,
    "baseline_global": BASELINE + GLOBAL,
    "baseline_temporal": BASELINE + TEMPORAL,
    "baseline_position": BASELINE + POSITION,
    "full": FULL,
}


def quarter(index: Column, n: Column) -> Column:
    """Quarter 1..4 of a position when n positions are split as evenly as possible, longer parts first."""
    size = F.floor(n / 4)
    extra = n % 4
    head = extra * (size + 1)
    return (
        F.when(index < head, F.floor(index / (size + 1)))
        .otherwise(extra + F.floor((index - head) / F.greatest(size, F.lit(1))))
        .cast("int")
        + 1
    )


def residual_statistics(residuals: DataFrame, hot="auto") -> tuple[DataFrame, DataFrame]:
    """n, mean, population std, excess kurtosis and lag-1 autocorrelation of the matched values.

    Returns (statistics, rejects); a series with one value or no variance is rejected.
    """
    matched = residuals.where(F.col("residual").isNotNull()).select(*SERIES, "note_idx", F.col("residual").alias("x"))
    pairs = with_order(matched, SERIES, ["note_idx"], prev={"y": F.col("x")}, hot=hot)
    m = F.avg("x")
    squares = F.var_pop("x") * F.count("x")
    cross = F.sum(F.col("x") * F.col("y")) - m * F.sum(F.when(F.col("y").isNotNull(), F.col("x") + F.col("y"))) + m * m * F.count("y")
    stats = pairs.groupBy(*SERIES).agg(
        F.count("x").alias("n"),
        m.alias("mean"),
        F.stddev_pop("x").alias("std"),
        F.kurtosis("x").alias("excess_kurtosis"),
        F.try_divide(cross, F.when(F.var_pop("x") > 0, squares)).alias("autocorrelation_lag1"),
    )
    usable = (F.col("n") > 1) & (F.col("std") > 0)
    return stats.where(usable), stats.where(~usable).select(*SERIES, F.lit("zero_variance").alias("reason"))


def _autocorrelation(x: Column, y: Column, keep: Column | None = None) -> Column:
    """Lag autocorrelation over pairs that are both present, centred on all present values."""
    value = x if keep is None else F.when(keep, x)
    other = y if keep is None else F.when(keep, y)
    both = value.isNotNull() & other.isNotNull()
    m = F.avg(value)
    top = (
        F.sum(F.when(both, value * other))
        - m * F.sum(F.when(both, value + other))
        + m * m * F.count(F.when(both, value))
    )
    bottom = F.when(F.var_pop(value) > 0, F.var_pop(value) * F.count(value))
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def series_sizes(residuals: DataFrame) -> DataFrame:
    return residuals.groupBy(*SERIES).agg((F.max("note_idx") + 1).alias("num_notes"))


def series_features(residuals: DataFrame, keys: Sequence[str] = ("series_id",), wide_values: bool = False, sized: bool = False) -> DataFrame:
    """All 29 features, note counts and the valid fraction, one row per series.

    ``note_idx`` is dense and starts at 0; a missing match is a NULL residual in place.  Quantiles count distinct
    values per series in one buffer, which is small for whole milliseconds within a hit window; with ``wide_values``
    they come from sorted value histograms instead. ``sized`` rows already have ``num_notes``.
    """
    keys = list(keys)
    lagged = with_neighbours(
        residuals.select(*keys, "note_idx", F.col("residual").alias("x"), *(["num_notes"] if sized else [])),
        keys,
        "note_idx",
        {f"y{k}": ("x", k) for k in LAGS},
    )
    if not sized:
        lagged = lagged.join(residuals.groupBy(*keys).agg((F.max("note_idx") + 1).alias("num_notes")), keys)
    rows = lagged.withColumn("q", quarter(F.col("note_idx"), F.col("num_notes")))
    rows = rows.withColumn("same_q", quarter(F.col("note_idx") - 1, F.col("num_notes")) == F.col("q"))
    x, y1 = F.col("x"), F.col("y1")
    zero = F.lit(0.0)
    step = x - y1
    aggs = [
        F.coalesce(F.var_pop(x), zero).alias("variance"),
        F.coalesce(F.kurtosis(x), zero).alias("excess_kurtosis"),
        F.coalesce(F.skewness(x), zero).alias("skewness"),
        *([] if wide_values else [F.percentile(x, F.array(*[F.lit(q / 100) for q in QUANTILES])).alias("_q")]),
        F.coalesce(F.avg(F.abs(x)), zero).alias("mean_absolute_residual"),
        *[_autocorrelation(x, F.col(f"y{k}")).alias(f"autocorrelation_lag{k}") for k in LAGS],
        F.coalesce(F.avg(F.abs(step)), zero).alias("mean_absolute_first_difference"),
        F.coalesce(F.var_pop(step), zero).alias("variance_first_difference"),
        F.coalesce(F.avg(F.when((x * y1).isNotNull(), (x * y1 < 0).cast("double"))), zero).alias("sign_change_rate"),
        F.max("num_notes").alias("num_notes"),
        F.count(x).alias("n_valid_residuals"),
        (F.count(x) / F.count(F.lit(1))).alias("valid_residual_fraction"),
    ]
    for q in QUARTERS:
        inside = F.col("q") == q
        aggs += [
            F.coalesce(F.var_pop(F.when(inside, x)), zero).alias(f"quarter_{q}_variance"),
            _autocorrelation(x, F.when(F.col("same_q"), y1), inside).alias(f"quarter_{q}_autocorrelation_lag1"),
            F.coalesce(F.avg(F.when(inside, F.abs(x))), zero).alias(f"quarter_{q}_mean_absolute_residual"),
        ]
    wide = rows.groupBy(*keys).agg(*aggs)
    if wide_values:
        names = {f"_q{q}": q / 100 for q in QUANTILES}
        found = exact_quantiles(residuals.select(*keys, "residual"), keys, "residual", names)
        wide = wide.join(found.select(*keys, F.array(*names).alias("_q")), keys, "left")
    wide = wide.withColumn("iqr", F.coalesce(F.col("_q")[3] - F.col("_q")[1], zero))
    for i, q in enumerate(QUANTILES):
        wide = wide.withColumn(f"quantile_{q}", F.coalesce(F.col("_q")[i], zero))
    return wide.select(*keys, *FULL, "num_notes", "n_valid_residuals", "valid_residual_fraction")


def quarter_shifts(shifts: DataFrame, sizes: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Requested/active counts, energy and absolute shift per quarter, long form with energy share.

    ``shifts`` has note_idx, requested (0/1), shift_ms (0 where not applied).
    """
    keys = list(keys)
    at = shifts.join(sizes, keys).withColumn("quarter", quarter(F.col("note_idx"), F.col("num_notes")))
    active = F.col("shift_ms") != 0
    per = at.groupBy(*keys, "quarter").agg(
        F.sum("requested").cast("long").alias("requested_carriers"),
        F.sum(active.cast("int")).cast("long").alias("active_carriers"),
        F.sum((F.col("shift_ms") * F.col("shift_ms")).cast("double")).alias("sum_squared_shift_ms2"),
        F.sum(F.abs("shift_ms").cast("double")).alias("total_absolute_shift_ms"),
    )
    total = per.groupBy(*keys).agg(F.sum("sum_squared_shift_ms2").alias("_total"))
    share = F.coalesce(F.try_divide(F.col("sum_squared_shift_ms2"), F.col("_total")), F.lit(0.0))
    return per.join(total, keys).withColumn("energy_fraction", share).drop("_total")


def layout_coverage(placement: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Span fraction and number of occupied capacity quartiles of the selected blocks."""
    b, c = F.col("block_idx"), F.col("capacity")
    return placement.groupBy(*keys, "capacity").agg(
        ((F.max(b) - F.min(b) + 1) / F.max(c)).alias("span_fraction"),
        F.count_distinct(F.least(F.floor(4 * b / c), F.lit(3))).alias("occupied_quartiles"),
    )


def bit_error_rate(sent: DataFrame, received: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of differing bits per message; a bit present on one side only is reported."""
    keys = list(keys)
    both = sent.select(*keys, "bit_idx", F.col("bit").alias("_a")).join(
        received.select(*keys, "bit_idx", F.col("bit").alias("_b")), [*keys, "bit_idx"], "full"
    )
    return both.groupBy(*keys).agg(
        F.coalesce(F.avg((F.col("_a") != F.col("_b")).cast("double")), F.lit(0.0)).alias("bit_error_rate"),
        F.sum((F.col("_a").isNull() | F.col("_b").isNull()).cast("int")).cast("long").alias("unpaired_bits"),
    )


def runs(flags: DataFrame, keys: Sequence[str], index: str, flag: str, hot="auto") -> DataFrame:
    """Start and length of every run of consecutive set flags (gaps and islands)."""
    keys = list(keys)
    back = with_order(flags, keys, [index], prev={"_before": F.col(flag)}, hot=hot)
    begins = (F.col(flag) == 1) & (F.coalesce(F.col("_before"), F.lit(0)) != 1)
    marked = back.withColumn("_begin", begins.cast("int"))
    numbered = with_order(marked, keys, [index], prefix={"_run": F.col("_begin")}, hot=hot)
    numbered = numbered.withColumn("_run", F.col("_run") + F.col("_begin")).where(F.col(flag) == 1)
    return numbered.groupBy(*keys, "_run").agg(
        F.min(index).alias("start_index"), F.count(F.lit(1)).alias("run_length")
    ).drop("_run")


def chip_diagnostics(chips: DataFrame, key: str, block: int = 8, hot="auto") -> DataFrame:
    """Share of +1, run lengths, lag correlations and the spread of block means of chip sequences."""
    lagged = with_neighbours(chips, [key], "chip_idx", {f"y{k}": ("chip", k) for k in LAGS})
    c = F.col("chip")

    def pearson(y: Column) -> Column:
        x = F.when(y.isNotNull(), c)
        cov, vx, vy = F.covar_pop(x, y), F.var_pop(x), F.var_pop(y)
        return F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))

    whole = lagged.groupBy(key).agg(
        F.avg((c == 1).cast("double")).alias("fraction_positive"),
        *[pearson(F.col(f"y{k}")).alias(f"lag{k}_correlation") for k in LAGS],
    )
    sides = []
    for sign in (1, -1):
        flagged = chips.withColumn("_flag", (F.col("chip") == sign).cast("int"))
        sides.append(runs(flagged, [key], "chip_idx", "_flag", hot))
    lengths = sides[0].unionByName(sides[1]).groupBy(key).agg(
        F.avg("run_length").alias("mean_run_length"), F.max("run_length").alias("max_run_length")
    )
    means = chips.groupBy(key, F.floor(F.col("chip_idx") / block).alias("_b")).agg(
        F.avg((F.col("chip") == 1).cast("double")).alias("_m")
    )
    spread = means.groupBy(key).agg(F.stddev_pop("_m").alias("block_fraction_sd"))
    return whole.join(lengths, key).join(spread, key)


def energy_summary(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ratio-of-sums energy figures of applied shifts; zero where nothing was active."""
    active, requested = F.sum("active_carriers"), F.sum("requested_carriers")
    squared, absolute = F.sum("sum_squared_shift_ms2"), F.sum("total_absolute_shift_ms")

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    return results.groupBy(*keys).agg(
        F.count_distinct("series_id").alias("series"),
        requested.alias("requested_carriers"),
        active.alias("active_carriers"),
        ratio(active, requested).alias("active_carrier_fraction"),
        squared.cast("double").alias("sum_squared_shift_ms2"),
        F.avg("sum_squared_shift_ms2").alias("mean_sum_squared_per_series"),
        ratio(squared, active).alias("mean_squared_shift_ms2"),
        F.sqrt(ratio(squared, active)).alias("rms_applied_shift_ms"),
        absolute.cast("double").alias("total_absolute_shift_ms"),
        ratio(absolute, active).alias("mean_absolute_shift_ms"),
        F.sum("dropped_for_hit_window").alias("dropped_for_hit_window"),
        F.sum("new_unmatched_events").alias("new_unmatched_events"),
    )
