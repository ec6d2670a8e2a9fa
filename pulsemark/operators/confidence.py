"""Decoder confidence: coverage, reliability bins, word categories, positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsemark.functions.dims import ratio, tally
from pulsemark.functions.ranks import exact_quantiles, value_prefix
from pulsemark.operators import coding as C
from pulsemark.operators.ranking import EDGE_DIGITS, equal_count_bins, quantile_edges, with_edges
from pulsemark.session import settle


def coverage_curve(bits: DataFrame, development: DataFrame, fractions: Sequence[float], side: str = "side") -> DataFrame:
    """Retained share and error rate when bits at or below a frozen development quantile are erased."""
    names = {f"f{i}": f for i, f in enumerate(fractions)}
    edges = exact_quantiles(development, [], "abs_correlation", names)
    arr = F.array(*[F.struct(F.lit(f).alias("fraction"), F.round(F.col(n), EDGE_DIGITS).alias("threshold")) for n, f in names.items()])
    at = with_edges(bits.select(side, "is_error", "abs_correlation"), edges.select(arr.alias("edges")))
    each = at.withColumn("_e", F.explode("edges"))
    gone = (F.col("_e.fraction") > 0) & (F.col("abs_correlation") <= F.col("_e.threshold"))
    bad = F.col("is_error") == 1
    return each.groupBy(side, F.col("_e.fraction").alias("fraction"), F.col("_e.threshold").alias("threshold")).agg(
        tally(~gone).alias("retained_bits"),
        ratio(tally(~gone), F.count(F.lit(1))).alias("retained_share"),
        tally(~gone & bad).alias("retained_errors"),
        ratio(tally(~gone & bad), tally(~gone)).alias("retained_error_rate"),
        tally(gone & bad).alias("erased_errors"),
        ratio(tally(gone & bad), tally(bad)).alias("captured_share"),
    )


def _bin_summary(binned: DataFrame, keys: Sequence[str], factor: str | None = None) -> DataFrame:
    out = binned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bits"),
        F.sum("is_error").cast("long").alias("errors"),
        F.avg(F.col("is_error").cast("double")).alias("error_rate"),
        F.avg("abs_correlation").alias("mean_abs_correlation"),
        F.min("abs_correlation").alias("min_abs_correlation"),
        F.max("abs_correlation").alias("max_abs_correlation"),
    )
    if factor is None:
        return out
    counts = binned.groupBy(*keys, factor).agg(F.count(F.lit(1)).alias("_n"))
    entry = F.struct(F.col(factor).cast("string").alias("k"), F.col("_n").alias("v"))
    # one entry per distinct factor value (the strengths of a policy)
    maps = counts.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("factor_counts"))
    return out.join(maps, list(keys))


def reliability_bins(bits: DataFrame, development: DataFrame, bins: int = 10, factor: str | None = None, carriers: str | None = None) -> DataFrame:
    """Error rate per side and development-quantile confidence bin, with the bin's thresholds; empty bins are rows, too.

    Adds the median confidence and, with ``carriers``, the mean number of valid carriers.
    """
    edges = settle(quantile_edges(development, "abs_correlation", bins))  # one row, used twice
    inner = F.slice("edges", 2, bins - 1)
    place = F.size(F.filter(inner, lambda e: e <= F.col("abs_correlation"))).cast("long")
    needed = ["side", "is_error", "abs_correlation", *(c for c in (factor, carriers) if c is not None)]
    binned = settle(with_edges(bits.select(*dict.fromkeys(needed)), edges).withColumn("bin", place).drop("edges"))  # read by every summary
    keys = ["side", "bin"]
    out = _bin_summary(binned, keys, factor)
    out = out.join(exact_quantiles(binned, keys, "abs_correlation", {"median_abs_correlation": 0.5}), keys)
    if carriers is not None:
        out = out.join(binned.groupBy(*keys).agg(F.avg(carriers).alias("mean_valid_carriers")), keys)
    cells = with_edges(binned.select("side").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))), edges)
    cells = cells.select(
        "side",
        F.col("bin").cast("long").alias("bin"),
        F.element_at("edges", F.col("bin") + 1).alias("threshold_low"),
        F.element_at("edges", F.col("bin") + 2).alias("threshold_high"),
    )
    return cells.join(out, keys, "left").fillna(0, ["bits", "errors"])


def rank_bins(bits: DataFrame, order: Sequence[str], bins: int = 10) -> DataFrame:
    """Error rate per equal-frequency confidence bin."""
    return _bin_summary(equal_count_bins(bits, order, bins, "bin"), ["bin"])


def _middle(before: str, count: str, total: str, p: float) -> tuple:
    """Aggregates (low, high, share) that interpolate the quantile ``p`` of a histogram with the given counters."""
    at = (F.col(total) - 1) * F.lit(p)
    inside = lambda k: (F.col(before) <= k) & (k < F.col(before) + F.col(count))
    value = F.col("abs_correlation")
    return F.max(F.when(inside(F.floor(at)), value)), F.max(F.when(inside(F.ceil(at)), value)), F.max(at - F.floor(at))


def key_confidence(bits: DataFrame, key: str) -> DataFrame:
    """Per key: median confidence of right and wrong bits, low-confidence AUC, error rate of the lowest decile.

    One histogram of confidences with right and wrong counts answers everything; the bits are read once.
    """
    one = F.lit(1)
    counts = {"n": one, "r": F.when(F.col("is_error") == 0, 1).otherwise(0), "w": F.when(F.col("is_error") == 1, 1).otherwise(0)}
    hist = settle(value_prefix(bits, [key], "abs_correlation", counts))
    picks = {}
    for name, c, p in (("median_correct", "r", 0.5), ("median_error", "w", 0.5), ("_d", "n", 0.1)):
        for part, column in zip(("lo", "hi", "t"), _middle(f"{c}_before", c, f"{c}_total", p)):
            picks[f"{name}_{part}"] = column
    # a wrong bit ranks above a right one where its confidence is lower
    wins = F.sum(F.col("w").cast("double") * (F.col("r_total") - F.col("r_before") - F.col("r") + F.col("r") / 2))
    per = hist.groupBy(key).agg(
        F.sum("w").cast("long").alias("n_pos"),
        F.sum("r").cast("long").alias("n_neg"),
        F.try_divide(wins, F.sum("w").cast("double") * F.sum("r")).alias("low_confidence_auc"),
        *[column.alias(name) for name, column in picks.items()],
    )
    value = lambda n: (F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_t")).cast("double")
    per = settle(per.select(key, "n_pos", "n_neg", "low_confidence_auc", *[value(n).alias(n) for n in ("median_correct", "median_error", "_d")]))
    low = hist.join(per.select(key, "_d"), key).where(F.col("abs_correlation") <= F.round("_d", EDGE_DIGITS)).groupBy(key)
    share = low.agg((F.sum("w") / F.sum("n")).alias("lowest_decile_error_rate"))
    return per.drop("_d").join(share, key, "left")


def codeword_details(words: DataFrame) -> DataFrame:
    """Per word: raw and decoded errors, category, ranks of the wrong bits.

    ``words`` has sent, word, info, decoded_info, status, weights.
    """
    wrong_word = F.col("decoded_info") != F.col("info")
    category = (
        F.when(wrong_word & (F.col("status") != C.DETECTED), "silent_miscorrected")
        .when(F.col("status") == C.CLEAN, "correct_clean")
        .when(F.col("status") == C.CORRECTED, "correct_repaired")
        .otherwise("detected_rejected")
    )
    flips = F.col("sent").bitwiseXOR(F.col("word"))
    wrong = [F.when(F.getbit(flips, F.lit(p)) == 1, C.weak_rank(F.col("weights"), p)) for p in range(8)]
    return words.withColumn("category", category).withColumn("raw_errors", F.bit_count(flips)).withColumn(
        "wrong_ranks", F.array_compact(F.array(*wrong))
    )


def codeword_summary(details: DataFrame, keys: Sequence[str]) -> DataFrame:
    return details.groupBy(*keys, "category").agg(
        F.count(F.lit(1)).alias("words"),
        F.sum("raw_errors").cast("long").alias("raw_errors"),
        F.avg(F.col("weights")[0].cast("double")).alias("mean_first_confidence"),
        F.avg(F.array_min("weights").cast("double")).alias("mean_lowest_confidence"),
    )


def miscorrection_ranks(details: DataFrame) -> DataFrame:
    """Confidence ranks of the wrong bits in silently miscorrected words, by raw error count."""
    silent = details.where(F.col("category") == "silent_miscorrected")
    ranks = silent.select("raw_errors", F.explode("wrong_ranks").alias("r"))
    per = ranks.groupBy("raw_errors").agg(
        F.count(F.lit(1)).alias("wrong_bits"), tally(F.col("r") == 0).alias("lowest_count"), F.avg("r").alias("mean_rank")
    )
    return silent.groupBy("raw_errors").agg(F.count(F.lit(1)).alias("words")).join(per, "raw_errors", "left")


def bit_value_asymmetry(bits: DataFrame, value: str = "true_bit") -> DataFrame:
    return bits.groupBy(value).agg(
        F.count(F.lit(1)).alias("bits"),
        F.sum("is_error").cast("long").alias("errors"),
        F.avg(F.col("is_error").cast("double")).alias("error_rate"),
    )


def host_projection(correlated: DataFrame, bit: str) -> DataFrame:
    """Clean host correlation signed by the bit it has to carry: mean, spread and share against the bit."""
    p = F.col(bit) * F.col("correlation")
    return correlated.groupBy(bit).agg(
        F.count(F.lit(1)).alias("bits"), F.avg(p).alias("mean"), F.stddev_pop(p).alias("sd"), F.avg((p < 0).cast("double")).alias("share_against")
    )


def position_errors(words: DataFrame, family: str) -> DataFrame:
    """Error rate by word position, for all families together and for each (grouping sets)."""
    flips = F.col("sent").bitwiseXOR(F.col("word"))
    at = words.select(family, F.posexplode(C.bits_of(flips)).alias("position", "is_error"))
    out = at.groupingSets([[F.col("position")], [F.col("position"), F.col(family)]], F.col("position"), F.col(family)).agg(
        F.grouping(family).alias("_g"), F.count(F.lit(1)).alias("bits"), F.sum("is_error").cast("long").alias("errors"),
        F.avg(F.col("is_error").cast("double")).alias("error_rate"),
    )
    return out.withColumn(family, F.when(F.col("_g") == 1, "ALL").otherwise(F.col(family))).drop("_g")


def corrected_ranks(details: DataFrame) -> DataFrame:
    """Rank of the corrected bit by category: count, mean, median, and a map rank -> words.  Ranks are 0..7."""
    ranks = C.weak_ranks(F.col("weights"))
    at = details.where(F.col("position").isNotNull()).select(
        "category", F.element_at(ranks, F.col("position") + 1).cast("int").alias("rank")
    )
    counts = at.groupBy("category", "rank").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct(F.col("rank").cast("string").alias("k"), F.col("n").alias("v"))
    maps = counts.groupBy("category").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("rank_counts"))
    stats = at.groupBy("category").agg(F.count(F.lit(1)).alias("words"), F.avg("rank").alias("mean_rank"), F.percentile("rank", F.lit(0.5)).alias("median_rank"))
    return stats.join(maps, "category")
