"""Experiment summaries: ratio-of-sums tables, transitions, coverage curves, selections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsemark.functions.dims import attach, ratio, share, tally
from pulsemark.functions.ranks import exact_quantiles
from pulsemark.operators.scoring import correlation, spearman


def error_summary(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted error rate with per-row mean/median, shares at 0 and below 5 %, and drop sums.

    ``results`` has bits, errors, dropped.
    """
    rows = results.withColumn("_rate", ratio(F.col("errors"), F.col("bits")))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("experiments"),
        F.sum("bits").alias("total_bits"),
        F.sum("errors").alias("bit_errors"),
        ratio(F.sum("errors"), F.sum("bits")).alias("error_rate"),
        F.avg("_rate").alias("mean_rate"),
        share(F.col("_rate") == 0).alias("zero_share"),
        share(F.col("_rate") < 0.05).alias("under_5pct_share"),
        F.sum("dropped").alias("total_dropped"),
    )
    return out.join(exact_quantiles(rows, keys, "_rate", {"median_rate": 0.5}), list(keys))


def trade_off(summary: DataFrame, auc: DataFrame, keys: Sequence[str], n: Column) -> DataFrame:
    """Error summary with detector AUC and the capacity multiplier 16/n."""
    return summary.join(auc, list(keys)).withColumn("capacity_multiplier", F.lit(16.0) / n)


def status_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def group_summary(df: DataFrame, keys: Sequence[str], metric: str, map_column: str) -> DataFrame:
    """Size, distinct maps, mean, median, min and max of a metric."""
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("series"),
        F.count_distinct(map_column).alias("maps"),
        F.avg(metric).alias("mean"),
        F.min(metric).alias("min"),
        F.max(metric).alias("max"),
    )
    return out.join(exact_quantiles(df, keys, metric, {"median": 0.5}), list(keys))


def scoped_rates(bits: DataFrame, scopes: Mapping[str, str]) -> DataFrame:
    """Error rate overall and per value of each scope column, stacked (grouping sets)."""
    cols = list(scopes.values())
    sets = [[]] + [[F.col(c)] for c in cols]
    out = bits.groupingSets(sets, *[F.col(c) for c in cols]).agg(
        F.grouping_id().alias("_g"),
        F.count(F.lit(1)).alias("total_bits"),
        F.sum("is_error").cast("long").alias("bit_errors"),
        F.avg(F.col("is_error").cast("double")).alias("error_rate"),
    )
    full = (1 << len(cols)) - 1
    scope, value = F.when(F.col("_g") == full, "overall"), F.when(F.col("_g") == full, "all")
    for i, (name, c) in enumerate(scopes.items()):
        mine = full & ~(1 << (len(cols) - 1 - i))
        scope = scope.when(F.col("_g") == mine, name)
        value = value.when(F.col("_g") == mine, F.col(c).cast("string"))
    return out.select(scope.alias("scope"), value.alias("group_value"), "total_bits", "bit_errors", "error_rate")


def with_all(df: DataFrame, key: str, aggs: Sequence[Column], label: str = "ALL") -> DataFrame:
    """One row per key value plus one for everything (rollup)."""
    out = df.rollup(key).agg(F.grouping(key).alias("_g"), *aggs)
    return out.withColumn(key, F.when(F.col("_g") == 1, label).otherwise(F.col(key).cast("string"))).drop("_g")


def outcome_summary(messages: DataFrame, keys: Sequence[str], decision: str) -> DataFrame:
    """Counts and rates of raw errors, decoded errors and accept/reject outcomes."""
    correct, wrong = F.col(decision) == "CORRECT_ACCEPT", F.col(decision) == "WRONG_ACCEPT"
    return messages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("configs"),
        F.sum("raw_bit_errors").alias("raw_bit_errors"),
        F.sum("coded_bits").alias("coded_bits"),
        ratio(F.sum("raw_bit_errors"), F.sum("coded_bits")).alias("raw_error_rate"),
        F.sum("post_bit_errors").alias("post_bit_errors"),
        F.sum("useful_bits").alias("useful_bits"),
        ratio(F.sum("post_bit_errors"), F.sum("useful_bits")).alias("post_error_rate"),
        tally(correct).alias("correct_accept"),
        tally(wrong).alias("wrong_accept"),
        tally(F.col(decision) == "REJECT").alias("reject"),
        share(F.col("post_bit_errors") == 0).alias("full_recovery_rate"),
        ratio(tally(correct), tally(correct | wrong)).alias("accepted_accuracy"),
    )


def two_level(df: DataFrame, inner: Sequence[str], outer: Sequence[str], numerator: str, denominator: str) -> DataFrame:
    """Ratio per inner unit, then mean, median, range and sample SD per outer key."""
    per = df.groupBy(*outer, *inner).agg(ratio(F.sum(numerator), F.sum(denominator)).alias("_r"))
    out = per.groupBy(*outer).agg(
        F.count("_r").alias("units"),
        F.avg("_r").alias("mean"),
        F.min("_r").alias("min"),
        F.max("_r").alias("max"),
        F.stddev_samp("_r").alias("sd"),
    )
    return out.join(exact_quantiles(per, outer, "_r", {"median": 0.5}), list(outer))


def rate_where_enough(df: DataFrame, keys: Sequence[str], unit: str, minimum: int) -> DataFrame:
    """Weighted error rate of groups with at least ``minimum`` distinct units."""
    return (
        df.groupBy(*keys)
        .agg(F.count_distinct(unit).alias("units"), ratio(F.sum("errors"), F.sum("bits")).alias("error_rate"))
        .where(F.col("units") >= minimum)
    )


def metric_distribution(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean, sample SD, extremes and quantiles of several metric columns, one row per metric."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])
    long = df.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*")
    by = [*keys, "metric"]
    out = long.groupBy(*by).agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    probs = {"q10": 0.1, "q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9}
    return out.join(exact_quantiles(long, by, "v", probs), by)


def factor_rates(bits: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Error rate and mean confidence for every value of several factors, stacked."""
    entries = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("factor_value")) for f in factors])
    long = bits.select("is_error", "abs_correlation", F.explode(entries).alias("_e")).select("is_error", "abs_correlation", "_e.*")
    return long.groupBy("factor", "factor_value").agg(
        F.count(F.lit(1)).alias("bits"),
        F.sum("is_error").cast("long").alias("errors"),
        F.avg(F.col("is_error").cast("double")).alias("error_rate"),
        F.avg("abs_correlation").alias("mean_abs_correlation"),
    )


def transitions(df: DataFrame, before: str, after: str, labels: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Count of every before -> after cell, empty cells included."""
    arr = F.array(*[F.lit(x) for x in labels])
    counts = df.groupBy(*keys, before, after).agg(F.count(F.lit(1)).alias("n"))
    base = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    grid = base.withColumn(before, F.explode(arr)).withColumn(after, F.explode(arr))
    return grid.join(counts, [*keys, before, after], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def pair_outcomes(df: DataFrame, keys: Sequence[str], first: Column, second: Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        tally(first & second).alias("both"),
        tally(first & ~second).alias("only_first"),
        tally(~first & second).alias("only_second"),
        tally(~first & ~second).alias("neither"),
    )


def condition_delta(df: DataFrame, keys: Sequence[str], condition: str, low: str, high: str) -> DataFrame:
    """Weighted error rate of two conditions side by side and their difference."""
    def rate(c: str) -> Column:
        at = F.col(condition) == c
        return ratio(F.sum(F.when(at, F.col("errors"))), F.sum(F.when(at, F.col("bits"))))

    return df.groupBy(*keys).agg(
        rate(low).alias("rate_low"), rate(high).alias("rate_high"), (rate(high) - rate(low)).alias("delta")
    )


def capture_rates(df: DataFrame, keys: Sequence[str], base: str, strict: str) -> DataFrame:
    """How many wrong accepts the stricter layer catches and how many right ones it costs."""
    wrong, right = F.col(base) == "WRONG_ACCEPT", F.col(base) == "CORRECT_ACCEPT"
    caught = F.col(strict) == "REJECT"
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("configs"),
        tally(wrong).alias("base_wrong"),
        tally(wrong & caught).alias("captured"),
        ratio(tally(wrong & caught), tally(wrong)).alias("capture_rate"),
        tally(right).alias("base_correct"),
        tally(right & caught).alias("extra_rejects"),
        ratio(tally(right & caught), tally(right)).alias("false_reject_rate"),
        ratio(tally(right & caught), tally(wrong & caught)).alias("rejects_per_capture"),
    )


def coverage_curve(series: DataFrame, caps: Sequence[tuple[int, int]], word_bits: int = 8, useful: int = 4) -> DataFrame:
    """Eligibility and word counts at each rational payload cap.

    ``series`` has map_id and capacity; the smallest fraction that carries a word is word_bits/capacity.
    """
    entries = F.array(*[F.struct(F.lit(n).alias("cap_num"), F.lit(d).alias("cap_den")) for n, d in caps])
    at = series.select("map_id", "capacity", F.explode(entries).alias("_e")).select("map_id", "capacity", "_e.*")
    c = F.col("capacity")
    allocated = F.when(c == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(c * F.col("cap_num") / F.col("cap_den"))))
    words = F.floor(allocated / word_bits)
    fits = words >= 1
    at = at.withColumn("_words", words.cast("long")).withColumn("_need", F.when(fits, F.lit(float(word_bits)) / c))
    by = ["cap_num", "cap_den"]
    out = at.groupBy(*by).agg(
        F.count(F.lit(1)).alias("series"),
        tally(F.col("_words") >= 1).alias("eligible"),
        share(F.col("_words") >= 1).alias("eligible_share"),
        F.count_distinct("map_id").alias("maps"),
        F.count_distinct(F.when(F.col("_words") >= 1, F.col("map_id"))).alias("eligible_maps"),
        F.avg(F.col("_words") * useful).alias("mean_useful_bits"),
        F.min("_need").alias("need_min"),
    )
    out = out.join(exact_quantiles(at, by, "_words", {"median_words": 0.5}), by)
    return out.join(exact_quantiles(at, by, "_need", {"need_median": 0.5, "need_p90": 0.9}), by, "left")


def policy_decisions(series: DataFrame, caps: Sequence[tuple[str, int, int]], word_bits: int = 8) -> DataFrame:
    """Per series and policy: unchanged, exact one-word floor, or abstention.

    ``series`` has series_id, capacity, allocated.  8/capacity <= cap is compared in integers.
    """
    entries = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(n).alias("n"), F.lit(d).alias("d")) for p, n, d in caps])
    at = series.select("*", F.explode(entries).alias("_e")).select("series_id", "capacity", "allocated", "_e.*")
    floor_ok = (F.col("capacity") >= word_bits) & (F.lit(word_bits) * F.col("d") <= F.col("capacity") * F.col("n"))
    base = F.col("allocated") >= word_bits
    decision = F.when(base, "unchanged").when(floor_ok, "one_word_floor").otherwise("abstain")
    bits = F.when(base, F.col("allocated")).when(floor_ok, word_bits).otherwise(0).cast("long")
    return at.select("series_id", "policy", decision.alias("decision"), bits.alias("requested_bits"), F.floor(bits / word_bits).alias("words"))


def stratum_totals(counts: DataFrame, rates: DataFrame, stratum: str, metrics: Sequence[str]) -> DataFrame:
    """Sum over strata of count x rate; raises when a stratum has no rate."""
    if not counts.join(rates, stratum, "left_anti").isEmpty():
        raise ValueError("a stratum has no rate")
    at = counts.join(rates, stratum)
    return at.agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(m)).alias(m) for m in metrics])


def selection_variation(choices: DataFrame, scopes: Mapping[str, Sequence[str]], choice: str) -> DataFrame:
    """Distinct choices per group of each scope: mean, and share of groups with more than one."""
    out = None
    for name, keys in scopes.items():
        per = choices.groupBy(*keys).agg(F.count_distinct(choice).alias("_d"))
        row = per.groupBy("k").agg(
            F.count(F.lit(1)).alias("groups"), share(F.col("_d") > 1).alias("share_multiple"), F.avg("_d").alias("mean_distinct")
        ).withColumn("comparison", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def side_information(messages: DataFrame, k: str = "k") -> DataFrame:
    """Bits needed to name one of k candidates, against the useful bits."""
    side = F.ceil(F.log2(F.col(k))).cast("long")
    return messages.groupBy(k).agg(
        F.max(side).alias("side_bits"),
        F.count(F.lit(1)).alias("messages"),
        F.sum("useful_bits").alias("useful_bits"),
        ratio(F.max(side) * F.count(F.lit(1)), F.sum("useful_bits")).alias("side_share"),
    )


def design_oracle(candidates: DataFrame, unit: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """Error rate per k of the first candidate, the predicted best and the actual best among the first k.

    All three choices are minima of a struct: one map-side combined aggregate per unit and k.
    """
    each = candidates.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("candidate_order") < F.col("k"))
    payload = F.struct("errors", "bits")
    predicted = F.struct("nonpositive_count", -F.col("minimum_margin"), -F.col("mean_margin"), "candidate_order")
    actual = F.struct(ratio(F.col("errors"), F.col("bits")), "candidate_order")
    per = each.groupBy(*unit, "k").agg(
        F.min_by(payload, F.col("candidate_order")).alias("b"),
        F.min_by(payload, predicted).alias("s"),
        F.min_by(payload, actual).alias("o"),
    )
    rate = lambda p: ratio(F.sum(f"{p}.errors"), F.sum(f"{p}.bits"))
    return per.groupBy("k").agg(rate("b").alias("baseline"), rate("s").alias("selector"), rate("o").alias("oracle"))


def blind_summary(decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``decisions`` has decision, correct (accepted and right), accepted_hypotheses."""
    taken = F.col("decision") == "accepted"
    return decisions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("configs"),
        tally(taken & F.col("correct")).alias("correct_accept"),
        tally(taken & ~F.col("correct")).alias("wrong_accept"),
        tally(~taken).alias("reject"),
        tally(F.col("decision") == "ambiguous_messages").alias("ambiguous_reject"),
        tally(F.col("decision") == "no_accepted_hypothesis").alias("zero_candidate_reject"),
        F.avg("accepted_hypotheses").alias("mean_accepted_hypotheses"),
        ratio(tally(taken & F.col("correct")), tally(taken)).alias("accepted_accuracy"),
    )


def wrong_hypotheses(hypotheses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hypotheses other than the selected one: passes, and passes with the same or another message."""
    wrong = hypotheses.where(~F.col("selected"))
    return wrong.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("wrong_hypotheses"),
        tally(F.col("accepted")).alias("passed"),
        tally(F.col("accepted") & F.col("matches")).alias("same_message"),
        tally(F.col("accepted") & ~F.col("matches")).alias("different_message"),
    )


def means_by_key(df: DataFrame, key: str, layout: str, metrics: Sequence[str]) -> DataFrame:
    """Metric means per key, and their sample SD across layouts."""
    per = df.groupBy(key, layout).agg(*[F.avg(m).alias(m) for m in metrics])
    aggs = [F.avg(m).alias(m + "_mean") for m in metrics] + [F.stddev_samp(m).alias(m + "_layout_sd") for m in metrics]
    return per.groupBy(key).agg(*aggs)


def class_contrast(df: DataFrame, kind: str, structured: Sequence[str], within: Sequence[str], payload: str) -> DataFrame:
    """Rows, errors, bits and weighted error rate of structured and other payload classes.

    Equal payloads of one class under the same ``within`` (series, layout) count once: the first by ``kind``.
    """
    classed = df.withColumn("payload_class", F.when(F.col(kind).isin(*structured), "structured").otherwise("random"))
    first = F.min(F.struct(kind, "errors", "bits")).alias("_r")
    once = classed.groupBy("payload_class", *within, payload).agg(first)
    return once.groupBy("payload_class").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("_r.errors").alias("errors"),
        F.sum("_r.bits").alias("bits"),
        ratio(F.sum("_r.errors"), F.sum("_r.bits")).alias("error_rate"),
    )


def payload_symmetry(
    payloads: DataFrame, measures: DataFrame, family: str, unit: str, payload: str, width: int, a: str, b: str, rate: tuple[str, str], means: Sequence[str]
) -> DataFrame:
    """One row comparing two inverted families, b minus a.

    ``payloads`` holds one word of ``width`` bits per (family, unit); units with both families give the weighted and
    the mean Hamming fraction. ``measures`` gives the difference of the error rates (sum / sum of the columns
    ``rate``) and of the mean of every column in ``means``.
    """
    word = lambda f: F.max(F.when(F.col(family) == f, F.col(payload)))
    both = payloads.groupBy(unit).agg(word(a).alias("_a"), word(b).alias("_b")).where("_a is not null and _b is not null")
    far = F.bit_count(F.col("_a").bitwiseXOR(F.col("_b")))
    distance = both.agg(
        F.count(F.lit(1)).alias("units"),
        F.try_divide(F.sum(far), F.count(F.lit(1)) * width).alias("hamming_fraction_weighted"),
        F.avg(far / width).alias("hamming_fraction_mean"),
    )
    of = lambda f, c: F.when(F.col(family) == f, F.col(c))
    gaps = [(ratio(F.sum(of(b, rate[0])), F.sum(of(b, rate[1]))) - ratio(F.sum(of(a, rate[0])), F.sum(of(a, rate[1])))).alias("error_rate_difference")]
    gaps += [(F.avg(of(b, c)) - F.avg(of(a, c))).alias(f"mean_{c}_difference") for c in means]
    return attach(distance, measures.agg(*gaps))


def design_audit(df: DataFrame, unit: str, order: str, value: str, ks: Sequence[int]) -> DataFrame:
    """Means over the first k layouts against all layouts: Pearson, Spearman, mean and max |difference|, SD."""
    whole = df.groupBy(unit).agg(F.avg(value).alias("_all"))
    each = df.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col(order) < F.col("k"))
    part = each.groupBy("k", unit).agg(F.round(F.avg(value), 9).alias("_part"))
    at = part.join(whole.withColumn("_all", F.round("_all", 9)), unit)
    gap = F.abs(F.col("_part") - F.col("_all"))
    out = at.groupBy("k").agg(
        F.count(F.lit(1)).alias("units"),
        correlation(F.col("_part"), F.col("_all")).alias("pearson"),
        F.avg(gap).alias("mean_abs_gap"),
        F.max(gap).alias("max_abs_gap"),
        F.stddev_samp("_part").alias("sd"),
    )
    return out.join(spearman(at, "_part", "_all", ["k"]).drop("rows"), "k")


def seed_collisions(df: DataFrame, seed: str) -> DataFrame:
    return df.groupBy(seed).agg(F.count(F.lit(1)).alias("holders")).where(F.col("holders") > 1)


def birthday_bound(n: int, space: int) -> float:
    """Approximate chance of any collision among n draws."""
    import math

    return 1.0 - math.exp(-n * (n - 1) / (2.0 * space))


