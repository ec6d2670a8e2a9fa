"""Rank-based detector scores: grouped AUC, influence, paired deltas, agreement, Spearman."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsemark.functions.dims import attach
from pulsemark.functions.ranks import rank_auc, value_prefix, with_average_rank
from pulsemark.session import settle


def group_auc(df: DataFrame, keys: Sequence[str], score: str, label: str, unit: str, minimum: int) -> DataFrame:
    """AUC per group that has at least ``minimum`` distinct units and both classes."""
    sizes = df.groupBy(*keys).agg(F.count_distinct(unit).alias("units")).where(F.col("units") >= minimum)
    auc = rank_auc(df, keys, score, label).where(F.col("auc").isNotNull())
    return auc.join(sizes, list(keys))


def predictor_auc(df: DataFrame, predictors: Sequence[tuple[str, Column]], label: str) -> DataFrame:
    """AUC of several columns against one flag, through one long table."""
    entries = F.array(*[F.struct(F.lit(n).alias("predictor"), c.cast("double").alias("score")) for n, c in predictors])
    long = df.select(F.col(label).alias("_label"), F.explode(entries).alias("_e")).select("_label", "_e.*")
    return rank_auc(long, ["predictor"], "score", "_label")


def influence(df: DataFrame, unit: str, score: str, label: str) -> DataFrame:
    """AUC without each unit, by subtracting the pairs it takes part in; no per-unit recomputation."""
    flags = {"_p": (F.col(label) == 1).cast("long"), "_q": (F.col(label) == 0).cast("long")}
    rows = df.select(unit, score, *[c.alias(n) for n, c in flags.items()])
    counts = {n: F.col(n) for n in flags}
    cells = rows.groupBy(unit, score).agg(F.sum("_p").alias("p"), F.sum("_q").alias("q"))
    everyone = value_prefix(rows, [], score, counts)
    totals = everyone.agg(
        F.sum("_p").alias("_np"),
        F.sum("_q").alias("_nq"),
        F.sum(F.col("_p") * (F.col("_q_before") + F.col("_q") / 2)).alias("_u"),
    )
    at = attach(cells.join(everyone, score), totals)
    touched = at.groupBy(unit).agg(
        F.sum("p").alias("p"),
        F.sum("q").alias("q"),
        F.sum(F.col("p") * (F.col("_q_before") + F.col("_q") / 2)).alias("as_pos"),
        F.sum(F.col("q") * (F.col("_np") - F.col("_p_before") - F.col("_p") / 2)).alias("as_neg"),
        F.max("_np").alias("_np"),
        F.max("_nq").alias("_nq"),
        F.max("_u").alias("_u"),
    )
    own = value_prefix(rows, [unit], score, counts).groupBy(unit).agg(
        F.sum(F.col("_p") * (F.col("_q_before") + F.col("_q") / 2)).alias("own")
    )
    left = F.col("_u") - F.col("as_pos") - F.col("as_neg") + F.col("own")
    without = F.try_divide(left.cast("double"), (F.col("_np") - F.col("p")) * (F.col("_nq") - F.col("q")))
    full = F.col("_u") / (F.col("_np") * F.col("_nq"))
    return touched.join(own, unit).select(unit, without.alias("auc_without"), (without - full).alias("delta"))


def paired_auc_delta(wide: DataFrame, label: str, first: str, second: str) -> DataFrame:
    """AUC of two score columns over the same rows and their difference."""
    long = predictor_auc(wide, [("first", F.col(first)), ("second", F.col(second))], label)
    pick = lambda n: F.max(F.when(F.col("predictor") == n, F.col("auc")))
    return long.agg(
        pick("first").alias("auc_first"), pick("second").alias("auc_second"), (pick("second") - pick("first")).alias("delta")
    )


def correlation(x: Column, y: Column) -> Column:
    """Pearson over rows where both are present; NULL when either is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.sqrt(F.var_pop(a) * F.var_pop(b))
    return F.when(spread > 0, F.covar_pop(a, b) / spread)


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Spearman correlation per key over complete rows (average ranks).

    Equal (x, y) rows are combined first, so a value that many rows share joins its rank
    once per distinct partner value.
    """
    keys = list(keys)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    base = rows.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_n"))
    cells = base
    for c in (x, y):
        runs = value_prefix(base, keys, c, {"_w": F.col("_n")})
        # centred average rank: the mean of all n ranks is (n + 1) / 2
        rank = F.col("_w_before") + (F.col("_w") + 1) / 2 - (F.col("_w_total") + 1) / 2
        cells = cells.join(runs.select(*keys, c, rank.alias("_rank_" + c)), [*keys, c])
    n, a, b = F.col("_n"), F.col("_rank_" + x), F.col("_rank_" + y)
    out = cells.groupBy(*keys).agg(
        F.sum(n * a * b).alias("_ab"), F.sum(n * a * a).alias("_aa"), F.sum(n * b * b).alias("_bb"), F.sum(n).alias("rows")
    )
    spread = F.sqrt(F.col("_aa") * F.col("_bb"))
    return out.select(*keys, F.when(spread > 0, F.col("_ab") / spread).alias("spearman"), "rows")


def spearman_matrix(df: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """Upper triangle of Spearman correlations: all columns are ranked in one long pass."""
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(row_id, F.explode(entries).alias("_e")).select(row_id, "_e.*")
    ranked = with_average_rank(long, ["feature"], "value", "_r")
    wide = ranked.groupBy(row_id).agg(*[F.max(F.when(F.col("feature") == c, F.col("_r"))).alias(c) for c in columns])
    pairs = list(combinations(columns, 2))
    row = wide.agg(*[correlation(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    out = F.array(
        *[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"c{i}").alias("spearman")) for i, (a, b) in enumerate(pairs)]
    )
    return row.select(F.explode(out).alias("_e")).select("_e.*")


def agreement(scores: DataFrame, first: str, second: str) -> DataFrame:
    """Score Spearman, pair-rank agreement and per-series difficulty Spearman of two models.

    ``scores`` has model, pair_id, series_id, label (0/1) and score, one row per (model, pair, label).
    """
    both = scores.where(F.col("model").isin(first, second))
    by = lambda m, l: F.max(F.when((F.col("model") == m) & (F.col("label") == l), F.col("score")))
    pairs = both.groupBy("pair_id", "series_id").agg(
        by(first, 0).alias("a0"), by(first, 1).alias("a1"), by(second, 0).alias("b0"), by(second, 1).alias("b1")
    )
    pairs = settle(pairs)  # three measures read it
    rows = pairs.select(F.explode(F.array(F.struct(F.col("a0").alias("a"), F.col("b0").alias("b")), F.struct(F.col("a1").alias("a"), F.col("b1").alias("b")))).alias("_e")).select("_e.*")
    score = spearman(rows, "a", "b").select(F.col("spearman").alias("score_spearman"), "rows")
    agree = pairs.agg(
        F.avg(((F.col("a1") > F.col("a0")) == (F.col("b1") > F.col("b0"))).cast("double")).alias("pair_rank_agreement"),
        F.count(F.lit(1)).alias("pairs"),
    )
    hard = pairs.groupBy("series_id").agg(F.avg(F.col("a1") - F.col("a0")).alias("a"), F.avg(F.col("b1") - F.col("b0")).alias("b"))
    hard = hard.select("series_id", F.round("a", 9).alias("a"), F.round("b", 9).alias("b"))
    difficulty = spearman(hard, "a", "b").select(F.col("spearman").alias("difficulty_spearman"), F.col("rows").alias("series"))
    return attach(attach(score, agree), difficulty)
