"""Scoring (M5-M11), resampling (B) and detector (M1-M4, M12-M14) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsemark.functions.ranks import rank_auc
from pulsemark.operators import cohorts, detect, features, gates, resample, scoring, sweep
from pulsemark.plans import roles as R
from pulsemark.plans.cohort_queries import PAIR_SQL, bits_and_hot, wide_pairs
from pulsemark.plans.registry import query, rnd, rounded, table
from pulsemark.plans.roles import with_sql
from pulsemark.plans.series import FEATURES_R1, NUM_BITS, W27_MARKED, features_sql, r1
from pulsemark.session import settle


def auc_sql(source: str, key: str, score: str, positive: str) -> str:
    """CTEs ending in auc(key, n_pos, n_neg, auc)."""
    return f"""hs AS (SELECT {key} AS k, {score} AS s, sum(({positive})::INT) AS p, sum((NOT ({positive}))::INT) AS q FROM {source} GROUP BY ALL),
 hp AS (SELECT *, sum(q) OVER (PARTITION BY k ORDER BY s) - q AS qb FROM hs),
 auc AS (SELECT k, sum(p)::BIGINT AS n_pos, sum(q)::BIGINT AS n_neg, sum(p * (qb + q / 2.0::DOUBLE)) / nullif(sum(p)::DOUBLE * sum(q)::DOUBLE, 0) AS auc FROM hp GROUP BY k)"""


def scored(spark, sf):
    return R.results(spark, sf).withColumn("label", (F.col("status") == "O").cast("int"))


@query("m05_rank_auc", with_sql(R.RESULTS_SQL, auc_sql("results", "0", "score", "status = 'O'")) + f"SELECT n_pos, n_neg, {rnd('auc')} AS auc FROM auc")
def _(spark, sf):
    return rounded(rank_auc(scored(spark, sf), [], "score", "label"))


@query(
    "m05_document_auc",
    with_sql("d AS (SELECT n_chars, quality, lang FROM documents d JOIN labels l ON l.doc_id = d.doc_id)", auc_sql("d", "lang", "n_chars", "quality = 1"))
    + f"SELECT k AS lang, n_pos, n_neg, {rnd('auc')} AS auc FROM auc",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return rounded(rank_auc(d, ["lang"], "n_chars", "quality"))


@query(
    "m06_predictor_auc",
    with_sql(
        R.BITS_SQL,
        """l AS (SELECT is_error, 'low_confidence' AS predictor, -abs_correlation AS s FROM bit_rows UNION ALL SELECT is_error, 'late_bit', bit_index FROM bit_rows
            UNION ALL SELECT is_error, 'side', side FROM bit_rows)""",
        auc_sql("l", "predictor", "s", "is_error = 1"),
    )
    + f"SELECT k AS predictor, n_pos, n_neg, {rnd('auc')} AS auc FROM auc",
)
def _(spark, sf):
    preds = [("low_confidence", -F.col("abs_correlation")), ("late_bit", F.col("bit_index")), ("side", F.col("side"))]
    return rounded(scoring.predictor_auc(bits_and_hot(spark, sf)[0], preds, "is_error"))


@query(
    "m07_group_auc",
    with_sql(R.RESULTS_SQL, auc_sql("results", "map_id", "score", "status = 'O'"), "u AS (SELECT map_id, count(DISTINCT series_id) AS units FROM results GROUP BY 1 HAVING count(DISTINCT series_id) >= 500)")
    + f"SELECT map_id, n_pos, n_neg, {rnd('auc')} AS auc, units FROM auc JOIN u ON map_id = k WHERE auc IS NOT NULL",
)
def _(spark, sf):
    return rounded(scoring.group_auc(scored(spark, sf), ["map_id"], "score", "label", "series_id", 500))


@query(
    "m08_influence",
    with_sql(
        R.BITS_SQL,
        """d AS (SELECT config_id AS unit, -abs_correlation AS s, is_error FROM bit_rows),
        x AS (SELECT u.unit, s, sum(is_error) AS p, sum(1 - is_error) AS q FROM d JOIN (SELECT DISTINCT unit FROM d) u ON u.unit <> d.unit GROUP BY ALL),
        xp AS (SELECT *, sum(q) OVER (PARTITION BY unit ORDER BY s) - q AS qb FROM x),
        a AS (SELECT unit, sum(p * (qb + q / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(q)::DOUBLE) AS auc_without FROM xp GROUP BY unit),
        y AS (SELECT s, sum(is_error) AS p, sum(1 - is_error) AS q FROM d GROUP BY s), yp AS (SELECT *, sum(q) OVER (ORDER BY s) - q AS qb FROM y),
        f AS (SELECT sum(p * (qb + q / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(q)::DOUBLE) AS full_auc FROM yp)""",
    )
    + f"SELECT unit AS config_id, {rnd('auc_without')} AS auc_without, {rnd('auc_without - full_auc')} AS delta FROM a, f",
)
def _(spark, sf):
    b = bits_and_hot(spark, sf)[0].withColumn("low", -F.col("abs_correlation"))
    return rounded(scoring.influence(b, "config_id", "low", "is_error"))


@query(
    "m09_paired_auc_delta",
    with_sql(R.RESULTS_SQL, "l AS (SELECT status, 1 AS m, score AS s FROM results UNION ALL SELECT status, 2, bits FROM results)", auc_sql("l", "m", "s", "status = 'O'"))
    + f"SELECT {rnd('max(auc) FILTER (k = 1)')} AS auc_first, {rnd('max(auc) FILTER (k = 2)')} AS auc_second, {rnd('max(auc) FILTER (k = 2) - max(auc) FILTER (k = 1)')} AS delta FROM auc",
)
def _(spark, sf):
    return rounded(scoring.paired_auc_delta(scored(spark, sf), "label", "score", "bits"))


MODEL_SQL = """w AS (SELECT l_orderkey AS pair_id, l_orderkey % 200 AS series_id, max(l_extendedprice) FILTER (l_linestatus='F') AS a0, max(l_extendedprice) FILTER (l_linestatus='O') AS a1,
   max(l_quantity) FILTER (l_linestatus='F') AS b0, max(l_quantity) FILTER (l_linestatus='O') AS b1 FROM lineitem GROUP BY ALL
   HAVING count(DISTINCT l_linestatus) = 2)"""


def rank_sql(x: str, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    c = f"PARTITION BY {part + ', ' if part else ''}{x}"
    return f"rank() OVER ({p}ORDER BY {x}) + (count(*) OVER ({c}) - 1) / 2.0::DOUBLE"


@query(
    "m10_model_agreement",
    with_sql(
        MODEL_SQL,
        "r AS (SELECT a0 AS a, b0 AS b FROM w UNION ALL SELECT a1, b1 FROM w)",
        f"rr AS (SELECT {rank_sql('a')} AS ra, {rank_sql('b')} AS rb FROM r)",
        "h AS (SELECT series_id, round(avg(a1 - a0), 9) AS a, round(avg(b1 - b0), 9) AS b FROM w GROUP BY 1)",
        f"hr AS (SELECT {rank_sql('a')} AS ra, {rank_sql('b')} AS rb FROM h)",
    )
    + f"""SELECT {rnd('(SELECT corr(ra, rb) FROM rr)', 7)} AS score_spearman, (SELECT count(*) FROM rr) AS rows,
        {rnd('(SELECT avg(((a1 > a0) = (b1 > b0))::INT) FROM w)')} AS pair_rank_agreement, (SELECT count(*) FROM w) AS pairs,
        {rnd('(SELECT corr(ra, rb) FROM hr)', 7)} AS difficulty_spearman, (SELECT count(*) FROM hr) AS series""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    label = (F.col("l_linestatus") == "O").cast("int")
    cells = li.groupBy(F.col("l_orderkey").alias("pair_id"), label.alias("label")).agg(F.max("l_extendedprice").alias("a"), F.max("l_quantity").alias("b"))
    both = cells.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("pair_id")
    models = F.explode(F.array(F.struct(F.lit("a").alias("model"), F.col("a").alias("score")), F.struct(F.lit("b").alias("model"), F.col("b").alias("score")))).alias("e")
    scores = cells.join(both, "pair_id").select("pair_id", (F.col("pair_id") % 200).alias("series_id"), "label", models).select("pair_id", "series_id", "label", "e.*")
    return rounded(scoring.agreement(scores, "a", "b"), score_spearman=7, difficulty_spearman=7)


@query(
    "m11_spearman",
    f"WITH r AS (SELECT l_returnflag AS condition, {rank_sql('l_quantity', 'l_returnflag')} AS ra, {rank_sql('l_extendedprice', 'l_returnflag')} AS rb FROM lineitem) "
    + f"SELECT condition, {rnd('corr(ra, rb)', 7)} AS spearman, count(*) AS rows FROM r GROUP BY condition",
)
def _(spark, sf):
    rows = R.results(spark, sf).withColumn("q", F.col("bits").cast("double"))
    return rounded(scoring.spearman(rows, "q", "score", ["condition"]), 7)


COUNTS = ("count_300", "count_100", "count_50", "count_miss")


@query(
    "m11_spearman_matrix",
    with_sql(R.HEADERS_SQL, "r AS (SELECT " + ", ".join(f"{rank_sql(c)} AS {c}" for c in COUNTS) + " FROM headers)")
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {rnd(f'corr({a}, {b})', 7)} AS spearman FROM r" for i, a in enumerate(COUNTS) for b in COUNTS[i + 1 :]
    ),
)
def _(spark, sf):
    return rounded(scoring.spearman_matrix(R.headers(spark, sf), "series_id", COUNTS), 7)


# ---- resampling ------------------------------------------------------------------------------

# how many resamples the studied analyses draw: sweeps, robustness, floors, keys
SWEEP, ROBUST, FLOOR, KEYS = 1000, 2000, 5000, 10_000


def draws_sql(units: str, unit: str, seed: str, iterations: int, tag: str = "") -> str:
    """CTEs num<tag>(units with unit_no) and dr<tag>(it, unit_no)."""
    return f"""num{tag} AS (SELECT *, row_number() OVER (ORDER BY {unit}) - 1 AS unit_no, count(*) OVER () AS nn FROM {units}),
 dr{tag} AS (SELECT it, ('0x' || substr(sha256('{seed}|' || it || '|' || pos), 1, 8))::BIGINT % nn AS unit_no FROM
   (SELECT unnest(range(0, {iterations})) AS it, nn FROM (SELECT count(*) AS nn FROM {units})), LATERAL (SELECT unnest(range(0, nn)) AS pos))"""


def ci_sql(metrics: dict[str, str], sums: list[str]) -> str:
    total = ", ".join(f"sum({c}) AS {c}" for c in sums)
    out = []
    for m, e in metrics.items():
        out.append(
            f"""SELECT '{m}' AS metric, {rnd(f'(SELECT {e} FROM (SELECT {total} FROM num))')} AS value, {rnd('quantile_cont(v, 0.025)')} AS ci_low,
            {rnd('quantile_cont(v, 0.975)')} AS ci_high, count(v) AS iterations FROM (SELECT {e} AS v FROM tot)"""
        )
    return f", tot AS (SELECT it, {total} FROM dr JOIN num ON num.unit_no = dr.unit_no GROUP BY it) " + " UNION ALL ".join(out)


DELTA = {"error_rate_delta": "errors_candidate / bits_candidate - errors_control / bits_control"}
SUMS = ["bits_control", "errors_control", "bits_candidate", "errors_candidate"]


@query(
    "b01_row_bootstrap",
    with_sql(PAIR_SQL, "p AS (SELECT map_id * 1000000 + series_id AS unit, * FROM pairs)", draws_sql("p", "unit", "b1", SWEEP)) + ci_sql(DELTA, SUMS),
)
def _(spark, sf):
    p = wide_pairs(spark, sf).withColumn("unit", F.col("map_id") * 1000000 + F.col("series_id"))
    return rounded(resample.bootstrap(p, "unit", SUMS, DELTA, SWEEP, "b1"))


PAIRED = {
    "error_rate_delta": DELTA["error_rate_delta"],
    "mean_bits_delta": "(bits_candidate - bits_control) / pairs",
    "root_bits_delta": "sqrt(bits_candidate / pairs) - sqrt(bits_control / pairs)",
    "mean_errors_delta": "(errors_candidate - errors_control) / pairs",
}


@query(
    "b02_cluster_paired_metrics",
    with_sql(
        PAIR_SQL,
        """c AS (SELECT map_id, sum(bits_control) AS bits_control, sum(errors_control) AS errors_control, sum(bits_candidate) AS bits_candidate,
           sum(errors_candidate) AS errors_candidate, count(*) AS pairs FROM pairs GROUP BY 1)""",
        draws_sql("c", "map_id", "b2", ROBUST),
    )
    + ci_sql(PAIRED, SUMS + ["pairs"]),
)
def _(spark, sf):
    units = resample.cluster_totals(wide_pairs(spark, sf), "map_id", {c: c for c in SUMS}).withColumnRenamed("rows", "pairs")
    return rounded(resample.bootstrap(units, "map_id", SUMS + ["pairs"], PAIRED, ROBUST, "b2"))


@query(
    "b03_cluster_mean_delta",
    with_sql(
        PAIR_SQL,
        "c AS (SELECT map_id, avg(errors_candidate / bits_candidate - errors_control / bits_control) AS d, 1 AS one FROM pairs GROUP BY 1)",
        draws_sql("c", "map_id", "b3", ROBUST),
    )
    + ci_sql({"mean_delta": "d / one"}, ["d", "one"]),
)
def _(spark, sf):
    d = F.col("errors_candidate") / F.col("bits_candidate") - F.col("errors_control") / F.col("bits_control")
    units = wide_pairs(spark, sf).groupBy("map_id").agg(F.avg(d).alias("d")).withColumn("one", F.lit(1))
    return rounded(resample.bootstrap(units, "map_id", ["d", "one"], {"mean_delta": "d / one"}, ROBUST, "b3"))


@query(
    "b04_cluster_median",
    with_sql(
        R.RESULTS_SQL,
        "u AS (SELECT DISTINCT map_id FROM results)",
        draws_sql("u", "map_id", "b4", ROBUST),
        "m AS (SELECT it, quantile_cont(bits, 0.5) AS v FROM dr JOIN num ON num.unit_no = dr.unit_no JOIN results r ON r.map_id = num.map_id GROUP BY it)",
    )
    + f"SELECT 'median' AS metric, {rnd('quantile_cont(v, 0.025)')} AS ci_low, {rnd('quantile_cont(v, 0.975)')} AS ci_high, count(v) AS iterations FROM m",
)
def _(spark, sf):
    return rounded(resample.bootstrap_median(R.results(spark, sf), "map_id", "bits", ROBUST, "b4"))


def _b5_sql(it: int) -> str:
    return (
        with_sql(
            R.RESULTS_SQL,
            "u AS (SELECT DISTINCT map_id FROM results)",
            draws_sql("u", "map_id", "b5", it),
            "w AS (SELECT it, map_id, count(*)::DOUBLE AS w FROM dr JOIN num ON num.unit_no = dr.unit_no GROUP BY ALL)",
            """l AS (SELECT map_id, 'score' AS m, score AS s, status='O' AS pos FROM results UNION ALL SELECT map_id, 'bits', bits, status='O' FROM results),
            ps AS (SELECT map_id AS c, m, s, count(*) AS p FROM l WHERE pos GROUP BY ALL),
            ev AS (SELECT m, map_id AS d, s, count(*) AS q FROM l WHERE NOT pos GROUP BY ALL UNION ALL SELECT m, u.map_id, s, 0 FROM (SELECT DISTINCT m, s FROM ps), u),
            es AS (SELECT m, d, s, sum(q) AS q FROM ev GROUP BY ALL),
            el AS (SELECT *, sum(q) OVER (PARTITION BY m, d ORDER BY s) - q AS below FROM es),
            wins AS (SELECT ps.m, c, d, sum(p * (below + q / 2.0::DOUBLE)) AS wins FROM ps JOIN el ON el.m = ps.m AND el.s = ps.s GROUP BY ALL),
            sizes AS (SELECT m, map_id, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS q FROM l GROUP BY ALL),
            tot AS (SELECT it, m, sum(w * p) AS p, sum(w * q) AS q FROM w JOIN sizes ON sizes.map_id = w.map_id GROUP BY ALL),
            a AS (SELECT x.it, wins.m, sum(x.w * y.w * wins) AS won FROM w x JOIN wins ON wins.c = x.map_id JOIN w y ON y.it = x.it AND y.map_id = wins.d GROUP BY ALL),
            v AS (SELECT tot.it, tot.m, won / (p * q) AS v FROM tot JOIN a ON a.it = tot.it AND a.m = tot.m WHERE p > 0 AND q > 0),
            z AS (SELECT m AS metric, v FROM v UNION ALL SELECT 'delta', max(v) FILTER (m='bits') - max(v) FILTER (m='score') FROM v GROUP BY it)""",
        )
        + f"SELECT metric, {rnd('quantile_cont(v, 0.025)')} AS ci_low, {rnd('quantile_cont(v, 0.975)')} AS ci_high, count(v) AS iterations FROM z GROUP BY metric"
    )


@query("b05_auc_bootstrap", _b5_sql(SWEEP))
def _(spark, sf):
    return rounded(resample.bootstrap_auc(scored(spark, sf), "map_id", ["score", "bits"], "label", SWEEP, "b5"))


RATES = {"raw": "raw_bit_errors / coded_bits", "post": "post_bit_errors / useful_bits", "correct": "correct / messages"}
RATE_SUMS = ["raw_bit_errors", "coded_bits", "post_bit_errors", "useful_bits", "correct", "messages"]


@query(
    "b06_ratio_of_sums",
    with_sql(
        R.MESSAGES_SQL,
        """c AS (SELECT map_id, sum(raw_bit_errors) AS raw_bit_errors, sum(coded_bits) AS coded_bits, sum(post_bit_errors) AS post_bit_errors, sum(useful_bits) AS useful_bits,
           sum((integrity='CORRECT_ACCEPT')::INT) AS correct, count(*) AS messages FROM messages GROUP BY 1)""",
        draws_sql("c", "map_id", "b6", FLOOR),
    )
    + ci_sql(RATES, RATE_SUMS),
)
def _(spark, sf):
    sums = {c: c for c in RATE_SUMS[:4]} | {"correct": "cast(integrity = 'CORRECT_ACCEPT' as int)", "messages": "1"}
    units = resample.cluster_totals(R.messages(spark, sf), "map_id", sums)
    return rounded(resample.bootstrap(units, "map_id", RATE_SUMS, RATES, FLOOR, "b6"))


@query(
    "b07_two_way",
    with_sql(
        R.RESULTS_SQL,
        "ka AS (SELECT DISTINCT seed FROM results), kb AS (SELECT DISTINCT map_id FROM results)",
        draws_sql("ka", "seed", "b7-a", ROBUST, "a"),
        draws_sql("kb", "map_id", "b7-b", ROBUST, "b"),
        """wa AS (SELECT it, seed, count(*) AS w FROM dra JOIN numa ON numa.unit_no = dra.unit_no GROUP BY ALL),
        wb AS (SELECT it, map_id, count(*) AS w FROM drb JOIN numb ON numb.unit_no = drb.unit_no GROUP BY ALL),
        c AS (SELECT seed, map_id, sum(errors) AS x, sum(bits) AS y FROM results GROUP BY ALL),
        s AS (SELECT wa.it, sum(wa.w * wb.w * x)::DOUBLE / sum(wa.w * wb.w * y)::DOUBLE AS v FROM wa JOIN c ON c.seed = wa.seed JOIN wb ON wb.it = wa.it AND wb.map_id = c.map_id GROUP BY 1)""",
    )
    + f"SELECT 'ratio' AS metric, {rnd('quantile_cont(v, 0.025)')} AS ci_low, {rnd('quantile_cont(v, 0.975)')} AS ci_high, count(v) AS iterations FROM s",
)
def _(spark, sf):
    return rounded(resample.bootstrap_two_way(R.results(spark, sf), "seed", "map_id", "errors", "bits", ROBUST, "b7"))


@query(
    "b08_key_mean",
    with_sql("c AS (SELECT l_suppkey AS key_id, round(avg(l_quantity), 9) AS m, 1 AS one FROM lineitem GROUP BY 1)", draws_sql("c", "key_id", "b8", KEYS)) + ci_sql({"key_mean": "m / one"}, ["m", "one"]),
)
def _(spark, sf):
    units = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("key_id")).agg(F.round(F.avg("l_quantity"), 9).alias("m"), F.lit(1).alias("one"))
    return rounded(resample.bootstrap(units, "key_id", ["m", "one"], {"key_mean": "m / one"}, KEYS, "b8"))


@query(
    "b09_zero_event_bounds",
    with_sql(R.MESSAGES_SQL, "z AS (SELECT lang, layout_seed, sum((integrity='WRONG_ACCEPT')::INT)::BIGINT AS events, count(*) AS configurations, count(DISTINCT map_id) AS units FROM messages GROUP BY ALL)")
    + f"""SELECT lang, layout_seed, events, configurations, units, {rnd('CASE WHEN events = 0 THEN 1 - pow(0.05::DOUBLE, 1.0::DOUBLE / configurations) END')} AS upper_per_configuration,
          {rnd('CASE WHEN events = 0 THEN 1 - pow(0.05::DOUBLE, 1.0::DOUBLE / units) END')} AS upper_per_unit FROM z""",
)
def _(spark, sf):
    m = R.messages(spark, sf).withColumn("wrong", (F.col("integrity") == "WRONG_ACCEPT").cast("int"))
    return rounded(resample.zero_event_bounds(m, ["lang", "layout_seed"], "wrong", "map_id"))


# ---- detectors -------------------------------------------------------------------------------

FEATURES = list(features.FULL)


def feature_pairs(spark, sf, pn_key="pn-a", alpha=24.0):
    pairs = sweep.marked_pairs(r1(spark, sf)[0], (alpha,), 8, pn_key, "layout-a", "random_a", NUM_BITS)
    rows = settle(features.series_features(pairs, ["series_id", "label"], sized=True))
    return detect.check_features(rows, ["series_id"], FEATURES)


def folded(spark, sf):
    rows = feature_pairs(spark, sf)
    return settle(rows.join(cohorts.group_folds(rows, "series_id", 5, "cv").select("series_id", "fold"), "series_id"))


def partitioned(rows):
    split = cohorts.split_groups(rows, "series_id", 0.3, "42")
    at = settle(rows.join(split, "series_id"))
    return at.where("partition = 'development'"), at.where("partition = 'validation'")


@query("m01_families_generalise")
def _(spark, sf):
    train, test = partitioned(feature_pairs(spark, sf))
    out = None
    for name in detect.FAMILIES:
        preds, _model = detect.generalise(train, test, name, FEATURES, "series_id")
        row = rank_auc(preds, [], "score", "label").withColumn("family", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return rounded(out)


@query("m03_group_cv_scores")
def _(spark, sf):
    preds, _models = detect.out_of_fold(folded(spark, sf), "logistic_l2", FEATURES, 5)
    return preds.select("series_id", "label", "fold", F.col("score"))


@query("m03_group_cv_interval")
def _(spark, sf):
    preds, _models = detect.out_of_fold(folded(spark, sf), "logistic_l2", FEATURES, 5)
    return rounded(detect.evaluation(preds, "series_id", SWEEP, "m3"))


PAIR_FEATURES_SQL = (
    f"SELECT *, 0 AS label FROM ({FEATURES_R1}) UNION ALL BY NAME SELECT *, 1 AS label FROM ({features_sql('m1', W27_MARKED.replace('12.0::DOUBLE', '24.0::DOUBLE'))})"
)
CV_FOLDS_SQL = """folds AS (SELECT series_id, (row_number() OVER (ORDER BY sha256('cv|' || series_id), series_id) - 1) % 5 AS fold
  FROM (SELECT DISTINCT user_id AS series_id FROM events))"""


@query(
    "m03_fold_coverage",
    with_sql(CV_FOLDS_SQL) + "SELECT fold, count(*) * 2 AS rows, count(*) AS series, count(*) AS positives, 2 AS times_scored FROM folds GROUP BY fold",
)
def _(spark, sf):
    """Every row is scored once, in its own fold, and a series' two rows share a fold."""
    preds, _models = detect.out_of_fold(folded(spark, sf), "logistic_l2", FEATURES, 5)
    per = preds.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.min("fold").alias("fold"), F.max("fold").alias("last"), F.sum("label").alias("p"))
    at = F.when(F.col("fold") == F.col("last"), F.col("fold"))  # null, and so no match, were a series split
    return per.groupBy(at.alias("fold")).agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("series"), F.sum("p").cast("long").alias("positives"), F.max("n").cast("int").alias("times_scored")
    )


@query(
    "m03_class_means",
    f"SELECT label, {', '.join(f'{rnd(f"avg({c})", 3)} AS {c}' for c in FEATURES if 'variance' not in c)} FROM ({PAIR_FEATURES_SQL}) GROUP BY label",
)
def _(spark, sf):
    names = [c for c in FEATURES if "variance" not in c]
    return rounded(detect.class_means(feature_pairs(spark, sf), names), 3)


@query("m03_importances")
def _(spark, sf):
    """Mean forest importances over the folds of all series."""
    rows = folded(spark, sf)
    _preds, models = detect.out_of_fold(rows, "random_forest", FEATURES, 5)
    return rounded(detect.weight_summary(detect.weight_table(rows, models)))


@query("m04_forest_generalisation")
def _(spark, sf):
    train, test = partitioned(feature_pairs(spark, sf))
    preds, _model = detect.generalise(train, test, "random_forest", FEATURES, "series_id")
    return preds.select("series_id", "label", "score")


@query("m12_coefficient_summary")
def _(spark, sf):
    rows = folded(spark, sf)
    _preds, models = detect.out_of_fold(rows, "logistic_l2", FEATURES, 5)
    return rounded(detect.weight_summary(detect.weight_table(rows, models)))


@query("m13_key_detectors")
def _(spark, sf):
    train = feature_pairs(spark, sf)
    model = detect.fit(train, "logistic_l2", FEATURES)
    others = None
    for key in ("pn-b", "pn-c"):
        rows = feature_pairs(spark, sf, key).withColumn("key_id", F.lit(key))
        others = rows if others is None else others.unionByName(rows)
    return rounded(detect.per_key_auc(model, others, "key_id"))


def keyed_pairs(spark, sf, keys):
    """Feature pairs of several keys with series folds: all rows of a series share its fold."""
    out = None
    for key in keys:
        rows = feature_pairs(spark, sf, key).withColumn("key_id", F.lit(key))
        out = rows if out is None else out.unionByName(rows)
    folds = cohorts.group_folds(out, "series_id", 3, "cv").select("series_id", "fold")
    return settle(out.join(folds, "series_id"))


@query("m13_key_aware_cv")
def _(spark, sf):
    preds, _models = detect.out_of_fold(keyed_pairs(spark, sf, ("pn-a", "pn-b")), "logistic_l2", FEATURES, 3)
    return rounded(rank_auc(preds, ["key_id"], "score", "label"))


@query("m13_held_out_keys")
def _(spark, sf):
    rows = keyed_pairs(spark, sf, ("pn-a", "pn-b"))
    return rounded(detect.held_out_keys(rows, "logistic_l2", FEATURES, "key_id", ("pn-a", "pn-b"), "fold", 3))


@query(
    "m13_key_class_counts",
    "SELECT key_id, label, count(DISTINCT user_id) AS rows FROM events, (SELECT unnest(['pn-a', 'pn-b']) AS key_id), (SELECT unnest([0, 1]) AS label) GROUP BY key_id, label",
)
def _(spark, sf):
    return keyed_pairs(spark, sf, ("pn-a", "pn-b")).groupBy("key_id", "label").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "m14_feature_gate",
    """SELECT vec_id AS series_id, count(*) AS rows FROM (SELECT vec_id, label % 2 AS label FROM embeddings UNION ALL SELECT vec_id, 1 FROM embeddings) GROUP BY 1
       HAVING NOT (count(*) FILTER (label = 0) = 1 AND count(*) FILTER (label = 1) = 1) OR count(*) <> 2""",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("series_id"), F.explode(F.array(F.col("label") % 2, F.lit(1))).alias("label"))
    return gates.label_pairs(e, ["series_id"], "label")
