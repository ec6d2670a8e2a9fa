"""Summary (A), confidence (X), gate (V) and source (S) queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pulsemark.functions import hashing as H
from pulsemark.operators import confidence, gates, policy, ranking, scoring, summaries
from pulsemark.plans import roles as R
from pulsemark.plans.cohort_queries import ACC_SQL, accuracies, bits_and_hot, edges_sql
from pulsemark.plans.registry import query, rnd, rounded, table
from pulsemark.plans.roles import with_sql
from pulsemark.session import ensure_checkpoint_dir
from pulsemark.sources import files, store

RES_SQL = R.RESULTS_SQL + ", res AS (SELECT *, errors / bits AS rate FROM results)"
ERR_COLS = f"""count(*) AS experiments, sum(bits)::BIGINT AS total_bits, sum(errors)::BIGINT AS bit_errors, {rnd('sum(errors)/sum(bits)')} AS error_rate,
  {rnd('avg(rate)')} AS mean_rate, {rnd('avg((rate = 0)::INT)')} AS zero_share, {rnd('avg((rate < 0.05)::INT)')} AS under_5pct_share,
  sum(seed)::BIGINT AS total_dropped, {rnd('quantile_cont(rate, 0.5)')} AS median_rate"""


def with_drops(spark, sf):
    return R.results(spark, sf).withColumn("dropped", F.col("seed"))


@query("a01_error_summary", with_sql(RES_SQL) + f"SELECT condition, seed, {ERR_COLS} FROM res GROUP BY condition, seed")
def _(spark, sf):
    return rounded(summaries.error_summary(with_drops(spark, sf), ["condition", "seed"]))


AUC_SQL = """hs AS (SELECT {k}, score, sum((status='O')::INT) AS p, sum((status<>'O')::INT) AS q FROM results GROUP BY ALL),
 hp AS (SELECT *, sum(q) OVER (PARTITION BY {k} ORDER BY score) - q AS qb FROM hs),
 auc AS (SELECT {k}, sum(p)::BIGINT AS n_pos, sum(q)::BIGINT AS n_neg, sum(p * (qb + q / 2.0::DOUBLE)) / nullif(sum(p)::DOUBLE * sum(q)::DOUBLE, 0) AS auc FROM hp GROUP BY {k})"""


@query(
    "a02_trade_off",
    with_sql(RES_SQL, AUC_SQL.format(k="condition"))
    + f"""SELECT s.*, n_pos, n_neg, {rnd('auc', 7)} AS auc, 16.0::DOUBLE / 8 AS capacity_multiplier FROM
          (SELECT condition, {ERR_COLS} FROM res GROUP BY condition) s JOIN auc ON auc.condition = s.condition""",
)
def _(spark, sf):
    rows = with_drops(spark, sf).withColumn("label", (F.col("status") == "O").cast("int"))
    auc = scoring.rank_auc(rows, ["condition"], "score", "label")
    return rounded(summaries.trade_off(summaries.error_summary(rows, ["condition"]), auc, ["condition"], F.lit(8)), auc=7)


@query("a03_status_counts", "SELECT CASE WHEN n_chars < 400 THEN NULL ELSE lang END AS status, source, count(*) AS rows FROM documents GROUP BY ALL")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("status", F.when(F.col("n_chars") >= 400, F.col("lang")))
    return summaries.status_counts(d, ["status", "source"])


@query(
    "a04_group_summary",
    with_sql(ACC_SQL)
    + f"""SELECT category, count(*) AS series, count(DISTINCT map_id) AS maps, {rnd('avg(accuracy)', 7)} AS mean, {rnd('min(accuracy)')} AS min,
          {rnd('max(accuracy)')} AS max, {rnd('quantile_cont(accuracy, 0.5)')} AS median FROM acc GROUP BY category""",
)
def _(spark, sf):
    return rounded(summaries.group_summary(accuracies(spark, sf), ["category"], "accuracy", "map_id"), mean=7)


@query(
    "a05_scoped_rates",
    with_sql(R.BITS_SQL, "b AS (SELECT *, bit_index % 5 AS seed FROM bit_rows)")
    + " UNION ALL ".join(
        f"SELECT '{s}' AS scope, {v} AS group_value, count(*) AS total_bits, sum(is_error)::BIGINT AS bit_errors, {rnd('avg(is_error)')} AS error_rate FROM b GROUP BY {g}"
        for s, v, g in (("overall", "'all'", "ALL"), ("seed", "seed::VARCHAR", "seed"), ("side", "side::VARCHAR", "side"), ("series", "config_id::VARCHAR", "config_id"))
    ),
)
def _(spark, sf):
    b = bits_and_hot(spark, sf)[0].withColumn("seed", F.col("bit_index") % 5)
    return rounded(summaries.scoped_rates(b, {"seed": "seed", "side": "side", "series": "config_id"}))


@query(
    "a06_all_and_groups",
    with_sql(R.RESULTS_SQL)
    + f"""SELECT coalesce(condition, 'ALL') AS condition, count(*) AS rows, {rnd('sum(errors)/sum(bits)')} AS error_rate FROM results GROUP BY ROLLUP(condition)""",
)
def _(spark, sf):
    aggs = [F.count(F.lit(1)).alias("rows"), F.try_divide(F.sum("errors").cast("double"), F.sum("bits")).alias("error_rate")]
    return rounded(summaries.with_all(R.results(spark, sf), "condition", aggs))


def _outcomes(keys: str, decision: str = "integrity") -> str:
    return f"""SELECT {keys}, count(*) AS configs, sum(raw_bit_errors)::BIGINT AS raw_bit_errors, sum(coded_bits)::BIGINT AS coded_bits,
      {rnd('sum(raw_bit_errors)/sum(coded_bits)')} AS raw_error_rate, sum(post_bit_errors)::BIGINT AS post_bit_errors, sum(useful_bits)::BIGINT AS useful_bits,
      {rnd('sum(post_bit_errors)/sum(useful_bits)')} AS post_error_rate, count(*) FILTER ({decision} = 'CORRECT_ACCEPT') AS correct_accept,
      count(*) FILTER ({decision} = 'WRONG_ACCEPT') AS wrong_accept, count(*) FILTER ({decision} = 'REJECT') AS reject,
      {rnd('avg((post_bit_errors = 0)::INT)')} AS full_recovery_rate,
      {rnd(f"count(*) FILTER ({decision} = 'CORRECT_ACCEPT') / nullif(count(*) FILTER ({decision} <> 'REJECT'), 0)")} AS accepted_accuracy
      FROM messages GROUP BY {keys}"""


@query("a07_outcome_summary", with_sql(R.MESSAGES_SQL) + _outcomes("lang, layout_seed"))
def _(spark, sf):
    return rounded(summaries.outcome_summary(R.messages(spark, sf), ["lang", "layout_seed"], "integrity"))


@query(
    "a08_two_level",
    with_sql(R.RESULTS_SQL, "p AS (SELECT condition, series_id, sum(errors)/sum(bits) AS r FROM results GROUP BY ALL)")
    + f"""SELECT condition, count(r) AS units, {rnd('avg(r)')} AS mean, {rnd('min(r)')} AS min, {rnd('max(r)')} AS max, {rnd('stddev_samp(r)', 7)} AS sd,
        {rnd('quantile_cont(r, 0.5)')} AS median FROM p GROUP BY condition""",
)
def _(spark, sf):
    return rounded(summaries.two_level(R.results(spark, sf), ["series_id"], ["condition"], "errors", "bits"), sd=7)


@query(
    "a09_minimum_group",
    with_sql(R.RESULTS_SQL)
    + f"SELECT map_id, count(DISTINCT series_id) AS units, {rnd('sum(errors)/sum(bits)')} AS error_rate FROM results GROUP BY map_id HAVING count(DISTINCT series_id) >= 500",
)
def _(spark, sf):
    return rounded(summaries.rate_where_enough(R.results(spark, sf), ["map_id"], "series_id", 500))


@query(
    "a10_metric_distribution",
    "WITH u AS (SELECT 'quantity' AS metric, l_quantity AS v FROM lineitem UNION ALL SELECT 'price', l_extendedprice FROM lineitem) "
    + f"""SELECT metric, count(v) AS n, {rnd('avg(v)', 4)} AS mean, {rnd('stddev_samp(v)', 4)} AS sd, {rnd('min(v)', 4)} AS min, {rnd('max(v)', 4)} AS max,
        {rnd('quantile_cont(v, 0.1)', 4)} AS q10, {rnd('quantile_cont(v, 0.25)', 4)} AS q25, {rnd('quantile_cont(v, 0.5)', 4)} AS median,
        {rnd('quantile_cont(v, 0.75)', 4)} AS q75, {rnd('quantile_cont(v, 0.9)', 4)} AS q90 FROM u GROUP BY metric""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    return rounded(summaries.metric_distribution(li, ["quantity", "price"]), 4)


@query(
    "a11_factor_rates",
    with_sql(R.BITS_SQL)
    + " UNION ALL ".join(
        f"SELECT '{f}' AS factor, {f}::VARCHAR AS factor_value, count(*) AS bits, sum(is_error)::BIGINT AS errors, {rnd('avg(is_error)')} AS error_rate, {rnd('avg(abs_correlation)', 7)} AS mean_abs_correlation FROM bit_rows GROUP BY {f}"
        for f in ("side", "true_bit")
    ),
)
def _(spark, sf):
    return rounded(summaries.factor_rates(bits_and_hot(spark, sf)[0], ["side", "true_bit"]), mean_abs_correlation=7)


OUTCOMES = ("CORRECT_ACCEPT", "WRONG_ACCEPT", "REJECT")


@query(
    "a12_transitions",
    with_sql(R.MESSAGES_SQL, "l AS (SELECT unnest(['CORRECT_ACCEPT','WRONG_ACCEPT','REJECT']) AS x)")
    + """SELECT a.lang, b.x AS baseline, c.x AS integrity, count(m.msg_id) AS n FROM (SELECT DISTINCT lang FROM messages) a, l b, l c
         LEFT JOIN messages m ON m.lang = a.lang AND m.baseline = b.x AND m.integrity = c.x GROUP BY ALL""".replace(
        ", l b, l c", " CROSS JOIN l b CROSS JOIN l c"
    ),
)
def _(spark, sf):
    return summaries.transitions(R.messages(spark, sf), "baseline", "integrity", OUTCOMES, ["lang"])


@query(
    "a13_pair_outcomes",
    with_sql(R.MESSAGES_SQL)
    + """SELECT lang, count(*) FILTER (a AND b) AS "both", count(*) FILTER (a AND NOT b) AS only_first, count(*) FILTER (NOT a AND b) AS only_second,
         count(*) FILTER (NOT a AND NOT b) AS neither FROM (SELECT lang, baseline = 'CORRECT_ACCEPT' AS a, integrity = 'CORRECT_ACCEPT' AS b FROM messages) GROUP BY lang""",
)
def _(spark, sf):
    return summaries.pair_outcomes(
        R.messages(spark, sf), ["lang"], F.col("baseline") == "CORRECT_ACCEPT", F.col("integrity") == "CORRECT_ACCEPT"
    )


_A = "sum(errors) FILTER (condition='A') / sum(bits) FILTER (condition='A')"
_N = "sum(errors) FILTER (condition='N') / sum(bits) FILTER (condition='N')"


@query(
    "a14_condition_delta",
    with_sql(R.RESULTS_SQL) + f"SELECT map_id, {rnd(_A)} AS rate_low, {rnd(_N)} AS rate_high, {rnd(f'{_N} - {_A}')} AS delta FROM results GROUP BY map_id",
)
def _(spark, sf):
    return rounded(summaries.condition_delta(R.results(spark, sf), ["map_id"], "condition", "A", "N"))


@query(
    "a15_capture_rates",
    with_sql(R.MESSAGES_SQL, "m AS (SELECT lang, baseline='WRONG_ACCEPT' AS w, baseline='CORRECT_ACCEPT' AS c, integrity='REJECT' AS r FROM messages)")
    + f"""SELECT lang, count(*) AS configs, count(*) FILTER (w) AS base_wrong, count(*) FILTER (w AND r) AS captured,
        {rnd('count(*) FILTER (w AND r) / nullif(count(*) FILTER (w), 0)')} AS capture_rate, count(*) FILTER (c) AS base_correct,
        count(*) FILTER (c AND r) AS extra_rejects, {rnd('count(*) FILTER (c AND r) / nullif(count(*) FILTER (c), 0)')} AS false_reject_rate,
        {rnd('count(*) FILTER (c AND r) / nullif(count(*) FILTER (w AND r), 0)')} AS rejects_per_capture FROM m GROUP BY lang""",
)
def _(spark, sf):
    return rounded(summaries.capture_rates(R.messages(spark, sf), ["lang"], "baseline", "integrity"))


CAP_SQL = "cap AS (SELECT doc_id AS series_id, lang AS map_id, n_chars // 8 AS capacity, CASE WHEN n_chars // 8 = 0 THEN 0 ELSE greatest(1, (n_chars // 8) * 3 // 40) END AS allocated FROM documents)"


def capacities(spark, sf):
    cap = policy.capacity(F.col("n_chars"))
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("series_id"), F.col("lang").alias("map_id"), cap.alias("capacity"), policy.fraction_bits(cap, 3, 40).alias("allocated")
    )


CAPS = ((3, 40), (1, 10), (1, 8), (1, 5))


@query(
    "a16_coverage_curve",
    with_sql(
        CAP_SQL,
        """c AS (SELECT map_id, capacity, n, d, CASE WHEN capacity = 0 THEN 0 ELSE greatest(1, capacity * n // d) END // 8 AS w
             FROM cap, (VALUES (3,40),(1,10),(1,8),(1,5)) t(n,d))""",
    )
    + f"""SELECT n AS cap_num, d AS cap_den, count(*) AS series, count(*) FILTER (w >= 1) AS eligible, {rnd('avg((w >= 1)::INT)')} AS eligible_share,
        count(DISTINCT map_id) AS maps, count(DISTINCT CASE WHEN w >= 1 THEN map_id END) AS eligible_maps, {rnd('avg(w * 4)')} AS mean_useful_bits,
        {rnd('min(CASE WHEN w >= 1 THEN 8.0::DOUBLE / capacity END)')} AS need_min, {rnd('quantile_cont(w, 0.5)')} AS median_words,
        {rnd('quantile_cont(CASE WHEN w >= 1 THEN 8.0::DOUBLE / capacity END, 0.5)')} AS need_median,
        {rnd('quantile_cont(CASE WHEN w >= 1 THEN 8.0::DOUBLE / capacity END, 0.9)')} AS need_p90 FROM c GROUP BY n, d""",
)
def _(spark, sf):
    return rounded(summaries.coverage_curve(capacities(spark, sf), CAPS))


DEC_SQL = """dec AS (SELECT series_id, p AS policy, capacity, CASE WHEN allocated >= 8 THEN 'unchanged' WHEN capacity >= 8 AND 8 * d <= capacity * n THEN 'one_word_floor' ELSE 'abstain' END AS decision,
   CASE WHEN allocated >= 8 THEN allocated WHEN capacity >= 8 AND 8 * d <= capacity * n THEN 8 ELSE 0 END AS requested_bits
   FROM cap, (VALUES ('cap10',1,10),('cap12',1,8),('cap20',1,5)) t(p,n,d))"""
POLICIES = (("cap10", 1, 10), ("cap12", 1, 8), ("cap20", 1, 5))


@query("a17_policy_decisions", with_sql(CAP_SQL, DEC_SQL) + "SELECT series_id, policy, decision, requested_bits, requested_bits // 8 AS words FROM dec")
def _(spark, sf):
    return summaries.policy_decisions(capacities(spark, sf), POLICIES)


@query(
    "a17_stratum_totals",
    with_sql(
        CAP_SQL,
        DEC_SQL,
        R.MESSAGES_SQL,
        """cnt AS (SELECT map_id AS lang, count(*) AS n FROM cap WHERE allocated < 8 GROUP BY 1),
        rate AS (SELECT lang, avg((integrity='CORRECT_ACCEPT')::INT) AS correct, avg((integrity='REJECT')::INT) AS reject FROM messages GROUP BY 1)""",
    )
    + f"SELECT sum(n)::BIGINT AS n, {rnd('sum(n*correct)', 6)} AS correct, {rnd('sum(n*reject)', 6)} AS reject FROM cnt JOIN rate ON cnt.lang = rate.lang",
)
def _(spark, sf):
    counts = capacities(spark, sf).where("allocated < 8").groupBy(F.col("map_id").alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    rates = R.messages(spark, sf).groupBy("lang").agg(
        F.avg((F.col("integrity") == "CORRECT_ACCEPT").cast("double")).alias("correct"), F.avg((F.col("integrity") == "REJECT").cast("double")).alias("reject")
    )
    return rounded(summaries.stratum_totals(counts, rates, "lang", ["correct", "reject"]), 6)


CAND_SQL = """cand AS (SELECT l_partkey AS series_id, l_orderkey % 3 AS layout, l_suppkey % 8 AS candidate_order, min(l_linenumber) AS nonpositive_count,
  max(l_discount) AS minimum_margin, max(l_tax) AS mean_margin, max(l_linenumber) AS dummy_count, sum(l_linenumber)::BIGINT AS errors, sum(l_quantity)::BIGINT AS bits FROM lineitem GROUP BY ALL),
 ks AS (SELECT c.*, k FROM cand c, (SELECT unnest([1,2,4,8]) AS k) WHERE candidate_order < k),
 choice AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, layout, k ORDER BY nonpositive_count, minimum_margin DESC, mean_margin DESC, candidate_order) AS rn,
   row_number() OVER (PARTITION BY series_id, layout, k ORDER BY dummy_count, minimum_margin DESC, mean_margin DESC, candidate_order) AS rd,
   row_number() OVER (PARTITION BY series_id, layout, k ORDER BY errors / bits, candidate_order) AS ro,
   row_number() OVER (PARTITION BY series_id, layout, k ORDER BY candidate_order) AS rb FROM ks))"""
KS = (1, 2, 4, 8)


def candidates(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("series_id"), (F.col("l_orderkey") % 3).alias("layout"), (F.col("l_suppkey") % 8).alias("candidate_order")).agg(
        F.min("l_linenumber").alias("nonpositive_count"),
        F.max("l_discount").alias("minimum_margin"),
        F.max("l_tax").alias("mean_margin"),
        F.max("l_linenumber").alias("dummy_count"),
        F.sum("l_linenumber").alias("errors"),
        F.sum("l_quantity").cast("long").alias("bits"),
    )


def choices(spark, sf):
    each = candidates(spark, sf).withColumn("k", F.explode(F.array(*[F.lit(k) for k in KS]))).where("candidate_order < k")

    def best(first):
        order = F.struct(first, -F.col("minimum_margin"), -F.col("mean_margin"), "candidate_order")
        return F.min_by("candidate_order", order)

    return each.groupBy("series_id", "layout", "k").agg(best("nonpositive_count").alias("chosen"), best("dummy_count").alias("dummy"))


@query(
    "a18_selection_variation",
    with_sql(CAND_SQL, "c AS (SELECT series_id, layout, k, candidate_order AS chosen FROM choice WHERE rn = 1)")
    + " UNION ALL ".join(
        f"""SELECT k, '{n}' AS comparison, count(*) AS groups, {rnd('avg((d > 1)::INT)')} AS share_multiple, {rnd('avg(d)')} AS mean_distinct FROM
            (SELECT k, {g}, count(DISTINCT chosen) AS d FROM c GROUP BY k, {g}) GROUP BY k"""
        for n, g in (("across_layouts", "series_id"), ("across_series", "layout"))
    ),
)
def _(spark, sf):
    scopes = {"across_layouts": ["series_id", "k"], "across_series": ["layout", "k"]}
    return rounded(summaries.selection_variation(choices(spark, sf), scopes, "chosen"))


@query(
    "a18_selection_frequency",
    with_sql(CAND_SQL) + f"SELECT k, candidate_order AS chosen, count(*) AS n, {rnd('count(*) / sum(count(*)) OVER (PARTITION BY k)')} AS fraction FROM choice WHERE rn = 1 GROUP BY k, candidate_order",
)
def _(spark, sf):
    counts = choices(spark, sf).groupBy("k", "chosen").agg(F.count(F.lit(1)).alias("n"))
    return rounded(ranking.group_share(counts, ["k"], "n", "fraction"))


@query(
    "a19_side_information",
    with_sql(R.MESSAGES_SQL)
    + f"""SELECT k, max(ceil(log2(k)))::BIGINT AS side_bits, count(*) AS messages, sum(useful_bits)::BIGINT AS useful_bits,
          {rnd('max(ceil(log2(k))) * count(*) / sum(useful_bits)')} AS side_share FROM messages, (SELECT unnest([1,2,4,8]) AS k) GROUP BY k""",
)
def _(spark, sf):
    m = R.messages(spark, sf).withColumn("k", F.explode(F.array(*[F.lit(k) for k in KS])))
    return rounded(summaries.side_information(m))


@query(
    "a20_design_oracle",
    with_sql(CAND_SQL)
    + f"""SELECT k, {rnd('sum(errors) FILTER (rb = 1) / sum(bits) FILTER (rb = 1)')} AS baseline, {rnd('sum(errors) FILTER (rn = 1) / sum(bits) FILTER (rn = 1)')} AS selector,
          {rnd('sum(errors) FILTER (ro = 1) / sum(bits) FILTER (ro = 1)')} AS oracle FROM choice GROUP BY k""",
)
def _(spark, sf):
    return rounded(summaries.design_oracle(candidates(spark, sf), ["series_id", "layout"], KS))


BLIND_SQL = """bl AS (SELECT msg_id, any_value(lang) AS lang, count(*) FILTER (reason='accepted') AS n, min(decoded_info) FILTER (reason='accepted') AS lo,
  max(decoded_info) FILTER (reason='accepted') AS hi, arg_min(info, word_idx) AS truth FROM decoded GROUP BY msg_id),
 bd AS (SELECT *, CASE WHEN lo IS NULL THEN 'no_accepted_hypothesis' WHEN lo <> hi THEN 'ambiguous_messages' ELSE 'accepted' END AS decision, coalesce(lo = hi AND lo = truth, false) AS correct FROM bl)"""


def blind(spark, sf):
    from pulsemark.operators import coding as C
    from pulsemark.operators import marking

    w = R.decoded_words(spark, sf)
    hyp = w.select("msg_id", (F.col("reason") == C.ACCEPTED).alias("accepted"), F.col("decoded_info").alias("message"))
    truth = w.groupBy("msg_id").agg(F.min_by("info", "word_idx").alias("truth"), F.max("lang").alias("lang"))
    return marking.blind_decision(hyp, ["msg_id"]).join(truth, "msg_id").withColumn("correct", F.coalesce(F.col("message") == F.col("truth"), F.lit(False)))


@query(
    "a21_blind_summary",
    with_sql(R.WORDS_SQL, BLIND_SQL)
    + f"""SELECT lang, count(*) AS configs, count(*) FILTER (decision='accepted' AND correct) AS correct_accept, count(*) FILTER (decision='accepted' AND NOT correct) AS wrong_accept,
        count(*) FILTER (decision<>'accepted') AS reject, count(*) FILTER (decision='ambiguous_messages') AS ambiguous_reject,
        count(*) FILTER (decision='no_accepted_hypothesis') AS zero_candidate_reject, {rnd('avg(n)')} AS mean_accepted_hypotheses,
        {rnd("count(*) FILTER (decision='accepted' AND correct) / nullif(count(*) FILTER (decision='accepted'), 0)")} AS accepted_accuracy FROM bd GROUP BY lang""",
)
def _(spark, sf):
    return rounded(summaries.blind_summary(blind(spark, sf), ["lang"]))


@query(
    "a21_wrong_hypotheses",
    with_sql(R.WORDS_SQL)
    + """SELECT word_idx, count(*) AS wrong_hypotheses, count(*) FILTER (reason='accepted') AS passed, count(*) FILTER (reason='accepted' AND decoded_info = info) AS same_message,
         count(*) FILTER (reason='accepted' AND decoded_info <> info) AS different_message FROM decoded WHERE word_idx > 0 GROUP BY word_idx""",
)
def _(spark, sf):
    from pulsemark.operators import coding as C

    w = R.decoded_words(spark, sf).select(
        "word_idx", (F.col("word_idx") == 0).alias("selected"), (F.col("reason") == C.ACCEPTED).alias("accepted"), (F.col("decoded_info") == F.col("info")).alias("matches")
    )
    return summaries.wrong_hypotheses(w, ["word_idx"])


@query(
    "a22_means_by_key",
    with_sql(R.RESULTS_SQL, "p AS (SELECT condition, seed, avg(bits) AS bits, avg(errors) AS errors FROM results GROUP BY ALL)")
    + f"SELECT condition, {rnd('avg(bits)', 7)} AS bits_mean, {rnd('avg(errors)', 7)} AS errors_mean, {rnd('stddev_samp(bits)', 6)} AS bits_layout_sd, {rnd('stddev_samp(errors)', 6)} AS errors_layout_sd FROM p GROUP BY condition",
)
def _(spark, sf):
    return rounded(summaries.means_by_key(R.results(spark, sf), "condition", "seed", ["bits", "errors"]), 7, bits_layout_sd=6, errors_layout_sd=6)


@query(
    "a23_class_contrast",
    with_sql(
        R.RESULTS_SQL,
        """c AS (SELECT *, CASE WHEN condition IN ('A','R') THEN 'structured' ELSE 'random' END AS payload_class FROM results),
        o AS (SELECT *, row_number() OVER (PARTITION BY payload_class, map_id, seed, shift ORDER BY condition, errors, bits) AS rn FROM c)""",
    )
    + f"SELECT payload_class, count(*) AS rows, sum(errors)::BIGINT AS errors, sum(bits)::BIGINT AS bits, {rnd('sum(errors) / sum(bits)')} AS error_rate FROM o WHERE rn = 1 GROUP BY payload_class",
)
def _(spark, sf):
    return rounded(summaries.class_contrast(R.results(spark, sf), "condition", ("A", "R"), ["map_id", "seed"], "shift"))


@query(
    "a23_payload_symmetry",
    with_sql(
        R.RESULTS_SQL,
        """w AS (SELECT map_id, max(word) FILTER (condition = 'A') AS a, max(word) FILTER (condition = 'R') AS b FROM
             (SELECT map_id, condition, max(series_id) % 65536 AS word FROM results GROUP BY ALL) GROUP BY map_id),
        h AS (SELECT bit_count(xor(a, b)) AS far FROM w WHERE a IS NOT NULL AND b IS NOT NULL)""",
    )
    + f"""SELECT (SELECT count(*) FROM h) AS units, (SELECT {rnd('sum(far) / (count(*) * 16)')} FROM h) AS hamming_fraction_weighted, (SELECT {rnd('avg(far / 16)')} FROM h) AS hamming_fraction_mean,
          {rnd("sum(errors) FILTER (condition = 'R') / sum(bits) FILTER (condition = 'R') - sum(errors) FILTER (condition = 'A') / sum(bits) FILTER (condition = 'A')")} AS error_rate_difference,
          {rnd("avg(shift) FILTER (condition = 'R') - avg(shift) FILTER (condition = 'A')", 7)} AS mean_shift_difference,
          {rnd("avg(score) FILTER (condition = 'R') - avg(score) FILTER (condition = 'A')", 5)} AS mean_score_difference FROM results""",
)
def _(spark, sf):
    rows = R.results(spark, sf)
    words = rows.groupBy("map_id", "condition").agg((F.max("series_id") % 65536).cast("long").alias("word"))
    out = summaries.payload_symmetry(words, rows, "condition", "map_id", "word", 16, "A", "R", ("errors", "bits"), ("shift", "score"))
    return rounded(out, mean_shift_difference=7, mean_score_difference=5)


@query(
    "a24_selection_agreement",
    with_sql(CAND_SQL, "c AS (SELECT series_id, layout, k, max(candidate_order) FILTER (rn = 1) AS a, max(candidate_order) FILTER (rd = 1) AS b FROM choice GROUP BY ALL)")
    + f"SELECT k, count(*) AS units, {rnd('avg((a = b)::INT)')} AS same_share FROM c GROUP BY k",
)
def _(spark, sf):
    same = F.avg((F.col("chosen") == F.col("dummy")).cast("double")).alias("same_share")
    return rounded(choices(spark, sf).groupBy("k").agg(F.count(F.lit(1)).alias("units"), same))


@query(
    "a25_design_audit",
    with_sql(
        R.RESULTS_SQL,
        """r AS (SELECT map_id, seed, errors / bits AS v FROM results), w AS (SELECT map_id, round(avg(v), 9) AS allv FROM r GROUP BY 1),
        p AS (SELECT k, map_id, round(avg(v), 9) AS part FROM r, (SELECT unnest([1,2,3]) AS k) WHERE seed < k GROUP BY ALL),
        j AS (SELECT k, part, allv, rank() OVER (PARTITION BY k ORDER BY part) + (count(*) OVER (PARTITION BY k, part) - 1) / 2.0::DOUBLE AS rp,
              rank() OVER (PARTITION BY k ORDER BY allv) + (count(*) OVER (PARTITION BY k, allv) - 1) / 2.0::DOUBLE AS ra FROM p JOIN w ON w.map_id = p.map_id)""",
    )
    + f"""SELECT k, count(*) AS units, {rnd('corr(part, allv)', 7)} AS pearson, {rnd('avg(abs(part - allv))', 7)} AS mean_abs_gap, {rnd('max(abs(part - allv))', 7)} AS max_abs_gap,
          {rnd('stddev_samp(part)', 7)} AS sd, {rnd('corr(rp, ra)', 7)} AS spearman FROM j GROUP BY k""",
)
def _(spark, sf):
    rows = R.results(spark, sf).withColumn("v", F.col("errors") / F.col("bits"))
    return rounded(summaries.design_audit(rows, "map_id", "seed", "v", (1, 2, 3)), 7)


@query(
    "a26_seed_collisions",
    "SELECT ('0x' || substr(sha256('layout|' || o_orderkey), 1, 8))::BIGINT % 65536 AS seed, count(*) AS holders FROM orders GROUP BY 1 HAVING count(*) > 1",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select((H.seed32("layout", F.col("o_orderkey")) % 65536).alias("seed"))
    return summaries.seed_collisions(o, "seed")


def listed(df, column: str, name: str):
    """A map column as text, its entries in key order."""
    entries = F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return df.withColumn(name, F.coalesce(F.array_join(entries, ","), F.lit(""))).drop(column)


# ---- confidence ------------------------------------------------------------------------------

BIN_COLS = f"""count(*) AS bits, sum(is_error)::BIGINT AS errors, {rnd('avg(is_error)')} AS error_rate, {rnd('avg(abs_correlation)', 7)} AS mean_abs_correlation,
   min(abs_correlation) AS min_abs_correlation, max(abs_correlation) AS max_abs_correlation"""
FRACTIONS = (0.0, 0.05, 0.1, 0.2)


@query(
    "x01_coverage_curve",
    with_sql(
        R.BITS_SQL,
        "t AS ("
        + " UNION ALL ".join(f"SELECT {f}::DOUBLE AS fraction, round(quantile_cont(abs_correlation, {f}), 9) AS threshold FROM bit_rows WHERE side = 0" for f in FRACTIONS)
        + "), g AS (SELECT side, fraction, threshold, is_error = 1 AS bad, fraction > 0 AND abs_correlation <= threshold AS gone FROM bit_rows, t)",
    )
    + f"""SELECT side, fraction, {rnd('threshold')} AS threshold, count(*) FILTER (NOT gone) AS retained_bits, {rnd('count(*) FILTER (NOT gone) / count(*)')} AS retained_share,
        count(*) FILTER (NOT gone AND bad) AS retained_errors, {rnd('count(*) FILTER (NOT gone AND bad) / count(*) FILTER (NOT gone)')} AS retained_error_rate,
        count(*) FILTER (gone AND bad) AS erased_errors, {rnd('count(*) FILTER (gone AND bad) / count(*) FILTER (bad)')} AS captured_share FROM g GROUP BY side, fraction, threshold""",
)
def _(spark, sf):
    b = bits_and_hot(spark, sf)[0]
    return rounded(confidence.coverage_curve(b, b.where("side = 0"), FRACTIONS))


@query(
    "x02_reliability_bins",
    with_sql(
        R.BITS_SQL,
        f"e AS ({edges_sql('bit_rows WHERE side = 0', 'abs_correlation')})",
        "b AS (SELECT *, len(list_filter(edges[2:10], lambda x: x <= abs_correlation)) AS bin FROM bit_rows, e)",
        f"""g AS (SELECT side, bin, {BIN_COLS}, {rnd('quantile_cont(abs_correlation, 0.5)', 7)} AS median_abs_correlation, {rnd('avg(bit_index)')} AS mean_valid_carriers FROM b GROUP BY side, bin)""",
        "f AS (SELECT side, bin, string_agg(k || ':' || n, ',' ORDER BY k) AS factors FROM (SELECT side, bin, true_bit::VARCHAR AS k, count(*) AS n FROM b GROUP BY ALL) GROUP BY side, bin)",
        "cells AS (SELECT side, bin FROM (SELECT DISTINCT side FROM bit_rows), (SELECT unnest(range(0, 10)) AS bin))",
    )
    + """SELECT c.side, c.bin, edges[c.bin + 1] AS threshold_low, edges[c.bin + 2] AS threshold_high, coalesce(bits, 0) AS bits, coalesce(errors, 0) AS errors, error_rate,
           mean_abs_correlation, min_abs_correlation, max_abs_correlation, median_abs_correlation, mean_valid_carriers, coalesce(factors, '') AS factors
         FROM cells c CROSS JOIN e LEFT JOIN g ON g.side = c.side AND g.bin = c.bin LEFT JOIN f ON f.side = c.side AND f.bin = c.bin""",
)
def _(spark, sf):
    b = bits_and_hot(spark, sf)[0]
    out = confidence.reliability_bins(b, b.where("side = 0"), 10, "true_bit", "bit_index")
    return rounded(listed(out, "factor_counts", "factors"), mean_abs_correlation=7, median_abs_correlation=7)


@query(
    "x02_rank_bins",
    with_sql(
        R.BITS_SQL,
        "r AS (SELECT *, row_number() OVER (ORDER BY abs_correlation, event_id) - 1 AS rk, count(*) OVER () AS n FROM bit_rows)",
        "b AS (SELECT *, greatest(0, (rk * 10 + n - 2) // (n - 1) - 1) AS bin FROM r)",
    )
    + f"SELECT bin, {BIN_COLS} FROM b GROUP BY bin",
)
def _(spark, sf):
    return rounded(confidence.rank_bins(bits_and_hot(spark, sf)[0], ["abs_correlation", "event_id"]), mean_abs_correlation=7)


@query(
    "x03_key_confidence",
    with_sql(
        R.BITS_SQL,
        """h AS (SELECT side, -abs_correlation AS s, sum(is_error) AS p, sum(1 - is_error) AS q FROM bit_rows GROUP BY ALL),
        hp AS (SELECT *, sum(q) OVER (PARTITION BY side ORDER BY s) - q AS qb FROM h),
        a AS (SELECT side, sum(p)::BIGINT AS n_pos, sum(q)::BIGINT AS n_neg, sum(p * (qb + q / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(q)) AS auc FROM hp GROUP BY side),
        d AS (SELECT side, round(quantile_cont(abs_correlation, 0.1), 9) AS d FROM bit_rows GROUP BY side)""",
    )
    + f"""SELECT b.side, any_value(n_pos) AS n_pos, any_value(n_neg) AS n_neg, {rnd('any_value(auc)')} AS low_confidence_auc,
        {rnd('quantile_cont(abs_correlation, 0.5) FILTER (is_error = 0)')} AS median_correct, {rnd('quantile_cont(abs_correlation, 0.5) FILTER (is_error = 1)')} AS median_error,
        {rnd('avg(is_error) FILTER (abs_correlation <= d)')} AS lowest_decile_error_rate FROM bit_rows b JOIN a ON a.side = b.side JOIN d ON d.side = b.side GROUP BY b.side""",
)
def _(spark, sf):
    return rounded(confidence.key_confidence(bits_and_hot(spark, sf)[0], "side"))


DETAIL_SQL = R.WORDS_SQL + """,
det AS (SELECT *, bit_count(flips) AS raw_errors, CASE WHEN decoded_info <> info AND status <> 'detected_double' THEN 'silent_miscorrected' WHEN status = 'clean' THEN 'correct_clean'
   WHEN status = 'corrected_single' THEN 'correct_repaired' ELSE 'detected_rejected' END AS category FROM decoded),
ranked AS (SELECT msg_id, word_idx, category, raw_errors, position, flips, p, row_number() OVER (PARTITION BY msg_id, word_idx ORDER BY weights[p + 1], p) - 1 AS rk
   FROM (SELECT *, unnest(range(0,8)) AS p FROM det))"""


@query(
    "x04_codeword_summary",
    with_sql(DETAIL_SQL)
    + f"""SELECT lang, category, count(*) AS words, sum(raw_errors)::BIGINT AS raw_errors, {rnd('avg(weights[1])')} AS mean_first_confidence,
          {rnd('avg(list_min(weights))')} AS mean_lowest_confidence FROM det GROUP BY lang, category""",
)
def _(spark, sf):
    return rounded(confidence.codeword_summary(confidence.codeword_details(R.decoded_words(spark, sf)), ["lang"]))


@query(
    "x04_miscorrection_ranks",
    with_sql(DETAIL_SQL)
    + f"""SELECT raw_errors, count(DISTINCT msg_id * 4 + word_idx) AS words, count(*) FILTER ((flips >> p::INT) & 1 = 1) AS wrong_bits,
          count(*) FILTER ((flips >> p::INT) & 1 = 1 AND rk = 0) AS lowest_count, {rnd('avg(rk) FILTER ((flips >> p::INT) & 1 = 1)')} AS mean_rank
        FROM ranked WHERE category = 'silent_miscorrected' GROUP BY raw_errors""",
)
def _(spark, sf):
    return rounded(confidence.miscorrection_ranks(confidence.codeword_details(R.decoded_words(spark, sf))))


@query(
    "x05_bit_value_asymmetry",
    with_sql(R.BITS_SQL) + f"SELECT true_bit, count(*) AS bits, sum(is_error)::BIGINT AS errors, {rnd('avg(is_error)')} AS error_rate FROM bit_rows GROUP BY true_bit",
)
def _(spark, sf):
    return rounded(confidence.bit_value_asymmetry(bits_and_hot(spark, sf)[0]))


def _host(spark, sf):
    from pulsemark.operators import marking
    from pulsemark.plans.series import bit_of, carried

    clean = marking.correlate(carried(spark, sf), "residual")
    return clean.withColumn("bit", bit_of())


def _host_sql() -> str:
    from pulsemark.plans.series import CAR_SQL

    return (
        with_sql(CAR_SQL, "c AS (SELECT series_id, bit_idx, any_value(bit) AS bit, any_value(bit) * coalesce(sum(residual * chip), 0) AS p FROM car WHERE bit_idx IS NOT NULL GROUP BY ALL)")
        + f"SELECT bit, count(*) AS bits, {rnd('avg(p)', 6)} AS mean, {rnd('stddev_pop(p)', 6)} AS sd, {rnd('avg((p < 0)::INT)')} AS share_against FROM c GROUP BY bit"
    )


@query("x05_host_projection", _host_sql())
def _(spark, sf):
    return rounded(confidence.host_projection(_host(spark, sf), "bit"), mean=6, sd=6)


@query(
    "x06_position_errors",
    with_sql(R.WORDS_SQL, "e AS (SELECT lang, p::INT AS position, ((flips >> p::INT) & 1) AS is_error FROM (SELECT lang, flips, unnest(range(0,8)) AS p FROM words))")
    + f"""SELECT position, coalesce(lang, 'ALL') AS lang, count(*) AS bits, sum(is_error)::BIGINT AS errors, {rnd('avg(is_error)')} AS error_rate
          FROM e GROUP BY GROUPING SETS ((position), (position, lang))""",
)
def _(spark, sf):
    return rounded(confidence.position_errors(R.words(spark, sf), "lang"))


@query(
    "x07_length_strata",
    with_sql(R.MESSAGES_SQL.replace("messages AS (", "messages1 AS ("), "messages AS (SELECT *, n_chars // 1000 AS length_stratum FROM messages1)") + _outcomes("length_stratum"),
)
def _(spark, sf):
    m = R.messages(spark, sf).withColumn("length_stratum", F.floor(F.col("n_chars") / 1000))
    return rounded(summaries.outcome_summary(m, ["length_stratum"], "integrity"))


@query(
    "x08_corrected_ranks",
    with_sql(DETAIL_SQL)
    + f"""SELECT category, count(*) AS words, {rnd('avg(rk)')} AS mean_rank, {rnd('quantile_cont(rk, 0.5)')} AS median_rank, 
          (SELECT string_agg(k || ':' || n, ',' ORDER BY k) FROM (SELECT rk::VARCHAR AS k, count(*) AS n FROM ranked i WHERE i.p = i.position AND i.category = o.category GROUP BY 1)) AS ranks
          FROM ranked o WHERE p = position GROUP BY category""",
)
def _(spark, sf):
    out = confidence.corrected_ranks(confidence.codeword_details(R.decoded_words(spark, sf)))
    return rounded(listed(out, "rank_counts", "ranks"))


# ---- gates -----------------------------------------------------------------------------------


@query("v01_label_pairs", "SELECT l_orderkey, count(*) AS rows FROM lineitem GROUP BY 1 HAVING NOT (count(*) FILTER (l_linestatus='O') = 1 AND count(*) FILTER (l_linestatus='F') = 1) OR count(*) <> 2")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("label", (F.col("l_linestatus") == "O").cast("int"))
    return gates.label_pairs(li, ["l_orderkey"], "label")


@query("v01_missing_conditions", "SELECT l_partkey, count(DISTINCT l_returnflag) AS conditions FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY 1 HAVING count(DISTINCT l_returnflag) < 3")
def _(spark, sf):
    rich = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    li = table(spark, sf, "lineitem").join(rich, "l_suppkey", "left_semi")
    return gates.missing_conditions(li, ["l_partkey"], "l_returnflag", ("A", "N", "R"))


@query(
    "v02_varying_columns",
    "SELECT l_orderkey, list_filter([CASE WHEN min(l_returnflag) <> max(l_returnflag) THEN 'l_returnflag' END, CASE WHEN min(l_suppkey) <> max(l_suppkey) THEN 'l_suppkey' END], lambda x: x IS NOT NULL) AS columns FROM lineitem GROUP BY 1 HAVING min(l_returnflag) <> max(l_returnflag) OR min(l_suppkey) <> max(l_suppkey)",
)
def _(spark, sf):
    return gates.varying(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_suppkey"])


@query("v02_energy_rule", "SELECT l_orderkey, l_linenumber, ['energy'] AS rules FROM lineitem WHERE NOT (round(l_quantity * l_discount * l_discount, 6) <= 0.4)")
def _(spark, sf):
    rule = F.round(F.col("l_quantity") * F.col("l_discount") * F.col("l_discount"), 6) <= 0.4
    return gates.expression_violations(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], {"energy": rule})


@query(
    "v02_not_finite",
    "SELECT series_id, list_filter([CASE WHEN t IS NULL THEN 'total' END, CASE WHEN c IS NULL THEN 'spread' END], lambda x: x IS NOT NULL) AS columns FROM (SELECT c_custkey AS series_id, sum(o_totalprice) AS t, CASE WHEN count(o_orderkey) > 1 THEN stddev_samp(o_totalprice) END AS c FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) WHERE t IS NULL OR c IS NULL",
)
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("series_id")).agg(
        F.sum("o_totalprice").alias("total"), F.when(F.count(F.lit(1)) > 1, F.stddev_samp("o_totalprice")).alias("spread")
    )
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("series_id"))
    return gates.not_finite(c.join(o, "series_id", "left"), ["series_id"], ["total", "spread"])


@query(
    "v03_totals_mismatch",
    """SELECT coalesce(o_orderkey, k) AS o_orderkey, ['lines'] AS columns FROM orders FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) ON k = o_orderkey
       WHERE NOT coalesce(abs(4 - n) <= 1e-9 AND o_orderkey IS NOT NULL, false)""",
)
def _(spark, sf):
    parts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("one"))
    parent = table(spark, sf, "orders").select("o_orderkey", F.lit(4).alias("lines"))
    return gates.totals_mismatch(parts, parent, ["o_orderkey"], {"lines": "one"})


@query(
    "v04_diagnostics",
    """SELECT 'duplicate_orders' AS "check", (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS value, 0::BIGINT AS expected, true AS ok
       UNION ALL SELECT 'duplicate_lines', n, 0, n = 0 FROM (SELECT count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))""",
)
def _(spark, sf):
    return gates.diagnostics(
        {
            "duplicate_orders": (gates.duplicate_keys(table(spark, sf, "orders"), ["o_orderkey"]), 0),
            "duplicate_lines": (gates.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]), 0),
        }
    )


@query(
    "v05_drift",
    f"""SELECT coalesce(c_custkey, o_custkey) AS series_id, {rnd('abs(c_acctbal - t)', 4)} AS max_gap, c_custkey IS NULL OR t IS NULL AS missing FROM customer
       FULL JOIN (SELECT o_custkey, max(o_totalprice) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE t IS NULL OR abs(c_acctbal - t) > 100000""",
)
def _(spark, sf):
    stored = table(spark, sf, "customer").select(F.col("c_custkey").alias("series_id"), F.col("c_acctbal").alias("v"))
    again = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("series_id")).agg(F.max("o_totalprice").alias("v"))
    return rounded(gates.drift(again, stored, ["series_id"], ["v"], 100000), 4)


@query("v06_dataset_gate", "SELECT r_regionkey AS s_nationkey, count(*) AS rows FROM (SELECT s_nationkey AS r_regionkey FROM supplier) GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    s = table(spark, sf, "supplier")
    return gates.dataset_gate(s, ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], ["s_nationkey"])


# ---- sources and incremental tables ------------------------------------------------------------


def scratch_path(spark, name):
    """A new folder below the shared checkpoint folder, for queries that write and read back."""
    return f"{ensure_checkpoint_dir(spark)}/pulsemark-{name}-{uuid.uuid4().hex}"


def page_files(spark, sf):
    return table(spark, sf, "pages").select(F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content"), "page_id")


@query("s01_pruned_scan", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def _(spark, sf):
    from pulsemark.sources.tables import read_table

    schema = table(spark, sf, "orders").schema
    o = read_table(spark, f"{sf}/orders.parquet", "parquet", schema, ["o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"])
    return o.where("o_orderstatus = 'F' AND o_totalprice > 100000").select("o_orderkey", "o_orderpriority")


@query("s02_strict_read", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, sf):
    from pulsemark.sources.tables import read_strict_csv

    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = scratch_path(spark, "strict")
    store.append(o, path, "csv")
    return read_strict_csv(spark, path, o.schema)


@query(
    "s03_offset_maps",
    """SELECT 'customer-' || c_custkey AS map_id, (round(c_acctbal))::INT AS offset_ms FROM customer
       UNION ALL SELECT 'supplier-' || s_suppkey, (round(s_acctbal))::INT FROM supplier""",
)
def _(spark, sf):
    """One flat and one nested offset map per nation, written as JSON files and read back."""
    from pulsemark.sources.tables import read_offsets

    def maps(name, key, nation, balance):
        entry = F.struct(F.concat(F.lit(f"{name}-"), key), F.round(balance).cast("int"))
        return table(spark, sf, name).groupBy(nation).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))

    path = scratch_path(spark, "offsets")
    flat = maps("customer", "c_custkey", "c_nationkey", "c_acctbal").select(F.to_json("m").alias("value"))
    nested = maps("supplier", "s_suppkey", "s_nationkey", "s_acctbal").select(F.to_json(F.struct(F.col("m").alias("offsets"))).alias("value"))
    for docs in (flat, nested):
        docs.write.option("maxRecordsPerFile", 1).mode("append").text(path)
    return read_offsets(spark, path).select("map_id", "offset_ms")


@query("s04_hash_index", "SELECT md5(html) AS md5, min(url) AS path, count(*) AS copies FROM pages GROUP BY 1")
def _(spark, sf):
    return files.hash_index(page_files(spark, sf))


@query("s05_file_sha256", "SELECT url AS path, sha256(html) AS sha256 FROM pages")
def _(spark, sf):
    return files.with_sha256(page_files(spark, sf))


@query(
    "s06_upsert",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority <> '1-URGENT' UNION ALL SELECT o_orderkey, 'X', o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    cols = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    batch = o.where("o_orderpriority = '1-URGENT'").withColumn("o_orderstatus", F.lit("X"))
    return store.upsert(o.select(*cols), batch.select(*cols), ["o_orderkey"])


@query(
    "s06_snapshot_replace",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') UNION ALL SELECT o_orderkey, 'X', o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, 'Y', o_totalprice FROM orders WHERE o_orderpriority = '2-HIGH'",
)
def _(spark, sf):
    """A snapshot table made, replaced in two steps by key, and read back."""
    from pulsemark.sources.snapshots import Snapshots

    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    stored = Snapshots(spark, scratch_path(spark, "snapshots"), ["o_orderkey"], 8)
    stored.replace(o.drop("o_orderpriority"))
    for priority, status in (("1-URGENT", "X"), ("2-HIGH", "Y")):
        stored.replace(o.where(F.col("o_orderpriority") == priority).withColumn("o_orderstatus", F.lit(status)).drop("o_orderpriority"))
    stored.collect_garbage()
    return stored.read()


@query(
    "s06_incremental_run",
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'ERROR' ELSE 'OK' END AS status, CASE WHEN c_custkey % 2 = 0 OR c_acctbal < 0 THEN 2 ELSE 1 END AS attempt FROM customer",
)
def _(spark, sf):
    """Half of the cells run first; a second run takes the rest and what failed, and replaces it by key."""
    from pulsemark.sources.snapshots import Snapshots, incremental_run

    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    stored = Snapshots(spark, scratch_path(spark, "runs"), ["c_custkey"], 8)

    def attempt(k):
        status = F.when(F.col("c_acctbal") < 0, "ERROR").otherwise("OK")
        return lambda cells: cells.join(c, "c_custkey").select("c_custkey", status.alias("status"), F.lit(k).alias("attempt"))

    incremental_run(stored, c.where("c_custkey % 2 = 1").select("c_custkey"), attempt(1), batches=2)
    incremental_run(stored, c.select("c_custkey"), attempt(2))
    return stored.read()


@query(
    "s08_append_with_header",
    "SELECT o_orderpriority, count(*) AS orders, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1",
)
def _(spark, sf):
    """Batches appended to one CSV folder, each with its header; read back by the header of each file."""
    from pulsemark.sources.tables import read_by_header

    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    path = scratch_path(spark, "appended")
    store.append(o.where("o_orderpriority < '3'"), path, "csv")
    store.append(o.where("o_orderpriority >= '3'").select("o_orderpriority", "o_orderkey"), path, "csv")  # another column order
    back = read_by_header(spark, path, ["o_orderkey", "o_orderpriority"])
    return back.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_orderkey").cast("long")).alias("keys"))


@query(
    "s07_append_unique",
    """WITH b AS (SELECT l_orderkey AS o_orderkey, max(l_extendedprice) AS o_totalprice FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
       SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b) UNION ALL SELECT * FROM b""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    batch = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("o_totalprice"))
    return store.append_unique(o, batch, ["o_orderkey"], ["o_totalprice"])


DONE_SQL = """st AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'OK' WHEN 'O' THEN 'ERROR' ELSE 'SKIP_CAPACITY' END AS status FROM orders),
 k AS (SELECT l_orderkey, bool_or(l_returnflag='A') AND bool_or(l_returnflag='R') AS ok FROM lineitem GROUP BY 1),
 done AS (SELECT o_orderkey FROM st LEFT JOIN k ON l_orderkey = o_orderkey WHERE status = 'SKIP_CAPACITY' OR (status = 'OK' AND coalesce(ok, false)))"""


def completed(spark, sf):
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "OK").when(F.col("o_orderstatus") == "O", "ERROR").otherwise("SKIP_CAPACITY")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    both = F.max(F.col("l_returnflag") == "A") & F.max(F.col("l_returnflag") == "R")
    return store.completed_keys(o.select("o_orderkey", status.alias("status")), "o_orderkey", {"labels": (lines, both)})


@query("s09_completed_keys", with_sql(DONE_SQL) + "SELECT o_orderkey FROM done")
def _(spark, sf):
    return completed(spark, sf)


@query("s09_remaining_cells", with_sql(DONE_SQL) + "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM done)")
def _(spark, sf):
    return store.remaining(table(spark, sf, "orders").select("o_orderkey"), completed(spark, sf), ["o_orderkey"])


@query(
    "s10_rejects",
    "SELECT doc_id, CASE WHEN length(text) = 0 THEN 'empty' WHEN n_chars < 200 THEN 'too_short' ELSE 'other_language' END AS reason FROM documents WHERE length(text) = 0 OR n_chars < 200 OR lang <> 'en'",
)
def _(spark, sf):
    rules = {"empty": F.length("text") == 0, "too_short": F.col("n_chars") < 200, "other_language": F.col("lang") != "en"}
    return store.split_rejects(table(spark, sf, "documents"), rules)[1].select("doc_id", "reason")


@query(
    "s11_historical_ids",
    """WITH u AS (SELECT 'series' AS entity, o_custkey::VARCHAR AS id, 'orders' AS source FROM orders UNION SELECT 'series', c_custkey::VARCHAR, 'customer' FROM customer
         UNION SELECT 'map', c_nationkey::VARCHAR, 'customer' FROM customer UNION SELECT 'map', s_nationkey::VARCHAR, 'supplier' FROM supplier UNION SELECT 'map', n_nationkey::VARCHAR, 'nation' FROM nation)
       SELECT entity, id, count(DISTINCT source) AS source_count, list_sort(list(DISTINCT source)) AS sources FROM u GROUP BY ALL""",
)
def _(spark, sf):
    tables = {t: table(spark, sf, t) for t in ("orders", "customer", "supplier", "nation")}
    return files.historical_ids(tables, {"series": ["o_custkey", "c_custkey"], "map": ["c_nationkey", "s_nationkey", "n_nationkey"]})


@query(
    "s11_directory_scan",
    """WITH u AS (SELECT 'series' AS entity, o_custkey::VARCHAR AS id, 'orders' AS source FROM orders UNION SELECT 'series', c_custkey::VARCHAR, 'customer' FROM customer
         UNION SELECT 'name', lower(c_name), 'customer' FROM customer UNION SELECT 'name', lower(s_name), 'supplier' FROM supplier UNION SELECT 'map', c_nationkey::VARCHAR, 'customer' FROM customer
         UNION SELECT 'map', s_nationkey::VARCHAR, 'supplier' FROM supplier UNION SELECT 'map', n_nationkey::VARCHAR, 'nation' FROM nation)
       SELECT entity, id, count(DISTINCT source) AS source_count, list_sort(list(DISTINCT source)) AS sources FROM u GROUP BY ALL""",
)
def _(spark, sf):
    """Tables written as CSV files below one folder; every file is read by its own header."""
    path = scratch_path(spark, "history")
    for name, columns in {"orders": ["o_orderkey", "o_custkey"], "customer": ["c_name", "c_custkey", "c_nationkey"], "supplier": ["s_nationkey", "s_name"], "nation": ["n_name", "n_nationkey"], "region": ["r_name"]}.items():
        store.append(table(spark, sf, name).select(*columns), f"{path}/{name}", "csv")
    entities = {"series": ["o_custkey", "c_custkey"], "map": ["c_nationkey", "s_nationkey", "n_nationkey"], "name": ["c_name", "s_name"]}
    return files.historical_ids_in(spark, path, entities, source="/([^/]+)/[^/]+$")


@query(
    "s12_manifest_audit",
    """WITH m AS (SELECT url AS path, CASE WHEN page_id % 11 = 3 THEN 'x' ELSE sha256(html) END AS want FROM pages WHERE length(html) > 500 UNION ALL SELECT url || '/old', 'y' FROM pages WHERE length(html) <= 500),
       f AS (SELECT url AS path, sha256(html) AS have FROM pages)
       SELECT coalesce(m.path, f.path) AS path, CASE WHEN have IS NULL THEN 'missing' WHEN want IS NULL THEN 'unlisted' WHEN have <> want THEN 'changed' ELSE 'ok' END AS status FROM m FULL JOIN f ON m.path = f.path""",
)
def _(spark, sf):
    p = table(spark, sf, "pages")
    big = p.where(F.length("html") > 500).select(F.col("url").alias("path"), F.when(F.col("page_id") % 11 == 3, "x").otherwise(F.sha2("html", 256)).alias("sha256"))
    old = p.where(F.length("html") <= 500).select(F.concat("url", F.lit("/old")).alias("path"), F.lit("y").alias("sha256"))
    return files.audit_manifest(files.with_sha256(page_files(spark, sf)), big.unionByName(old))


@query("s13_categorised_scan", r"SELECT url AS path, regexp_extract(url, '^https?://([^/]+)/', 1) AS category FROM pages WHERE regexp_extract(url, '^https?://([^/]+)/', 1) <> ''")
def _(spark, sf):
    return files.categorised(page_files(spark, sf), "^https?://([^/]+)/").select("path", "category")


@query(
    "k07_valid_index",
    """WITH i AS (SELECT md5(url) AS file_hash, md5(html) AS map_hash, CASE WHEN page_id % 9 = 4 THEN md5('x') ELSE md5(html) END AS content_hash, 'User' || (page_id % 40) AS usr,
         CASE page_id % 5 WHEN 0 THEN 'True' WHEN 1 THEN '1' ELSE 'false' END AS failed, (page_id % 7 = 6)::INT AS mode, 20140000 + page_id AS version, length(html) AS n_events FROM pages)
       SELECT file_hash, (min((map_hash, lower(usr)))).unnamed AS map_hash, '' AS user FROM i""".split("SELECT file_hash, (min")[0]
    + """SELECT file_hash, min(map_hash) AS map_hash, min(lower(usr)) AS "user" FROM i WHERE failed NOT IN ('True','1') AND mode = 0 AND version <= 20140200 AND content_hash = map_hash AND n_events > 0
         AND lower(usr) NOT IN (SELECT 'user' || s_nationkey FROM supplier) GROUP BY file_hash""",
)
def _(spark, sf):
    p, k = table(spark, sf, "pages"), F.col("page_id")
    index = p.select(
        F.md5("url").alias("file_hash"),
        F.md5("html").alias("map_hash"),
        F.when(k % 9 == 4, F.md5(F.lit("x"))).otherwise(F.md5("html")).alias("content_hash"),
        F.concat(F.lit("User"), k % 40).alias("user"),
        F.when(k % 5 == 0, "True").when(k % 5 == 1, "1").otherwise("false").alias("failed"),
        (k % 7 == 6).cast("int").alias("mode"),
        (k + 20140000).alias("version"),
        F.length("html").alias("n_events"),
    )
    maps = table(spark, sf, "benchmark").select(F.md5("text").alias("map_hash"))
    users = table(spark, sf, "supplier").select(F.concat(F.lit("user"), F.col("s_nationkey")).alias("user")).distinct()
    return files.valid_index(index, maps, users, 20140200)
