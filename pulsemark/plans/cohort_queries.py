"""Join (J6-J14), ranking (R), set (T) and cohort (D) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsemark.functions.ordered import first_rows
from pulsemark.operators import cohorts, joins, policy, ranking
from pulsemark.plans import roles as R
from pulsemark.plans.registry import query, rnd, rounded, table
from pulsemark.plans.roles import with_sql
from pulsemark.session import spread

ACC_SQL = R.HEADERS_SQL + """,
acc AS (SELECT *, round((300*count_300 + 100*count_100 + 50*count_50)::DOUBLE / (300*(count_300+count_100+count_50+count_miss))::DOUBLE, 9) AS accuracy FROM headers)"""


def accuracies(spark, sf):
    num, den = policy.accuracy_ratio(*[F.col(c) for c in ("count_300", "count_100", "count_50", "count_miss")])
    return R.headers(spark, sf).withColumn("accuracy", F.round(num.cast("double") / den.cast("double"), 9))


# ---- joins ---------------------------------------------------------------------------------


@query(
    "j06_match_reasons",
    """WITH st AS (SELECT o_custkey AS series_id, count(*) AS n, stddev_pop(o_totalprice) AS std FROM orders GROUP BY 1)
       SELECT c_custkey AS series_id, c_custkey % 30 AS map_id,
         CASE WHEN n_nationkey IS NULL THEN 'no_map' WHEN n_regionkey = 4 THEN 'no_offset' WHEN coalesce(n, 0) < 5 THEN 'too_few_matches'
              WHEN std = 0 THEN 'zero_variance' END AS reason
       FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 30 LEFT JOIN st ON st.series_id = c_custkey""",
)
def _(spark, sf):
    series = table(spark, sf, "customer").select(F.col("c_custkey").alias("series_id"), (F.col("c_custkey") % 30).alias("map_id"))
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("map_id"), "n_regionkey")
    offsets = nation.where(F.col("n_regionkey") != 4).withColumn("offset_ms", F.col("n_regionkey"))
    stats = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("series_id")).agg(
        F.count(F.lit(1)).alias("num_matched"), F.stddev_pop("o_totalprice").alias("std")
    )
    return joins.with_match_reason(series, nation, offsets, stats, 5)


@query(
    "j07_checked_join",
    """SELECT o_orderkey, c_mktsegment, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def _(spark, sf):
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    out = joins.checked_join(table(spark, sf, "orders"), cust, ["o_custkey"], "many_to_one")
    return out.select("o_orderkey", "c_mktsegment", "o_orderstatus")


@query(
    "j07_duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def _(spark, sf):
    return joins.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("j08_label_lookup", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def _(spark, sf):
    dim = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return joins.lookup_label(table(spark, sf, "supplier"), dim, ["s_nationkey"], "n_name").select("s_suppkey", "n_name")


CONFIG_SQL = R.RESULTS_SQL + """,
cfg AS (SELECT map_id, series_id, condition, sum(bits)::BIGINT AS bits, sum(errors)::BIGINT AS errors FROM results GROUP BY ALL)"""


def configs(spark, sf):
    return R.results(spark, sf).groupBy("map_id", "series_id", "condition").agg(
        F.sum("bits").alias("bits"), F.sum("errors").alias("errors")
    )


def wide_pairs(spark, sf):
    return joins.paired_conditions(
        configs(spark, sf), ["map_id", "series_id"], "condition", {"A": "control", "R": "candidate"}, ["bits", "errors"]
    )


PAIR_SQL = CONFIG_SQL + """,
pairs AS (SELECT a.map_id, a.series_id, a.bits AS bits_control, a.errors AS errors_control, r.bits AS bits_candidate, r.errors AS errors_candidate
  FROM cfg a JOIN cfg r ON a.map_id = r.map_id AND a.series_id = r.series_id AND a.condition = 'A' AND r.condition = 'R')"""


@query("j09_paired_conditions", with_sql(PAIR_SQL) + "SELECT * FROM pairs")
def _(spark, sf):
    return wide_pairs(spark, sf)


@query(
    "j10_label_deltas",
    with_sql(R.R2_SQL)
    + f"""SELECT pair_id, {rnd('max(m) FILTER (label = 1) - max(m) FILTER (label = 0)')} AS mean_delta FROM
        (SELECT series_id // 10 AS pair_id, label, avg(residual) AS m FROM r2 GROUP BY ALL) GROUP BY pair_id HAVING count(*) = 2""",
)
def _(spark, sf):
    means = R.residuals_vectors(spark, sf).groupBy(F.floor(F.col("series_id") / 10).alias("pair_id"), "label").agg(F.avg("residual").alias("mean"))
    return rounded(joins.label_deltas(means, ["pair_id"], "label", ["mean"]))


@query("j07_uncovered_keys", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def _(spark, sf):
    return joins.uncovered(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])


@query(
    "j11_disjoint_selection",
    """SELECT o_orderkey, o_custkey, 'group_disjoint' AS rule FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    design = orders.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"))
    chosen, rule = joins.select_disjoint(orders, design, 1, "o_custkey", "o_orderkey")
    return chosen.select("o_orderkey", "o_custkey", F.lit(rule).alias("rule"))


@query(
    "j11_disjoint_fallback",
    """SELECT o_orderkey, o_custkey, 'unit_disjoint' AS rule FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')""",
)
def _(spark, sf):
    """More rows are asked for than stay when whole groups go, so only the units themselves are left out."""
    orders = table(spark, sf, "orders")
    design = orders.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"))
    chosen, rule = joins.select_disjoint(orders, design, orders.count(), "o_custkey", "o_orderkey")
    return chosen.select("o_orderkey", "o_custkey", F.lit(rule).alias("rule"))


@query(
    "j12_assigned_rows",
    with_sql(ACC_SQL)
    + """SELECT series_id, CASE WHEN accuracy >= 0.75 THEN 10.0::DOUBLE WHEN accuracy >= 0.5 THEN 15.0::DOUBLE ELSE 20.0::DOUBLE END AS alpha,
         series_id * 100 + (CASE WHEN accuracy >= 0.75 THEN 10 WHEN accuracy >= 0.5 THEN 15 ELSE 20 END) AS cell FROM acc""",
)
def _(spark, sf):
    acc = accuracies(spark, sf)
    assigned = acc.select("series_id", policy.strength_float(F.col("accuracy"), (0.5, 0.75), (20.0, 15.0, 10.0)).alias("alpha"))
    grid = acc.select("series_id", F.explode(F.array(F.lit(10.0), F.lit(15.0), F.lit(20.0))).alias("alpha"))
    grid = grid.withColumn("cell", F.col("series_id") * 100 + F.col("alpha").cast("long"))
    return joins.select_assigned(grid, assigned)


@query(
    "j13_complete_grid",
    with_sql(R.RESULTS_SQL, "o AS (SELECT series_id, seed, sum(errors)::BIGINT AS errors FROM results WHERE condition = 'A' GROUP BY ALL)")
    + """SELECT p_partkey AS series_id, k.seed, coalesce(errors, 0) AS errors FROM part JOIN (SELECT unnest(range(0,5)) AS seed) k ON true
         LEFT JOIN o ON o.series_id = p_partkey AND o.seed = k.seed""",
)
def _(spark, sf):
    got = R.results(spark, sf).where(F.col("condition") == "A").groupBy("series_id", "seed").agg(F.sum("errors").alias("errors"))
    units = table(spark, sf, "part").select(F.col("p_partkey").alias("series_id"))
    seeds = F.array(*[F.lit(s).cast("long") for s in range(5)])
    return joins.complete_grid(units, "seed", seeds, got, ["series_id", "seed"], {"errors": 0})


@query("j14_overlap", "SELECT o_custkey AS id FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def _(spark, sf):
    poor = table(spark, sf, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("id"))
    return joins.overlap(table(spark, sf, "orders").select(F.col("o_custkey").alias("id")), poor, "id")


# ---- ranking -------------------------------------------------------------------------------

GRADE_SQL = " ".join(f"WHEN p < {bound} THEN '{name}'" if bound is not None else f"ELSE '{name}'" for name, bound in ranking.CATEGORIES)
GRADE_ALPHAS = dict(zip((name for name, _ in ranking.CATEGORIES), policy.StrengthPolicy().alphas))
PCT_SQL = ACC_SQL + f""",
pct AS (SELECT *, count(*) OVER (PARTITION BY map_id) AS group_size,
   CASE WHEN count(*) OVER (PARTITION BY map_id) <= 1 THEN 50.0 ELSE
   (rank() OVER (PARTITION BY map_id ORDER BY accuracy) + (count(*) OVER (PARTITION BY map_id, accuracy) - 1) / 2.0::DOUBLE - 1.0::DOUBLE)
    / (count(*) OVER (PARTITION BY map_id) - 1) * 100.0::DOUBLE END AS p FROM acc),
grp AS (SELECT *, CASE WHEN group_size < 40 THEN '{ranking.INSUFFICIENT}' {GRADE_SQL} END AS grade,
   CASE WHEN group_size >= 40 THEN p END AS kept FROM pct)"""


@query("r01_group_percentile", with_sql(PCT_SQL) + f"SELECT series_id, map_id, group_size, {rnd('p')} AS percentile FROM pct")
def _(spark, sf):
    out = ranking.group_percentile(accuracies(spark, sf), "map_id", "accuracy")
    return rounded(out.select("series_id", "map_id", "group_size", "percentile"))


@query("r02_r03_performance_groups", with_sql(PCT_SQL) + f"SELECT series_id, grade AS category, {rnd('kept')} AS percentile FROM grp")
def _(spark, sf):
    out = ranking.performance_groups(accuracies(spark, sf).drop("category"), "map_id", "accuracy", 40)
    return rounded(out.select("series_id", "category", "percentile"))


@query(
    "r04_equal_count_bins",
    """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS rk, count(*) OVER () AS n FROM events)
       SELECT event_id, greatest(0, -((-(rk * 10)) // (n - 1)) - 1)::BIGINT AS bin FROM
       (SELECT event_id, rk, n FROM r)""".replace("-((-(rk * 10)) // (n - 1))", "((rk * 10 + n - 2) // (n - 1))"),
)
def _(spark, sf):
    return ranking.equal_count_bins(R.events(spark, sf), ["value", "event_id"], 10, "bin").select("event_id", "bin")


EDGE_SQL = "list_transform(range(0, 11), lambda k: k / 10.0::DOUBLE)"


def edges_sql(source: str, column: str) -> str:
    picks = ", ".join(f"round(quantile_cont({column}, {i / 10}), 9)" for i in range(11))
    return f"SELECT [{picks}]::DOUBLE[] AS edges FROM {source}"


@query(
    "r05_quantile_bins",
    with_sql(f"e AS ({edges_sql('lineitem', 'l_quantity')})")
    + """SELECT l_quantity, greatest(0, len(list_filter(list_distinct(edges), lambda x: x < l_quantity)) - 1) AS bin, count(*) AS n
         FROM lineitem, e GROUP BY ALL""",
)
def _(spark, sf):
    return ranking.quantile_bins(table(spark, sf, "lineitem"), "l_quantity", 10, "bin").groupBy("l_quantity", "bin").agg(F.count(F.lit(1)).alias("n"))


@query(
    "r06_fixed_bins",
    """SELECT o_orderkey, CASE WHEN o_totalprice <= 50000 THEN 'low' WHEN o_totalprice <= 150000 THEN 'mid' WHEN o_totalprice <= 300000 THEN 'high'
         ELSE 'top' END AS bin FROM orders""",
)
def _(spark, sf):
    b = ranking.fixed_bins(F.col("o_totalprice"), (50000, 150000, 300000), ("low", "mid", "high", "top"))
    return table(spark, sf, "orders").select("o_orderkey", b.alias("bin"))


@query(
    "r07_reference_bins",
    with_sql(R.BITS_SQL, f"e AS ({edges_sql('bit_rows WHERE side = 0', 'abs_correlation')})")
    + "SELECT event_id, len(list_filter(edges[2:10], lambda x: x <= abs_correlation)) AS bin FROM bit_rows, e WHERE side = 1",
)
def _(spark, sf):
    b = R.bit_rows(spark, sf, R.hot_users(spark, sf))
    out = ranking.reference_bins(b.where("side = 1"), b.where("side = 0"), "abs_correlation", 10, "bin")
    return out.select("event_id", "bin")


@query(
    "r08_median_normalised",
    with_sql(R.BITS_SQL)
    + f"""SELECT event_id, {rnd('abs_correlation / nullif(m, 0)', 7)} AS normalised FROM
          (SELECT *, quantile_cont(abs_correlation, 0.5) OVER (PARTITION BY config_id) AS m FROM bit_rows)""",
)
def _(spark, sf):
    out = ranking.median_normalised(R.bit_rows(spark, sf, R.hot_users(spark, sf)), ["config_id"], "abs_correlation", "normalised")
    return rounded(out.select("event_id", "normalised"), 7)


@query(
    "r09_distinct_per_group",
    "SELECT o_orderkey, n AS custs FROM orders JOIN (SELECT o_orderpriority p, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1) ON p = o_orderpriority",
)
def _(spark, sf):
    return ranking.distinct_per_group(table(spark, sf, "orders"), ["o_orderpriority"], "o_custkey", "custs").select("o_orderkey", "custs")


@query(
    "r10_word_ranks",
    with_sql(
        R.WORDS_SQL,
        """x AS (SELECT msg_id, word_idx, weights, position, unnest(range(0,8)) AS p FROM decoded),
        y AS (SELECT *, weights[p + 1] AS c, row_number() OVER (PARTITION BY msg_id, word_idx ORDER BY weights[p + 1], p) - 1 AS rk FROM x)""",
    )
    + """SELECT msg_id, word_idx, list(rk ORDER BY p)::BIGINT[] AS ranks, min(c) AS lowest, max(c) FILTER (rk = 1) AS second_lowest,
           max(c) FILTER (rk = 1) - min(c) AS gap, count(*) FILTER (c <= 40)::INT AS low_bits, max(rk) FILTER (p = position)::BIGINT AS corrected_rank
         FROM y GROUP BY msg_id, word_idx""",
)
def _(spark, sf):
    from pulsemark.operators import coding as C

    w = R.decoded_words(spark, sf).withColumn("ranks", C.weak_ranks(F.col("weights")))
    ordered = F.array_sort("weights")
    return w.select(
        "msg_id",
        "word_idx",
        F.transform("ranks", lambda r: r.cast("long")).alias("ranks"),
        ordered[0].alias("lowest"),
        ordered[1].alias("second_lowest"),
        (ordered[1] - ordered[0]).alias("gap"),
        F.size(F.filter("weights", lambda c: c <= 40)).alias("low_bits"),
        F.when(F.col("position").isNotNull(), F.element_at("ranks", F.coalesce("position", F.lit(0)) + 1)).cast("long").alias("corrected_rank"),
    )


@query(
    "r11_group_share",
    f"""SELECT l_returnflag, l_linestatus, n, {rnd('n / sum(n) OVER (PARTITION BY l_returnflag)')} AS fraction FROM
        (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)""",
)
def _(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return rounded(ranking.group_share(counts, ["l_returnflag"], "n", "fraction"))


ADJ_SQL = R.BITS_SQL + ", adj AS (SELECT *, lag(is_error) OVER (PARTITION BY config_id ORDER BY bit_index) AS prev_error FROM bit_rows)"


def bits_and_hot(spark, sf):
    hot = R.hot_users(spark, sf)
    renamed = None if hot is None else hot.withColumnRenamed("series_id", "config_id")
    return R.bit_rows(spark, sf, hot), renamed


@query(
    "r12_adjacent_independence",
    with_sql(ADJ_SQL)
    + f"""SELECT count(*) AS total_bits, sum(is_error)::BIGINT AS bit_errors, {rnd('avg(is_error)')} AS error_rate,
        {rnd('corr(prev_error, is_error)')} AS lag1_error_correlation, {rnd('avg(prev_error * is_error)')} AS observed_pair_frequency,
        {rnd('avg(is_error) ** 2')} AS expected_pair_frequency, {rnd('avg(prev_error * is_error) / avg(is_error) ** 2')} AS observed_to_expected,
        count(prev_error) AS adjacent_pairs FROM adj""",
)
def _(spark, sf):
    return rounded(ranking.independence(*bits_and_hot(spark, sf)))


@query(
    "r13_conditional_independence",
    with_sql(ADJ_SQL)
    + f"""SELECT sum(b)::BIGINT AS observed_pairs, {rnd('sum(n * r * r)')} AS expected_pairs, {rnd('sum(b) / sum(n * r * r)')} AS observed_to_expected,
        sum(n)::BIGINT AS adjacent_pairs FROM (SELECT config_id, count(prev_error) AS n, sum(prev_error * is_error) AS b, avg(is_error) AS r FROM adj GROUP BY 1)""",
)
def _(spark, sf):
    return rounded(ranking.conditional_independence(*bits_and_hot(spark, sf)))


@query(
    "r14_score_percentiles",
    f"""WITH fa AS (SELECT value AS v FROM events WHERE event_type = 'view'), fb AS (SELECT value AS v FROM events WHERE event_type = 'click'),
       q AS (SELECT a.*, b.* FROM (SELECT count(*) AS na, quantile_cont(v, 0.25) AS a25, quantile_cont(v, 0.5) AS a50, quantile_cont(v, 0.75) AS a75 FROM fa) a,
                                  (SELECT count(*) AS nb, quantile_cont(v, 0.25) AS b25, quantile_cont(v, 0.5) AS b50, quantile_cont(v, 0.75) AS b75 FROM fb) b),
       r AS (SELECT v, sum(ka) OVER (ORDER BY v) AS ba, sum(kb) OVER (ORDER BY v) AS bb FROM
             (SELECT v, sum(x) AS ka, sum(y) AS kb FROM (SELECT v, 1 AS x, 0 AS y FROM fa UNION ALL SELECT v, 0, 1 FROM fb) GROUP BY v)),
       e AS (SELECT event_id, value FROM events WHERE event_type = 'purchase')
       SELECT event_id, value, {rnd('100.0 * coalesce(ba, 0) / na')} AS first_percentile, {rnd('100.0 * coalesce(bb, 0) / nb')} AS second_percentile,
         {rnd('a25')} AS first_q25, {rnd('a50')} AS first_median, {rnd('a75')} AS first_q75, {rnd('b25')} AS second_q25, {rnd('b50')} AS second_median, {rnd('b75')} AS second_q75,
         CASE WHEN value BETWEEN a25 AND a75 AND value BETWEEN b25 AND b75 THEN 'ambiguous' WHEN value BETWEEN a25 AND a75 THEN 'first_like'
              WHEN value BETWEEN b25 AND b75 THEN 'second_like' WHEN abs(abs(value - a50) - abs(value - b50)) < 0.03 THEN 'atypical'
              WHEN abs(value - a50) < abs(value - b50) THEN 'lean_first' ELSE 'lean_second' END AS verdict
       FROM e ASOF LEFT JOIN r ON e.value >= r.v, q""",
)
def _(spark, sf):
    side = lambda kind: R.events(spark, sf).where(F.col("event_type") == kind).select("event_id", "value")
    return rounded(ranking.score_percentiles(side("purchase"), side("view"), side("click"), "event_id", "value"))


@query(
    "r15_position_of_key",
    f"""WITH k AS (SELECT c_nationkey AS key_id, avg(c_acctbal) AS v FROM customer GROUP BY 1), m AS (SELECT v AS mine FROM k WHERE key_id = 7)
        SELECT {rnd('max(mine)', 6)} AS value, {rnd('(max(mine) - avg(v)) / stddev_samp(v)', 6)} AS z, count(*) FILTER (v < mine) + 1 AS ascending_rank,
          {rnd('avg((v <= mine)::INT)')} AS share_at_or_below FROM k, m""",
)
def _(spark, sf):
    keys = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("key_id")).agg(F.avg("c_acctbal").alias("v"))
    return rounded(ranking.position_of(keys, "key_id", "v", 7), value=6, z=6)


# ---- sort, top-k, sets -----------------------------------------------------------------------


@query("t02_top_per_group", "SELECT l_suppkey, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY -l_extendedprice, l_orderkey, l_partkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 3")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    li = li.withColumn("_m", -F.col("l_extendedprice"))
    return first_rows(li, ["l_suppkey"], ["_m", "l_orderkey", "l_partkey", "l_linenumber"], 3).select("l_suppkey", "l_orderkey", "l_extendedprice")


@query(
    "t01_t04_top_by_magnitude",
    "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END, abs(c_acctbal - 4000) DESC, c_custkey LIMIT 25",
)
def _(spark, sf):
    order = F.coalesce(F.try_element_at(F.create_map(F.lit("BUILDING"), F.lit(0), F.lit("MACHINERY"), F.lit(1)), F.col("c_mktsegment")), F.lit(2))
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return c.orderBy(order, F.abs(F.col("c_acctbal") - 4000).desc(), "c_custkey").limit(25)


@query(
    "t03_keep_first",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1",
)
def _(spark, sf):
    # the first row of a group is a minimum: it combines map-side, no ordering is needed
    best = F.struct("o_orderdate", "o_orderkey", "o_totalprice")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(best).alias("b")).select("o_custkey", "b.o_orderkey", "b.o_totalprice")


@query(
    "t05_union_missing_columns",
    "SELECT c_custkey AS id, c_acctbal AS bal, c_mktsegment AS segment, NULL AS nation FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_nationkey FROM supplier",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s, allowMissingColumns=True)


@query("t06_except", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf):
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).subtract(done)


@query("t07_reindex_labels", "SELECT r_name AS label, coalesce(n, 0) AS n FROM region LEFT JOIN (SELECT n_regionkey AS k, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 9000 GROUP BY 1) ON k = r_regionkey")
def _(spark, sf):
    rich = table(spark, sf, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    counts = rich.join(table(spark, sf, "nation"), "n_nationkey").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "region").join(counts, "r_regionkey", "left").select(F.col("r_name").alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


# ---- cohorts ---------------------------------------------------------------------------------


@query(
    "d01_group_split",
    """WITH g AS (SELECT DISTINCT c_nationkey AS map_id FROM customer), o AS (SELECT map_id, row_number() OVER (ORDER BY sha256('42|' || map_id), map_id) - 1 AS pos, count(*) OVER () AS n FROM g)
       SELECT map_id, CASE WHEN pos < least(greatest(2, ceil(round(n * 0.3::DOUBLE, 9))), n - 2) THEN 'validation' ELSE 'development' END AS partition FROM o""",
)
def _(spark, sf):
    return cohorts.split_groups(R.headers(spark, sf).select("map_id"), "map_id", 0.3, "42")


@query(
    "d02_diverse_sample",
    with_sql(
        R.HEADERS_SQL,
        """d AS (SELECT *, sha256('7|' || series_id) AS h, row_number() OVER (PARTITION BY category, map_id ORDER BY sha256('7|' || series_id), series_id) AS rn FROM headers)""",
    )
    + "SELECT series_id, category, map_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY (rn > 1)::INT, h, series_id) AS k FROM d) WHERE k <= 20",
)
def _(spark, sf):
    return cohorts.diverse_sample(R.headers(spark, sf), "category", "map_id", "series_id", 20, "7").select("series_id", "category", "map_id")


@query(
    "d03_round_robin",
    with_sql(R.HEADERS_SQL, "d AS (SELECT series_id, map_id, row_number() OVER (PARTITION BY map_id ORDER BY sha256('9|' || series_id), series_id) AS depth FROM headers)")
    + "SELECT series_id, map_id FROM d ORDER BY depth, map_id LIMIT 80",
)
def _(spark, sf):
    return cohorts.round_robin(R.headers(spark, sf), "map_id", "series_id", 80, "9").select("series_id", "map_id")


@query(
    "d04_per_bin_sample",
    "SELECT l_quantity, o_orderkey FROM (SELECT l_quantity, l_orderkey AS o_orderkey, row_number() OVER (PARTITION BY l_quantity ORDER BY sha256('3|' || l_orderkey), l_orderkey) AS rn FROM (SELECT DISTINCT l_quantity, l_orderkey FROM lineitem)) WHERE rn <= 20",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", F.col("l_orderkey").alias("o_orderkey")).distinct()
    return cohorts.per_bin_sample(li, "l_quantity", "o_orderkey", 20, "3")


@query(
    "d05_unique_user_corpus",
    """WITH RECURSIVE one AS (SELECT map_id, user, unit, h FROM (SELECT *, row_number() OVER (PARTITION BY map_id, user ORDER BY h, unit) AS k FROM
         (SELECT DISTINCT l_suppkey AS map_id, l_partkey AS user, l_orderkey AS unit, sha256('floor|' || l_suppkey || '|' || l_orderkey) AS h FROM lineitem)) WHERE k = 1),
       g AS (SELECT map_id, list({'user': user, 'unit': unit} ORDER BY h, unit, user) AS l FROM one GROUP BY map_id HAVING count(*) >= 6),
       o AS (SELECT *, row_number() OVER (ORDER BY sha256('floor|' || map_id), map_id) AS rank FROM g),
       walk AS (SELECT 0::BIGINT AS rank, 0 AS taken, []::BIGINT[] AS used, NULL::BIGINT AS map_id, []::STRUCT("user" BIGINT, unit BIGINT)[] AS got
         UNION ALL SELECT rank, taken + (len(f) = 6)::INT, CASE WHEN len(f) = 6 THEN used || list_transform(f, lambda x: x.user) ELSE used END, map_id, CASE WHEN len(f) = 6 THEN f ELSE [] END
         FROM (SELECT o.rank, taken, used, o.map_id, list_filter(o.l, lambda x: NOT list_contains(used, x.user))[1:6] AS f FROM walk JOIN o ON o.rank = walk.rank + 1 WHERE taken < 5)),
       p AS (SELECT map_id, got, unnest(range(1, len(got) + 1)) AS k FROM walk WHERE len(got) > 0)
       SELECT map_id, got[k].user AS user, got[k].unit AS unit, CASE WHEN k <= 2 THEN 'calibration' ELSE 'primary' END AS role FROM p""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("map_id"), F.col("l_partkey").alias("user"), F.col("l_orderkey").alias("unit"))
    li = spread(li, "map_id", "user").distinct()  # the operator groups by the same two columns: no further shuffle
    return cohorts.unique_user_corpus(li, "map_id", "user", "unit", 6, 2, 5, "floor")


@query("d06_ordered_subset", "SELECT l_orderkey, l_extendedprice, doc_id AS ord FROM lineitem JOIN documents ON l_orderkey = doc_id * 7")
def _(spark, sf):
    wanted = table(spark, sf, "documents").select((F.col("doc_id") * 7).alias("l_orderkey"), F.col("doc_id").alias("ord"))
    return cohorts.ordered_subset(table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice"), wanted, "l_orderkey", "ord")


FOLD_SQL = """folds AS (SELECT c_nationkey AS map_id, n AS rows, (row_number() OVER (ORDER BY -n, sha256('cv|' || c_nationkey), c_nationkey) - 1) % 5 AS fold
   FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1))"""


@query("d07_group_folds", with_sql(FOLD_SQL) + "SELECT * FROM folds")
def _(spark, sf):
    return cohorts.group_folds(table(spark, sf, "customer").select(F.col("c_nationkey").alias("map_id")), "map_id", 5, "cv")


@query(
    "d08_shuffled_assignment",
    with_sql(ACC_SQL)
    + """SELECT a.series_id, b.accuracy FROM (SELECT series_id, row_number() OVER (ORDER BY series_id) AS k FROM acc) a
         JOIN (SELECT accuracy, row_number() OVER (ORDER BY sha256('42|' || series_id), series_id) AS k FROM acc) b ON a.k = b.k""",
)
def _(spark, sf):
    return cohorts.shuffled_values(accuracies(spark, sf), "series_id", "accuracy", "42")


@query("d09_quartile_policy", with_sql(ACC_SQL) + f"SELECT {rnd('quantile_cont(accuracy, 0.25)')} AS q25, {rnd('quantile_cont(accuracy, 0.5)')} AS q50, {rnd('quantile_cont(accuracy, 0.75)')} AS q75 FROM acc")
def _(spark, sf):
    return rounded(cohorts.quartile_policy(accuracies(spark, sf), "accuracy"))


@query(
    "d10_policy_assignments",
    with_sql(PCT_SQL)
    + f"""SELECT series_id, [{", ".join(f"{a}::DOUBLE" for a in policy.StrengthPolicy().alphas)}][1 + (accuracy >= (SELECT round(quantile_cont(accuracy, 0.25), 9) FROM acc))::INT
          + (accuracy >= (SELECT round(quantile_cont(accuracy, 0.5), 9) FROM acc))::INT + (accuracy >= (SELECT round(quantile_cont(accuracy, 0.75), 9) FROM acc))::INT] AS alpha,
          CASE grade {" ".join(f"WHEN '{g}' THEN {a}::DOUBLE" for g, a in GRADE_ALPHAS.items())} END AS alpha_oracle FROM grp""",
)
def _(spark, sf):
    acc = accuracies(spark, sf).drop("category")
    graded = ranking.performance_groups(acc, "map_id", "accuracy", 40)
    q = cohorts.quartile_policy(acc, "accuracy").select(F.array(*[F.round(c, 9) for c in ("q25", "q50", "q75")]).alias("edges"))
    at = ranking.with_edges(graded, q)
    passed = F.size(F.filter("edges", lambda e: e <= F.col("accuracy")))
    alphas = F.array(*[F.lit(a) for a in policy.StrengthPolicy().alphas])
    oracle = policy.strength_by_category(F.col("category"), GRADE_ALPHAS)
    return at.select("series_id", F.element_at(alphas, passed + 1).alias("alpha"), oracle.alias("alpha_oracle"))


@query(
    "d11_rule_grid",
    with_sql(
        R.WORDS_SQL,
        """rules AS (SELECT * FROM (VALUES ('R1', NULL), ('R2_q05', 15), ('R2_q10', 30), ('R2_q20', 60), ('R4', NULL)) t(rule_id, thr)),
        g AS (SELECT msg_id, rule_id, decoded_info <> info AS wrong, CASE WHEN status = 'detected_double' THEN false
          WHEN rule_id LIKE 'R2%' AND status = 'corrected_single' AND len(list_filter(weights, lambda c: c <= thr)) >= 2 THEN false
          WHEN rule_id = 'R4' THEN reason = 'accepted' ELSE true END AS ok FROM decoded, rules)""",
    )
    + f"""SELECT rule_id, count(*) AS words, count(*) FILTER (ok AND NOT wrong) AS correct_accept, count(*) FILTER (ok AND wrong) AS wrong_accept,
          count(*) FILTER (NOT ok) AS reject, {rnd('count(*) FILTER (NOT ok) / count(*)')} AS reject_rate FROM g GROUP BY rule_id""",
)
def _(spark, sf):
    w = R.words(spark, sf)
    from pulsemark.operators import coding as C

    grid = cohorts.rule_grid(w, (("q05", 15), ("q10", 30), ("q20", 60)))
    wrong, ok = C.hard_decode(F.col("word")) != F.col("info"), F.col("reason") == C.ACCEPTED
    return rounded(
        grid.groupBy("rule_id").agg(
            F.count(F.lit(1)).alias("words"),
            F.count(F.when(ok & ~wrong, 1)).alias("correct_accept"),
            F.count(F.when(ok & wrong, 1)).alias("wrong_accept"),
            F.count(F.when(~ok, 1)).alias("reject"),
            F.avg((~ok).cast("double")).alias("reject_rate"),
        )
    )


@query(
    "d12_duplicate_payloads",
    """WITH p AS (SELECT DISTINCT l_orderkey AS unit, l_returnflag AS family, l_linenumber AS payload FROM lineitem)
       SELECT a.unit, a.payload, a.family AS family_a, b.family AS family_b FROM p a JOIN p b ON a.unit = b.unit AND a.payload = b.payload AND a.family < b.family""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_returnflag").alias("family"), F.col("l_linenumber").alias("payload"))
    return cohorts.duplicate_payloads(li, "unit", "family", "payload")


@query(
    "d13_stacked_sources",
    """SELECT c_custkey AS id, c_acctbal AS bal, c_mktsegment AS segment, 'customer' AS source, substr(sha256('customer|' || c_custkey), 1, 16) AS row_id FROM customer
       UNION ALL SELECT s_suppkey, s_acctbal, NULL, 'supplier', substr(sha256('supplier|' || s_suppkey), 1, 16) FROM supplier""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))
    return cohorts.stack_sources({"customer": c, "supplier": s}, ["id"])


@query(
    "d14_set_digest",
    """WITH ids AS (SELECT DISTINCT url AS id FROM pages WHERE url IS NOT NULL),
       s AS (SELECT count(*) AS n, sum(('0x' || substr(sha256(id),1,15))::BIGINT)::VARCHAR AS a, sum(('0x' || substr(sha256(id),16,15))::BIGINT)::VARCHAR AS b,
             sum(('0x' || substr(sha256(id),31,15))::BIGINT)::VARCHAR AS c, sum(('0x' || substr(sha256(id),46,15))::BIGINT)::VARCHAR AS d FROM ids)
       SELECT n AS ids, sha256(n || '|' || a || '|' || b || '|' || c || '|' || d) AS digest FROM s""",
)
def _(spark, sf):
    return cohorts.set_digest(table(spark, sf, "pages"), "url")
