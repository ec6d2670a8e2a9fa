"""Feature (F) and marking (W1-W18, W20, W27) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsemark.functions import exact
from pulsemark.functions import hashing as H
from pulsemark.operators import coding, features, frames, marking, policy, sweep
from pulsemark.plans import roles as R
from pulsemark.plans.registry import query, rnd, rounded, table
from pulsemark.plans.roles import with_sql
from pulsemark.session import settle


def r1(spark, sf):
    hot = R.hot_users(spark, sf)
    return R.residuals_events(spark, sf, hot), hot


def quarter_sql(i: str, n: str) -> str:
    return (
        f"(CASE WHEN {i} < ({n} % 4) * ({n} // 4 + 1) THEN {i} // ({n} // 4 + 1) "
        f"ELSE {n} % 4 + ({i} - ({n} % 4) * ({n} // 4 + 1)) // greatest({n} // 4, 1) END + 1)"
    )


@query(
    "f01_residual_statistics",
    with_sql(
        R.R1_SQL,
        """m AS (SELECT series_id, note_idx, residual AS x, avg(residual) OVER (PARTITION BY series_id) AS mu,
             lag(residual) OVER (PARTITION BY series_id ORDER BY note_idx) AS y FROM r1 WHERE residual IS NOT NULL)""",
    )
    + f"""SELECT series_id, count(*) AS n, {rnd('avg(x)')} AS mean, {rnd('stddev_pop(x)')} AS std,
          {rnd('avg((x-mu)**4) / avg((x-mu)**2)**2 - 3', 7)} AS excess_kurtosis,
          {rnd('sum((x-mu)*(y-mu)) / sum((x-mu)**2)', 7)} AS autocorrelation_lag1
        FROM m GROUP BY series_id HAVING count(*) > 1 AND stddev_pop(x) > 0""",
)
def _(spark, sf):
    res, hot = r1(spark, sf)
    return rounded(features.residual_statistics(res, hot)[0], excess_kurtosis=7, autocorrelation_lag1=7)


def features_sql(source: str, r: str, recursive: bool = False, vd: int = 6) -> str:
    qv = []
    for q in features.QUARTERS:
        qv += [
            f"{rnd(f'coalesce(var_pop(x) FILTER (q = {q}), 0)', vd)} AS quarter_{q}_variance",
            f"{rnd(f'coalesce(sum((x-qm)*(y1-qm)) FILTER (q = {q} AND pq = {q}) / nullif(sum((x-qm)**2) FILTER (q = {q}), 0), 0)', 6)} AS quarter_{q}_autocorrelation_lag1",
            f"{rnd(f'coalesce(avg(abs(x)) FILTER (q = {q}), 0)', 6)} AS quarter_{q}_mean_absolute_residual",
        ]
    auto = [
        f"{rnd(f'coalesce(sum((x-mu)*(y{k}-mu)) / nullif(sum((x-mu)**2), 0), 0)', 6)} AS autocorrelation_lag{k}" for k in features.LAGS
    ]
    quant = [f"{rnd(f'coalesce(quantile_cont(x, {p / 100}), 0)', 6)} AS quantile_{p}" for p in features.QUANTILES]
    lags = ", ".join(f"lag(x, {k}) OVER w AS y{k}" for k in features.LAGS)
    return (
        ("WITH RECURSIVE " if recursive else "WITH ")
        + ",\n".join(
            (
            r,
            f"""base AS (SELECT series_id, note_idx, residual AS x, max(note_idx) OVER (PARTITION BY series_id) + 1 AS n,
                 avg(residual) OVER (PARTITION BY series_id) AS mu FROM {source}),
            placed AS (SELECT *, {quarter_sql('note_idx', 'n')} AS q FROM base),
            l AS (SELECT *, {lags}, lag(q) OVER w AS pq, avg(x) OVER (PARTITION BY series_id, q) AS qm FROM placed
                  WINDOW w AS (PARTITION BY series_id ORDER BY note_idx))""",
            )
        )
        + "\n"
        + f"""SELECT series_id, {rnd('coalesce(var_pop(x), 0)', vd)} AS variance,
        {rnd('coalesce(avg((x-mu)**4) / nullif(avg((x-mu)**2)**2, 0) - 3, 0)', 6)} AS excess_kurtosis,
        {rnd('coalesce(avg((x-mu)**3) / nullif(avg((x-mu)**2)**1.5, 0), 0)', 6)} AS skewness,
        {rnd('coalesce(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 0)', 6)} AS iqr,
        {rnd('coalesce(avg(abs(x)), 0)', 6)} AS mean_absolute_residual,
        {", ".join(quant + auto + qv)},
        {rnd('coalesce(avg(abs(x-y1)), 0)', 6)} AS mean_absolute_first_difference,
        {rnd('coalesce(var_pop(x-y1), 0)', vd)} AS variance_first_difference,
        {rnd('coalesce(avg(CASE WHEN x*y1 IS NOT NULL THEN (x*y1 < 0)::INT END), 0)', 6)} AS sign_change_rate,
        max(n) AS num_notes, count(x) AS n_valid_residuals, {rnd('count(x) / count(*)', 6)} AS valid_residual_fraction
        FROM l GROUP BY series_id"""
    )


FEATURES_R1 = features_sql("r1", R.R1_SQL)
FEATURES_R2 = features_sql("r2", R.R2_SQL)


def _pick(columns) -> str:
    return f"SELECT series_id, {', '.join(columns)} FROM ({FEATURES_R1})"


DISTRIBUTION = ("variance", "excess_kurtosis") + features.GLOBAL


@query("f02_distribution", _pick(DISTRIBUTION))
def _(spark, sf):
    return rounded(features.series_features(r1(spark, sf)[0]).select("series_id", *DISTRIBUTION), 6)


LAG_COLUMNS = tuple(f"autocorrelation_lag{k}" for k in features.LAGS)


@query("f03_indexed_autocorrelation", _pick(LAG_COLUMNS))
def _(spark, sf):
    return rounded(features.series_features(r1(spark, sf)[0]).select("series_id", *LAG_COLUMNS), 6)


@query("f04_temporal", _pick(("autocorrelation_lag1",) + features.TEMPORAL))
def _(spark, sf):
    return rounded(
        features.series_features(r1(spark, sf)[0]).select("series_id", "autocorrelation_lag1", *features.TEMPORAL), 6
    )


@query("f05_position", _pick(features.POSITION))
def _(spark, sf):
    return rounded(features.series_features(r1(spark, sf)[0]).select("series_id", *features.POSITION), 6)


@query("f06_features_events", FEATURES_R1)
def _(spark, sf):
    return rounded(features.series_features(r1(spark, sf)[0]), 6)


@query("f06_features_vectors", FEATURES_R2)
def _(spark, sf):
    return rounded(features.series_features(R.residuals_vectors(spark, sf)), 6)


@query("f07_baseline_features", _pick(features.BASELINE))
def _(spark, sf):
    return rounded(features.series_features(r1(spark, sf)[0]).select("series_id", *features.BASELINE), 6)


@query(
    "f08_quarter_labels",
    with_sql(R.R1_SQL)
    + f"SELECT series_id, note_idx, {quarter_sql('note_idx', 'n')} AS quarter FROM (SELECT *, max(note_idx) OVER (PARTITION BY series_id) + 1 AS n FROM r1)",
)
def _(spark, sf):
    res = r1(spark, sf)[0]
    at = res.join(features.series_sizes(res), "series_id")
    return at.select("series_id", "note_idx", features.quarter(F.col("note_idx"), F.col("num_notes")).alias("quarter"))


@query(
    "f09_quarter_shifts",
    with_sql(
        R.R1_SQL,
        f"""s AS (SELECT series_id, {quarter_sql('note_idx', 'n')} AS quarter, req, CASE WHEN req = 1 THEN note_idx % 7 - 3 ELSE 0 END AS shift
            FROM (SELECT *, max(note_idx) OVER (PARTITION BY series_id) + 1 AS n, coalesce((residual::BIGINT % 2 = 0)::INT, 0) AS req FROM r1)),
        p AS (SELECT series_id, quarter, sum(req)::BIGINT AS requested_carriers, sum((shift <> 0)::INT)::BIGINT AS active_carriers,
              sum(shift*shift)::DOUBLE AS sum_squared_shift_ms2, sum(abs(shift))::DOUBLE AS total_absolute_shift_ms FROM s GROUP BY ALL)""",
    )
    + f"""SELECT *, {rnd("coalesce(sum_squared_shift_ms2 / nullif(sum(sum_squared_shift_ms2) OVER (PARTITION BY series_id), 0), 0)")} AS energy_fraction FROM p""",
)
def _(spark, sf):
    res = r1(spark, sf)[0]
    req = F.coalesce((F.col("residual").cast("long") % 2 == 0).cast("int"), F.lit(0))
    shifts = res.select(
        "series_id", "note_idx", req.alias("requested"), F.when(req == 1, F.col("note_idx") % 7 - 3).otherwise(0).alias("shift_ms")
    )
    return rounded(features.quarter_shifts(shifts, features.series_sizes(res)))


def sgn(expr: str) -> str:
    return f"(CASE WHEN ('0x' || substr(sha256({expr}), 1, 1))::INT % 2 = 1 THEN 1 ELSE -1 END)"


def carriers_sql(n: int = 8, tag: str = "") -> str:
    return f"""blk{tag} AS (SELECT series_id, note_idx, residual, frame_idx, nn // {n} AS capacity, nn AS num_notes,
        CASE WHEN note_idx // {n} < nn // {n} THEN note_idx // {n} END AS block_idx
      FROM (SELECT *, max(note_idx) OVER (PARTITION BY series_id) + 1 AS nn FROM r1)),
    place{tag} AS (SELECT capacity, block_idx, row_number() OVER (PARTITION BY capacity ORDER BY sha256('layout-a|' || capacity || '|' || block_idx), block_idx) - 1 AS bit_idx
      FROM (SELECT DISTINCT capacity, block_idx FROM blk{tag} WHERE block_idx IS NOT NULL)),
    sel{tag} AS (SELECT * FROM place{tag} WHERE bit_idx < greatest(1, (capacity * 3) // 4)),
    car{tag} AS (SELECT b.*, bit_idx, CASE WHEN bit_idx IS NOT NULL THEN {sgn(f"'pn-a|chip|' || (bit_idx * {n} + note_idx % {n})")} END AS chip,
        CASE WHEN bit_idx IS NOT NULL THEN {sgn("'random_a|' || series_id || '|bit|' || bit_idx")} END AS bit
      FROM blk{tag} b LEFT JOIN sel{tag} s ON s.capacity = b.capacity AND s.block_idx = b.block_idx)"""


CAR_SQL = R.R1_SQL + ",\n" + carriers_sql()
MARK_SQL = CAR_SQL + """,
    mark AS (SELECT *, coalesce(round_even(residual + 12.0::DOUBLE * chip * bit, 0) + 0.0::DOUBLE, residual) AS marked FROM car)"""
NUM_BITS = "greatest(1, capacity * 3 div 4)"


def carried(spark, sf, pn_key="pn-a"):
    return marking.carriers(r1(spark, sf)[0], 8, pn_key, "layout-a", NUM_BITS)


def bit_of(family="random_a"):
    return marking.message_bit(family, F.col("series_id"), F.col("bit_idx"))


def marked(spark, sf):
    out = marking.embed(carried(spark, sf), 12.0, bit_of())
    return out.withColumn("marked", F.col("marked") + F.lit(0.0))


@query(
    "f10_layout_coverage",
    with_sql(CAR_SQL)
    + f"""SELECT capacity, {rnd('(max(block_idx) - min(block_idx) + 1) / capacity')} AS span_fraction,
          count(DISTINCT least(4 * block_idx // capacity, 3)) AS occupied_quartiles FROM sel GROUP BY capacity""",
)
def _(spark, sf):
    blocks = marking.with_blocks(r1(spark, sf)[0], 8).where(F.col("block_idx").isNotNull()).select("capacity", "block_idx").distinct()
    return rounded(features.layout_coverage(marking.place_blocks(blocks, "layout-a", NUM_BITS), []))


@query(
    "f11_bit_error_rate",
    with_sql(R.WORDS_SQL) + f"SELECT msg_id, {rnd('sum(bit_count(flips)) / 32.0')} AS bit_error_rate, 0::BIGINT AS unpaired_bits FROM words GROUP BY msg_id",
)
def _(spark, sf):
    w = R.words(spark, sf)

    def side(c):
        return w.select("msg_id", "word_idx", F.posexplode(coding.bits_of(F.col(c))).alias("p", "bit")).select(
            "msg_id", (F.col("word_idx") * 8 + F.col("p")).alias("bit_idx"), "bit"
        )

    return rounded(features.bit_error_rate(side("sent"), side("word"), ["msg_id"]))


@query(
    "f12_error_runs",
    with_sql(R.BITS_SQL)
    + """SELECT config_id, min(bit_index) AS start_index, count(*) AS run_length FROM
         (SELECT config_id, bit_index, bit_index - row_number() OVER (PARTITION BY config_id ORDER BY bit_index) AS g
          FROM bit_rows WHERE is_error = 1) GROUP BY config_id, g""",
)
def _(spark, sf):
    hot = R.hot_users(spark, sf)
    renamed = None if hot is None else hot.withColumnRenamed("series_id", "config_id")
    return features.runs(R.bit_rows(spark, sf, hot), ["config_id"], "bit_index", "is_error", renamed)


CHIPS_SQL = f"""chips AS (SELECT c_custkey AS key_id, k AS chip_idx, {sgn("c_custkey || '|chip|' || k")} AS chip
   FROM (SELECT c_custkey, unnest(range(0, 64)) AS k FROM customer))"""


def chips(spark, sf):
    return marking.chip_table(table(spark, sf, "customer").select(F.col("c_custkey").alias("key_id")), "key_id", 64)


def _pearson(k: int) -> str:
    return rnd(
        f"CASE WHEN var_pop(chip) FILTER (y{k} IS NOT NULL) > 0 AND var_pop(y{k}) > 0 THEN covar_pop(chip, y{k}) / "
        f"sqrt(var_pop(chip) FILTER (y{k} IS NOT NULL) * var_pop(y{k})) END", 7
    )


@query(
    "f13_chip_diagnostics",
    with_sql(
        CHIPS_SQL,
        """l AS (SELECT *, lag(chip,1) OVER w AS y1, lag(chip,2) OVER w AS y2, lag(chip,4) OVER w AS y4, lag(chip,8) OVER w AS y8,
              chip_idx - row_number() OVER (PARTITION BY key_id, chip ORDER BY chip_idx) AS g FROM chips
              WINDOW w AS (PARTITION BY key_id ORDER BY chip_idx)),
        a AS (SELECT key_id, avg((chip=1)::INT) AS fraction_positive, """
        + ", ".join(f"{_pearson(k)} AS lag{k}_correlation" for k in (1, 2, 4, 8))
        + """ FROM l GROUP BY key_id),
        r AS (SELECT key_id, avg(n) AS mean_run_length, max(n) AS max_run_length FROM
              (SELECT key_id, chip, g, count(*) AS n FROM l GROUP BY ALL) GROUP BY key_id),
        b AS (SELECT key_id, stddev_pop(m) AS block_fraction_sd FROM
              (SELECT key_id, chip_idx // 8 AS b, avg((chip=1)::INT) AS m FROM chips GROUP BY ALL) GROUP BY key_id)""",
    )
    + f"""SELECT a.key_id, {rnd('fraction_positive', 7)} AS fraction_positive, lag1_correlation, lag2_correlation, lag4_correlation, lag8_correlation,
          {rnd('mean_run_length', 7)} AS mean_run_length, max_run_length, {rnd('block_fraction_sd', 7)} AS block_fraction_sd
          FROM a JOIN r ON a.key_id = r.key_id JOIN b ON a.key_id = b.key_id""",
)
def _(spark, sf):
    return rounded(features.chip_diagnostics(chips(spark, sf), "key_id", hot=None), 7)


def _energy(df):
    return df.select(
        "condition",
        "series_id",
        F.col("bits").alias("requested_carriers"),
        F.col("errors").alias("active_carriers"),
        (F.col("errors") * F.rint("shift") * F.rint("shift")).alias("sum_squared_shift_ms2"),
        (F.col("errors") * F.rint("shift")).alias("total_absolute_shift_ms"),
        F.col("seed").alias("dropped_for_hit_window"),
        (F.col("bits") - F.col("errors")).alias("new_unmatched_events"),
    )


@query(
    "f14_energy_summary",
    with_sql(R.RESULTS_SQL, "e AS (SELECT *, errors * round_even(shift,0) AS ab, errors * round_even(shift,0) * round_even(shift,0) AS sq FROM results)")
    + f"""SELECT condition, count(DISTINCT series_id) AS series, sum(bits)::BIGINT AS requested_carriers, sum(errors)::BIGINT AS active_carriers,
        {rnd('sum(errors)/sum(bits)')} AS active_carrier_fraction, sum(sq)::DOUBLE AS sum_squared_shift_ms2,
        {rnd('avg(sq)', 6)} AS mean_sum_squared_per_series, {rnd('sum(sq)/sum(errors)')} AS mean_squared_shift_ms2,
        {rnd('sqrt(sum(sq)/sum(errors))')} AS rms_applied_shift_ms, sum(ab)::DOUBLE AS total_absolute_shift_ms,
        {rnd('sum(ab)/sum(errors)')} AS mean_absolute_shift_ms, sum(seed)::BIGINT AS dropped_for_hit_window,
        sum(bits - errors)::BIGINT AS new_unmatched_events FROM e GROUP BY condition""",
)
def _(spark, sf):
    return rounded(features.energy_summary(_energy(R.results(spark, sf)), ["condition"]), mean_sum_squared_per_series=6)


# ---- marking -------------------------------------------------------------------------------


@query(
    "w01_ids_and_seeds",
    """SELECT c_custkey, ('0x' || substr(h,1,8))::BIGINT AS seed32, ('0x' || substr(h,1,8))::BIGINT & 2147483647 AS seed31,
         ('0x' || substr(h,1,15))::BIGINT AS seed60, substr(h,1,16) AS key_id,
         sha256('{"map":' || c_nationkey || ',"series":' || c_custkey || '}') AS config_id
       FROM (SELECT *, sha256('v1|' || c_custkey || '|' || c_mktsegment) AS h FROM customer)""",
)
def _(spark, sf):
    c = table(spark, sf, "customer")
    parts = ("v1", F.col("c_custkey"), F.col("c_mktsegment"))
    canonical = F.to_json(F.struct(F.col("c_nationkey").alias("map"), F.col("c_custkey").alias("series")))
    return c.select(
        "c_custkey",
        H.seed32(*parts).alias("seed32"),
        H.seed31(*parts).alias("seed31"),
        H.seed60(*parts).alias("seed60"),
        H.short_id(*parts).alias("key_id"),
        F.sha2(canonical, 256).alias("config_id"),
    )


@query("w02_chips", with_sql(CHIPS_SQL) + "SELECT key_id, chip_idx, chip FROM chips")
def _(spark, sf):
    return chips(spark, sf)


@query("w02_exact_chips")
def _(spark, sf):
    """Chips of every customer's key from the studied generator; SQL has no 128-bit arithmetic, tests hold it against NumPy."""
    return exact.chip_table(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 64)


@query("w03_exact_placement")
def _(spark, sf):
    sizes = marking.with_blocks(r1(spark, sf)[0], 8).select("capacity")
    return exact.placements(sizes, "layout-a")


@query("w05_exact_round_trip")
def _(spark, sf):
    """Marks with exact chips and placement, decoded: bits and errors per series."""
    carried = marking.exact_carriers(r1(spark, sf)[0].select("series_id", "note_idx", "residual"), 8, "pn-a", "layout-a", NUM_BITS)
    bit = marking.message_bit("random_a", F.col("series_id"), F.col("bit_idx"))
    decoded = marking.correlate(marking.embed(carried, 20.0, bit), "marked")
    wrong = F.sum((F.col("decoded_bit") != bit).cast("long")).alias("errors")
    return decoded.groupBy("series_id").agg(F.count(F.lit(1)).alias("bits"), wrong)


@query("w03_block_placement", with_sql(CAR_SQL) + "SELECT capacity, block_idx, bit_idx FROM place")
def _(spark, sf):
    blocks = marking.with_blocks(r1(spark, sf)[0], 8).where(F.col("block_idx").isNotNull()).select("capacity", "block_idx").distinct()
    return marking.place_blocks(blocks, "layout-a")


@query("w03_prefix_placement", with_sql(CAR_SQL) + "SELECT capacity, block_idx, block_idx AS bit_idx FROM place WHERE block_idx < greatest(1, (capacity * 3) // 4)")
def _(spark, sf):
    blocks = marking.with_blocks(r1(spark, sf)[0], 8).where(F.col("block_idx").isNotNull()).select("capacity", "block_idx").distinct()
    return marking.place_blocks(blocks, "layout-a", NUM_BITS, "prefix")


@query("w04_embed", with_sql(MARK_SQL) + "SELECT series_id, note_idx, residual, bit_idx, chip, marked FROM mark")
def _(spark, sf):
    return marked(spark, sf).select("series_id", "note_idx", "residual", "bit_idx", "chip", "marked")


@query(
    "w05_correlate_decode",
    with_sql(MARK_SQL)
    + """SELECT series_id, bit_idx, c AS correlation, n_valid, CASE WHEN c >= 0 THEN 1 ELSE -1 END AS decoded_bit FROM
         (SELECT series_id, bit_idx, coalesce(sum(marked * chip), 0) + 0.0::DOUBLE AS c, count(marked) AS n_valid FROM mark
          WHERE bit_idx IS NOT NULL GROUP BY ALL)""",
)
def _(spark, sf):
    out = marking.correlate(marked(spark, sf), "marked")
    return out.withColumn("correlation", F.col("correlation") + F.lit(0.0))


@query(
    "w06_w08_capacity_policy",
    """SELECT doc_id, cap AS capacity, alloc AS allocated,
         CASE WHEN alloc // 8 >= 1 THEN 'NORMAL_7_5' WHEN cap >= 64 THEN 'FLOOR_12_5' ELSE 'NO_CAPACITY' END AS capacity_class,
         CASE WHEN alloc // 8 >= 1 THEN alloc // 8 * 8 WHEN cap >= 64 THEN 8 ELSE 0 END AS transmitted,
         CASE WHEN alloc // 8 >= 1 THEN alloc // 8 * 4 WHEN cap >= 64 THEN 4 ELSE 0 END AS useful
       FROM (SELECT doc_id, n_chars // 8 AS cap, CASE WHEN n_chars // 8 = 0 THEN 0 ELSE greatest(1, (n_chars // 8) * 3 // 40) END AS alloc FROM documents)""",
)
def _(spark, sf):
    d = policy.payload_decision(F.col("n_chars"))
    return table(spark, sf, "documents").select("doc_id", d.alias("d")).select("doc_id", "d.*")


@query(
    "w07_fraction_bits",
    "SELECT doc_id, CASE WHEN n_chars // 8 = 0 THEN 0 ELSE greatest(1, (n_chars // 8) * 1 // 8) END AS bits FROM documents",
)
def _(spark, sf):
    cap = policy.capacity(F.col("n_chars"))
    return table(spark, sf, "documents").select("doc_id", policy.fraction_bits(cap, 1, 8).alias("bits"))


QUALITY_SQL = """q AS (SELECT *, (300*count_300 + 100*count_100 + 50*count_50)::BIGINT AS num,
      (300*(count_300+count_100+count_50+count_miss))::BIGINT AS den FROM headers)"""


@query(
    "w09_quality",
    with_sql(R.HEADERS_SQL, QUALITY_SQL)
    + f"""SELECT series_id, num, den, den // 300 AS total_judgements, {rnd('num/den')} AS accuracy,
          {rnd('count_miss/(den/300)')} AS miss_fraction FROM q""",
)
def _(spark, sf):
    counts = [F.col(c) for c in ("count_300", "count_100", "count_50", "count_miss")]
    num, den = policy.accuracy_ratio(*counts)
    out = R.headers(spark, sf).select("series_id", num.alias("num"), den.alias("den"), policy.quality(*counts).alias("q"))
    return rounded(out.select("series_id", "num", "den", "q.*"))


@query(
    "w10_strength_policy",
    with_sql(R.HEADERS_SQL, QUALITY_SQL)
    + f"""SELECT series_id,
        [{", ".join(f"{a}::DOUBLE" for a in policy.StrengthPolicy().alphas)}][1 + {" + ".join(f"(num::HUGEINT*{d} >= den::HUGEINT*{n})::INT" for n, d in policy.StrengthPolicy().thresholds)}] AS alpha,
        CASE WHEN num/den >= 0.75 THEN 10.0::DOUBLE WHEN num/den >= 0.5 THEN 15.0::DOUBLE ELSE 20.0::DOUBLE END AS alpha_float,
        CASE category WHEN 'BUILDING' THEN 12.0::DOUBLE WHEN 'MACHINERY' THEN 16.0::DOUBLE END AS alpha_category FROM q""",
)
def _(spark, sf):
    counts = [F.col(c) for c in ("count_300", "count_100", "count_50", "count_miss")]
    num, den = policy.accuracy_ratio(*counts)
    return R.headers(spark, sf).select(
        "series_id",
        policy.strength(num, den).alias("alpha"),
        policy.strength_float(num / den, (0.5, 0.75), (20.0, 15.0, 10.0)).alias("alpha_float"),
        policy.strength_by_category(F.col("category"), {"BUILDING": 12.0, "MACHINERY": 16.0}).alias("alpha_category"),
    )


@query(
    "w12_hit_window_guard",
    with_sql(MARK_SQL, "g AS (SELECT *, coalesce(round_even(marked - residual, 0), 0)::BIGINT AS ask FROM mark)")
    + """SELECT series_id, note_idx, (ask <> 0)::INT AS requested, coalesce(ask <> 0 AND abs(residual + ask) > 95, false)::INT AS hit_drop,
           CASE WHEN ask <> 0 AND abs(residual + ask) > 95 THEN 0 ELSE ask END AS shift_ms FROM g""",
)
def _(spark, sf):
    out = marking.guard_window(marked(spark, sf), 100.0, 5.0)
    return out.select("series_id", "note_idx", "requested", F.coalesce("hit_drop", F.lit(0)).alias("hit_drop"), "shift_ms")


SHIFT = 1_800_000
ANCHORS_SQL = R.TIMED_SQL + f""",
    anchors AS (SELECT DISTINCT t.series_id, t.frame_idx, t.abs_ms AS t,
       CASE WHEN ('0x' || substr(sha256('shift|' || t.series_id || '|' || t.frame_idx), 2, 1))::INT < 10
            THEN {sgn("'dir|' || t.series_id || '|' || t.frame_idx")} * {SHIFT} ELSE 0 END AS shift_ms
       FROM timed t JOIN presses p ON p.series_id = t.series_id AND p.frame_idx = t.frame_idx)"""
PASSES_SQL = """passes AS (
      SELECT 0 AS k, series_id, frame_idx, t, shift_ms, shift_ms AS safe, true AS moved FROM anchors
      UNION ALL
      SELECT k + 1, series_id, frame_idx, t, shift_ms, nxt, bool_or(nxt <> safe) OVER (PARTITION BY series_id) FROM
        (SELECT *, CASE WHEN coalesce(t + safe < pv, false) OR coalesce(t + safe > nx, false) THEN 0 ELSE safe END AS nxt
         FROM (SELECT *, lag(t + safe) OVER w AS pv, lead(t + safe) OVER w AS nx FROM passes WHERE moved
               WINDOW w AS (PARTITION BY series_id ORDER BY frame_idx)))),
    repaired AS (SELECT * FROM (SELECT *, max(k) OVER (PARTITION BY series_id) AS last FROM passes) WHERE k = last)"""
ANCHORS_SQL += ",\n" + PASSES_SQL


def anchors(spark, sf, back=None):
    hot = R.hot_users(spark, sf)
    timed = frames.absolute_times(R.frames(spark, sf, hot), hot)
    if back is not None:
        timed = timed.withColumn("abs_ms", F.col("abs_ms") - back)
    downs = frames.key_down_frames(frames.key_downs(timed, hot)).join(
        timed.select("series_id", "frame_idx", F.col("abs_ms").alias("t")), ["series_id", "frame_idx"]
    )
    at = (F.col("series_id"), F.col("frame_idx"))
    asked = F.conv(F.substring(H.digest("shift", *at), 2, 1), 16, 10).cast("int") < 10
    shift = F.when(asked, H.sign("dir", *at) * SHIFT).otherwise(0).cast("long")
    return timed, downs.withColumn("shift_ms", shift), hot


RETIME_SQL = """j AS (SELECT f.series_id, f.frame_idx, f.abs_ms, f.abs_ms + r.safe AS target FROM timed f
            LEFT JOIN repaired r ON r.series_id = f.series_id AND r.frame_idx = f.frame_idx),
        c AS (SELECT *, last_value(target IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
               first_value(target IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY frame_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM j),
        m AS (SELECT *, coalesce(target, least(greatest(abs_ms, coalesce(l, abs_ms)), coalesce(r, greatest(abs_ms, coalesce(l, abs_ms))))) AS new_ms FROM c)"""


@query("w13_keep_order", "WITH RECURSIVE " + ANCHORS_SQL + " SELECT series_id, frame_idx, t, shift_ms, safe AS safe_shift_ms FROM repaired")
def _(spark, sf):
    _, at, hot = anchors(spark, sf)
    return marking.keep_order(at, hot)


@query(
    "w13_order_rejects",
    "WITH RECURSIVE " + ANCHORS_SQL.replace("sum(time_delta_ms) OVER (PARTITION BY series_id ORDER BY frame_idx)::BIGINT AS abs_ms", "(sum(time_delta_ms) OVER (PARTITION BY series_id ORDER BY frame_idx) - CASE WHEN frame_idx % 9 = 4 THEN 90000000 ELSE 0 END)::BIGINT AS abs_ms")
    + """ SELECT series_id, frame_idx, 'unresolvable_inversion' AS reason FROM
         (SELECT *, lag(t + safe) OVER (PARTITION BY series_id ORDER BY frame_idx) AS pv FROM repaired) WHERE pv > t + safe""",
)
def _(spark, sf):
    _, at, hot = anchors(spark, sf, F.when(F.col("frame_idx") % 9 == 4, 90_000_000).otherwise(0))  # frames that jump back
    return marking.order_violations(marking.keep_order(at, hot), hot)


@query(
    "w14_retime",
    "WITH RECURSIVE "
    + ANCHORS_SQL
    + ",\n"
    + RETIME_SQL
    + """
      SELECT series_id, frame_idx, abs_ms, new_ms, new_ms - coalesce(lag(new_ms) OVER (PARTITION BY series_id ORDER BY frame_idx), 0) AS new_delta_ms FROM m""",
)
def _(spark, sf):
    timed, at, hot = anchors(spark, sf)
    out = marking.retime(timed, marking.keep_order(at, hot), hot)
    return out.select("series_id", "frame_idx", "abs_ms", "new_ms", "new_delta_ms")


TRIP = dict(window_ms=900_000, margin_ms=5.0, n=4, alpha=120_000.0)


def trip(spark, sf):
    hot = R.hot_users(spark, sf)
    timed = frames.absolute_times(R.frames(spark, sf, hot), hot)
    views = R.events(spark, sf).where(F.col("event_type") == "view").select(
        F.col("user_id").alias("series_id"),
        "event_id",
        (R.epoch_ms(F.col("ts")) + (H.seed32("note", F.col("event_id")) % 1201 - 600) * 1000).alias("note_ms"),
    )
    from pulsemark.functions.ordered import with_position

    notes = with_position(views, ["series_id"], ["note_ms", "event_id"], "note_idx", hot).select("series_id", "note_idx", "note_ms")
    return sweep.round_trip(timed, notes, pn_key="pn-a", layout_key="layout-a", family="random_a", num_bits=NUM_BITS, hot=hot, **TRIP)


LIMIT = TRIP["window_ms"] - TRIP["margin_ms"]
TRIP_SQL = ",\n".join(
    [
        R.TIMED_SQL,
        """notes AS (SELECT series_id, note_ms, row_number() OVER (PARTITION BY series_id ORDER BY note_ms, event_id) - 1 AS note_idx FROM
          (SELECT user_id AS series_id, event_id, epoch_us(ts)//1000 + (('0x' || substr(sha256('note|' || event_id), 1, 8))::BIGINT % 1201 - 600) * 1000 AS note_ms
           FROM events WHERE event_type = 'view'))""",
        R.walk_sql(TRIP["window_ms"], "1"),
        """clean AS (SELECT series_id, note_idx, CASE WHEN frame_idx IS NULL OR rn = 1 THEN residual END AS residual,
            CASE WHEN frame_idx IS NOT NULL AND rn = 1 THEN frame_idx END AS frame_idx
          FROM (SELECT *, row_number() OVER (PARTITION BY series_id, frame_idx ORDER BY note_idx) AS rn FROM indexed1))""",
        carriers_sql(TRIP["n"], "_t").replace("FROM r1", "FROM clean"),
        f"""asked AS (SELECT *, coalesce(round_even(marked - residual, 0), 0)::BIGINT AS ask FROM
            (SELECT *, coalesce(round_even(residual + {TRIP["alpha"]}::DOUBLE * chip * bit, 0), residual) AS marked FROM car_t)),
        guarded AS (SELECT *, (ask <> 0)::INT AS requested, coalesce(ask <> 0 AND abs(residual + ask) > {LIMIT}, false)::INT AS hit_drop,
            CASE WHEN ask <> 0 AND abs(residual + ask) > {LIMIT} THEN 0 ELSE ask END AS shift_ms FROM asked),
        anchors AS (SELECT t.series_id, t.frame_idx, t.abs_ms AS t, coalesce(g.shift_ms, 0) AS shift_ms FROM timed t
            JOIN (SELECT DISTINCT series_id, frame_idx FROM presses) p ON p.series_id = t.series_id AND p.frame_idx = t.frame_idx
            LEFT JOIN (SELECT * FROM guarded WHERE shift_ms <> 0 AND frame_idx IS NOT NULL) g ON g.series_id = t.series_id AND g.frame_idx = t.frame_idx)""",
        PASSES_SQL,
        RETIME_SQL,
        """presses2 AS (SELECT p.series_id, p.frame_idx, new_ms AS press_ms, row_number() OVER (PARTITION BY p.series_id ORDER BY new_ms, button, p.frame_idx) - 1 AS press_idx
            FROM presses p JOIN m ON m.series_id = p.series_id AND m.frame_idx = p.frame_idx)""",
        R.walk_sql(TRIP["window_ms"], "2", "presses2"),
        """trip AS (SELECT g.*, i.residual AS after, coalesce(safe, 0) <> 0 AND g.shift_ms <> 0 AS active, CASE WHEN coalesce(safe, 0) <> 0 AND g.shift_ms <> 0 THEN safe ELSE 0 END AS moved
            FROM guarded g LEFT JOIN repaired r ON r.series_id = g.series_id AND r.frame_idx = g.frame_idx
            LEFT JOIN indexed2 i ON i.series_id = g.series_id AND i.note_idx = g.note_idx)""",
    ]
)
TRIP_SUMS = """sum(requested)::BIGINT AS requested_carriers, count(*) FILTER (active) AS active_carriers, sum(requested)::BIGINT - count(*) FILTER (active) AS dropped_carriers,
    sum(hit_drop)::BIGINT AS hit_window_drops, count(*) FILTER (shift_ms <> 0 AND NOT active) AS chronology_drops,
    count(*) FILTER (residual IS NOT NULL AND after IS NULL) AS new_unmatched_events, count(*) FILTER (residual IS NULL AND after IS NOT NULL) AS new_matched_events,
    count(*) FILTER ((residual IS NULL) <> (after IS NULL)) AS rematching_changes, sum((moved * moved)::DOUBLE) AS sum_squared_shift_ms2,
    sum(abs(moved)::DOUBLE) AS total_absolute_shift_ms, count(residual) AS clean_valid_residuals"""


@query("w15_round_trip", "WITH RECURSIVE " + TRIP_SQL + f" SELECT series_id, {TRIP_SUMS} FROM trip GROUP BY series_id")
def _(spark, sf):
    out = sweep.diagnostics(trip(spark, sf), ["series_id"], TRIP["n"], TRIP["alpha"])
    keep = [
        "requested_carriers", "active_carriers", "dropped_carriers", "hit_window_drops", "chronology_drops", "new_unmatched_events",
        "new_matched_events", "rematching_changes", "sum_squared_shift_ms2", "total_absolute_shift_ms", "clean_valid_residuals",
    ]
    return out.select("series_id", *keep)


@query(
    "w16_bit_diagnostics",
    "WITH RECURSIVE "
    + TRIP_SQL
    + f""", g AS (SELECT series_id, bit_idx, max(bit) AS true_bit, coalesce(sum(after * chip), 0) AS c, count(after) AS there, min(block_idx) AS block_idx, max(capacity) AS capacity,
           max(num_notes) AS num_notes, {TRIP_SUMS}, avg(residual) AS mean, var_pop(residual) AS var, avg(abs(residual)) AS mabs, coalesce(sum(residual * chip), 0) AS pn
         FROM trip WHERE bit_idx IS NOT NULL GROUP BY series_id, bit_idx)
       SELECT g.* EXCLUDE (c, there, mean, var, mabs, pn), {rnd('c')} AS correlation, {rnd('abs(c)')} AS abs_correlation,
         {rnd(f"abs(c) / ({TRIP['alpha']}::DOUBLE * greatest(1, there))", 6)} AS normalized_abs_correlation, there AS roundtrip_valid_carriers,
         {rnd('mean', 5)} AS clean_mean_residual, {rnd('sqrt(var)', 5)} AS clean_deviation, {rnd('mabs', 5)} AS clean_mean_absolute_residual, {rnd('pn')} AS clean_pn_correlation,
         CASE WHEN c >= 0 THEN 1 ELSE -1 END AS decoded_bit, ((c >= 0) <> (true_bit = 1))::INT AS is_error, block_idx * {TRIP['n']} AS block_start_note,
         {rnd(f"(2 * block_idx * {TRIP['n']} + {TRIP['n']}) / (2.0::DOUBLE * num_notes)", 6)} AS block_center_fraction, least(3, 4 * block_idx // nullif(capacity, 0)) + 1 AS block_quarter FROM g""",
)
def _(spark, sf):
    rows = trip(spark, sf).where(F.col("bit_idx").isNotNull())
    out = sweep.diagnostics(rows, ["series_id", "bit_idx"], TRIP["n"], TRIP["alpha"])
    out = out.withColumn("clean_deviation", F.sqrt("clean_variance")).drop("clean_variance")  # squares this large round at exact halves
    return rounded(out, 6, clean_deviation=5, clean_mean_residual=5, clean_mean_absolute_residual=5)


KEYS = ("pn-a", "pn-b", "pn-c", "pn-d")
MARGIN_SQL = CAR_SQL + f""",
    cand AS (SELECT unnest(['pn-a','pn-b','pn-c','pn-d']) AS key_id),
    mar AS (SELECT series_id, key_id, bit_idx, any_value(bit) * coalesce(sum(residual * {sgn("key_id || '|chip|' || (bit_idx * 8 + note_idx % 8)")}), 0)
              + 12.0::DOUBLE * count(residual) + 0.0::DOUBLE AS margin
            FROM car, cand WHERE bit_idx IS NOT NULL GROUP BY series_id, key_id, bit_idx),
    sc AS (SELECT series_id, key_id, sum((margin <= 0)::INT)::BIGINT AS nonpositive_count, min(margin) AS minimum_margin,
             round(avg(margin), 9) AS mean_margin FROM mar GROUP BY ALL)"""


def margins(spark, sf):
    base = carried(spark, sf).where(F.col("bit_idx").isNotNull())
    each = base.withColumn("key_id", F.explode(F.array(*[F.lit(k) for k in KEYS])))
    each = each.withColumn("chip", marking.chip(F.col("key_id"), F.col("bit_idx") * 8 + F.col("note_idx") % 8))
    clean = marking.correlate(each, "residual", ["series_id", "key_id"])
    out = marking.predicted_margins(clean, bit_of(), 12.0)
    return out.withColumn("margin", F.col("margin") + F.lit(0.0))


def margin_scores(spark, sf):
    return rounded(marking.summarize_margins(margins(spark, sf), ["series_id", "key_id"]))


@query("w17_predicted_margins", with_sql(MARGIN_SQL) + "SELECT series_id, key_id, bit_idx, margin FROM mar")
def _(spark, sf):
    return margins(spark, sf).select("series_id", "key_id", "bit_idx", "margin")


@query("w17_margin_summary", with_sql(MARGIN_SQL) + "SELECT * FROM sc")
def _(spark, sf):
    return margin_scores(spark, sf)


@query(
    "w18_selected_candidate",
    with_sql(MARGIN_SQL)
    + """SELECT k, series_id, key_id FROM (SELECT k, series_id, key_id, row_number() OVER (PARTITION BY k, series_id
           ORDER BY nonpositive_count, minimum_margin DESC, mean_margin DESC, key_id) AS rn
         FROM sc, (SELECT unnest([1,2,4]) AS k) WHERE key_id < 'pn-' || substr('abcde', k + 1, 1)) WHERE rn = 1""",
)
def _(spark, sf):
    rank = F.array_position(F.array(*[F.lit(k) for k in KEYS]), F.col("key_id")) - 1
    scores = margin_scores(spark, sf).withColumn("candidate_rank", rank)
    each = scores.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4)))).where(F.col("candidate_rank") < F.col("k"))
    return marking.select_candidate(each, ["k", "series_id"], "key_id")


@query(
    "w20_message_families",
    f"""SELECT c_custkey, fam AS family, b AS bit_idx,
         (CASE fam WHEN 'all_zero' THEN -1 WHEN 'all_one' THEN 1 WHEN 'alternating' THEN CASE WHEN b % 2 = 1 THEN 1 ELSE -1 END
          ELSE {sgn("fam || '|' || c_custkey || '|bit|' || b")} END)::INT AS bit
       FROM (SELECT c_custkey, unnest(['all_zero','all_one','alternating','random_a','random_b']) AS fam FROM customer)
       JOIN (SELECT unnest(range(0, 12))::INT AS b) k ON true""",
)
def _(spark, sf):
    fam = F.explode(F.array(*[F.lit(f) for f in marking.FAMILIES]))
    base = table(spark, sf, "customer").select("c_custkey", fam.alias("family"))
    at = base.withColumn("bit_idx", F.explode(F.sequence(F.lit(0), F.lit(11))))
    return at.withColumn("bit", marking.message_bit(F.col("family"), F.col("c_custkey"), F.col("bit_idx")))


ALPHAS, NS = (8.0, 12.0, 20.0), (8, 16)


def _sweep_sql() -> str:
    parts = [R.R1_SQL]
    runs = []
    for n in NS:
        parts.append(carriers_sql(n, f"_{n}"))
        runs.append(
            f"""SELECT series_id, alpha, {n} AS n, bit_idx, any_value(bit) AS bit,
               coalesce(sum((round_even(residual + alpha * chip * bit, 0)) * chip), 0) AS c
               FROM car_{n}, (SELECT unnest([8.0::DOUBLE, 12.0::DOUBLE, 20.0::DOUBLE]) AS alpha) WHERE bit_idx IS NOT NULL GROUP BY ALL"""
        )
    parts.append("runs AS (" + " UNION ALL ".join(runs) + ")")
    parts.append(
        """per AS (SELECT series_id, alpha, n, count(*) AS bits, sum(((c >= 0) <> (bit = 1))::INT)::BIGINT AS errors FROM runs GROUP BY ALL),
        cells AS (SELECT series_id, alpha, n, nn // n AS capacity FROM (SELECT series_id, max(note_idx) + 1 AS nn FROM r1 GROUP BY 1),
           (SELECT unnest([8.0::DOUBLE, 12.0::DOUBLE, 20.0::DOUBLE]) AS alpha), (SELECT unnest([8, 16])::INT AS n))"""
    )
    return (
        with_sql(*parts)
        + f"""SELECT c.series_id, c.alpha, c.n, capacity, CASE WHEN capacity = 0 THEN 'SKIP_CAPACITY' ELSE 'OK' END AS status,
        coalesce(bits, 0) AS bits, coalesce(errors, 0) AS errors, {rnd('errors / bits')} AS error_rate
        FROM cells c LEFT JOIN per p ON p.series_id = c.series_id AND p.alpha = c.alpha AND p.n = c.n"""
    )


@query("w27_sweep", _sweep_sql())
def _(spark, sf):
    res = settle(r1(spark, sf)[0].select("series_id", "note_idx", "residual"))  # read once per n by the sweep
    return rounded(sweep.run_sweep(res, ALPHAS, NS, "pn-a", "layout-a", "random_a", NUM_BITS))


W27_MARKED = MARK_SQL + """,
    m1 AS (SELECT series_id, note_idx, marked AS residual FROM mark)"""


@query(
    "w27_sweep_features",
    f"SELECT *, 12.0::DOUBLE AS alpha, 0 AS label FROM ({FEATURES_R1}) UNION ALL BY NAME SELECT *, 12.0::DOUBLE AS alpha, 1 AS label FROM ({features_sql('m1', W27_MARKED)})",
)
def _(spark, sf):
    pairs = sweep.marked_pairs(r1(spark, sf)[0], (12.0,), 8, "pn-a", "layout-a", "random_a", NUM_BITS)
    return rounded(features.series_features(settle(pairs), ["series_id", "alpha", "label"], sized=True), 6)


GRID = sweep.Grid((8.0, 20.0), (8, 16), (0.5, 0.75), ("distributed", "prefix"), ("pn-a", "pn-b"), ("random_a", "alternating"), {"near": "layout-a", "far": "layout-b"})


def _listed(values) -> str:
    return "unnest([" + ", ".join(f"{v}::DOUBLE" if isinstance(v, float) else f"'{v}'" for v in values) + "])"


def _grid_parts(grid: sweep.Grid) -> list[str]:
    """Settings, shapes, and the carriers of every cell (``ch``) with their chip and bit."""
    parts, runs, shapes = [R.R1_SQL], [], []
    for i, (condition, key, n, fraction, layout) in enumerate(grid.shapes()):
        order = f"sha256('{key}|' || capacity || '|' || block_idx), block_idx" if layout == "distributed" else "block_idx"
        where = f"'{condition}' AS condition, {n} AS n, {fraction}::DOUBLE AS payload_fraction, '{layout}' AS layout"
        shapes.append(f"SELECT {where}")
        parts.append(
            f"""b{i} AS (SELECT series_id, note_idx, residual, nn // {n} AS capacity, CASE WHEN note_idx // {n} < nn // {n} THEN note_idx // {n} END AS block_idx
                FROM (SELECT *, max(note_idx) OVER (PARTITION BY series_id) + 1 AS nn FROM r1)),
            p{i} AS (SELECT * FROM (SELECT capacity, block_idx, row_number() OVER (PARTITION BY capacity ORDER BY {order}) - 1 AS bit_idx
                FROM (SELECT DISTINCT capacity, block_idx FROM b{i} WHERE block_idx IS NOT NULL)) WHERE bit_idx < greatest(1, floor(capacity * {fraction}::DOUBLE + 1e-9::DOUBLE)))"""
        )
        runs.append(
            f"""SELECT b{i}.series_id, {where}, bit_idx, note_idx, residual, bit_idx * {n} + note_idx % {n} AS spot FROM b{i} JOIN p{i} ON p{i}.capacity = b{i}.capacity AND p{i}.block_idx = b{i}.block_idx"""
        )
    axes = (f"(SELECT {_listed(v)} AS {n})" for n, v in (("alpha", grid.alphas), ("pn_key", grid.pn_keys), ("family", grid.families)))
    parts.append(f"settings AS (SELECT * FROM {', '.join(axes)})")
    parts.append(f"shapes AS ({' UNION ALL '.join(shapes)})")
    parts.append("rows AS (" + " UNION ALL ".join(runs) + ")")
    parts.append(
        f"""ch AS (SELECT *, {sgn("pn_key || '|chip|' || spot")} AS chip, CASE family WHEN 'alternating' THEN CASE WHEN bit_idx % 2 = 1 THEN 1 ELSE -1 END
              ELSE {sgn("family || '|' || series_id || '|bit|' || bit_idx")} END AS bit FROM rows, settings)"""
    )
    return parts


def _grid_sql() -> str:
    """Every cell of GRID, from carriers placed per shape."""
    parts = _grid_parts(GRID)
    parts.append(
        """per_bit AS (SELECT series_id, condition, n, payload_fraction, layout, alpha, pn_key, family, bit_idx, any_value(bit) AS bit,
              coalesce(sum(coalesce(round_even(residual + alpha * chip * bit, 0), residual) * chip), 0) AS c FROM ch GROUP BY ALL),
        per AS (SELECT series_id, condition, n, payload_fraction, layout, alpha, pn_key, family, count(*) AS bits, sum(((c >= 0) <> (bit = 1))::INT)::BIGINT AS errors
              FROM per_bit GROUP BY ALL),
        cells AS (SELECT series_id, shapes.*, settings.*, nn // n AS capacity FROM (SELECT series_id, max(note_idx) + 1 AS nn FROM r1 GROUP BY 1), shapes, settings)"""
    )
    return with_sql(*parts) + f"""SELECT series_id, condition, n, payload_fraction, layout, alpha, pn_key, family, capacity, CASE WHEN capacity = 0 THEN 'SKIP_CAPACITY' ELSE 'OK' END AS status,
        coalesce(bits, 0) AS bits, coalesce(errors, 0) AS errors, {rnd('errors / bits')} AS error_rate
        FROM cells LEFT JOIN per USING (series_id, condition, n, payload_fraction, layout, alpha, pn_key, family)"""


@query("w27_full_grid", _grid_sql())
def _(spark, sf):
    res = settle(r1(spark, sf)[0].select("series_id", "note_idx", "residual"))  # read once per shape
    return rounded(sweep.run_grid(res, GRID))


# two values on each of four axes: strength, block length, layout, message family
FEATURE_GRID = sweep.Grid((8.0, 20.0), (8, 16), (0.75,), ("distributed", "prefix"), ("pn-a",), ("random_a", "alternating"), {"near": "layout-a"})


NUDGE = 1.37e-8  # values that lie on a half of the last digit, such as -5/128, round alike in both engines after it


def _grid_features_sql() -> str:
    """Features of every cell of FEATURE_GRID; a series under one cell is a series of its own meanwhile."""
    nudged = lambda sql: sql.replace("::DOUBLE, 6) + 0.0", f"::DOUBLE + {NUDGE}::DOUBLE, 6) + 0.0")
    axes = "series_id, condition, n, payload_fraction, layout, alpha, pn_key, family"
    parts = _grid_parts(FEATURE_GRID) + [
        f"""cells AS (SELECT series_id, shapes.*, settings.* FROM (SELECT series_id, max(note_idx) + 1 AS nn FROM r1 GROUP BY 1), shapes, settings WHERE nn // n > 0),
        named AS (SELECT *, concat_ws('|', {axes}) AS cell FROM cells),
        marks AS (SELECT {axes}, note_idx, round_even(residual + alpha * chip * bit, 0) AS m FROM ch),
        m1 AS (SELECT cell AS series_id, note_idx, coalesce(m, residual) AS residual FROM
               (SELECT named.*, note_idx, residual FROM named JOIN r1 ON r1.series_id = named.series_id) LEFT JOIN marks USING ({axes}, note_idx))"""
    ]
    marked = nudged(features_sql("m1", ",\n".join(parts)))
    cells = with_sql(*parts) + "SELECT * FROM named"
    return f"""SELECT f.* EXCLUDE (series_id), c.* EXCLUDE (cell), 1 AS label FROM ({marked}) f JOIN ({cells}) c ON c.cell = f.series_id
      UNION ALL BY NAME SELECT f.* EXCLUDE (series_id), c.* EXCLUDE (cell), 0 AS label FROM ({nudged(FEATURES_R1)}) f JOIN ({cells}) c ON c.series_id = f.series_id"""


@query("w27_grid_features", _grid_features_sql())
def _(spark, sf):
    res = settle(r1(spark, sf)[0].select("series_id", "note_idx", "residual"))
    found = sweep.grid_features(res, FEATURE_GRID)
    return rounded(found.withColumns({c: F.col(c) + NUDGE for c in found.columns if c in features.FULL or c == "valid_residual_fraction"}), 6)
