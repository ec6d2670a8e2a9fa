"""Frame shaping, matching and calibration queries (K, J1-J5, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsemark.operators import calibrate, features, frames, matching
from pulsemark.plans import roles as R
from pulsemark.plans.registry import query, rnd, rounded, table
from pulsemark.plans.roles import with_sql
from pulsemark.plans.series import features_sql
from pulsemark.session import settle

W = R.MATCH_WINDOW_MS


def timed(spark, sf):
    hot = R.hot_users(spark, sf)
    return frames.absolute_times(R.frames(spark, sf, hot), hot), hot


@query("k01_absolute_times", with_sql(R.TIMED_SQL) + "SELECT series_id, frame_idx, abs_ms FROM timed")
def _(spark, sf):
    return timed(spark, sf)[0].select("series_id", "frame_idx", "abs_ms")


@query(
    "k02_sentinel_violations",
    with_sql(R.FRAMES_SQL)
    + """SELECT series_id, min(CASE WHEN time_delta_ms = -12345 THEN frame_idx END) AS first_sentinel,
           max(CASE WHEN time_delta_ms <> -12345 THEN frame_idx END) AS last_frame
         FROM frames GROUP BY series_id
         HAVING max(CASE WHEN time_delta_ms <> -12345 THEN frame_idx END) > min(CASE WHEN time_delta_ms = -12345 THEN frame_idx END)""",
)
def _(spark, sf):
    return frames.sentinel_violations(R.frames(spark, sf, R.hot_users(spark, sf)))


@query("k03_key_downs", with_sql(R.TIMED_SQL) + "SELECT series_id, press_idx, press_ms, frame_idx, button FROM presses")
def _(spark, sf):
    t, hot = timed(spark, sf)
    return frames.key_downs(t, hot).select("series_id", "press_idx", "press_ms", "frame_idx", "button")


@query("k04_key_down_frames", with_sql(R.TIMED_SQL) + "SELECT DISTINCT series_id, frame_idx FROM presses")
def _(spark, sf):
    t, hot = timed(spark, sf)
    return frames.key_down_frames(frames.key_downs(t, hot))


@query(
    "k05_aligned_presses",
    with_sql(R.TIMED_SQL)
    + """SELECT p.series_id, press_idx, press_ms + n_regionkey * 100 - 200 AS press_ms, series_id % 30 AS map_id
         FROM presses p JOIN nation ON n_nationkey = series_id % 30""",
)
def _(spark, sf):
    t, hot = timed(spark, sf)
    presses = frames.key_downs(t, hot)
    who = t.select("series_id", (F.col("series_id") % 30).alias("map_id")).distinct()
    offsets = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("map_id"), (F.col("n_regionkey") * 100 - 200).alias("offset_ms")
    )
    return frames.align_to_map(presses, who, offsets)[0].select("series_id", "press_idx", "press_ms", "map_id")


@query(
    "k05_missing_offsets",
    """SELECT DISTINCT user_id AS series_id, 'no_offset' AS reason FROM events
       WHERE user_id % 30 NOT IN (SELECT n_nationkey FROM nation)""",
)
def _(spark, sf):
    presses = R.events(spark, sf).select(F.col("user_id").alias("series_id"), F.lit(0).cast("long").alias("press_ms"))
    who = presses.select("series_id", (F.col("series_id") % 30).alias("map_id")).distinct()
    offsets = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("map_id"), F.lit(0).alias("offset_ms")
    )
    return frames.align_to_map(presses, who, offsets)[1]


@query(
    "k06_hit_windows",
    f"""SELECT p_partkey, {rnd('od')} AS difficulty, {rnd('200.0::DOUBLE - 10.0::DOUBLE * od')} AS window_ms
        FROM (SELECT p_partkey, CASE WHEN p_partkey & 16 <> 0 THEN least(e * 1.4::DOUBLE, 10.0::DOUBLE) ELSE e END AS od
              FROM (SELECT p_partkey, CASE WHEN p_partkey & 2 <> 0 THEN p_size / 5.0::DOUBLE * 0.5::DOUBLE
                           ELSE p_size / 5.0::DOUBLE END AS e FROM part))""",
)
def _(spark, sf):
    od = frames.effective_difficulty(F.col("p_size") / F.lit(5.0), F.col("p_partkey"))
    return rounded(
        table(spark, sf, "part").select("p_partkey", od.alias("difficulty"), frames.hit_window_ms(od).alias("window_ms"))
    )


@query(
    "k08_reused_frames",
    with_sql(R.R1_SQL)
    + """SELECT series_id, note_idx, CASE WHEN frame_idx IS NULL OR rn = 1 THEN residual END AS residual,
           CASE WHEN rn = 1 THEN frame_idx END AS frame_idx, coalesce(frame_idx IS NOT NULL AND rn > 1, false) AS removed
         FROM (SELECT *, row_number() OVER (PARTITION BY series_id, frame_idx ORDER BY note_idx) AS rn FROM r1)
      """.replace("CASE WHEN rn = 1 THEN frame_idx END", "CASE WHEN frame_idx IS NOT NULL AND rn = 1 THEN frame_idx END"),
)
def _(spark, sf):
    return frames.drop_reused_frames(R.residuals_events(spark, sf, R.hot_users(spark, sf)))


@query(
    "k09_unique_targets",
    """SELECT l_suppkey AS series_id, l_orderkey AS frame_idx,
         CASE WHEN min(l_linenumber) = max(l_linenumber) THEN min(l_linenumber) END AS shift_ms,
         min(l_linenumber) <> max(l_linenumber) AS rejected
       FROM lineitem GROUP BY ALL""",
)
def _(spark, sf):
    targets = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("series_id"), F.col("l_orderkey").alias("frame_idx"), F.col("l_linenumber").alias("shift_ms")
    )
    good, bad = frames.unique_targets(targets)
    bad = bad.select("series_id", "frame_idx", F.lit(None).cast("int").alias("shift_ms"), F.lit(True).alias("rejected"))
    return good.withColumn("rejected", F.lit(False)).unionByName(bad)


CHAIN_SQL = R.MATCH_SQL + ",\n" + R.chain_sql(W)
WALK_SQL = R.MATCH_SQL + ",\n" + R.walk_sql(W)


@query(
    "j01_band_pairs",
    with_sql(R.MATCH_SQL)
    + f"""SELECT p.series_id, press_idx, note_idx, press_ms - note_ms AS error_ms
          FROM presses p JOIN notes n ON p.series_id = n.series_id AND press_ms BETWEEN note_ms - {W} AND note_ms + {W}""",
)
def _(spark, sf):
    presses, notes = R.presses_notes(spark, sf, R.hot_users(spark, sf))
    return matching.band_pairs(presses, notes, W).select(
        "series_id", "press_idx", "note_idx", (F.col("press_ms") - F.col("note_ms")).alias("error_ms")
    )


@query("j02_optimal_match", "WITH RECURSIVE " + WALK_SQL + " SELECT * FROM matched")
def _(spark, sf):
    hot = R.hot_users(spark, sf)
    presses, notes = R.presses_notes(spark, sf, hot)
    return matching.match_optimal(presses, notes, W, hot)


@query(
    "j02_match_totals",
    "WITH RECURSIVE "
    + CHAIN_SQL
    + """
    SELECT series_id, k AS matches, min(cost)::BIGINT AS total_abs_error FROM chain
    WHERE (series_id, k) IN (SELECT series_id, max(k) FROM chain GROUP BY series_id) GROUP BY series_id, k""",
)
def _(spark, sf):
    hot = R.hot_users(spark, sf)
    presses, notes = R.presses_notes(spark, sf, hot)
    m = matching.match_optimal(presses, notes, W, hot)
    return m.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("matches"), F.sum(F.abs(F.col("press_ms") - F.col("note_ms"))).alias("total_abs_error")
    )


@query("j03_indexed_residuals", "WITH RECURSIVE " + WALK_SQL + " SELECT * FROM indexed")
def _(spark, sf):
    hot = R.hot_users(spark, sf)
    presses, notes = R.presses_notes(spark, sf, hot)
    return matching.indexed_residuals(notes, matching.match_optimal(presses, notes, W, hot))


@query("j04_matched_residuals", "WITH RECURSIVE " + WALK_SQL + " SELECT series_id, note_idx, press_ms - note_ms AS residual FROM matched")
def _(spark, sf):
    hot = R.hot_users(spark, sf)
    presses, notes = R.presses_notes(spark, sf, hot)
    m = matching.match_optimal(presses, notes, W, hot)
    return m.select("series_id", "note_idx", (F.col("press_ms") - F.col("note_ms")).alias("residual"))


def _scan_sql(shift: str) -> str:
    return f"""g AS (
      SELECT DISTINCT series_id, 0::BIGINT AS i, 0::BIGINT AS j, 0::BIGINT AS m FROM presses
      UNION ALL
      SELECT g.series_id, g.i + (d <= {W})::INT, g.j + (d >= -{W})::INT, g.m + (abs(d) <= {W})::INT
      FROM (SELECT g.*, press_ms + ({shift}) - note_ms AS d FROM g
            JOIN presses p ON p.series_id = g.series_id AND press_idx = i
            JOIN notes n ON n.series_id = g.series_id AND note_idx = j) g)"""


@query(
    "j05_first_fit_counts",
    "WITH RECURSIVE " + R.MATCH_SQL + ",\n" + _scan_sql("0") + " SELECT series_id, max(m) AS matches FROM g GROUP BY series_id HAVING max(m) > 0",
)
def _(spark, sf):
    hot = R.hot_users(spark, sf)
    presses, notes = R.presses_notes(spark, sf, hot)
    return matching.match_first_fit(presses, notes, W, hot).groupBy("series_id").agg(F.count(F.lit(1)).alias("matches"))


@query(
    "c01_evenly_spaced",
    """WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n
                  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
       SELECT DISTINCT o_custkey, o_orderkey FROM p LEFT JOIN (SELECT unnest(range(0, 5)) AS i) k ON true
       WHERE n <= 5 OR pos = (i * (n - 1)) // 4""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return calibrate.evenly_spaced(orders, "o_custkey", ["o_orderdate", "o_orderkey"], 5).select("o_custkey", "o_orderkey")


BIN = W // 3000  # the studied calibration takes 20 ms bins within 60 s
HIST_SQL = f"""diffs AS (SELECT p.series_id, note_ms - press_ms AS d FROM presses p JOIN notes n ON p.series_id = n.series_id
           AND note_ms - press_ms BETWEEN -{W} AND {W}),
    hist AS (SELECT series_id, (d + {W}) // {BIN} AS bin, count(*) AS n FROM diffs GROUP BY ALL),
    scaled AS (SELECT *, n / max(n) OVER (PARTITION BY series_id) AS height FROM hist)"""


@query("c02_lag_histogram", with_sql(R.MATCH_SQL, HIST_SQL) + f"SELECT series_id, bin, n, {rnd('height')} AS height FROM scaled")
def _(spark, sf):
    presses, notes = R.presses_notes(spark, sf, R.hot_users(spark, sf))
    return rounded(calibrate.lag_histogram(presses, notes, W, BIN))


@query(
    "c03_common_offsets",
    with_sql(
        R.MATCH_SQL,
        HIST_SQL,
        f"""tops AS (SELECT series_id % 3 AS map_id, bin, round(sum(height), 9) AS h FROM scaled GROUP BY ALL),
        coarse AS (SELECT map_id, -{W} + bin * {BIN} + {BIN // 2} AS coarse_ms FROM
          (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY h DESC, bin) AS rn FROM tops) WHERE rn = 1),
        fine AS (SELECT p.series_id, note_ms - press_ms - coarse_ms AS d, count(*) AS n, any_value(c.map_id) AS map_id
          FROM presses p JOIN coarse c ON c.map_id = p.series_id % 3 JOIN notes n ON p.series_id = n.series_id
           AND note_ms - press_ms - coarse_ms BETWEEN -{4 * BIN} AND {4 * BIN} GROUP BY ALL),
        fines AS (SELECT map_id, d, round(sum(h), 9) AS h FROM
          (SELECT *, n / max(n) OVER (PARTITION BY series_id) AS h FROM fine) GROUP BY ALL)""",
    )
    + """SELECT f.map_id, coarse_ms, coarse_ms + d AS offset_ms FROM
         (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY h DESC, d) AS rn FROM fines) f
         JOIN coarse c ON c.map_id = f.map_id WHERE rn = 1""",
)
def _(spark, sf):
    presses, notes = R.presses_notes(spark, sf, R.hot_users(spark, sf))
    maps = notes.select("series_id").distinct().withColumn("map_id", F.col("series_id") % 3)
    return calibrate.common_offsets(presses, notes, maps, W, BIN)


@query(
    "c04_offset_validation",
    "WITH RECURSIVE "
    + R.MATCH_SQL
    + ",\n"
    + _scan_sql("(g.series_id % 3 - 1) * 600000")
    + f""", ratios AS (SELECT g.series_id, g.series_id % 3 AS map_id, max(m) / any_value(n) AS ratio FROM g
        JOIN (SELECT series_id, count(*) AS n FROM notes GROUP BY 1) k ON k.series_id = g.series_id GROUP BY g.series_id)
      SELECT map_id, count(*) AS num_series, {rnd('min(ratio)')} AS min_match_ratio, {rnd('max(ratio)')} AS max_match_ratio,
        {rnd('quantile_cont(ratio, 0.5)')} AS median_match_ratio, quantile_cont(ratio, 0.5) < 0.95 AS flagged
      FROM ratios GROUP BY map_id""",
)
def _(spark, sf):
    hot = R.hot_users(spark, sf)
    presses, notes = R.presses_notes(spark, sf, hot)
    map_id = F.col("series_id") % 3
    offsets = notes.select("series_id").distinct().select(
        "series_id", map_id.alias("map_id"), ((map_id - 1) * 600_000).alias("offset_ms")
    )
    return rounded(calibrate.validate_offsets(presses, notes, offsets, W, hot=hot))


VARIANCES = [c for c in features.FULL if "variance" in c]


# the whole preparation: match, note-indexed residuals, one note per frame, features
@query("k10_series_preparation", features_sql("indexed", WALK_SQL, recursive=True, vd=-3))
def _(spark, sf):
    hot = R.hot_users(spark, sf)
    presses, notes = R.presses_notes(spark, sf, hot)
    matched = matching.match_optimal(presses, notes, W, hot)
    residuals = settle(matching.indexed_residuals(notes, matched))  # read three times below: match once
    clean = frames.drop_reused_frames(residuals, hot)
    return rounded(features.series_features(clean, wide_values=True), 6, **{c: -3 for c in VARIANCES})
