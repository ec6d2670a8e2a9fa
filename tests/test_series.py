"""Features, policies and marking on small fixtures."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemark.functions import exact
from pulsemark.functions.ordered import hot_keys
from pulsemark.operators import features, frames, marking, order_repair, policy, sweep

CASES = {
    "a": [1, 2, 4, 8, 16],
    "b": [1, None, 4, 8, None, 16],
    "c": [-12, -3, 2, None, 7, 21],
    "d": [1, None, -1],
    "e": [1, None, None, None, 100, 100, 100, 100],
    "f": [None],
    "g": [5],
    "h": [5, 5, None],
}


def residuals(spark, cases):
    rows = [(k, i, None if v is None else float(v)) for k, vs in cases.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series_id string, note_idx long, residual double")


def auto(x, lag):
    v = x[~np.isnan(x)]
    if len(v) == 0 or len(x) <= lag or np.sum((v - v.mean()) ** 2) <= 0:
        return 0.0
    a, b = x[:-lag] - v.mean(), x[lag:] - v.mean()
    ok = ~np.isnan(a) & ~np.isnan(b)
    return float(np.sum(a[ok] * b[ok]) / np.sum((v - v.mean()) ** 2))


def test_features_against_numpy(spark):
    rng = np.random.default_rng(4)
    cases = dict(CASES)
    for i in range(6):
        n = int(rng.integers(9, 60))
        cases[f"r{i}"] = [None if rng.random() < 0.2 else int(v) for v in rng.integers(-40, 40, n)]
    got = {r.series_id: r.asDict() for r in features.series_features(residuals(spark, cases)).collect()}
    assert set(got) == set(cases)
    for key, vals in cases.items():
        x = np.array([np.nan if v is None else v for v in vals], dtype=float)
        v, g = x[~np.isnan(x)], got[key]
        assert all(np.isfinite(g[f]) for f in features.FULL)
        assert g["num_notes"] == len(x) and g["n_valid_residuals"] == len(v)
        if len(v):
            assert np.isclose(g["variance"], v.var()) and np.isclose(g["mean_absolute_residual"], np.abs(v).mean())
            assert np.allclose([g[f"quantile_{q}"] for q in features.QUANTILES], np.quantile(v, [q / 100 for q in features.QUANTILES]))
            if v.var() > 0:
                c = v - v.mean()
                assert np.isclose(g["excess_kurtosis"], np.mean(c**4) / v.var() ** 2 - 3)
                assert np.isclose(g["skewness"], np.mean(c**3) / v.var() ** 1.5)
        for lag in features.LAGS:
            assert np.isclose(g[f"autocorrelation_lag{lag}"], auto(x, lag), atol=1e-9), (key, lag)
        d = np.diff(x)
        d = d[~np.isnan(d)]
        assert np.isclose(g["mean_absolute_first_difference"], np.abs(d).mean() if len(d) else 0)
        for q, part in enumerate(np.array_split(x, 4), 1):
            p = part[~np.isnan(part)]
            assert np.isclose(g[f"quarter_{q}_variance"], p.var() if len(p) else 0)
            assert np.isclose(g[f"quarter_{q}_autocorrelation_lag1"], auto(part, 1) if len(part) else 0, atol=1e-9)
    assert got["d"]["autocorrelation_lag1"] == 0.0
    assert [got["e"][f"quarter_{q}_mean_absolute_residual"] for q in features.QUARTERS] == [1, 0, 100, 100]


def test_statistics_reject_constant(spark):
    good, bad = features.residual_statistics(residuals(spark, {"x": [1, 3, 2], "y": [4, 4], "z": [7]}))
    assert [r.series_id for r in good.collect()] == ["x"]
    assert {r.series_id for r in bad.collect()} == {"y", "z"}


def test_capacity_boundaries(spark):
    caps = [63, 64, 106, 107, 213, 214]
    df = spark.createDataFrame([(c * 8,) for c in caps], "n long").select(policy.payload_decision(F.col("n")).alias("d")).select("d.*")
    got = [(r.capacity_class.split("_")[0], r.allocated, r.transmitted) for r in df.collect()]
    assert got == [("NO", 4, 0), ("FLOOR", 4, 8), ("FLOOR", 7, 8), ("NORMAL", 8, 8), ("NORMAL", 15, 8), ("NORMAL", 16, 16)]
    every = spark.range(1, 10000).select("id", policy.fraction_bits(F.col("id"), 3, 40).alias("b")).collect()
    assert all(r.b == max(1, int(np.floor(r.id * 0.075 + 1e-12))) for r in every)


def test_strength_thresholds(spark):
    rows = [(8350645, 9681588), (8350644, 9681588), (29, 31), (6041359, 6184332), (1, 1), (0, 1)]
    df = spark.createDataFrame(rows, "n long, d long").select(policy.strength(F.col("n"), F.col("d")).alias("a"))
    assert [r.a for r in df.collect()] == [16.0, 20.0, 12.0, 10.0, 10.0, 20.0]
    policy.validate_policy(policy.StrengthPolicy())
    for bad in (((29, 31), (1, 2)), ((3, 2), (5, 6))):
        with pytest.raises(ValueError):
            policy.validate_policy(policy.StrengthPolicy(thresholds=bad, alphas=(20.0, 16.0, 12.0)))
    with pytest.raises(ValueError):
        policy.validate_policy(policy.StrengthPolicy(alphas=(25.0, 16.0, 12.0, 10.0)))


def test_zero_correlation_decodes_to_one(spark):
    res = residuals(spark, {"z": [0] * 16, "n": [None if i % 3 == 0 else 0 for i in range(16)], "m": [None] * 16})
    got = marking.correlate(marking.carriers(res, 8, "k", "l"), "residual").collect()
    assert len(got) == 6 and all(r.decoded_bit == 1 and r.correlation == 0 for r in got)


def test_round_trip_of_marks(spark):
    rng = np.random.default_rng(1)
    vals = [int(v) for v in rng.integers(-25, 26, 800)]
    for i in (3, 17, 89, 301, 650):
        vals[i] = None
    res = residuals(spark, {"s": vals})
    bit = marking.message_bit("random_a", F.col("series_id"), F.col("bit_idx"))
    placed = {}
    for n in (5, 10):
        c = marking.carriers(res, 8, "k", "layout", F.lit(n))
        blocks = {(r.block_idx, r.bit_idx) for r in c.where("bit_idx is not null").select("block_idx", "bit_idx").distinct().collect()}
        assert len(blocks) == n and len({b for b, _ in blocks}) == n and all(0 <= b < 100 for b, _ in blocks)
        placed[n] = blocks
        marked = marking.embed(c, 14.0, bit)
        untouched = marked.where("bit_idx is null and residual is not null and marked <> residual").count()
        gone = marked.where("residual is null and marked is not null").count()
        assert untouched == 0 and gone == 0
        noiseless = marked.withColumn("only", F.col("marked") - F.col("residual"))
        back = marking.correlate(noiseless, "only").withColumn("bit", bit).collect()
        assert len(back) == n and all(r.decoded_bit == r.bit for r in back)
    assert placed[5] < placed[10]


def test_messages_are_nested(spark):
    df = spark.range(8).select(*[marking.message_bit(f, F.lit("o"), F.col("id")).alias(f) for f in marking.FAMILIES]).collect()
    assert [r.all_zero for r in df] == [-1] * 8 and [r.all_one for r in df] == [1] * 8
    assert [r.alternating for r in df] == [-1, 1] * 4
    assert {r.random_a for r in df} == {-1, 1}


def settle_brute(t, s):
    s = list(s)
    while True:
        m = [a + b for a, b in zip(t, s)]
        bad = [i for i in range(len(t) - 1) if m[i] > m[i + 1]]
        hit = {k for i in bad for k in (i, i + 1) if s[k]}
        if not hit:
            return s
        for k in hit:
            s[k] = 0


def test_order_repair(spark):
    rng = np.random.default_rng(2)
    cases = []
    for k in range(40):
        t = np.cumsum(rng.integers(0, 30, 25))
        cases.append((t, rng.choice([-12, 0, 12], 25)))
    rows = [(k, i, int(t[i]), int(s[i])) for k, (t, s) in enumerate(cases) for i in range(25)]
    df = spark.createDataFrame(rows, "series_id long, frame_idx long, t long, shift_ms long")
    for hot in (None, hot_keys(df, ["series_id"], 10)):
        got = marking.keep_order(df, hot)
        assert marking.order_violations(got, None).count() == 0
        by = {}
        for r in got.orderBy("series_id", "frame_idx").collect():
            by.setdefault(r.series_id, []).append(r.safe_shift_ms)
        for k, (t, s) in enumerate(cases):
            assert by[k] == settle_brute(t.tolist(), s.tolist())


def test_take_back_rounds_equal_whole_passes():
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(1, 40))
        t = np.cumsum(rng.integers(0, rng.choice([4, 12]), n))
        s = rng.choice([-12, -5, 0, 5, 12], n)
        rounds = order_repair.take_back_rounds(t, s, np.ones(n - 1, bool))
        safe = np.where(rounds < order_repair.NEVER, 0, s)
        assert safe.tolist() == settle_brute(t.tolist(), s.tolist())
    # a chain in which every round takes one row back: linear, not a pass over all rows per round
    n = 60_000
    t, s = chain(n)
    rounds = order_repair.take_back_rounds(t, s, np.ones(n - 1, bool))
    assert (rounds < order_repair.NEVER).sum() == n - 1 and rounds.max() >= n - 3


def chain(n):
    """Rows all moved ahead by 100, the first still: once one is back, the next one before it is out of order."""
    t = np.arange(n, dtype=np.int64) * 10
    s = np.full(n, 100)
    s[-1] = 0
    return t, s


def test_long_islands_exchange_their_ends(spark, monkeypatch):
    monkeypatch.setattr(order_repair, "PER_STRETCH", 1)
    spark.conf.set("spark.pulsemark.hotRows", "12")
    spark.conf.set("spark.pulsemark.stretchRows", "8")
    try:
        rng = np.random.default_rng(7)
        cases = [chain(40)] + [(np.cumsum(rng.integers(0, 9, 60)), rng.choice([-12, 0, 12], 60)) for _ in range(6)]
        rows = [(k, i, int(t[i]), int(s[i])) for k, (t, s) in enumerate(cases) for i in range(len(t))]
        df = spark.createDataFrame(rows, "series_id long, frame_idx long, t long, shift_ms long")
        by = {}
        for r in sorted(marking.keep_order(df, "auto").collect()):
            by.setdefault(r.series_id, []).append(r.safe_shift_ms)
        for k, (t, s) in enumerate(cases):
            assert by[k] == settle_brute(t.tolist(), s.tolist()), k
    finally:
        spark.conf.unset("spark.pulsemark.hotRows")
        spark.conf.unset("spark.pulsemark.stretchRows")


def test_grid_features_carry_cell_numbers(spark):
    """Marked rows name their cell by number; features are those of each cell alone, and done cells are left out."""
    rng = np.random.default_rng(8)
    res = residuals(spark, {k: [None if rng.random() < 0.1 else int(v) for v in rng.integers(-30, 30, n)] for k, n in (("a", 40), ("b", 27), ("c", 5))})
    grid = sweep.Grid((4.0, 9.0), (8, 16), (0.75,), ("distributed", "prefix"), ("p",), ("random_a", "alternating"), {"x": "lay"})
    assert sweep._grid_marked(res, grid, None).columns == ["series_id", "_cell", "note_idx", "num_notes", "marked"]
    found = sweep.grid_features(res, grid)
    whole = {(*r[:8], r.label): r for r in found.collect()}
    assert len(whole) == 2 * 2 * 16  # c has no capacity
    for n, layout in ((8, "prefix"), (16, "distributed")):
        bits = F.greatest(F.lit(1), F.floor(F.col("capacity") * 0.75 + 1e-9).cast("int"))
        carried = marking.carriers(res.where("series_id != 'c'"), n, "p", "lay", bits, layout)
        alone = marking.embed(carried, 9.0, marking.message_bit("random_a", F.col("series_id"), F.col("bit_idx")))
        for r in features.series_features(alone.select("series_id", "note_idx", F.col("marked").alias("residual"))).collect():
            got = whole[r.series_id, "x", n, 0.75, layout, 9.0, "p", "random_a", 1]
            assert all(np.isclose(got[c], r[c]) for c in r.asDict() if c != "series_id")
    done = found.where("label = 1 and (series_id = 'b' or alpha = 4.0)").select("series_id", *sweep.GRID_AXES)
    rest = {(*r[:8], r.label) for r in sweep.grid_features(res, grid, done).collect()}
    assert rest == {k for k in whole if k[0] == "a" and k[5] == 9.0}


def test_a_grid_takes_up_where_it_stopped(spark):
    """Cells against marking and decoding each one alone; finished cells are left out."""
    rng = np.random.default_rng(6)
    res = residuals(spark, {k: [None if rng.random() < 0.1 else int(v) for v in rng.integers(-30, 31, n)] for k, n in (("a", 70), ("b", 41), ("c", 5))})
    grid = sweep.Grid((4.0, 25.0), (8,), (0.5, 1.0), ("prefix", "distributed"), ("p", "q"), ("random_a", "all_zero"), {"x": "lay"})
    whole = {tuple(r[:8]): r for r in sweep.run_grid(res, grid).collect()}
    assert len(whole) == 3 * 32 and {r.status for k, r in whole.items() if k[0] == "c"} == {"SKIP_CAPACITY"}
    for (series, _, n, fraction, layout, alpha, key, family), r in whole.items():
        if series == "a" and alpha == 4.0 and fraction == 0.5:
            carried = marking.carriers(res.where("series_id = 'a'"), n, key, "lay", F.lit(4), layout)
            bit = marking.message_bit(family, F.col("series_id"), F.col("bit_idx"))
            got = marking.correlate(marking.embed(carried, alpha, bit), "marked").withColumn("bit", bit).collect()
            assert (len(got), sum(x.decoded_bit != x.bit for x in got)) == (r.bits, r.errors) == (4, r.errors)
    done = sweep.run_grid(res, grid).where("series_id = 'b' or alpha = 4.0").select("series_id", *sweep.GRID_AXES)
    rest = {tuple(r[:8]): r for r in sweep.run_grid(res, grid, done).collect()}
    assert rest == {k: r for k, r in whole.items() if k[0] != "b" and k[5] != 4.0}


def test_exact_bits_are_those_of_the_generator(spark, monkeypatch):
    # fixed values: the first chips and the placement of ten blocks, as NumPy's default generator gives them
    seed = int.from_bytes(hashlib.sha256(b"key-1").digest()[:4], "big")
    want = np.where(np.random.default_rng(seed).random(1000) < 0.5, -1, 1)
    monkeypatch.setattr(exact, "STRETCH", 64)
    keys = spark.createDataFrame([("key-1",), ("key-2",), ("key-1",), (None,)], "k string")
    got = {}
    for r in sorted(exact.chip_table(keys, "k", 1000).collect()):
        got.setdefault(r.k, []).append(r.chip)
    assert set(got) == {"key-1", "key-2"} and got["key-1"] == want.tolist() and got["key-2"] != want.tolist()
    assert exact.chip_table(spark.createDataFrame([(7,)], "k long"), "k", 3).count() == 3
    with pytest.raises(ValueError):
        exact.chip_table(keys, "k", 0)
    layout = int.from_bytes(hashlib.sha256(b"lay|payload-layout-v1").digest()[:8], "big")
    monkeypatch.setattr(exact, "ROWS", 7)
    placed = {}
    for r in exact.placements(spark.createDataFrame([(10,), (33,), (10,), (0,)], "capacity long"), "lay").collect():
        placed.setdefault(r.capacity, {})[r.bit_idx] = r.block_idx
    for capacity in (10, 33):
        assert [placed[capacity][b] for b in range(capacity)] == np.random.default_rng(layout).permutation(capacity).tolist()
    assert set(placed) == {10, 33}


def test_exact_marks_equal_a_plain_embedding(spark):
    """Positions, chips and marked values against an array version, for both layouts and two message lengths."""
    rng = np.random.default_rng(3)
    x = rng.integers(-25, 26, 83).astype(float)
    x[[3, 40]] = np.nan
    res = residuals(spark, {"s": [None if np.isnan(v) else int(v) for v in x]})
    n, capacity = 8, 83 // 8
    for layout in ("distributed", "prefix"):
        order = np.random.default_rng(exact.layout_seed("l")).permutation(capacity) if layout == "distributed" else np.arange(capacity)
        for bits in (4, 9):
            pn = np.where(np.random.default_rng(exact.pn_seed("p")).random(bits * n) < 0.5, -1, 1)
            want = x.copy()
            for b, block in enumerate(order[:bits]):
                want[block * n : block * n + n] += 6.0 * pn[b * n : b * n + n]
            carried = marking.exact_carriers(res, n, "p", "l", F.lit(bits), layout)
            got = marking.embed(carried, 6.0, F.lit(1)).orderBy("note_idx").collect()
            assert len(got) == 83
            assert np.allclose([np.nan if r.marked is None else r.marked for r in got], want, equal_nan=True)


def test_retime_clamps(spark):
    timed = spark.createDataFrame([("s", 0, 5), ("s", 1, 10), ("s", 2, 12), ("s", 3, 20), ("s", 4, 21)], "series_id string, frame_idx long, abs_ms long")
    anchors = spark.createDataFrame([("s", 1, 4), ("s", 3, -5)], "series_id string, frame_idx long, safe_shift_ms long")
    got = marking.retime(timed, anchors, None).orderBy("frame_idx").collect()
    assert [r.new_ms for r in got] == [5, 14, 14, 15, 21]
    assert [r.new_delta_ms for r in got] == [5, 9, 0, 1, 6]


def test_physical_round_trip_recovers_message(spark):
    """Presses close to notes, marked strongly: every bit comes back and energies add up."""
    rng = np.random.default_rng(8)
    frames_rows, notes_rows = [], []
    for s in range(3):
        last = 0
        for i in range(64):
            note = 1000 + 400 * i
            press = note + int(rng.integers(-6, 7))
            for t, k in ((press, 1 if i % 2 else 2), (press + 60, 0)):
                frames_rows.append((s, len([r for r in frames_rows if r[0] == s]), t - last, k))
                last = t
            notes_rows.append((s, i, note))
    fr = spark.createDataFrame(frames_rows, "series_id long, frame_idx long, time_delta_ms long, keys int")
    notes = spark.createDataFrame(notes_rows, "series_id long, note_idx long, note_ms long")
    timed = frames.absolute_times(fr, None)
    trip = sweep.round_trip(timed, notes, 150, 5.0, 8, 20.0, "k", "l", "random_b", F.lit(6), None)
    per = sweep.diagnostics(trip.where("bit_idx is not null"), ["series_id", "bit_idx"], 8, 20.0).collect()
    assert len(per) == 18 and all(r.is_error == 0 for r in per)
    assert all(r.requested_carriers == 8 and r.active_carriers == 8 and r.rematching_changes == 0 for r in per)
    assert all(r.sum_squared_shift_ms2 == 8 * 400 for r in per)
    rest = trip.where("bit_idx is null and residual <> after").count()
    assert rest == 0


def test_blind_and_selection(spark):
    h = spark.createDataFrame([("a", True, 3), ("a", True, 3), ("b", True, 1), ("b", True, 2), ("c", False, 1)], "u string, accepted boolean, message int")
    got = {r.u: (r.decision, r.message) for r in marking.blind_decision(h, ["u"]).collect()}
    assert got == {"a": ("accepted", 3), "b": ("ambiguous_messages", None), "c": ("no_accepted_hypothesis", None)}
    s = spark.createDataFrame(
        [("u", "k1", 0, 1, 5.0, 9.0), ("u", "k2", 1, 0, 1.0, 2.0), ("u", "k3", 2, 0, 1.0, 3.0), ("u", "k4", 3, 0, 1.0, 3.0)],
        "unit string, key_id string, candidate_rank int, nonpositive_count long, minimum_margin double, mean_margin double",
    )
    picks = [marking.select_candidate(s, ["unit"], "key_id", k).first().key_id for k in (1, 2, 4)]
    assert picks == ["k1", "k2", "k3"]
