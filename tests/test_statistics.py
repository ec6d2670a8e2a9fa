"""Scoring, resampling, cohorts, calibration, detectors."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemark import session
from pulsemark.functions.ordered import first_rows, with_position
from pulsemark.operators import calibrate, cohorts, detect, features, frames, resample, scoring, summaries, sweep


def auc(y, s):
    p, n = s[y == 1], s[y == 0]
    return float(np.mean((p[:, None] > n[None, :]) + 0.5 * (p[:, None] == n[None, :])))


def scored(spark, n=240, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    s = np.round(rng.normal(size=n) + 0.7 * y, 1)
    u = rng.integers(0, 12, n)
    df = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(u, s, y)], "unit long, score double, label int")
    return df, u, s, y


def test_influence_equals_recomputation(spark):
    df, u, s, y = scored(spark)
    for r in scoring.influence(df, "unit", "score", "label").collect():
        assert abs(r.auc_without - auc(y[u != r.unit], s[u != r.unit])) < 1e-12
        assert abs(r.delta - (r.auc_without - auc(y, s))) < 1e-12


def draw(n, seed, it, pos):
    return int(hashlib.sha256(f"{seed}|{it}|{pos}".encode()).hexdigest()[:8], 16) % n


def test_bootstrap_equals_numpy(spark):
    units = [(f"u{i:02d}", float(i % 5), float(3 + i % 4)) for i in range(17)]
    df = spark.createDataFrame(units, "unit string, x double, y double")
    got = resample.bootstrap(df, "unit", ["x", "y"], {"r": "x / y"}, 60, "seed").first()
    x, y = np.array([u[1] for u in units]), np.array([u[2] for u in units])
    vals = []
    for it in range(60):
        pick = [draw(17, "seed", it, p) for p in range(17)]
        vals.append(x[pick].sum() / y[pick].sum())
    assert np.isclose(got.value, x.sum() / y.sum())
    assert np.allclose([got.ci_low, got.ci_high], np.quantile(vals, [0.025, 0.975]))


def test_auc_bootstrap_equals_numpy(spark):
    df, u, s, y = scored(spark)
    got = resample.bootstrap_auc(df, "unit", ["score"], "label", 25, "z").first()
    names, vals = sorted(set(u.tolist())), []
    for it in range(25):
        rows = np.concatenate([np.flatnonzero(u == names[draw(len(names), "z", it, p)]) for p in range(len(names))])
        vals.append(auc(y[rows], s[rows]))
    assert np.allclose([got.ci_low, got.ci_high], np.quantile(vals, [0.025, 0.975]))


def test_auc_bootstrap_sweeps_ties_in_chunks_and_ranges(spark, monkeypatch):
    """Few distinct scores (runs over batches), three chunks of iterations, a score column that is all ties."""
    monkeypatch.setattr(resample, "CHUNK", 10)
    rng = np.random.default_rng(12)
    u, y = rng.integers(0, 9, 400), rng.integers(0, 2, 400)
    s = np.round(rng.normal(size=400) + 0.4 * y)
    rows = [(f"c{a}", float(b), 1.0, int(c)) for a, b, c in zip(u, s, y)] + [("c0", None, 1.0, 1), ("c1", 2.0, None, None)]
    df = spark.createDataFrame(rows, "unit string, score double, flat double, label int").repartition(6)
    got = {r.metric: r for r in resample.bootstrap_auc(df, "unit", ["flat", "score"], "label", 25, "k").collect()}
    names, vals = sorted({f"c{a}" for a in u}), []
    units = np.array([f"c{a}" for a in u])
    for it in range(25):
        picks = [names[draw(9, "k", it, p)] for p in range(9)]
        have = np.concatenate([np.flatnonzero(units == p) for p in picks])
        vals.append(auc(y[have], s[have]))
    assert np.allclose([got["score"].ci_low, got["score"].ci_high], np.quantile(vals, [0.025, 0.975]))
    assert got["flat"].ci_low == got["flat"].ci_high == 0.5
    assert np.allclose(got["delta"].ci_low, np.quantile(np.array(vals) - 0.5, 0.025))


def test_median_bootstrap(spark):
    df, u, s, _ = scored(spark)
    got = resample.bootstrap_median(df, "unit", "score", 20, "m").first()
    names, vals = sorted(set(u.tolist())), []
    for it in range(20):
        vals.append(np.median(np.concatenate([s[u == names[draw(len(names), "m", it, p)]] for p in range(len(names))])))
    assert np.allclose([got.ci_low, got.ci_high], np.quantile(vals, [0.025, 0.975]))


def test_counts_are_sent_to_slices_and_not_to_cells(spark):
    """A cell carries no draw counts: a block of them goes once to every slice, however many cells there are."""
    counts = resample.draw_table(spark, 1500, 20, "z", 8)
    cells = spark.range(30_000).select((F.col("id") % 1500).alias("unit_no"), F.col("id").cast("double").alias("s"), (F.col("id") % 3).cast("int").alias("slice"))
    laid = resample._laid([counts], cells, ["s"], 3, 3)
    kinds = {r.kind: (r.rows, r.sent) for r in laid.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.count("data").alias("sent")).collect()}
    assert kinds == {0: (2 * 3 * 3, 2 * 3 * 3), resample.CELLS: (90_000, 0)}
    per = laid.select("part", F.spark_partition_id().alias("at")).distinct().collect()
    assert len(per) == 9 and {r.part for r in per} == set(range(9)) and len({r.at for r in per}) == 9
    drawn = sum(np.frombuffer(r.data, "u1").sum() for r in counts.collect())
    assert drawn == 1500 * 20


def test_a_slice_is_sent_the_counts_of_its_own_units(spark):
    """However many slices there are, counts are sent once per unit and slice that meet in a cell, and not per slice."""
    counts = resample.draw_table(spark, 3000, 20, "z", 8)
    cells = spark.range(6000).select((F.col("id") % 3000).alias("unit_no"), F.col("id").cast("double").alias("s"), F.floor(F.col("id") / 150).cast("int").alias("slice"))
    laid = resample._laid([counts], cells, ["s"], 40, 3).where("kind = 0")
    assert laid.agg(F.sum(F.length("data"))).first()[0] == 6000 * 8 * 3
    known = [(r.part, resample._Drawn([(r.units, r.data)], 8)) for r in laid.where("part % 40 = 7").collect()]
    units = np.arange(7 * 150, 8 * 150)
    for it in range(20):
        drawn = np.bincount([draw(3000, "z", it, p) for p in range(3000)], minlength=3000)
        assert (sum(d.of(units)[:, it % 8] for part, d in known if part == it // 8 * 40 + 7) == drawn[units]).all()


def test_draws_of_many_tasks_and_packs_are_counted_once(spark, monkeypatch):
    for name, value in {"TASK_DRAWS": 90, "PACKED": 30, "PACKED_MOST": 60, "BLOCK": 4}.items():
        monkeypatch.setattr(resample, name, value)
    got = {(r.chunk, r.block): np.frombuffer(r.data, "u1").reshape(4, 7) for r in resample.draw_table(spark, 41, 25, "m", 7).collect()}
    assert len(got) == 4 * 11
    for it in range(25):
        counts = np.concatenate([got[it // 7, b][:, it % 7] for b in range(11)])
        assert (counts == np.bincount([draw(41, "m", it, p) for p in range(41)], minlength=44)).all()


def test_marked_pairs_read_the_residuals_once(spark):
    """Sizes and blocks are told from settled residuals, so their positions are found once; pairs know their series' size."""
    rows = spark.createDataFrame([(s, t, float(t % 5)) for s in (1, 2) for t in range(20 + s)], "series_id long, t long, residual double")
    placed = with_position(rows, ["series_id"], ["t"], "note_idx", None).drop("t")
    pairs = sweep.marked_pairs(placed, (24.0,), 8, "pn-a", "layout-a", "random_a", 2)
    assert "Window" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.series_id, r.label): (r.n, r.num_notes) for r in pairs.groupBy("series_id", "label", "num_notes").agg(F.count("*").alias("n")).collect()} == {
        (s, label): (20 + s, 20 + s) for s in (1, 2) for label in (0, 1)
    }
    keys = ["series_id", "label"]
    told = [sorted(map(tuple, features.series_features(p, keys, sized=sized).collect())) for p, sized in ((pairs, True), (pairs.drop("num_notes"), False))]
    assert told[0] == told[1]


def test_median_bootstrap_over_slices_and_stretches(spark, monkeypatch):
    """Runs of equal values, even and odd numbers of rows, units in several blocks, null values and a null cluster."""
    monkeypatch.setattr(resample, "CHUNK", 7)
    monkeypatch.setattr(resample, "SLICE_ROWS", 40)
    monkeypatch.setattr(resample, "BLOCK", 4)
    rng = np.random.default_rng(5)
    u, s = rng.integers(0, 11, 301), np.round(rng.normal(size=301), 1)
    df = spark.createDataFrame([(f"c{a:02d}", float(b)) for a, b in zip(u, s)] + [("c03", None), (None, 50.0)], "unit string, score double")
    got = resample.bootstrap_median(df, "unit", "score", 25, "m").first()
    names, vals = [None, *sorted({f"c{a:02d}" for a in u})], []
    units = np.array([f"c{a:02d}" for a in u])
    for it in range(25):
        vals.append(np.median(np.concatenate([s[units == names[draw(len(names), "m", it, p)]] for p in range(len(names))])))
    assert np.allclose([got.ci_low, got.ci_high], np.quantile(vals, [0.025, 0.975])) and got.iterations == 25


@pytest.mark.parametrize("first, second", [("a", "b"), ("b", "a")])
def test_two_way_bootstrap_equals_numpy(spark, monkeypatch, first, second):
    """Either side may have more units; null sums add nothing, and a draw without known rows has no ratio."""
    monkeypatch.setattr(resample, "CHUNK", 7)
    monkeypatch.setattr(resample, "BLOCK", 4)
    rng = np.random.default_rng(6)
    a, b, x, y = rng.integers(0, 3, 90), rng.integers(0, 13, 90), rng.integers(0, 5, 90), rng.integers(1, 9, 90)
    known = rng.random(90) < 0.6
    rows = [(int(i), f"k{j:02d}", int(v) if k else None, float(w)) for i, j, v, w, k in zip(a, b, x, y, known)]
    df = spark.createDataFrame(rows, "a long, b string, x int, y double")
    got = resample.bootstrap_two_way(df, first, second, "x", "y", 25, "t").first()
    sides = {"a": sorted(set(a.tolist())), "b": sorted({f"k{j:02d}" for j in b})}
    at, vals = {"a": a.tolist(), "b": [f"k{j:02d}" for j in b]}, []
    for it in range(25):
        w = np.ones(90)
        for name, tag in ((first, "a"), (second, "b")):
            ids = sides[name]
            picks = [ids[draw(len(ids), f"t-{tag}", it, p)] for p in range(len(ids))]
            w *= [picks.count(v) for v in at[name]]
        if (w * known).sum() and w.sum():
            vals.append((w * x * known).sum() / (w * y).sum())
    assert np.allclose([got.ci_low, got.ci_high], np.quantile(vals, [0.025, 0.975])) and got.iterations == len(vals)


def test_tasks_hold_no_more_rows_as_tables_grow(spark, monkeypatch):
    """Targets of one shift a frame: more rows make more partitions, also for units of distinct users."""
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    targets = spark.range(2000).select((F.col("id") % 40).alias("series_id"), F.col("id").alias("frame_idx"), F.lit(3).alias("shift_ms"))
    good, bad = frames.unique_targets(targets)
    assert good.rdd.getNumPartitions() == 20 and good.count() == 2000 and bad.isEmpty()
    units = targets.select("series_id", "frame_idx", F.col("shift_ms").alias("unit"))
    first = first_rows(session.spread(units, "series_id", "frame_idx").distinct(), ["series_id", "frame_idx"], ["unit"], 1)
    assert first.rdd.getNumPartitions() == 20 and first.count() == 2000


def test_zero_event_bound(spark):
    df = spark.createDataFrame([("a", 0, i) for i in range(10)] + [("b", 1, 1)], "k string, e int, u int")
    got = {r.k: r.upper_per_configuration for r in resample.zero_event_bounds(df, ["k"], "e", "u").collect()}
    assert abs(got["a"] - (1 - 0.05**0.1)) < 1e-12 and got["b"] is None


def test_unique_user_corpus_equals_greedy(spark):
    rng = random.Random(4)
    rows = sorted({(m, u, m * 1000 + u * 3 + k) for m in range(12) for u in range(15) for k in range(2) if rng.random() < 0.5})
    df = spark.createDataFrame(rows, "map long, user long, unit long")
    got = sorted((r.map, r.user, r.unit, r.role) for r in cohorts.unique_user_corpus(df, "map", "user", "unit", 4, 1, 3, "q").collect())
    h = lambda *p: hashlib.sha256("|".join(map(str, p)).encode()).hexdigest()
    first = {}
    for m, u, x in rows:
        first[(m, u)] = min(first.get((m, u), (h("q", m, x), x)), (h("q", m, x), x))
    used, want, taken = set(), [], 0
    for m in sorted(range(12), key=lambda v: h("q", v)):
        if sum(1 for k in first if k[0] == m) < 4 or taken == 3:
            continue
        free = sorted((v, k[1]) for k, v in first.items() if k[0] == m and k[1] not in used)[:4]
        if len(free) < 4:
            continue
        taken += 1
        used |= {u for _, u in free}
        want += [(m, u, x, "calibration" if i == 0 else "primary") for i, ((_, x), u) in enumerate(free)]
    assert got == sorted(want)


def test_a_thousand_clashing_groups_settle_in_few_passes(spark, monkeypatch):
    """Every group wants users that groups before and after it want too."""
    passes = []
    reserved = cohorts._reserved
    monkeypatch.setattr(cohorts, "_reserved", lambda *a: passes.append(1) or reserved(*a))
    rng = random.Random(9)
    rows = sorted({(m, (3 * m + k + rng.choice([0, 0, 3000 - 3 * m])) % 3100, m * 100 + k) for m in range(1000) for k in range(14)})
    df = spark.createDataFrame(rows, "map long, user long, unit long").repartition(4)
    got = sorted((r.map, r.user) for r in cohorts.unique_user_corpus(df, "map", "user", "unit", 3, 1, 520, "t").collect())
    h = lambda *p: hashlib.sha256("|".join(map(str, p)).encode()).hexdigest()
    lists = {}
    for m, u, x in rows:
        lists.setdefault(m, {})[u] = min(lists.get(m, {}).get(u, ("~", 0)), (h("t", m, x), x))
    used, want, clashes = set(), [], 0
    for m in sorted(lists, key=lambda v: h("t", v)):
        if len(want) == 520 * 3 or len(lists[m]) < 3:
            continue
        order = sorted(lists[m], key=lists[m].get)
        free = [u for u in order if u not in used][:3]
        clashes += order[:3] != free
        if len(free) == 3:
            used.update(free)
            want += [(m, u) for u in free]
    assert got == sorted(want) and clashes > 300
    assert len(passes) <= 20, len(passes)


def test_split_and_folds(spark):
    maps = spark.range(34).select(F.col("id").alias("map_id"))
    a = {r.map_id: r.partition for r in cohorts.split_groups(maps, "map_id", 0.3, "42").collect()}
    b = {r.map_id: r.partition for r in cohorts.split_groups(maps.repartition(3), "map_id", 0.3, "42").collect()}
    assert a == b and sum(v == "validation" for v in a.values()) == 11
    folds = cohorts.group_folds(maps.unionByName(maps.where("map_id < 10")), "map_id", 5, "s").collect()
    assert len(folds) == 34 and {r.fold for r in folds} == set(range(5))


def test_duplicate_payloads(spark):
    df = spark.createDataFrame([(1, "a", "p"), (1, "b", "p"), (1, "c", "p"), (2, "a", "p"), (2, "b", "q")], "u int, f string, p string")
    got = sorted((r.u, r.family_a, r.family_b) for r in cohorts.duplicate_payloads(df, "u", "f", "p").collect())
    assert got == [(1, "a", "b"), (1, "a", "c"), (1, "b", "c")]


def test_common_offset(spark):
    rng = random.Random(9)
    notes, presses = [], []
    for s in range(4):
        shift = 137 if s < 2 else -420
        for i in range(40):
            t = 1000 * i + rng.randrange(300)
            notes.append((s, i, t))
            presses.append((s, i, t - shift + rng.choice([0, 0, 0, 3]), i))
    n = spark.createDataFrame(notes, "series_id long, note_idx long, note_ms long")
    p = spark.createDataFrame(presses, "series_id long, press_idx long, press_ms long, frame_idx long")
    maps = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "b")], "series_id long, map_id string")
    got = {r.map_id: r.offset_ms for r in calibrate.common_offsets(p, n, maps, 2000, 20).collect()}
    assert got == {"a": 137, "b": -420}
    offs = maps.join(spark.createDataFrame(list(got.items()), "map_id string, offset_ms long"), "map_id")
    check = calibrate.validate_offsets(p, n, offs, 10, hot=None).collect()
    assert all(r.median_match_ratio == 1.0 and not r.flagged for r in check)


def test_stratum_totals_need_rates(spark):
    counts = spark.createDataFrame([("a", 2), ("b", 3)], "s string, n long")
    rates = spark.createDataFrame([("a", 0.5), ("b", 1.0)], "s string, ok double")
    assert summaries.stratum_totals(counts, rates, "s", ["ok"]).first().ok == 4.0
    with pytest.raises(ValueError):
        summaries.stratum_totals(counts, rates.where("s = 'a'"), "s", ["ok"])
    assert abs(summaries.birthday_bound(23, 365) - 0.5) < 0.01


def test_energy_pools(spark):
    from pulsemark.operators.features import energy_summary

    rows = [("a", 4, 2, 417.0, 29.0, 1, 1), ("b", 2, 1, 200.0, 14.0, 0, 2)]
    df = spark.createDataFrame(rows, "series_id string, requested_carriers long, active_carriers long, sum_squared_shift_ms2 double, total_absolute_shift_ms double, dropped_for_hit_window long, new_unmatched_events long")
    r = energy_summary(df.withColumn("method", F.lit("m")), ["method"]).first()
    assert r.sum_squared_shift_ms2 == 617 and abs(r.rms_applied_shift_ms - (617 / 3) ** 0.5) < 1e-12 and r.new_unmatched_events == 3


def test_detectors_separate_classes(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(80):
        base = rng.normal(size=3)
        rows.append((i, 0, *[float(v) for v in base]))
        rows.append((i, 1, *[float(v) for v in base + [2.5, 0, 0]]))
    df = spark.createDataFrame(rows, "series_id long, label int, a double, b double, c double")
    names = ["a", "b", "c"]
    detect.check_features(df, ["series_id"], names)
    with pytest.raises(ValueError):
        detect.check_features(df.where("series_id > 0 or label = 0"), ["series_id"], names)
    folds = cohorts.group_folds(df, "series_id", 3, "x").select("series_id", "fold")
    data = df.join(folds, "series_id").cache()
    preds, models = detect.out_of_fold(data, "logistic_l2", names, 3)
    assert preds.count() == 160 and preds.select("series_id", "label").distinct().count() == 160
    weights = detect.weight_summary(detect.weight_table(df, models)).collect()
    assert weights[0].feature == "a" and weights[0].mean > 0
    train, test = data.where("series_id < 50"), data.where("series_id >= 50")
    for family in ("rbf_svm", "random_forest"):
        scores, _ = detect.generalise(train, test, family, names, "series_id", trees=20)
        rows = scores.select("label", "score").toPandas()
        assert auc(rows["label"].values, rows["score"].values) > 0.85, family
    with pytest.raises(ValueError):
        detect.generalise(train, data, "logistic_l2", names, "series_id")


def two_feature_pairs(spark, names):
    """Pairs in five folds: the first feature tells the class of even series, the second that of odd ones."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        for label in (0, 1):
            v = [float(x) for x in rng.normal(size=len(names))]
            v[i % 2] += 6.0 * label
            rows.append((i, label, i % 5, *v))
    return spark.createDataFrame(rows, f"series_id long, label int, fold int, {', '.join(f'{n} double' for n in names)}")


def test_a_scope_limits_training_and_scoring(spark):
    names = ["a", "b", "c"]
    data = two_feature_pairs(spark, names)
    preds, models = detect.out_of_fold(data, "random_forest", names, 5, trees=20, scope=F.col("series_id") % 2 == 0)
    assert preds.count() == 60 and preds.where("series_id % 2 = 1").isEmpty()
    mean = {r.feature: r["mean"] for r in detect.weight_summary(detect.weight_table(data, models)).collect()}
    assert mean["a"] > 10 * mean["b"]


def test_importances_are_learnt_on_all_series(spark, monkeypatch):
    from pulsemark.plans import score_queries
    from pulsemark.plans.catalog import QUERIES

    monkeypatch.setattr(score_queries, "folded", lambda spark, sf: two_feature_pairs(spark, score_queries.FEATURES).cache())
    few, seen = detect.out_of_fold, []

    def short(*args, **options):
        preds, models = few(*args, trees=20, **options)
        seen.append(preds.select("series_id", "label").distinct().count())
        return preds, models

    monkeypatch.setattr(detect, "out_of_fold", short)
    mean = {r.feature: r["mean"] for r in QUERIES["m03_importances"](spark, "").collect()}
    assert seen == [120]
    a, b = (mean[n] for n in score_queries.FEATURES[:2])
    assert 0.5 < a / b < 2
