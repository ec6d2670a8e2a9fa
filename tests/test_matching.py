"""Matching against brute force, and the frame operators."""

import itertools
import random

from pyspark.sql import functions as F

from pulsemark.functions.ordered import hot_keys
from pulsemark.operators import frames as fr
from pulsemark.operators import calibrate, long_islands
from pulsemark.operators.matching import band_pairs, indexed_residuals, match_first_fit, match_optimal


def brute_totals(presses, notes, window):
    """(matches, cost) of the best non-crossing matching by full dynamic programming."""
    best = [[(0, 0)] * (len(notes) + 1) for _ in range(len(presses) + 1)]
    for i, p in enumerate(presses, 1):
        for j, n in enumerate(notes, 1):
            options = [best[i - 1][j], best[i][j - 1]]
            if abs(p - n) <= window:
                m, c = best[i - 1][j - 1]
                options.append((m + 1, c - abs(p - n)))
            best[i][j] = max(options)
    return best[-1][-1][0], -best[-1][-1][1]


def chains(presses, notes, window):
    """Every non-crossing matching as a list of (press, note) pairs."""
    pairs = [(p, n) for n in range(len(notes)) for p in range(len(presses)) if abs(presses[p] - notes[n]) <= window]

    def extend(done, rest):
        yield done
        for k, (p, n) in enumerate(rest):
            if not done or (p > done[-1][0] and n > done[-1][1]):
                yield from extend(done + [(p, n)], rest[k + 1 :])

    return list(extend([], sorted(pairs, key=lambda x: (x[1], x[0]))))


def brute_ties(presses, notes, window):
    """Best chain, ties settled pair by pair from the end by smaller press then note."""
    return min(
        chains(presses, notes, window),
        key=lambda c: (-len(c), sum(abs(presses[p] - notes[n]) for p, n in c), [x for x in reversed(c)]),
    )


def frame(spark, cases, which):
    rows = []
    for s, (presses, notes) in enumerate(cases):
        for i, t in enumerate(presses if which == "press" else notes):
            rows.append((s, i, t, i * 10) if which == "press" else (s, i, t))
    if which == "press":
        return spark.createDataFrame(rows, "series_id long, press_idx long, press_ms long, frame_idx long")
    return spark.createDataFrame(rows, "series_id long, note_idx long, note_ms long")


def test_match_against_brute_force(spark):
    rng = random.Random(11)
    cases = [([4, 6], [5, 7])]
    for _ in range(150):
        span = rng.choice([12, 40])
        cases.append(
            (sorted(rng.randrange(span) for _ in range(rng.randrange(1, 7))),
             sorted(rng.randrange(span) for _ in range(rng.randrange(1, 7))))
        )
    presses, notes = frame(spark, cases, "press"), frame(spark, cases, "note")
    for hot in (None, hot_keys(presses, ["series_id"], 4)):
        got = {}
        for r in match_optimal(presses, notes, 2, hot).collect():
            assert r.frame_idx == r.press_idx * 10
            got.setdefault(r.series_id, []).append((r.press_idx, r.note_idx))
        for s, (p, n) in enumerate(cases):
            pairs = sorted(got.get(s, []))
            assert pairs == brute_ties(p, n, 2), (s, p, n)
            assert (len(pairs), sum(abs(p[a] - n[b]) for a, b in pairs)) == brute_totals(p, n, 2)
    assert len(brute_ties(*cases[0], 2)) == 2
    pairs = band_pairs(presses, notes, 2).count()
    assert pairs == sum(1 for p, n in cases for a, b in itertools.product(p, n) if abs(a - b) <= 2)


def test_first_fit(spark):
    presses = spark.createDataFrame([(0, i, t, i) for i, t in enumerate([1, 4, 9, 30])], "series_id long, press_idx long, press_ms long, frame_idx long")
    notes = spark.createDataFrame([(0, i, t) for i, t in enumerate([2, 3, 10, 50])], "series_id long, note_idx long, note_ms long")
    got = sorted((r.press_idx, r.note_idx) for r in match_first_fit(presses, notes, 1, None).collect())
    assert got == [(0, 0), (1, 1), (2, 2)]
    full = indexed_residuals(notes, match_optimal(presses, notes, 1, None)).orderBy("note_idx").collect()
    assert [r.residual for r in full] == [-1.0, 1.0, -1.0, None]


def test_frames(spark):
    rows = [("a", 0, 10, 1), ("a", 1, 5, 1), ("a", 2, 5, 5), ("a", 3, 5, 0), ("a", 4, 5, 12), ("a", 5, -12345, 0),
            ("b", 0, 7, 0), ("b", 1, -12345, 0), ("b", 2, 7, 1)]
    frames = spark.createDataFrame(rows, "series_id string, frame_idx long, time_delta_ms long, keys int")
    good, bad = fr.split_gameplay(frames)
    assert [r.series_id for r in bad.collect()] == ["b"]
    downs = fr.key_downs(good, None).orderBy("press_idx").collect()
    assert [(r.press_ms, r.button, r.frame_idx, r.press_idx) for r in downs] == [
        (10, 1, 0, 0), (20, 4, 2, 1), (30, 4, 4, 2), (30, 8, 4, 3)]


def test_reused_frames(spark):
    r = spark.createDataFrame([("s", 0, 1.0, 10), ("s", 1, 2.0, 10), ("s", 2, 3.0, 11), ("s", 3, None, None)],
                              "series_id string, note_idx long, residual double, frame_idx long")
    got = fr.drop_reused_frames(r).orderBy("note_idx").collect()
    assert [x.residual for x in got] == [1.0, None, 3.0, None]
    assert sum(x.removed for x in got) == 1


def test_hit_window(spark):
    df = spark.createDataFrame([(8.0, 2), (8.0, 16), (5.0, 0)], "od double, mods int")
    got = [round(r[0], 6) for r in df.select(fr.hit_window_ms(fr.effective_difficulty(F.col("od"), F.col("mods")))).collect()]
    assert got == [160.0, 100.0, 150.0]


def test_shared_chains_are_released():
    """A long dense island: giving out shared chains early must not change the answer."""
    from pulsemark.operators.matching import _Optimal

    class Eager(_Optimal):
        RELEASE_EVERY = 3

    rng = random.Random(5)
    for _ in range(60):
        events = sorted((rng.randrange(400), rng.randrange(2), k) for k in range(160))
        answers = []
        for kind in (_Optimal, Eager):
            out = []
            solver = kind(6.0, out)
            for t, which, k in events:
                solver.press(t, k, -1) if which == 0 else solver.note(t, k)
            solver.finish()
            answers.append(out)
        assert answers[0] == answers[1]
        presses = [t for t, w, _ in events if w == 0]
        notes = [t for t, w, _ in events if w == 1]
        assert (len(answers[0]), sum(abs(p[1] - p[3]) for p in answers[0])) == brute_totals(presses, notes, 6)


def test_long_islands_are_solved_in_stretches(spark):
    """Every cut an island can have: the answers of one task per island, ties included."""
    rng = random.Random(3)
    cases = []
    for _ in range(40):
        span = rng.choice([12, 40, 60])
        cases.append(tuple(sorted(rng.randrange(span) for _ in range(rng.randrange(1, 30))) for _ in range(2)))
    presses, notes = frame(spark, cases, "press"), frame(spark, cases, "note")

    def rows(match, hot):
        return sorted(tuple(r) for r in match(presses, notes, 2, hot).collect())

    whole = {match: rows(match, None) for match in (match_optimal, match_first_fit)}
    spark.conf.set("spark.pulsemark.hotRows", "6")
    try:
        for size in ("3",):
            spark.conf.set("spark.pulsemark.stretchRows", size)
            for match, want in whole.items():
                assert rows(match, "auto") == want, (match, size)
    finally:
        spark.conf.unset("spark.pulsemark.hotRows")
        spark.conf.unset("spark.pulsemark.stretchRows")


def test_a_dense_island_spreads_over_tasks(spark):
    n = 6000
    rng = random.Random(2)
    times = [sorted(rng.randrange(40 * n) for _ in range(n)) for _ in range(2)]
    presses, notes = frame(spark, [times], "press"), frame(spark, [times], "note")
    want = sorted(tuple(r) for r in match_optimal(presses, notes, 400, None).collect())
    spark.conf.set("spark.pulsemark.hotRows", "1000")
    spark.conf.set("spark.pulsemark.stretchRows", "512")
    try:
        from pulsemark.operators.matching import islands

        rows = islands(presses, notes, 400, None)
        found = long_islands.long_islands(rows, 1000)
        part = long_islands.stretches(rows.join(found, ["series_id", "island"], "left_semi"), found, F.col("kind") == 0)
        sizes = [r["count"] for r in part.groupBy("island", "stretch").count().collect()]
        assert len(sizes) >= 20 and max(sizes) <= 512 + 4 * 40
        assert sorted(tuple(r) for r in match_optimal(presses, notes, 400, "auto").collect()) == want
    finally:
        spark.conf.unset("spark.pulsemark.hotRows")
        spark.conf.unset("spark.pulsemark.stretchRows")


def test_lag_counts_by_difference_and_by_transform(spark, monkeypatch):
    rng = random.Random(6)
    rows = {k: [(s, rng.randrange(-500, 4000)) for s in range(3) for _ in range(150)] + [(7, 10)] * (k + 1) for k in (0, 1)}
    presses = spark.createDataFrame(rows[0], "series_id long, press_ms long")
    notes = spark.createDataFrame(rows[1], "series_id long, note_ms long")
    for reach, low, width in ((700, -700, 20), (90, -90, 1), (64, -50, 7)):
        want = {}
        for s, p in rows[0]:
            for other, n in rows[1]:
                if s == other and abs(n - p) <= reach:
                    want[s, (n - p - low) // width] = want.get((s, (n - p - low) // width), 0) + 1
        for block, direct, exact in ((1 << 18, 1 << 25, 1 << 45), (256, 0, 1 << 45), (256, 0, 0)):
            monkeypatch.setattr(calibrate, "BLOCK", block)
            monkeypatch.setattr(calibrate, "DIRECT", direct)
            monkeypatch.setattr(calibrate, "EXACT", exact)
            got = {(r.series_id, r.bin): r.n for r in calibrate.lag_counts(presses, notes, reach, low, width).collect()}
            assert got == want, (reach, block, exact)
