"""Interval join and optimal one-to-one monotone matching of presses to notes.

A series is cut into islands: stretches of the merged timeline that no
candidate pair crosses.  The cuts come from ordered columns only, so no pair is
ever emitted; each island is solved on its own, streaming through Arrow batches. In
hot series, islands above ``spark.pulsemark.hotRows`` rows are cut further into
stretches (``long_islands``).
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsemark.functions.ordered import hot_keys, with_order
from pulsemark.operators.long_islands import first_fit_long, long_islands, match_long
from pulsemark.session import hot_rows, settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SERIES = ["series_id"]
NO_FRAME = -1  # Arrow batches carry no NULL integers; NULL again outside


def band_pairs(presses: DataFrame, notes: DataFrame, window_ms: int) -> DataFrame:
    """All (press, note) pairs with ``|press_ms - note_ms| <= window_ms``.

    Equi-join on (series, time bucket); a press lies in one bucket, a note's
    window touches two, so a busy series spreads over its buckets.
    """
    width = max(1, 2 * window_ms)
    left = presses.withColumn("_bucket", F.floor(F.col("press_ms") / width))
    right = notes.withColumn(
        "_bucket",
        F.explode(
            F.sequence(
                F.floor((F.col("note_ms") - window_ms) / width), F.floor((F.col("note_ms") + window_ms) / width)
            )
        ),
    )
    pairs = left.join(right, [*SERIES, "_bucket"])
    return pairs.where(F.abs(F.col("press_ms") - F.col("note_ms")) <= window_ms).drop("_bucket")


def islands(presses: DataFrame, notes: DataFrame, window: Column | int, hot="auto") -> DataFrame:
    """Merged timeline rows that have a partner within the window, with their island number."""
    w = F.lit(window) if not isinstance(window, Column) else window
    left = presses.select(
        *SERIES,
        F.col("press_ms").alias("t"),
        F.lit(0).alias("kind"),
        F.col("press_idx").alias("idx"),
        F.coalesce("frame_idx", F.lit(NO_FRAME)).cast("long").alias("frame_idx"),
        w.cast("double").alias("window_ms"),
    )
    right = notes.select(
        *SERIES,
        F.col("note_ms").alias("t"),
        F.lit(1).alias("kind"),
        F.col("note_idx").alias("idx"),
        F.lit(NO_FRAME).cast("long").alias("frame_idx"),
        w.cast("double").alias("window_ms"),
    )
    order = ["t", "kind", "idx"]
    press_t = F.when(F.col("kind") == 0, F.col("t"))
    note_t = F.when(F.col("kind") == 1, F.col("t"))
    near = with_order(
        left.unionByName(right),
        SERIES,
        order,
        prev_valid={"_last_press": press_t, "_last_note": note_t},
        next_valid={"_next_press": press_t, "_next_note": note_t},
        hot=hot,
    )
    here_press = F.coalesce(press_t, F.col("_next_press"))
    here_note = F.coalesce(note_t, F.col("_next_note"))
    crossed = F.coalesce(here_press - F.col("_last_note") <= F.col("window_ms"), F.lit(False)) | F.coalesce(
        here_note - F.col("_last_press") <= F.col("window_ms"), F.lit(False)
    )
    is_press = F.col("kind") == 0
    before = F.when(is_press, F.col("_last_note")).otherwise(F.col("_last_press"))
    after = F.when(is_press, F.col("_next_note")).otherwise(F.col("_next_press"))
    has_partner = F.coalesce(F.col("t") - before <= F.col("window_ms"), F.lit(False)) | F.coalesce(
        after - F.col("t") <= F.col("window_ms"), F.lit(False)
    )
    cut = near.select(
        *SERIES, *order, "frame_idx", "window_ms", has_partner.alias("_has"), F.when(crossed, 0).otherwise(1).alias("_cut")
    )
    numbered = with_order(cut, SERIES, order, prefix={"island": F.col("_cut")}, hot=hot)
    return (
        numbered.withColumn("island", (F.col("island") + F.col("_cut")).cast("long")).where("_has").drop("_has", "_cut")
    )


class _Optimal:
    """Most matches, then least total |error|, then smaller press and note, over one island in time order.

    Notes advance in time.  Presses behind every later window fold into ``settled``,
    the best chain so far, so only presses inside the window stay live.  A chain end
    is [value, matches, previous end, press, note]; value counts MATCH per match less
    the errors.  Presses are met in order and notes in time, so a strict comparison
    leaves ties to the smaller press, then note.  From time to time the part of the
    chains that all live ends share is given out and dropped, so memory follows the
    window, not the length of the island.
    """

    MATCH = 1 << 64
    RELEASE_EVERY = 2048

    def __init__(self, window: float, out: list):
        self.window, self.out = window, out
        self.none = [0, 0, None, None, None]
        self.settled = self.none
        self.live: list = []  # [press, best chain that ends there]
        self.ahead: deque = deque()
        self.notes: deque = deque()
        self.taken = 0

    def press(self, t, idx, frame):
        self._until(t)
        self.ahead.append((t, idx, frame))

    def note(self, t, idx):
        self._until(t)
        self.notes.append((t, idx))

    def _until(self, now):
        while self.notes and self.notes[0][0] + self.window < now:
            self._take(self.notes.popleft())

    def _take(self, note):
        t, live = note[0], self.live
        while self.ahead and self.ahead[0][0] <= t + self.window:
            live.append([self.ahead.popleft(), self.none])
        gone = 0
        while gone < len(live) and live[gone][0][0] < t - self.window:
            self._settle(live[gone][1])
            gone += 1
        del live[:gone]
        best, step = self.settled, self.MATCH
        for slot in live:
            press, held = slot
            value = best[0] + step - abs(press[0] - t)
            if value > held[0]:
                slot[1] = [value, best[1] + 1, best, press, note]
            if held[0] > best[0]:
                best = held
        self.taken += 1
        if self.taken % self.RELEASE_EVERY == 0:
            self._release()

    def _settle(self, end):
        if end[0] > self.settled[0]:
            self.settled = end

    def _give(self, end):
        pairs = []
        while end[3] is not None:
            (press_t, press_idx, frame), (note_t, note_idx) = end[3], end[4]
            pairs.append((note_idx, note_t, press_idx, press_t, frame))
            end = end[2]
        self.out.extend(reversed(pairs))

    def _release(self):
        ends = [self.settled] + [held for _, held in self.live if held is not self.none]
        depth = min(e[1] for e in ends)
        for k, e in enumerate(ends):
            while e[1] > depth:
                e = e[2]
            ends[k] = e
        while any(e is not ends[0] for e in ends):
            ends = [e[2] for e in ends]
        shared = ends[0]
        if shared[3] is not None:
            self._give(shared)
            shared[2] = shared[3] = shared[4] = None

    def finish(self):
        while self.notes:
            self._take(self.notes.popleft())
        for _, held in self.live:
            self._settle(held)
        self._give(self.settled)


class _FirstFit:
    """Two-pointer scan: match when inside the window, else drop the earlier side."""

    def __init__(self, window: float, out: list):
        self.window, self.out = window, out
        self.presses: deque = deque()
        self.notes: deque = deque()

    def press(self, t, idx, frame):
        self.presses.append((t, idx, frame))
        self._scan()

    def note(self, t, idx):
        self.notes.append((t, idx))
        self._scan()

    def _scan(self):
        while self.presses and self.notes:
            press, note = self.presses[0], self.notes[0]
            gap = press[0] - note[0]
            if abs(gap) <= self.window:
                self.out.append((note[1], note[0], press[1], press[0], press[2]))
            if gap <= self.window:
                self.presses.popleft()
            if gap >= -self.window:
                self.notes.popleft()

    def finish(self):
        pass


def _solver(kind: type) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    columns = ["series_id", "note_idx", "note_ms", "press_idx", "press_ms", "frame_idx"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, solver, found, done = None, None, [], []

        def drain():
            done.extend((here[0], *pair) for pair in found)
            found.clear()

        for batch in batches:
            rows = zip(*[batch[c].tolist() for c in ("series_id", "island", "kind", "t", "idx", "frame_idx", "window_ms")])
            for series, island, which, t, idx, frame, window in rows:
                if (series, island) != here:
                    if solver is not None:
                        solver.finish()
                        drain()
                    here, solver = (series, island), kind(window, found)
                if which == 0:
                    solver.press(t, idx, frame)
                else:
                    solver.note(t, idx)
            if solver is not None:
                drain()
            if done:
                yield pd.DataFrame(done, columns=columns)
                done.clear()
        if solver is not None:
            solver.finish()
            drain()
            if done:
                yield pd.DataFrame(done, columns=columns)

    return run


def _solve(presses: DataFrame, notes: DataFrame, window: Column | int, kind: type, split: Callable, hot) -> DataFrame:
    if isinstance(hot, str):
        hot = hot_keys(presses.select(*SERIES).union(notes.select(*SERIES)), SERIES)
    rows = islands(presses, notes, window, hot)
    if hot is None:  # no series, and so no island, is long
        return _by_island(rows, kind)
    rows = settle(rows)
    long = long_islands(rows.join(F.broadcast(hot), SERIES, "left_semi"), hot_rows(rows.sparkSession))
    if long is None:
        return _by_island(rows, kind)
    key = [*SERIES, "island"]
    cut = split(rows.join(F.broadcast(long), key, "left_semi"), long).withColumn("frame_idx", F.nullif(F.col("frame_idx"), F.lit(NO_FRAME)))
    return _by_island(rows.join(F.broadcast(long), key, "left_anti"), kind).unionByName(cut)


def _by_island(rows: DataFrame, kind: type) -> DataFrame:
    series = rows.schema["series_id"].dataType.simpleString()
    ready = rows.repartition("series_id", "island").sortWithinPartitions("series_id", "island", "t", "kind", "idx")
    return ready.mapInPandas(
        _solver(kind),
        f"series_id {series}, note_idx long, note_ms long, press_idx long, press_ms long, frame_idx long",
    ).withColumn("frame_idx", F.nullif(F.col("frame_idx"), F.lit(NO_FRAME)))


def match_optimal(presses: DataFrame, notes: DataFrame, window: Column | int, hot="auto") -> DataFrame:
    """Matched pairs (series, note, press, frame) of the optimal non-crossing matching."""
    return _solve(presses, notes, window, _Optimal, match_long, hot)


def match_first_fit(presses: DataFrame, notes: DataFrame, window: Column | int, hot="auto") -> DataFrame:
    """Matched pairs of the greedy two-pointer scan."""
    return _solve(presses, notes, window, _FirstFit, first_fit_long, hot)


def indexed_residuals(notes: DataFrame, matched: DataFrame) -> DataFrame:
    """Every note with its residual and frame; unmatched notes keep their index with NULLs."""
    hits = matched.select(
        *SERIES, "note_idx", (F.col("press_ms") - F.col("note_ms")).cast("double").alias("residual"), "frame_idx"
    )
    return notes.select(*SERIES, "note_idx").join(hits, [*SERIES, "note_idx"], "left")
