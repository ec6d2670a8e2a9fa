"""One island over many tasks: matching in stretches whose boundary states are composed.

An island is cut into stretches of consecutive rows. What is left of a cut touches what is right of it only through the
rows within one window of the cut, so a stretch is solved for every state its left cut may be in:

* optimal matching: the state is the first press that notes right of the cut may use. A stretch gives, for every state on
  its left and right, the best chain between them (most matches, least error, then smaller last press and note); these
  combine like a matrix product of (max, +).
* first fit: the state is which rows before the cut still wait, a run of presses or of notes that ends at the cut.

Then one pass along the stretches of an island, which holds a few numbers a state, fixes the state of each cut, and every
stretch makes its pairs by itself. For optimal matching a pass back over the stretches says where the chain leaves each.
Rows a stretch shares with its neighbours (the halo) are found by counting rows before t - window and up to t + window.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsemark.functions.ordered import with_order
from pulsemark.session import settle, stretch_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ISLAND = ["series_id", "island"]
STRETCH = [*ISLAND, "stretch"]
MATCH = 1 << 64
PAIRS = "note_idx long, note_ms long, press_idx long, press_ms long, frame_idx long"


def long_islands(rows: DataFrame, limit: int) -> DataFrame | None:
    """Islands of more than ``limit`` rows, or None; at most rows / limit of them."""
    found = rows.groupBy(*ISLAND).count().where(F.col("count") > limit).select(*ISLAND)
    return None if found.isEmpty() else settle(found)


def stretches(rows: DataFrame, islands: DataFrame, halo: Column) -> DataFrame:
    """Rows of long islands per stretch: own rows, and rows of kind ``halo`` within a window of the stretch.

    Adds ``stretch``, ``own`` and ``no``, the row's number among the presses or notes of its island.
    """
    size = stretch_rows(rows.sparkSession)
    order = ["t", "kind", "idx"]
    placed = with_order(rows, ISLAND, order, prefix={"pos": F.lit(1), "_presses": (F.col("kind") == 0).cast("int")}, hot=islands)
    no = F.when(F.col("kind") == 0, F.col("_presses")).otherwise(F.col("pos") - F.col("_presses"))
    placed = settle(placed.withColumn("no", no.cast("long")).withColumn("pos", F.col("pos").cast("long")).drop("_presses"))
    # probes: a row's window starts before all rows at t - window, and ends behind all rows at t + window
    at, real = F.col("t").cast("double"), F.lit(1)
    probes = placed.where(halo).select(
        *ISLAND, "kind", "no", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"), at.alias("_at"), "window_ms"
    )
    probes = probes.select(*ISLAND, (F.col("_at") + F.col("side") * F.col("window_ms")).alias("at"), "side", "kind", "no", F.lit(0).alias("real"))
    line = placed.select(*ISLAND, at.alias("at"), F.lit(0).alias("side"), "kind", "no", real.alias("real")).unionByName(probes)
    counted = with_order(line, ISLAND, ["at", "side", "kind", "no"], prefix={"before": F.col("real")}, hot=islands).where("real = 0")
    reach = counted.groupBy(*ISLAND, "kind", "no").agg(
        F.max(F.when(F.col("side") == -1, F.col("before"))).alias("low"), (F.max(F.when(F.col("side") == 1, F.col("before"))) - 1).alias("high")
    )
    touched = placed.join(reach, [*ISLAND, "kind", "no"], "left")
    own = F.floor(F.col("pos") / size)
    spread = F.sequence(F.coalesce(F.floor(F.col("low") / size), own), F.coalesce(F.floor(F.col("high") / size), own))
    out = touched.select(*ISLAND, "t", "kind", "idx", "frame_idx", "window_ms", "no", own.alias("_own"), F.explode(spread).alias("stretch"))
    return settle(out.withColumn("own", F.col("stretch") == F.col("_own")).drop("_own"))


def _sides(rows: pd.DataFrame) -> tuple[list[tuple], list[tuple], float, int, int]:
    """Presses and own notes of a stretch as (no, t, idx, frame), its window, and the times of its first and last own row."""
    rows = rows.sort_values(["kind", "no"])
    columns = [rows[c].tolist() for c in ("no", "t", "idx", "frame_idx")]
    kinds = rows["kind"].tolist()
    every = list(zip(*columns))
    first_note = kinds.index(1) if 1 in kinds else len(kinds)
    own = rows.loc[rows["own"], "t"]
    return every[:first_note], every[first_note:], float(rows["window_ms"].iloc[0]), int(own.min()), int(own.max())


def _places(presses: list[tuple], low: float) -> int:
    """Number of the first press at or after ``low``."""
    return next((p[0] for p in presses if p[1] >= low), presses[-1][0] + 1)


# ---- optimal matching


def _transfer(presses: list[tuple], notes: list[tuple], window: float, states: range) -> tuple[np.ndarray, np.ndarray, int]:
    """Value and last note of the best chain that ends at each press, for each first usable press."""
    step = 1 << 46
    kind: type = np.int64
    if (len(notes) + 1) * step >= 1 << 61 or window * (len(notes) + 1) >= step:
        step, kind = 1 << 80, object
    never = -(1 << 61) if kind is np.int64 else -(step**2)
    number = np.array([p[0] for p in presses])
    time = np.array([p[1] for p in presses], np.int64)
    prior = np.where(number[:, None] >= np.arange(states.start, states.stop)[None, :], 0, never).astype(kind)
    value = np.full(prior.shape, never, kind)
    last = np.full(prior.shape, -1, np.int64)
    settled = np.full(prior.shape[1], never, kind)
    left = 0
    for note, t, _, _ in notes:
        new_left = int(np.searchsorted(time, t - window, "left"))
        right = int(np.searchsorted(time, t + window, "right"))
        if new_left > left:
            settled = np.maximum(settled, value[left:new_left].max(axis=0))
            left = new_left
        if right <= left:
            continue
        before = np.maximum.accumulate(np.vstack([settled[None, :], value[left : right - 1]]), axis=0)
        error = np.abs(time[left:right] - t)
        if kind is object:
            error = error.astype(object)
        found = np.maximum(before, prior[left:right]) + (step - error)[:, None]
        better = (found > value[left:right]) & (found > 0)
        value[left:right][better] = found[better]
        last[left:right][better] = note
    return value, last, step


def _matrix(rows: pd.DataFrame) -> pd.DataFrame:
    """Best chains of a stretch between the states of its cuts, as flat lists (left state, right state)."""
    key = rows[STRETCH].iloc[0].to_dict()
    presses, notes, window, first, end = _sides(rows)
    out = {**key, "in_low": 0, "in_size": 0, "out_low": 0, "out_size": 0, "matches": [], "errors": [], "press": [], "note": []}
    if presses:
        low = _places(presses, first - window)
        high = next((p[0] for p in reversed(presses) if p[1] <= first + window), low - 1)
        states = range(low, max(low, high + 1) + 1)
        start, stop = _places(presses, end - window), presses[-1][0] + 1
        value, last, step = _transfer(presses, notes, window, states)
        best = [(0, 0, 0)] * len(states)  # value, press, note
        seen: dict[int, list[tuple]] = {presses[0][0]: list(best)}
        for k, p in enumerate(presses):
            for s in range(len(states)):
                if value[k, s] > best[s][0]:
                    best[s] = (int(value[k, s]), p[0], int(last[k, s]))
            seen[p[0] + 1] = list(best)
        for s in range(len(states)):
            for b in range(start, stop + 1):
                v, press, note = seen[b][s]
                matches = -(-v // step)
                out["matches"].append(matches)
                out["errors"].append(matches * step - v)
                out["press"].append(press)
                out["note"].append(note)
        out.update(in_low=states.start, in_size=len(states), out_low=start, out_size=stop - start + 1)
    return pd.DataFrame([out])


_MATRIX = "island long, stretch long, in_low long, in_size long, out_low long, out_size long, matches array<long>, errors array<long>, press array<long>, note array<long>"
_NOTHING = (0, 0, 0, 0)  # matches, -error, -press, -note of the best chain so far


class _Front:
    """Best chain before a cut for each first press behind it."""

    def __init__(self):
        self.low, self.best = 0, [_NOTHING]

    def at(self, press: int) -> tuple[int, int, int, int]:
        return self.best[min(max(press - self.low, 0), len(self.best) - 1)]


def _along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The front at the left cut of each stretch; stretches come in order."""
    here, front = None, _Front()
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if (r.series_id, r.island) != here:
                here, front = (r.series_id, r.island), _Front()
            entry = [front.at(r.in_low + s) for s in range(r.in_size)]
            out.append((r.series_id, r.island, r.stretch, r.in_low, *([x[k] for x in entry] for k in range(4))))
            if not r.in_size:
                continue
            after = _Front()
            after.low, after.best = r.out_low, []
            for b in range(r.out_size):
                best = front.at(r.out_low + b)
                for s in range(r.in_size):
                    k = s * r.out_size + b
                    if r.matches[k] > 0:
                        e = entry[s]
                        best = max(best, (e[0] + int(r.matches[k]), e[1] - int(r.errors[k]), -int(r.press[k]), -int(r.note[k])))
                after.best.append(best)
            front = after
        yield pd.DataFrame(out, columns=[*STRETCH, "low", "matches", "gain", "press", "note"])


_FRONT = "island long, stretch long, low long, matches array<long>, gain array<long>, press array<long>, note array<long>"


class _Chains:
    """Chain ends of a stretch, given the front at its left cut. An end is [value, previous end, press, note]."""

    def __init__(self, rows: pd.DataFrame, front: pd.DataFrame):
        self.presses, self.notes, window, _, self.end = _sides(rows)
        self.window = window
        self.first = self.presses[0][0] if self.presses else 0
        r = front.iloc[0]
        entry = _Front()
        entry.low = int(r["low"])
        entry.best = [tuple(int(v) for v in x) for x in zip(r["matches"], r["gain"], r["press"], r["note"])] or [_NOTHING]
        self.entry = entry
        self.ends: list[list | None] = [None] * len(self.presses)
        time = [p[1] for p in self.presses]
        left = right = 0
        settled = None
        for note in self.notes:
            while right < len(time) and time[right] <= note[1] + window:
                right += 1
            while left < right and time[left] < note[1] - window:
                settled = self.best_of(settled, self.ends[left])
                left += 1
            best = settled
            for k in range(left, right):
                held = self.ends[k]
                before = self.or_entry(best, self.presses[k][0])
                value = before[0] + MATCH - abs(time[k] - note[1])
                if held is None or value > held[0]:
                    self.ends[k] = [value, before, self.presses[k], note]
                best = self.best_of(best, held)

    @staticmethod
    def best_of(best: list | None, other: list | None) -> list | None:
        """Ends come with rising presses, so a tie stays with the smaller press."""
        return other if other is not None and (best is None or other[0] > best[0]) else best

    def or_entry(self, best: list | None, press: int) -> list:
        """``best``, or the chain before the cut where that is better or ties with a smaller press (its note is smaller)."""
        matches, gain, before, _ = self.entry.at(press)
        value = matches * MATCH + gain
        if best is None or value > best[0] or (value == best[0] and -before <= best[2][0]):
            return [value, None, None, None]
        return best

    def exits(self) -> tuple[int, list[list]]:
        """First state of the right cut, and the best end below each of its states."""
        low = _places(self.presses, self.end - self.window)
        best, out = None, []
        for k, (press, *_) in enumerate(self.presses):
            if press >= low:
                out.append(self.or_entry(best, press))
            best = self.best_of(best, self.ends[k])
        return low, [*out, self.or_entry(best, self.presses[-1][0] + 1)]


def _ways(rows: pd.DataFrame, front: pd.DataFrame) -> pd.DataFrame:
    """For each state of the right cut, the state in which the best chain leaves the stretch on its left."""
    key = front[STRETCH].iloc[0].to_dict()
    chains = _Chains(rows, front)
    low, leaves = 0, []
    if chains.presses:
        low, ends = chains.exits()
        for b, end in enumerate(ends):
            state = low + b
            while end[1] is not None:
                state, end = end[2][0], end[1]
            leaves.append(state)
    return pd.DataFrame([{**key, "low": low, "leaves": leaves}])


def _back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state of each stretch's right cut on the best chain; stretches come last first."""
    here, state = None, None
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if (r.series_id, r.island) != here:
                here, state = (r.series_id, r.island), 1 << 62
            out.append((r.series_id, r.island, r.stretch, state))
            if len(r.leaves):
                place = min(max(state - r.low, 0), len(r.leaves) - 1)
                left = int(r.leaves[place])
                state = min(state, left)
        yield pd.DataFrame(out, columns=[*STRETCH, "state"])


def _pairs(rows: pd.DataFrame, front: pd.DataFrame) -> pd.DataFrame:
    chains, found = _Chains(rows, front), []
    if chains.presses:
        low, ends = chains.exits()
        end = ends[min(max(int(front["state"].iloc[0]) - low, 0), len(ends) - 1)]
        while end[1] is not None:
            (_, press_ms, press_idx, frame), (_, note_ms, note_idx, _) = end[2], end[3]
            found.append((rows["series_id"].iloc[0], note_idx, note_ms, press_idx, press_ms, frame))
            end = end[1]
    return pd.DataFrame(found, columns=["series_id", "note_idx", "note_ms", "press_idx", "press_ms", "frame_idx"])


def match_long(rows: DataFrame, islands: DataFrame) -> DataFrame:
    """Optimal matching of long islands; ``rows`` are their rows."""
    series = f"series_id {rows.schema['series_id'].dataType.simpleString()}"
    part = stretches(rows, islands, F.col("kind") == 0)
    matrices = settle(part.groupBy(*STRETCH).applyInPandas(_matrix, f"{series}, {_MATRIX}"))
    along = matrices.repartition(*ISLAND).sortWithinPartitions(*STRETCH).mapInPandas(_along, f"{series}, {_FRONT}")
    fronts = settle(along)
    by_stretch = part.groupBy(*STRETCH)
    ways = settle(by_stretch.cogroup(fronts.groupBy(*STRETCH)).applyInPandas(_ways, f"{series}, island long, stretch long, low long, leaves array<long>"))
    back = ways.repartition(*ISLAND).sortWithinPartitions(*ISLAND, F.col("stretch").desc())
    states = back.mapInPandas(_back, f"{series}, island long, stretch long, state long")
    planned = settle(fronts.join(states, STRETCH))
    return by_stretch.cogroup(planned.groupBy(*STRETCH)).applyInPandas(_pairs, f"{series}, {PAIRS}")


# ---- first fit


def _scan(presses: list[tuple], notes: list[tuple], window: float) -> tuple[int, int, list[tuple]]:
    """Two pointers over (no, t, idx, frame) lists: how many of each side are used up, and the pairs."""
    i = j = 0
    pairs = []
    while i < len(presses) and j < len(notes):
        gap = presses[i][1] - notes[j][1]
        if abs(gap) <= window:
            pairs.append((presses[i], notes[j]))
        i += gap <= window
        j += gap >= -window
    return i, j, pairs


class _Waiting:
    """Rows of a stretch by side, and the rows before its cut that may still wait."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["kind", "no"])
        self.window = float(rows["window_ms"].iloc[0])
        own = rows.loc[rows["own"]]
        self.first, self.last = int(own["t"].min()), int(own["t"].max())
        self.own: list[list[tuple]] = []
        self.halo: list[list[tuple]] = []
        for kind in (0, 1):
            side = rows[rows["kind"] == kind]
            listed = lambda part: list(zip(*[part[c].tolist() for c in ("no", "t", "idx", "frame_idx")]))
            mine = listed(side[side["own"]])
            border = own.sort_values(["t", "kind", "idx"]).iloc[0]
            early = side[~side["own"] & ((side["t"] < border["t"]) | ((side["t"] == border["t"]) & (side["kind"] <= border["kind"])))]
            before = [r for r in listed(early) if not mine or r[0] < mine[0][0]]
            self.own.append(mine)
            self.halo.append(before)

    def run(self, state: int) -> tuple[int, list[tuple]]:
        """State of the right cut, and the pairs, when ``state`` > 0 presses or < 0 notes wait at the left cut."""
        presses, notes = list(self.own[0]), list(self.own[1])
        if state > 0:
            presses = self.halo[0][max(0, len(self.halo[0]) - state) :] + presses
        elif state < 0:
            notes = self.halo[1][max(0, len(self.halo[1]) + state) :] + notes
        i, j, pairs = _scan(presses, notes, self.window)
        # what lies more than a window before the last row meets no later row
        alive = lambda side: sum(r[1] >= self.last - self.window for r in side)
        return alive(presses[i:]) - alive(notes[j:]), pairs


def _steps(rows: pd.DataFrame) -> pd.DataFrame:
    key = rows[STRETCH].iloc[0].to_dict()
    waiting = _Waiting(rows)
    low, high = -len(waiting.halo[1]), len(waiting.halo[0])
    return pd.DataFrame([{**key, "low": low, "after": [waiting.run(s)[0] for s in range(low, high + 1)]}])


def _follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state of each stretch's left cut; stretches come in order."""
    here, state = None, 0
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if (r.series_id, r.island) != here:
                here, state = (r.series_id, r.island), 0
            place = min(max(state - r.low, 0), len(r.after) - 1)
            out.append((r.series_id, r.island, r.stretch, r.low + place))
            state = int(r.after[place])
        yield pd.DataFrame(out, columns=[*STRETCH, "state"])


def _fitted(rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
    _, pairs = _Waiting(rows).run(int(states["state"].iloc[0]))
    series = rows["series_id"].iloc[0]
    found = [(series, n[2], n[1], p[2], p[1], p[3]) for p, n in pairs]
    return pd.DataFrame(found, columns=["series_id", "note_idx", "note_ms", "press_idx", "press_ms", "frame_idx"])


def first_fit_long(rows: DataFrame, islands: DataFrame) -> DataFrame:
    """First-fit matching of long islands; ``rows`` are their rows."""
    series = f"series_id {rows.schema['series_id'].dataType.simpleString()}"
    part = stretches(rows, islands, F.lit(True))
    steps = settle(part.groupBy(*STRETCH).applyInPandas(_steps, f"{series}, island long, stretch long, low long, after array<long>"))
    states = steps.repartition(*ISLAND).sortWithinPartitions(*STRETCH).mapInPandas(_follow, f"{series}, island long, stretch long, state long")
    return part.groupBy(*STRETCH).cogroup(settle(states).groupBy(*STRETCH)).applyInPandas(_fitted, f"{series}, {PAIRS}")
