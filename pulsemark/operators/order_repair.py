"""Repair of out-of-order neighbours, event by event, within one stretch or over many.

A round takes both sides of every adjacent inversion back to shift 0, all judged from the state the round began with. Only
pairs beside a row that the last round changed can be new, and a row changes once at most, so following the changes is
linear in the rows, however long a chain of changes runs.

A long island is cut into stretches. A stretch sees its neighbours only through the row at either end: its time, its
shift, and the round in which it is taken back. Stretches are solved with the rounds known so far, tell the rounds of
their own end rows, and those whose neighbours' rounds have changed are solved again. What happens in a round follows from
earlier rounds alone, so when no round changes any more, all are those of the whole island.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsemark.functions.ordered import with_order
from pulsemark.session import settle, stretch_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NEVER = 1 << 62  # round of a row that keeps its shift
PER_STRETCH = 64  # rows here are three numbers, so stretches are longer than those of events
KEY = ["series_id", "island", "stretch"]
End = tuple[int, int, int]  # time, shift, round


def take_back_rounds(t: np.ndarray, shift: np.ndarray, linked: np.ndarray, left: End | None = None, right: End | None = None) -> np.ndarray:
    """Round in which each row's shift is taken back, or NEVER; ``linked`` says which neighbours belong together.

    ``left`` and ``right`` are rows beside the ends whose rounds are given.
    """
    edge = [e for e in (left, right) if e is not None]
    if edge:
        before, after = ([left] if left else []), ([right] if right else [])
        t = np.concatenate([[e[0] for e in before], t, [e[0] for e in after]]).astype(np.int64)
        shift = np.concatenate([[e[1] for e in before], shift, [e[1] for e in after]]).astype(np.int64)
        linked = np.concatenate([[True] * len(before), linked, [True] * len(after)]).astype(bool)
    n = len(t)
    offset = 1 if left else 0
    given = ([(left[2], 0)] if left else []) + ([(right[2], n - 1)] if right else [])
    given = sorted(g for g in given if g[0] < NEVER)
    fixed = np.zeros(n, bool)
    if left:
        fixed[0] = True
    if right:
        fixed[-1] = True
    rounds = np.full(n, NEVER, np.int64)
    live = shift != 0
    moved = t + shift
    look = np.flatnonzero(linked)
    now = 0
    while True:
        bad = look[moved[look] > moved[look + 1]]
        touched = np.unique(np.concatenate([bad, bad + 1]))
        touched = touched[live[touched] & ~fixed[touched]]
        if not len(touched):
            if not given:
                return rounds[offset : n - (1 if right else 0)]
            now = max(now, given[0][0])  # nothing happens until a given row is taken back
        rounds[touched] = now
        due = [at for when, at in given if when <= now]
        given = [g for g in given if g[0] > now]
        changed = np.concatenate([touched, np.array(due, touched.dtype)])
        live[changed] = False
        moved[changed] = t[changed]
        look = np.unique(np.concatenate([changed - 1, changed]))
        look = look[(look >= 0) & (look < n - 1)]
        look = look[linked[look]]
        now += 1


def _end(ends: pd.DataFrame, stretch: int, side: str) -> End | None:
    row = ends[(ends["of"] == stretch) & (ends["side"] == side)]
    return None if row.empty else (int(row["t"].iloc[0]), int(row["shift_ms"].iloc[0]), int(row["round"].iloc[0]))


def _solve(rows: pd.DataFrame, ends: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    rows = rows.sort_values("frame_idx", ignore_index=True)
    stretch = int(rows["stretch"].iloc[0])
    linked = np.ones(len(rows) - 1, bool)
    found = take_back_rounds(rows["t"].values, rows["shift_ms"].values, linked, _end(ends, stretch - 1, "last"), _end(ends, stretch + 1, "first"))
    return rows, found


def _tell_ends(rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    if rows.empty:
        return pd.DataFrame(columns=[*KEY, "side", "t", "shift_ms", "round"])
    rows, found = _solve(rows, ends)
    told = rows.assign(round=found).iloc[[0, -1]].assign(side=["first", "last"])
    return told[[*KEY, "side", "t", "shift_ms", "round"]]


def _repaired(rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    columns = ["series_id", "frame_idx", "t", "shift_ms"]
    if rows.empty:
        return pd.DataFrame(columns=[*columns, "safe_shift_ms"])
    rows, found = _solve(rows, ends)
    return rows[columns].assign(safe_shift_ms=np.where(found < NEVER, 0, rows["shift_ms"].values))


def _beside(ends: DataFrame) -> DataFrame:
    """Ends keyed by the stretch that sees them: a last row by the stretch after it, a first row by the one before."""
    seen_by = F.col("stretch") + F.when(F.col("side") == "last", 1).otherwise(-1)
    return ends.select("series_id", "island", seen_by.alias("stretch"), F.col("stretch").alias("of"), "side", "t", "shift_ms", "round")


def _with_ends(rows: DataFrame, ends: DataFrame, solve: Callable, schema: str) -> DataFrame:
    return rows.groupBy(*KEY).cogroup(_beside(ends).groupBy(*KEY)).applyInPandas(solve, schema)


def repair_long(rows: DataFrame, islands: DataFrame) -> DataFrame:
    """safe_shift_ms of long islands; ``rows`` (series_id, island, frame_idx, t, shift_ms) are theirs."""
    kind = rows.schema["series_id"].dataType.simpleString()
    size = PER_STRETCH * stretch_rows(rows.sparkSession)
    placed = with_order(rows, KEY[:2], ["frame_idx"], prefix={"_pos": F.lit(1)}, hot=islands)
    placed = settle(placed.withColumn("stretch", F.floor(F.col("_pos") / size)).drop("_pos"))
    told = f"series_id {kind}, island long, stretch long, side string, t long, shift_ms long, round long"
    nothing = rows.sparkSession.createDataFrame([], told)
    ends = settle(_with_ends(placed, nothing, _tell_ends, told))
    news = ends.where(F.col("round") < NEVER)
    while not news.isEmpty():
        again = _beside(news).select(*KEY).distinct()
        later = _with_ends(placed.join(again, KEY, "left_semi"), ends, _tell_ends, told)
        later = settle(later.withColumnRenamed("round", "_new").select(*KEY, "side", "_new"))
        both = settle(ends.join(later, [*KEY, "side"], "left").withColumn("_new", F.coalesce("_new", "round")))
        news = both.where("_new != round").select(*KEY, "side", "t", "shift_ms", "round")
        ends = both.withColumn("round", F.col("_new")).drop("_new").select(*KEY, "side", "t", "shift_ms", "round")
    return _with_ends(placed, ends, _repaired, f"series_id {kind}, frame_idx long, t long, shift_ms long, safe_shift_ms long")
