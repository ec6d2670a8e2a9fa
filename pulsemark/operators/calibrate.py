"""Per-map time offset from the lag histogram of presses against notes."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsemark.functions.ordered import with_position
from pulsemark.functions.ranks import exact_quantiles
from pulsemark.functions.stretches import whole_islands
from pulsemark.operators.matching import match_first_fit
from pulsemark.session import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SERIES = ["series_id"]


def evenly_spaced(df: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """At most ``k`` evenly spaced rows of each group's sorted rows (positions truncated)."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    placed = with_position(df, [group], order, "_pos").join(sizes, group)
    n, pos = F.col("_n"), F.col("_pos")
    span = F.greatest(n - 1, F.lit(1))
    step = F.ceil(pos * (k - 1) / span)
    keep = (n <= k) | (F.floor(step * span / (k - 1)) == pos)
    return placed.where(keep).drop("_n", "_pos")


BLOCK = 1 << 18  # milliseconds correlated at once
DIRECT = 1 << 25  # pairs up to which a stretch is counted pair by pair rather than by transforms
EXACT = 1 << 45  # product of the blocks' norms up to which rounding a transform gives the exact counts


def lag_counts(presses: DataFrame, notes: DataFrame, reach: int, low: int, width: int) -> DataFrame:
    """Count of note-press differences per series and bin; differences lie within ``reach`` of 0, bin 0 starts at ``low``.

    Both sides are first combined per millisecond. A series is cut into stretches of press times; notes within reach of
    two stretches go to both, so at most three copies of an event are shuffled, and no pair is. A stretch is the discrete
    correlation of two count vectors: by Fourier transforms of blocks when it is dense, by differences when it is sparse.
    """
    size = BLOCK * max(1, -(-2 * reach // BLOCK))
    p = presses.groupBy(*SERIES, F.col("press_ms").cast("long").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    q = notes.groupBy(*SERIES, F.col("note_ms").cast("long").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    of = lambda t: F.floor(t / size)
    near = F.sequence(of(F.col("t") - reach), of(F.col("t") + reach))
    rows = p.select(*SERIES, of(F.col("t")).alias("island"), F.lit(0).alias("kind"), "t", "n").unionByName(
        q.select(*SERIES, F.explode(near).alias("island"), F.lit(1).alias("kind"), "t", "n")
    )
    kind = presses.schema["series_id"].dataType.simpleString()
    ready = rows.repartition(*SERIES, "island").sortWithinPartitions(*SERIES, "island", "t")
    found = ready.mapInPandas(_correlated(reach, low, width, size), f"series_id {kind}, bin long, n long")
    return found.groupBy(*SERIES, "bin").agg(F.sum("n").alias("n"))


def _correlated(reach: int, low: int, width: int, size: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    base, bins = (-reach - low) // width, (2 * reach) // width + 2

    def told(names: pd.Index, code: np.ndarray | int, lag: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        keys, place = np.unique(code * bins + (lag - low) // width - base, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, place, n)
        return pd.DataFrame({"series_id": np.asarray(names)[keys // bins], "bin": keys % bins + base, "n": total})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_islands(batches):
            series, names = pd.factorize(rows["series_id"])
            change = np.concatenate(([False], (series[1:] != series[:-1]) | (rows["island"].values[1:] != rows["island"].values[:-1])))
            group = np.cumsum(change)
            # groups side by side on one axis, too far apart to meet
            axis = rows["t"].values - rows["island"].values * size + group * (size + 3 * reach + 1)
            sides = [rows["kind"].values == k for k in (0, 1)]
            press, note = axis[sides[0]], axis[sides[1]]
            times = [rows["n"].values[m] for m in sides]
            first, last = np.searchsorted(note, press - reach, "left"), np.searchsorted(note, press + reach, "right")
            pairs = np.bincount(group[sides[0]], last - first, minlength=group[-1] + 1)
            sparse = np.flatnonzero(pairs[group[sides[0]]] <= DIRECT)
            code = series[sides[0]]
            step = max(1, DIRECT // 8 // max(1, int((last - first).max(initial=1))))
            for at in range(0, len(sparse), step):
                here = sparse[at : at + step]
                count = last[here] - first[here]
                which = np.repeat(here, count)
                met = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[here], count)
                yield told(names, code[which], note[met] - press[which], times[0][which] * times[1][met])
            for dense in np.flatnonzero(pairs > DIRECT):
                mine = [group[m] == dense for m in sides]
                both = [np.stack([x[m], n[m]]) for x, n, m in zip((press, note), times, mine)]
                for lag, n in _by_transform(*both, reach):
                    yield told(names, int(code[mine[0]][0]), lag, n)

    return run


def _by_transform(press: np.ndarray, note: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lags, counts) of note-press differences within ``reach``, block against block."""
    lags = np.arange(-BLOCK + 1, BLOCK)

    def blocks(side: np.ndarray) -> dict[int, tuple[np.ndarray, float, np.ndarray, np.ndarray]]:
        out = {}
        place = side[0] // BLOCK
        for k in np.unique(place):
            t, n = side[:, place == k]
            line = np.zeros(2 * BLOCK)
            line[t - k * BLOCK] = n
            out[int(k)] = (np.fft.rfft(line), float(np.sqrt((n.astype(float) ** 2).sum())), t - k * BLOCK, n)
        return out

    near = -(-reach // BLOCK)
    notes = blocks(note)
    for k, (spectrum, norm, t, n) in blocks(press).items():
        for other in range(k - near, k + near + 1):
            if other not in notes:
                continue
            spectrum2, norm2, t2, n2 = notes[other]
            if norm * norm2 <= EXACT:
                line = np.rint(np.fft.irfft(np.conj(spectrum) * spectrum2, 2 * BLOCK)).astype(np.int64)
                counts = np.concatenate([line[BLOCK + 1 :], line[:BLOCK]])
            else:  # too many events in a millisecond for a transform's precision
                counts = np.zeros(len(lags), np.int64)
                for time, times in zip(t, n):
                    counts[t2 - time + BLOCK - 1] += times * n2
            lag = lags + (other - k) * BLOCK
            good = (counts != 0) & (np.abs(lag) <= reach)
            yield lag[good], counts[good]


def lag_histogram(presses: DataFrame, notes: DataFrame, limit: int, width: int) -> DataFrame:
    """Histogram of note-press differences within +-limit, scaled to peak 1 per series."""
    return _scaled(lag_counts(presses, notes, limit, -limit, width))


def _scaled(counts: DataFrame) -> DataFrame:
    """Adds ``height``: the count over the largest of its series."""
    counts = settle(counts)
    peaks = counts.groupBy(*SERIES).agg(F.max("n").alias("_peak"))
    return counts.join(peaks, SERIES).withColumn("height", F.col("n") / F.col("_peak")).drop("_peak")


def _first_peak(hist: DataFrame, maps: DataFrame) -> DataFrame:
    """First bin with the greatest summed height per map."""
    total = hist.join(maps, SERIES).groupBy("map_id", "bin").agg(F.round(F.sum("height"), 9).alias("h"))
    return total.groupBy("map_id").agg(F.min_by("bin", F.struct(-F.col("h"), "bin")).alias("bin"))


def common_offsets(presses: DataFrame, notes: DataFrame, maps: DataFrame, limit: int, width: int) -> DataFrame:
    """Two-stage offset per map: coarse peak bin, then 1 ms bins around its centre.

    ``maps`` maps series_id to map_id.
    """
    coarse = _first_peak(lag_histogram(presses, notes, limit, width), maps).select(
        "map_id", (F.lit(-limit) + F.col("bin") * width + width // 2).alias("coarse_ms")
    )
    radius = max(100, 4 * width)
    centred = presses.join(maps.join(coarse, "map_id"), SERIES).withColumn(
        "press_ms", F.col("press_ms") + F.col("coarse_ms")
    )
    best = _first_peak(_scaled(lag_counts(centred, notes, radius, -radius, 1)), maps)
    return best.join(coarse, "map_id").select(
        "map_id", "coarse_ms", (F.col("coarse_ms") - radius + F.col("bin")).alias("offset_ms")
    )


def validate_offsets(
    presses: DataFrame, notes: DataFrame, offsets: DataFrame, window_ms: int, minimum: float = 0.95, hot="auto"
) -> DataFrame:
    """Median/min/max share of matched notes per map under its fixed offset, flagged below ``minimum``.

    ``offsets`` maps series_id to map_id and offset_ms.
    """
    moved = presses.join(offsets, SERIES).withColumn("press_ms", F.col("press_ms") + F.col("offset_ms"))
    hits = match_first_fit(moved, notes, window_ms, hot).groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_m"))
    sizes = notes.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_n"))
    ratio = F.coalesce(F.col("_m"), F.lit(0)) / F.col("_n")
    per = offsets.select(*SERIES, "map_id").join(sizes, SERIES).join(hits, SERIES, "left").withColumn("ratio", ratio)
    per = settle(per.select(*SERIES, "map_id", "ratio"))  # one row per series, read twice
    middle = exact_quantiles(per, ["map_id"], "ratio", {"median_match_ratio": 0.5})
    ends = per.groupBy("map_id").agg(
        F.count(F.lit(1)).alias("num_series"),
        F.min("ratio").alias("min_match_ratio"),
        F.max("ratio").alias("max_match_ratio"),
    )
    return ends.join(middle, "map_id").withColumn("flagged", F.col("median_match_ratio") < minimum)
