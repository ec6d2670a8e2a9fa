"""Keyed additive marks on residual series as table transforms.

A series of n notes has n div N blocks.  A layout key orders the blocks of a
capacity by hash and bit i goes to the i-th block, so shorter messages use a
subset of the longer message's blocks.  Chips and random message bits are hash
expressions, so no key table is joined.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsemark.functions import exact
from pulsemark.functions import hashing as H
from pulsemark.functions.ordered import hot_keys, with_order, with_position
from pulsemark.functions.stretches import breaks, whole_islands
from pulsemark.operators.long_islands import long_islands
from pulsemark.operators.order_repair import NEVER, repair_long, take_back_rounds
from pulsemark.session import BROADCAST_ROWS, hot_rows, settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SERIES = ["series_id"]
FAMILIES = ("all_zero", "all_one", "alternating", "random_a", "random_b")


def chip(key: Column | str, chip_idx: Column) -> Column:
    """+1/-1 chip of a key."""
    return H.sign(key, "chip", chip_idx)


def chip_table(keys: DataFrame, key: str, length: int) -> DataFrame:
    """chip_idx 0..length-1 for every key; ``length`` is a sequence length, not a table size."""
    at = keys.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))).alias("chip_idx"))
    return at.withColumn("chip", chip(F.col(key), F.col("chip_idx")))


def message_bit(family: Column | str, owner: Column, bit_idx: Column) -> Column:
    """Bit (+1/-1) of a deterministic message; a shorter message is a prefix of a longer one."""
    fam = family if isinstance(family, Column) else F.lit(family)
    return (
        F.when(fam == "all_zero", F.lit(-1))
        .when(fam == "all_one", F.lit(1))
        .when(fam == "alternating", F.when(bit_idx % 2 == 1, 1).otherwise(-1))
        .otherwise(H.sign(fam, owner, "bit", bit_idx))
        .cast("int")
    )


def place_blocks(
    capacity_blocks: DataFrame, layout_key: str, num_bits: Column | str | None = None, layout: str = "distributed", hot="auto"
) -> DataFrame:
    """Give the blocks of every capacity their bit number.

    ``capacity_blocks`` holds the distinct (capacity, block_idx): a capacity has as many rows as it says, so a caller
    that knows the longest series can name the ``hot`` capacities.  "prefix" keeps block order.
    """
    if layout == "prefix":
        placed = capacity_blocks.withColumn("bit_idx", F.col("block_idx"))
    else:
        drawn = capacity_blocks.withColumn("_h", H.digest(layout_key, F.col("capacity"), F.col("block_idx")))
        placed = with_position(drawn, ["capacity"], ["_h", "block_idx"], "bit_idx", hot).drop("_h")
    if num_bits is None:
        return placed
    limit = F.expr(num_bits) if isinstance(num_bits, str) else num_bits
    return placed.where(F.col("bit_idx") < limit)


def with_blocks(residuals: DataFrame, n: int) -> DataFrame:
    """Add num_notes, capacity and block_idx (NULL for the tail that fills no block)."""
    sizes = residuals.groupBy(*SERIES).agg((F.max("note_idx") + 1).alias("num_notes"))
    block = F.floor(F.col("note_idx") / n).cast("long")
    out = residuals.join(sizes, SERIES).withColumn("capacity", F.floor(F.col("num_notes") / n).cast("long"))
    return out.withColumn("block_idx", F.when(block < F.col("capacity"), block))


def carriers(
    residuals: DataFrame,
    n: int,
    pn_key: str,
    layout_key: str,
    num_bits: Column | str | None = None,
    layout: str = "distributed",
    hot="auto",
) -> DataFrame:
    """Residual rows with the bit they carry (NULL when unselected) and their chip."""
    blocked = with_blocks(residuals, n)
    distinct = blocked.where(F.col("block_idx").isNotNull()).select("capacity", "block_idx").distinct()
    placed = settle(place_blocks(distinct, layout_key, num_bits, layout, hot))
    # few capacities hold most rows: a shuffle by them would send these to few tasks
    at = blocked.join(F.broadcast(placed) if placed.count() <= BROADCAST_ROWS else placed, ["capacity", "block_idx"], "left")
    return at.withColumn("chip", F.when(F.col("bit_idx").isNotNull(), chip(pn_key, F.col("bit_idx") * n + F.col("note_idx") % n)))


def exact_carriers(residuals: DataFrame, n: int, pn_key: str, layout_key: str, num_bits: Column | str | None = None, layout: str = "distributed") -> DataFrame:
    """As ``carriers`` with the studied experiments' own generator (``functions.exact``) for chips and placement."""
    blocked = with_blocks(residuals, n)
    sizes = blocked.select("capacity").distinct()
    if layout == "prefix":
        placed = sizes.where("capacity > 0").select("capacity", F.explode(F.sequence(F.lit(0).cast("long"), F.col("capacity") - 1)).alias("block_idx"))
        placed = placed.withColumn("bit_idx", F.col("block_idx"))
    else:
        placed = exact.placements(sizes, layout_key)
    if num_bits is not None:
        placed = placed.where(F.col("bit_idx") < (F.expr(num_bits) if isinstance(num_bits, str) else num_bits))
    placed = settle(placed)
    most = placed.agg(F.max("bit_idx")).first()[0]
    at = blocked.join(placed, ["capacity", "block_idx"], "left").withColumn("_spot", F.col("bit_idx") * n + F.col("note_idx") % n)
    length = 1 if most is None else (most + 1) * n
    keys = residuals.sparkSession.range(1).select(F.lit(pn_key).alias("_key"))
    chips = exact.chip_table(keys, "_key", length).select(F.col("chip_idx").alias("_spot"), "chip")
    return at.join(F.broadcast(chips) if length <= BROADCAST_ROWS else chips, "_spot", "left").drop("_spot")


def embed(carried: DataFrame, alpha: Column | float, bit: Column, quantize: bool = True) -> DataFrame:
    """Add ``marked``: residual + alpha*chip*bit on carrying positions, half-even rounded; else the residual."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    moved = F.col("residual") + a * F.col("chip") * bit
    moved = F.rint(moved) if quantize else moved
    return carried.withColumn("marked", F.coalesce(moved, F.col("residual")))


def correlate(carried: DataFrame, value: str, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Block correlation and decoded bit per carried bit; a block with no value gives 0, and 0 decodes to +1."""
    c = F.coalesce(F.sum(F.col(value) * F.col("chip")), F.lit(0.0))
    return (
        carried.where(F.col("bit_idx").isNotNull())
        .groupBy(*keys, "bit_idx")
        .agg(c.alias("correlation"), F.count(value).alias("n_valid"))
        .withColumn("decoded_bit", F.when(F.col("correlation") >= 0, 1).otherwise(-1).cast("int"))
    )


def predicted_margins(correlated: DataFrame, bit: Column, alpha: Column | float) -> DataFrame:
    """bit * clean correlation + alpha * valid positions, per bit."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return correlated.withColumn("margin", bit * F.col("correlation") + a * F.col("n_valid"))


def summarize_margins(margins: DataFrame, keys: Sequence[str]) -> DataFrame:
    return margins.groupBy(*keys).agg(
        F.sum((F.col("margin") <= 0).cast("int")).cast("long").alias("nonpositive_count"),
        F.min("margin").alias("minimum_margin"),
        F.avg("margin").alias("mean_margin"),
    )


def select_candidate(scores: DataFrame, unit: Sequence[str], candidate: str, first_k: int | None = None) -> DataFrame:
    """Best candidate per unit: fewest nonpositive, larger minimum, larger mean, then id.

    ``first_k`` keeps candidates whose ``candidate_rank`` is below it, so choices over growing k are nested.
    """
    pool = scores if first_k is None else scores.where(F.col("candidate_rank") < first_k)
    best = F.struct("nonpositive_count", -F.col("minimum_margin"), -F.col("mean_margin"), candidate)
    return pool.groupBy(*unit).agg(F.min_by(candidate, best).alias(candidate))


def blind_decision(hypotheses: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Accept a unit only when its accepted hypotheses agree on one message."""
    taken = F.when(F.col("accepted"), F.col("message"))
    out = hypotheses.groupBy(*unit).agg(
        F.count(taken).alias("accepted_hypotheses"), F.min(taken).alias("_low"), F.max(taken).alias("_high")
    )
    reason = (
        F.when(F.col("_low").isNull(), "no_accepted_hypothesis")
        .when(F.col("_low") != F.col("_high"), "ambiguous_messages")
        .otherwise("accepted")
    )
    message = F.when(F.col("_low") == F.col("_high"), F.col("_low"))
    return out.select(*unit, "accepted_hypotheses", reason.alias("decision"), message.alias("message"))


def guard_window(shifts: DataFrame, window_ms: Column | float, margin_ms: float) -> DataFrame:
    """Zero a shift that would push its residual past window - margin.

    Needs residual, marked; adds requested (0/1), shift_ms, hit_drop (0/1).
    """
    w = window_ms if isinstance(window_ms, Column) else F.lit(float(window_ms))
    limit = F.greatest(w - F.lit(float(margin_ms)), F.lit(0.0))
    ask = F.coalesce(F.rint(F.col("marked") - F.col("residual")).cast("long"), F.lit(0).cast("long"))
    out = shifts.withColumn("_ask", ask)
    wanted = F.col("_ask") != 0
    drop = wanted & (F.abs(F.col("residual") + F.col("_ask")) > limit)
    return (
        out.withColumn("requested", wanted.cast("int"))
        .withColumn("hit_drop", drop.cast("int"))
        .withColumn("shift_ms", F.when(drop, 0).otherwise(F.col("_ask")).cast("long"))
        .drop("_ask")
    )


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in whole_islands(batches):
        rounds = take_back_rounds(rows["t"].values, rows["shift_ms"].values, ~breaks(rows))
        safe = np.where(rounds < NEVER, 0, rows["shift_ms"].values)
        yield rows.assign(safe_shift_ms=safe)[["series_id", "frame_idx", "t", "shift_ms", "safe_shift_ms"]]


def keep_order(anchors: DataFrame, hot="auto") -> DataFrame:
    """Add safe_shift_ms so that anchors (key-down frames: t, shift_ms, 0 if untouched) stay in order.

    Repair only ever takes shifts back to 0, so neighbours whose gap is at least what the first moves forward plus
    what the second moves back can never swap: the series is cut there, and each island is repaired on its own, one
    above ``spark.pulsemark.hotRows`` rows in stretches that exchange their end rows (``order_repair``). Inversions that no shift explains remain; ``order_violations`` lists them.
    """
    order = ["frame_idx"]
    if isinstance(hot, str):
        hot = hot_keys(anchors, SERIES)
    back = with_order(anchors, SERIES, order, prev={"_t": F.col("t"), "_s": F.col("shift_ms")}, hot=hot)
    reach = F.greatest(F.col("_s"), F.lit(0)) + F.greatest(-F.col("shift_ms"), F.lit(0))
    cut = back.withColumn("_cut", F.coalesce(F.col("t") - F.col("_t") >= reach, F.lit(True)).cast("int")).drop("_t", "_s")
    numbered = with_order(cut, SERIES, order, prefix={"island": F.col("_cut")}, hot=hot)
    numbered = numbered.withColumn("island", (F.col("island") + F.col("_cut")).cast("long"))
    kind = anchors.schema["series_id"].dataType.simpleString()
    rows = numbered.select("series_id", "island", "frame_idx", "t", F.col("shift_ms").cast("long").alias("shift_ms"))
    if hot is None:  # no series, and so no island, is long
        return _by_island(rows, kind)
    rows = settle(rows)
    long = long_islands(rows.join(F.broadcast(hot), SERIES, "left_semi"), hot_rows(rows.sparkSession))
    if long is None:
        return _by_island(rows, kind)
    key = [*SERIES, "island"]
    cut = repair_long(rows.join(F.broadcast(long), key, "left_semi"), long)
    return _by_island(rows.join(F.broadcast(long), key, "left_anti"), kind).unionByName(cut)


def _by_island(rows: DataFrame, kind: str) -> DataFrame:
    ready = rows.repartition("series_id", "island").sortWithinPartitions("series_id", "island", "frame_idx")
    return ready.mapInPandas(_repair, f"series_id {kind}, frame_idx long, t long, shift_ms long, safe_shift_ms long")


def order_violations(repaired: DataFrame, hot="auto") -> DataFrame:
    """Anchors still out of order after repair (their unshifted times already are)."""
    moved = F.col("t") + F.col("safe_shift_ms")
    back = with_order(repaired, SERIES, ["frame_idx"], prev={"_m": moved}, hot=hot)
    return back.where(F.col("_m") > moved).select(*SERIES, "frame_idx", F.lit("unresolvable_inversion").alias("reason"))


def retime(timed: DataFrame, anchors: DataFrame, hot="auto") -> DataFrame:
    """Move anchors to their target time, clamp other frames between neighbouring anchors, recompute deltas.

    ``timed`` has frame_idx, abs_ms; ``anchors`` has frame_idx, safe_shift_ms for every key-down frame.
    """
    joined = timed.join(anchors.select(*SERIES, "frame_idx", "safe_shift_ms"), [*SERIES, "frame_idx"], "left")
    target = F.when(F.col("safe_shift_ms").isNotNull(), F.col("abs_ms") + F.col("safe_shift_ms"))
    near = with_order(
        joined.withColumn("_target", target),
        SERIES,
        ["frame_idx"],
        prev_valid={"_left": F.col("_target")},
        next_valid={"_right": F.col("_target")},
        hot=hot,
    )
    low = F.coalesce(F.greatest(F.col("abs_ms"), F.col("_left")), F.col("abs_ms"))
    clamped = F.least(low, F.coalesce(F.col("_right"), low))
    moved = near.withColumn("new_ms", F.coalesce(F.col("_target"), clamped).cast("long"))
    out = with_order(moved, SERIES, ["frame_idx"], prev={"_p": F.col("new_ms")}, hot=hot)
    return out.withColumn("new_delta_ms", F.col("new_ms") - F.coalesce(F.col("_p"), F.lit(0))).drop(
        "_target", "_left", "_right", "_p"
    )
