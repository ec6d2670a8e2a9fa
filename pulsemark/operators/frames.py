"""Frame streams: absolute time, key-down edges, alignment, carrier hygiene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsemark.functions.ordered import with_order, with_position
from pulsemark.session import spread

# fixed values: format constants of the frame stream
SENTINEL_DELTA = -12345
BUTTON_BITS = (1, 2, 4, 8)
MOD_EASY = 2
MOD_HARD = 16

SERIES = ["series_id"]


def absolute_times(frames: DataFrame, hot="auto") -> DataFrame:
    """Drop sentinel frames and add ``abs_ms``, the running sum of deltas; indices are kept."""
    kept = frames.where(F.col("time_delta_ms") != SENTINEL_DELTA)
    timed = with_order(kept, SERIES, ["frame_idx"], prefix={"abs_ms": F.col("time_delta_ms")}, hot=hot)
    return timed.withColumn("abs_ms", (F.col("abs_ms") + F.col("time_delta_ms")).cast("long"))


def sentinel_violations(frames: DataFrame) -> DataFrame:
    """Series with a real frame after their first sentinel (map-side combined, no ordering)."""
    sentinel = F.col("time_delta_ms") == SENTINEL_DELTA
    edges = frames.groupBy(*SERIES).agg(
        F.min(F.when(sentinel, F.col("frame_idx"))).alias("first_sentinel"),
        F.max(F.when(~sentinel, F.col("frame_idx"))).alias("last_frame"),
    )
    return edges.where(F.col("last_frame") > F.col("first_sentinel"))


def split_gameplay(frames: DataFrame, hot="auto") -> tuple[DataFrame, DataFrame]:
    """Timed frames of clean series, and a reject row (series, reason) for the others."""
    bad = sentinel_violations(frames)
    good = absolute_times(frames.join(bad, SERIES, "left_anti"), hot)
    return good, bad.select(*SERIES, F.lit("frame_after_sentinel").alias("reason"))


def key_downs(timed: DataFrame, hot="auto") -> DataFrame:
    """One row per button going down; two buttons in one frame give two rows."""
    before = with_order(timed, SERIES, ["frame_idx"], prev={"_prev_keys": F.col("keys")}, hot=hot)
    pressed = F.col("keys").bitwiseAND(F.bitwise_not(F.coalesce(F.col("_prev_keys"), F.lit(0))))
    buttons = F.array(*[F.lit(b) for b in BUTTON_BITS])
    downs = F.filter(buttons, lambda b: pressed.bitwiseAND(b) != 0)
    events = before.select(
        *SERIES, "frame_idx", F.col("abs_ms").alias("press_ms"), F.explode(downs).alias("button")
    )
    return with_position(events, SERIES, ["press_ms", "button", "frame_idx"], "press_idx", hot)


def key_down_frames(presses: DataFrame) -> DataFrame:
    return presses.select(*SERIES, "frame_idx").distinct()


def align_to_map(presses: DataFrame, headers: DataFrame, offsets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shift presses by their map's fixed offset; series without one are rejected."""
    placed = headers.select(*SERIES, "map_id").join(offsets.select("map_id", "offset_ms"), "map_id", "left")
    aligned = presses.join(placed.where(F.col("offset_ms").isNotNull()), SERIES).withColumn(
        "press_ms", F.col("press_ms") + F.col("offset_ms")
    )
    rejects = placed.where(F.col("offset_ms").isNull()).select(*SERIES, F.lit("no_offset").alias("reason"))
    return aligned, rejects


def has_mod(mods: Column, bit: int) -> Column:
    return mods.bitwiseAND(F.lit(bit)) != 0


def effective_difficulty(base: Column, mods: Column) -> Column:
    """Easy halves the difficulty, hard raises it by 1.4 up to 10."""
    eased = F.when(has_mod(mods, MOD_EASY), base * 0.5).otherwise(base)
    return F.when(has_mod(mods, MOD_HARD), F.least(eased * 1.4, F.lit(10.0))).otherwise(eased)


def hit_window_ms(difficulty: Column) -> Column:
    return F.lit(200.0) - F.lit(10.0) * difficulty


def drop_reused_frames(residuals: DataFrame, hot="auto") -> DataFrame:
    """A frame carries one note only: the first keeps it, later ones become missing in place."""
    used = residuals.where(F.col("frame_idx").isNotNull()).groupBy(*SERIES, "frame_idx").agg(
        F.min("note_idx").alias("_owner")
    )
    joined = residuals.join(used, [*SERIES, "frame_idx"], "left")
    keeps = F.col("_owner") == F.col("note_idx")
    removed = F.col("frame_idx").isNotNull() & ~keeps
    return joined.select(
        *SERIES,
        "note_idx",
        F.when(removed, None).otherwise(F.col("residual")).alias("residual"),
        F.when(removed, None).otherwise(F.col("frame_idx")).alias("frame_idx"),
        F.coalesce(removed, F.lit(False)).alias("removed"),
    )


def unique_targets(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One shift per frame; frames with differing shifts are rejected."""
    merged = spread(targets, *SERIES, "frame_idx").groupBy(*SERIES, "frame_idx").agg(
        F.min("shift_ms").alias("shift_ms"), F.max("shift_ms").alias("_max")
    )
    good = merged.where(F.col("shift_ms") == F.col("_max")).drop("_max")
    bad = merged.where(F.col("shift_ms") != F.col("_max")).select(
        *SERIES, "frame_idx", F.lit("conflicting_shifts").alias("reason")
    )
    return good, bad
