"""Parameter sweeps and the physical round trip, as table jobs keyed by cell."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsemark.functions import hashing as H
from pulsemark.operators import frames as fr
from pulsemark.operators import marking as M
from pulsemark.operators.features import series_features
from pulsemark.operators.matching import indexed_residuals, match_optimal
from pulsemark.session import hot_rows, settle

SERIES = ["series_id"]


def config_id(*parts) -> Column:
    """Hash id of a cell's parameters."""
    return H.short_id(*parts)


def _hot_capacities(series: DataFrame, n: int):
    """None when no series of (num_notes) can have more blocks of ``n`` notes than an ordinary key may have rows."""
    longest = series.agg(F.max("num_notes")).first()[0] or 0
    return None if longest // n <= hot_rows(series.sparkSession) else "auto"


def planned_cells(series: DataFrame, alphas: Sequence[float], ns: Sequence[int], completed: DataFrame | None = None) -> DataFrame:
    """Series x alpha x n cells still to run, with capacity and status PLANNED or SKIP_CAPACITY.

    ``series`` has series_id and num_notes; ``completed`` has (series_id, alpha, n).
    """
    grid = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(n).alias("n")) for a in alphas for n in ns])
    cells = series.select(*SERIES, "num_notes", F.explode(grid).alias("g")).select(*SERIES, "num_notes", "g.alpha", "g.n")
    cells = cells.withColumn("capacity", F.floor(F.col("num_notes") / F.col("n")).cast("long"))
    cells = cells.withColumn("status", F.when(F.col("capacity") == 0, "SKIP_CAPACITY").otherwise("PLANNED"))
    return cells if completed is None else cells.join(completed, [*SERIES, "alpha", "n"], "left_anti")


def run_sweep(
    residuals: DataFrame,
    alphas: Sequence[float],
    ns: Sequence[int],
    pn_key: str,
    layout_key: str,
    family: str,
    num_bits: Column | str,
    completed: DataFrame | None = None,
) -> DataFrame:
    """Bits, errors and error rate of every planned cell; cells without capacity get a skip row.

    Blocks, chips and bits are found once per n; only the strength is multiplied out.
    """
    series = residuals.groupBy(*SERIES).agg((F.max("note_idx") + 1).alias("num_notes"))
    cells = planned_cells(series, alphas, ns, completed)
    bit = M.message_bit(family, F.col("series_id"), F.col("bit_idx"))
    runs = None
    hot = _hot_capacities(series, min(ns))
    for n in ns:
        base = M.carriers(residuals, n, pn_key, layout_key, num_bits, hot=hot).where(F.col("bit_idx").isNotNull())
        each = base.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas]))).withColumn("n", F.lit(n))
        if completed is not None:
            each = each.join(completed, [*SERIES, "alpha", "n"], "left_anti")
        marked = M.embed(each, F.col("alpha"), bit)
        decoded = M.correlate(marked, "marked", [*SERIES, "alpha", "n"])
        runs = decoded if runs is None else runs.unionByName(decoded)
    per = runs.groupBy(*SERIES, "alpha", "n").agg(
        F.count(F.lit(1)).alias("bits"), F.sum((F.col("decoded_bit") != bit).cast("int")).cast("long").alias("errors")
    )
    out = cells.join(per, [*SERIES, "alpha", "n"], "left")
    return out.select(
        *SERIES,
        "alpha",
        "n",
        "capacity",
        F.when(F.col("capacity") == 0, "SKIP_CAPACITY").otherwise("OK").alias("status"),
        F.coalesce("bits", F.lit(0)).alias("bits"),
        F.coalesce("errors", F.lit(0)).alias("errors"),
        F.try_divide(F.col("errors").cast("double"), F.col("bits")).alias("error_rate"),
    )


GRID_AXES = ["condition", "n", "payload_fraction", "layout", "alpha", "pn_key", "family"]


@dataclass(frozen=True)
class Grid:
    """The axes of a sweep; ``conditions`` maps a condition's name to its layout key."""

    alphas: Sequence[float]
    ns: Sequence[int]
    fractions: Sequence[float]
    layouts: Sequence[str]
    pn_keys: Sequence[str]
    families: Sequence[str]
    conditions: Mapping[str, str]

    def shapes(self):
        """(condition, layout key, n, fraction, layout): what decides where blocks lie."""
        for (name, key), n, fraction, layout in product(self.conditions.items(), self.ns, self.fractions, self.layouts):
            yield name, key, n, fraction, layout

    def settings(self) -> Column:
        """Array of (alpha, pn_key, family): what is multiplied out over the placed blocks."""
        return F.array(
            *[
                F.struct(F.lit(float(a)).alias("alpha"), F.lit(k).alias("pn_key"), F.lit(f).alias("family"))
                for a, k, f in product(self.alphas, self.pn_keys, self.families)
            ]
        )


def grid_cells(series: DataFrame, grid: Grid, completed: DataFrame | None = None) -> DataFrame:
    """Every series x cell still to run, with capacity, bits and status; ``completed`` has series_id and the axes."""
    shapes = F.array(
        *[
            F.struct(F.lit(c).alias("condition"), F.lit(n).alias("n"), F.lit(float(f)).alias("payload_fraction"), F.lit(l).alias("layout"))
            for c, _, n, f, l in grid.shapes()
        ]
    )
    cells = series.select(*SERIES, "num_notes", F.explode(shapes).alias("s"), grid.settings().alias("g"))
    cells = cells.select(*SERIES, "num_notes", "s.*", F.explode("g").alias("g")).select("*", "g.*").drop("g")
    cells = cells.withColumn("capacity", F.floor(F.col("num_notes") / F.col("n")).cast("long"))
    cells = cells.withColumn("status", F.when(F.col("capacity") == 0, "SKIP_CAPACITY").otherwise("OK"))
    return cells if completed is None else cells.join(completed, [*SERIES, *GRID_AXES], "left_anti")


def _cell_axes(grid: Grid, spark: SparkSession) -> DataFrame:
    """(_cell, axes): the cells of a grid by number, shapes first."""
    settings = list(product(grid.alphas, grid.pn_keys, grid.families))
    rows = [(c, n, float(f), l, float(a), k, m) for c, _, n, f, l in grid.shapes() for a, k, m in settings]
    types = ["string", "int", "double", "string", "double", "string", "string"]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_cell int, " + ", ".join(f"{n} {t}" for n, t in zip(GRID_AXES, types)))


def _grid_marked(residuals: DataFrame, grid: Grid, completed: DataFrame | None) -> DataFrame:
    """Marked residual rows (series_id, _cell, note_idx, num_notes, marked) of every cell with capacity.

    Carriers are found once per shape; rows carry the number of their cell and not its axes.
    """
    out, first = None, 0
    settings = list(product(grid.alphas, grid.pn_keys, grid.families))
    if completed is not None:
        completed = completed.join(F.broadcast(_cell_axes(grid, residuals.sparkSession)), GRID_AXES).select(*SERIES, "_cell")
    hot = _hot_capacities(residuals.groupBy(*SERIES).agg((F.max("note_idx") + 1).alias("num_notes")), min(grid.ns))
    for _, layout_key, n, fraction, layout in grid.shapes():
        bits = F.greatest(F.lit(1), F.floor(F.col("capacity") * F.lit(float(fraction)) + 1e-9).cast("int"))
        base = M.carriers(residuals, n, grid.pn_keys[0], layout_key, bits, layout, hot).drop("chip").where("capacity > 0")
        here = [F.struct(F.lit(first + i).alias("_cell"), F.lit(float(a)).alias("alpha"), F.lit(k).alias("pn_key"), F.lit(f).alias("family")) for i, (a, k, f) in enumerate(settings)]
        first += len(here)
        each = base.withColumn("g", F.explode(F.array(*here))).select("*", "g.*").drop("g")
        if completed is not None:
            each = each.join(completed, [*SERIES, "_cell"], "left_anti")
        spot = F.col("bit_idx") * n + F.col("note_idx") % n
        each = each.withColumn("chip", F.when(F.col("bit_idx").isNotNull(), M.chip(F.col("pn_key"), spot)))
        bit = M.message_bit(F.col("family"), F.col("series_id"), F.col("bit_idx"))
        part = M.embed(each, F.col("alpha"), bit).select(*SERIES, "_cell", "note_idx", "num_notes", "marked")
        out = part if out is None else out.unionByName(part)
    return out


def run_grid(residuals: DataFrame, grid: Grid, completed: DataFrame | None = None) -> DataFrame:
    """One result row per series and cell: bits, errors, error rate; cells without capacity get a skip row.

    Settings multiply sums and not rows: a residual row adds to one sum per chip key, strength and sign of its bit, and the
    families choose among the sums of their bit. Series without a cell to run are left out before.
    """
    keys = [*SERIES, *GRID_AXES]
    series = residuals.groupBy(*SERIES).agg((F.max("note_idx") + 1).alias("num_notes"))
    cells = grid_cells(series, grid, completed)
    if completed is not None:
        cells = settle(cells)
        residuals = residuals.join(cells.where("status = 'OK'").select(*SERIES).distinct(), SERIES, "left_semi")
    hot = _hot_capacities(series, min(grid.ns))
    sums = [(a, k, sign) for a in grid.alphas for k in grid.pn_keys for sign in (1, -1)]
    per = None
    for condition, layout_key, n, fraction, layout in grid.shapes():
        bits = F.greatest(F.lit(1), F.floor(F.col("capacity") * F.lit(float(fraction)) + 1e-9).cast("int"))
        base = M.carriers(residuals, n, grid.pn_keys[0], layout_key, bits, layout, hot).where("bit_idx is not null and capacity > 0")
        spot = F.col("bit_idx") * n + F.col("note_idx") % n
        base = base.select(*SERIES, "bit_idx", "residual", *[M.chip(k, spot).alias(f"_chip{i}") for i, k in enumerate(grid.pn_keys)])
        chips = {k: F.col(f"_chip{i}") for i, k in enumerate(grid.pn_keys)}
        marked = lambda a, k, sign: F.coalesce(F.rint(F.col("residual") + float(a) * chips[k] * sign), F.col("residual"))  # noqa: B023, E731
        summed = base.groupBy(*SERIES, "bit_idx").agg(*[F.coalesce(F.sum(marked(a, k, s) * chips[k]), F.lit(0.0)).alias(f"_c{i}") for i, (a, k, s) in enumerate(sums)])
        at = {x: F.col(f"_c{i}") for i, x in enumerate(sums)}
        wrong = []
        for f in grid.families:
            bit = M.message_bit(f, F.col("series_id"), F.col("bit_idx"))
            for a, k in product(grid.alphas, grid.pn_keys):
                decoded = F.when(bit == 1, at[a, k, 1]).otherwise(at[a, k, -1]) >= 0
                wrong.append(F.struct(F.lit(float(a)).alias("alpha"), F.lit(k).alias("pn_key"), F.lit(f).alias("family"), (decoded != (bit == 1)).cast("long").alias("wrong")))
        part = summed.select(*SERIES, F.inline(F.array(*wrong))).groupBy(*SERIES, "alpha", "pn_key", "family")
        part = part.agg(F.count(F.lit(1)).alias("bits"), F.sum("wrong").alias("errors"))
        part = part.withColumns({"condition": F.lit(condition), "n": F.lit(n), "payload_fraction": F.lit(float(fraction)), "layout": F.lit(layout)})
        per = part if per is None else per.unionByName(part)
    out = cells.join(per, keys, "left").fillna(0, ["bits", "errors"])
    rate = F.try_divide(F.col("errors").cast("double"), F.col("bits")).alias("error_rate")
    return out.select(*keys, "capacity", "status", "bits", "errors", rate)


def grid_features(residuals: DataFrame, grid: Grid, completed: DataFrame | None = None) -> DataFrame:
    """Two feature rows per series and cell with capacity: clean (label 0, computed once per series) and marked (1)."""
    keys = [*SERIES, *GRID_AXES]
    series = residuals.groupBy(*SERIES).agg((F.max("note_idx") + 1).alias("num_notes"))
    cells = grid_cells(series, grid, completed).where("status = 'OK'").select(*keys)
    clean = cells.join(series_features(residuals), SERIES).withColumn("label", F.lit(0))
    marked = _grid_marked(residuals, grid, completed).withColumnRenamed("marked", "residual")
    found = series_features(marked, [*SERIES, "_cell"], sized=True).join(F.broadcast(_cell_axes(grid, residuals.sparkSession)), "_cell").drop("_cell")
    return clean.unionByName(found.withColumn("label", F.lit(1)))


def marked_pairs(
    residuals: DataFrame, alphas: Sequence[float], n: int, pn_key: str, layout_key: str, family: str, num_bits: Column | str
) -> DataFrame:
    """Clean (label 0) and marked (label 1) residual rows per (series, alpha) with their series' ``num_notes``, ready for feature extraction.

    Sizes, blocks and rows all read the residuals, which are settled for it.
    """
    residuals = settle(residuals.select(*SERIES, "note_idx", "residual"))
    bit = M.message_bit(family, F.col("series_id"), F.col("bit_idx"))
    each = M.carriers(residuals, n, pn_key, layout_key, num_bits).withColumn(
        "alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas]))
    )
    both = M.embed(each, F.col("alpha"), bit).withColumn(
        "v", F.explode(F.array(F.struct(F.lit(0).alias("label"), F.col("residual")), F.struct(F.lit(1).alias("label"), F.col("marked").alias("residual"))))
    )
    return both.select(*SERIES, "alpha", "v.label", "note_idx", "v.residual", "num_notes")


def round_trip(
    timed: DataFrame,
    notes: DataFrame,
    window_ms: int,
    margin_ms: float,
    n: int,
    alpha: float,
    pn_key: str,
    layout_key: str,
    family: str,
    num_bits: Column | str,
    hot="auto",
) -> DataFrame:
    """Mark, guard, repair, re-time, re-detect, re-match: one row per note with before and after.

    The tables several steps read (frames, presses, shifts, repaired anchors) are settled
    once in the checkpoint folder.  Columns: residual, frame_idx, bit_idx, chip, bit, requested, hit_drop, shift_ms,
    safe_shift_ms, after (residual found again after re-timing).
    """
    timed = settle(timed.select(*SERIES, "frame_idx", "abs_ms", "keys"))
    presses = settle(fr.key_downs(timed, hot))
    notes = settle(notes)
    clean = fr.drop_reused_frames(indexed_residuals(notes, match_optimal(presses, notes, window_ms, hot)), hot)
    bit = M.message_bit(family, F.col("series_id"), F.col("bit_idx"))
    carried = M.carriers(clean, n, pn_key, layout_key, num_bits)
    asked = settle(M.guard_window(M.embed(carried, alpha, bit), window_ms, margin_ms))
    targets = asked.where((F.col("shift_ms") != 0) & F.col("frame_idx").isNotNull()).select(*SERIES, "frame_idx", "shift_ms")
    downs = fr.key_down_frames(presses).join(
        timed.select(*SERIES, "frame_idx", F.col("abs_ms").alias("t")), [*SERIES, "frame_idx"]
    )
    anchors = downs.join(targets, [*SERIES, "frame_idx"], "left").withColumn(
        "shift_ms", F.coalesce(F.col("shift_ms"), F.lit(0).cast("long"))
    )
    safe = settle(M.keep_order(anchors, hot))
    if not M.order_violations(safe, hot).isEmpty():
        raise ValueError("an inversion cannot be repaired; see order_violations")
    moved = M.retime(timed, safe, hot).drop("abs_ms").withColumnRenamed("new_ms", "abs_ms")
    again = fr.key_downs(moved.select(*SERIES, "frame_idx", "abs_ms", "keys"), hot)
    after = indexed_residuals(notes, match_optimal(again, notes, window_ms, hot)).select(
        *SERIES, "note_idx", F.col("residual").alias("after")
    )
    out = asked.withColumn("bit", F.when(F.col("bit_idx").isNotNull(), bit))
    out = out.join(safe.select(*SERIES, "frame_idx", "safe_shift_ms"), [*SERIES, "frame_idx"], "left")
    return out.join(after, [*SERIES, "note_idx"], "left")


def _n(cond: Column) -> Column:
    return F.sum(F.coalesce(cond, F.lit(False)).cast("int")).cast("long")


def diagnostics(trip: DataFrame, keys: Sequence[str], n: int, alpha: float) -> DataFrame:
    """Per-bit (keys include bit_idx) or per-series counts, energies and correlations of a round trip."""
    active = F.coalesce(F.col("safe_shift_ms"), F.lit(0)) != 0
    active = active & (F.col("shift_ms") != 0)
    here, there = F.col("residual").isNotNull(), F.col("after").isNotNull()
    shift = F.when(active, F.col("safe_shift_ms")).otherwise(0)
    corr = F.coalesce(F.sum(F.col("after") * F.col("chip")), F.lit(0.0))
    out = trip.groupBy(*keys).agg(
        F.max("bit").alias("true_bit"),
        corr.alias("correlation"),
        F.abs(corr).alias("abs_correlation"),
        (F.abs(corr) / (alpha * F.greatest(F.lit(1), _n(there)))).alias("normalized_abs_correlation"),
        F.min("block_idx").alias("block_idx"),
        F.max("capacity").alias("capacity"),
        F.max("num_notes").alias("num_notes"),
        _n(there).alias("roundtrip_valid_carriers"),
        F.sum("requested").cast("long").alias("requested_carriers"),
        _n(active).alias("active_carriers"),
        F.sum("hit_drop").cast("long").alias("hit_window_drops"),
        _n((F.col("shift_ms") != 0) & ~active).alias("chronology_drops"),
        _n(here & ~there).alias("new_unmatched_events"),
        _n(~here & there).alias("new_matched_events"),
        F.sum((shift * shift).cast("double")).alias("sum_squared_shift_ms2"),
        F.sum(F.abs(shift).cast("double")).alias("total_absolute_shift_ms"),
        F.count("residual").alias("clean_valid_residuals"),
        F.avg("residual").alias("clean_mean_residual"),
        F.var_pop("residual").alias("clean_variance"),
        F.avg(F.abs("residual")).alias("clean_mean_absolute_residual"),
        F.coalesce(F.sum(F.col("residual") * F.col("chip")), F.lit(0.0)).alias("clean_pn_correlation"),
    )
    start = F.col("block_idx") * n
    return (
        out.withColumn("decoded_bit", F.when(F.col("correlation") >= 0, 1).otherwise(-1))
        .withColumn("is_error", (F.col("decoded_bit") != F.col("true_bit")).cast("int"))
        .withColumn("block_start_note", start)
        .withColumn("block_center_fraction", (2 * start + n) / (2.0 * F.col("num_notes")))
        .withColumn("block_quarter", F.least(F.lit(3), F.floor(4 * F.col("block_idx") / F.nullif(F.col("capacity"), F.lit(0)))) + 1)
        .withColumn("dropped_carriers", F.col("requested_carriers") - F.col("active_carriers"))
        .withColumn("rematching_changes", F.col("new_unmatched_events") + F.col("new_matched_events"))
    )
