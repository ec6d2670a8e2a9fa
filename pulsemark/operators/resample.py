"""Bootstrap intervals over pre-aggregated units.

Units (rows, clusters, keys) are first summed to one row each and numbered;
iteration i draws n of n unit numbers by hash, so the same hash gives the same
draws in SQL.  Draws are generated in place from ``range``.  A unit table counted
to at most BROADCAST_ROWS is sent to them, and each task adds up its draws before
one row per iteration is shuffled; a larger one is joined by shuffle.

Statistics that need more than sums (AUC, median, two ways) work on cells and a draw
table.  A task has a slice of the cells and a stretch of iterations: it is sent the
counts of its iterations, one byte each, of the units that its cells have, and then its
cells pass by, so that neither a cell is multiplied by the iterations nor a count by the
cells, and no more counts are sent than cells times iterations, whatever the slices.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsemark.functions import hashing as H
from pulsemark.functions.ordered import with_position
from pulsemark.session import BROADCAST_ROWS, partitions, settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LOW, HIGH = 0.025, 0.975
CHUNK = 512  # iterations that are worked on side by side, at most
BLOCK = 1024  # units whose counts make one row of a draw table
TABLE_BYTES = 1 << 28  # counts that a task holds
SLICE_ROWS = 8_000_000  # cells that a task sorts
SLICE_LEAST = 4096  # cells that a slice is worth
PACKED = 1 << 20  # draws that are packed together before they are shuffled, PACKED_MOST where there are many units
PACKED_MOST = 1 << 23
TASK_DRAWS = 4_000_000  # draws that a task makes
CELLS = 9  # the kind of a cell among rows; lower kinds are draw tables


def numbered(units: DataFrame, unit: str, name: str = "unit_no") -> tuple[DataFrame, int]:
    """Units with a dense number in id order, and their count."""
    out = settle(with_position(units, [], [unit], name))
    return out, out.count()


def to_draws(drawn: DataFrame, table: DataFrame, n: int, on: str | list[str] = "unit_no") -> DataFrame:
    """Draws joined with the unit table of ``n`` rows."""
    return drawn.join(F.broadcast(table) if n <= BROADCAST_ROWS else table, on)


def draws(spark: SparkSession, n: int, iterations: int, seed: str) -> DataFrame:
    """(iteration, unit_no) drawn with replacement, n per iteration."""
    base = spark.range(iterations * n).select(
        F.floor(F.col("id") / n).cast("long").alias("iteration"), (F.col("id") % n).alias("_pos")
    )
    return base.select("iteration", H.draw(F.lit(n), seed, F.col("iteration"), F.col("_pos")).alias("unit_no"))


def _spread(samples: DataFrame, names: Sequence[str]) -> DataFrame:
    """Long (metric, ci_low, ci_high); a sample is one value per iteration, so at most ``iterations`` values."""
    entries = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names])
    long = samples.select(F.explode(entries).alias("_e")).select("_e.*").where(F.col("v").isNotNull())
    q = F.percentile("v", F.array(F.lit(LOW), F.lit(HIGH)))
    return long.groupBy("metric").agg(q[0].alias("ci_low"), q[1].alias("ci_high"), F.count("v").alias("iterations"))


def bootstrap(units: DataFrame, unit: str, sums: Sequence[str], statistics: Mapping[str, str], iterations: int, seed: str) -> DataFrame:
    """Observed value and 95 % interval of every statistic in one pass.

    ``units`` has one row per resampling unit with the columns ``sums``;
    ``statistics`` are SQL expressions over the summed columns.
    """
    table, n = numbered(units.select(unit, *sums), unit)
    picked = to_draws(draws(units.sparkSession, n, iterations, seed), table, n)
    totals = picked.groupBy("iteration").agg(*[F.sum(c).alias(c) for c in sums])
    samples = totals.select(*[F.expr(e).alias(m) for m, e in statistics.items()])
    seen = table.agg(*[F.sum(c).alias(c) for c in sums])
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(e).cast("double").alias("value")) for m, e in statistics.items()])
    observed = seen.select(F.explode(entries).alias("_e")).select("_e.*")
    return observed.join(_spread(samples, list(statistics)), "metric")


def cluster_totals(rows: DataFrame, cluster: str, sums: Mapping[str, str]) -> DataFrame:
    """Per-cluster sums of SQL row expressions, plus ``rows``."""
    return rows.groupBy(cluster).agg(*[F.sum(F.expr(e)).alias(n) for n, e in sums.items()], F.count(F.lit(1)).alias("rows"))


def bootstrap_median(rows: DataFrame, cluster: str, value: str, iterations: int, seed: str) -> DataFrame:
    """Interval of the median under cluster resampling.

    Two passes over the sorted cells: the first counts the rows that every iteration draws from a slice of the values, so
    that the middle rows can be placed, and the second finds their values.
    """
    spark = rows.sparkSession
    cells = rows.where(F.col(value).isNotNull()).groupBy(cluster, F.col(value).cast("double").alias("s")).agg(F.count(F.lit(1)).alias("p"))
    table, n = numbered(cells.select(cluster).distinct(), cluster)
    width = _width(n, iterations)
    chunks = -(-iterations // width)
    weights = draw_table(spark, n, iterations, seed, width)
    cells = settle(cells.join(table, cluster).select("unit_no", "s", "p"))
    cuts = _cuts(cells, "s", _slices(spark, cells.count(), chunks))
    slices = len(cuts) + 1
    laid = settle(_laid([weights], cells.withColumn("slice", _slice_of("s", cuts)), ["s"], slices, chunks))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _parts(batches, 1, width, lambda part, drawn: _Held(part, drawn[0]))

    total = np.zeros((slices, chunks * width), np.int64)
    for row in laid.mapInArrow(held, "part int, total binary").toLocalIterator():
        chunk, at = divmod(row.part, slices)
        total[at, chunk * width : (chunk + 1) * width] = np.frombuffer(row.total, np.int64)
    before, drawn = np.cumsum(total, axis=0) - total, total.sum(axis=0)
    low, high = (drawn - 1) // 2, drawn // 2  # places of the middle rows; none where nothing was drawn

    def middle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def begin(part: int, drawn: list[_Drawn]) -> _Middle:
            chunk, at = divmod(part, slices)
            here = slice(chunk * width, (chunk + 1) * width)
            return _Middle(chunk * width, drawn[0], low[here] - before[at, here], high[here] - before[at, here])

        yield from _parts(batches, 1, width, begin)

    found = laid.mapInArrow(middle, "iteration long, low double, high double").where(F.col("iteration") < iterations)
    medians = found.groupBy("iteration").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    return _spread(medians.select((F.col("low") + (F.col("high") - F.col("low")) / 2).alias("median")), ["median"])


def bootstrap_auc(rows: DataFrame, cluster: str, scores: Sequence[str], label: str, iterations: int, seed: str) -> DataFrame:
    """Interval of the AUC of each score column, and of the last minus the first, under cluster resampling.

    Rows are first combined per (cluster, score, label) and sorted by score once, for all iterations. A task sweeps its
    range of scores with one number per iteration, the weighted negatives passed so far; each range tells its totals, and
    what lies before a range is added up afterwards. Iterations that draw one class only are skipped.
    """
    entries = F.array(*[F.struct(F.lit(s).alias("metric"), F.col(s).cast("double").alias("s")) for s in scores])
    positive = F.col(label) == 1
    cells = (
        rows.where(F.col(label).isNotNull())
        .select(cluster, positive.alias("_pos"), F.explode(entries).alias("_e"))
        .where("_e.s is not null")
        .groupBy(cluster, F.col("_e.metric").alias("metric"), F.col("_e.s").alias("s"))
        .agg(F.sum(F.col("_pos").cast("long")).alias("p"), F.sum((~F.col("_pos")).cast("long")).alias("q"))
    )
    table, n = numbered(rows.select(cluster).distinct(), cluster)
    width = _width(n, iterations)
    weights = draw_table(rows.sparkSession, n, iterations, seed, width)
    per = _swept_auc(settle(cells.join(table, cluster).select("unit_no", "metric", "s", "p", "q")), weights, scores, iterations, width)
    wide = per.groupBy("iteration").agg(*[F.max(F.when(F.col("metric") == s, F.col("auc"))).alias(s) for s in scores])
    names = list(scores)
    if len(scores) > 1:
        wide = wide.withColumn("delta", F.col(scores[-1]) - F.col(scores[0]))
        names.append("delta")
    return _spread(wide, names)


def _width(n: int, iterations: int) -> int:
    """Iterations that are worked on side by side over ``n`` units."""
    return max(1, min(CHUNK, iterations, TABLE_BYTES // max(1, n)))


def draw_table(spark: SparkSession, n: int, iterations: int, seed: str, width: int) -> DataFrame:
    """(chunk, block, data): how often each of BLOCK units is drawn in each of ``width`` iterations, as unsigned numbers.

    The draws are those of ``draws``; the bytes of their hashes are made into unit numbers where they are packed.
    """
    total = iterations * n
    ids = spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, -(-total // TASK_DRAWS)))
    iteration = F.floor(F.col("id") / n).cast("long")
    hashes = ids.select("id", H.seed_bytes(seed, iteration, F.col("id") % n).alias("hash"))
    size = min(PACKED_MOST, max(PACKED, n))
    packed = hashes.mapInArrow(lambda batches: _packed(batches, n, width, size), "chunk long, block long, at binary")

    def counted(table: pa.Table) -> pa.Table:
        at = np.concatenate([np.frombuffer(v.as_buffer(), "<i4") for v in table.column("at")])  # about BLOCK * width draws
        counts = np.bincount(at, minlength=BLOCK * width)
        size = next(d for d in ("<u1", "<u2", "<u4", "<u8") if counts.max() <= np.iinfo(d).max)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "block": table.column("block").slice(0, 1), "data": pa.array([counts.astype(size).tobytes()], pa.binary())})

    return settle(packed.groupBy("chunk", "block").applyInArrow(counted, "chunk long, block long, data binary"))


def _packed(batches: Iterator[pa.RecordBatch], n: int, width: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, hash) of draws to one row per chunk and block of ``size`` draws."""
    blocks = -(-n // BLOCK)

    def pack(some: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, at = (np.concatenate(c) for c in zip(*some))
        low = key.min()
        near = key - low
        order = np.argsort(near.astype(np.uint16) if near.max() < 1 << 16 else near, kind="stable")
        key, at = key[order], at[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        data = [a.tobytes() for a in np.split(at, first[1:])]
        return pa.RecordBatch.from_arrays([pa.array(key[first] // blocks), pa.array(key[first] % blocks), pa.array(data, pa.binary())], ["chunk", "block", "at"])

    some, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            iteration = batch.column("id").to_numpy() // n
            hashed = batch.column("hash").cast(pa.binary(4))
            unit = np.frombuffer(hashed.buffers()[1], ">u4")[hashed.offset : hashed.offset + len(hashed)].astype(np.int64) % n
            some.append((iteration // width * blocks + unit // BLOCK, (unit % BLOCK * width + iteration % width).astype("<i4")))
            rows += batch.num_rows
        if rows >= size:
            yield pack(some)
            some, rows = [], 0
    if some:
        yield pack(some)


def _slices(spark: SparkSession, cells: int, chunks: int) -> int:
    """Slices that the cells are worth: enough for all tasks, and none larger than a task sorts."""
    return max(1, min(-(-partitions(spark) // chunks), -(-cells // SLICE_LEAST)), -(-cells // SLICE_ROWS))


def _cuts(cells: DataFrame, value: str, slices: int) -> list[float]:
    """Values that cut the cells into about equal slices, fewer where values repeat."""
    if slices < 2:
        return []
    wanted = F.percentile_approx(value, F.array(*[F.lit(i / slices) for i in range(1, slices)]))
    return sorted({float(c) for c in cells.agg(wanted).first()[0] or []})


def _slice_of(value: str, cuts: Sequence[float]) -> Column:
    out = F.lit(0)
    for cut in cuts:
        out = out + (F.col(value) > F.lit(cut)).cast("int")
    return out


def _laid(tables: Sequence[DataFrame], cells: DataFrame, order: Sequence[str], slices: int, chunks: int, units: Sequence[str] = ("unit_no",)) -> DataFrame:
    """Parts (chunk, slice), one a partition: first the counts of its iterations, then the cells of its slice in order.

    Every draw table has a column of unit numbers in ``cells``; a slice is sent the counts of the units that it has.
    """
    of = lambda chunk, at: (chunk * slices + at).cast("int").alias("part")
    rest = [c for c in cells.columns if c != "slice"]
    each = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    out = cells.withColumn("_c", each).select(of(F.col("_c"), F.col("slice")), F.lit(CELLS).alias("kind"), *rest)
    for kind, (table, unit) in enumerate(zip(tables, units)):
        sent = _dealt(table, cells, unit)
        out = out.unionByName(sent.select(of(F.col("chunk"), F.col("slice")), F.lit(kind).alias("kind"), "units", "data"), allowMissingColumns=True)
    return out.repartitionById(slices * chunks, "part").sortWithinPartitions("part", "kind", *order)


def _dealt(table: DataFrame, cells: DataFrame, unit: str) -> DataFrame:
    """(chunk, slice, units, data): the counts of a block's units that a slice of the cells has."""
    seen = cells.select(F.floor(F.col(unit) / BLOCK).alias("block"), F.col("slice").cast("int").alias("slice"), F.col(unit).cast("long").alias("unit"))
    wanted = seen.distinct().groupBy("block").agg(F.sort_array(F.collect_list(F.struct("slice", "unit"))).alias("wanted"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (chunk, data) in enumerate(zip(batch.column("chunk"), batch.column("data"))):
                pairs = batch.column("wanted")[i].values
                to, unit = pairs.field("slice").to_numpy(), pairs.field("unit").to_numpy()
                raw = np.frombuffer(data.as_buffer(), np.uint8).reshape(BLOCK, -1)
                edges = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True])))
                parts = [unit[a:b] for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk.as_py()] * len(parts), pa.int64()),
                        pa.array(to[edges[:-1]], pa.int32()),
                        pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary()),
                        pa.array([raw[p % BLOCK].tobytes() for p in parts], pa.binary()),
                    ],
                    ["chunk", "slice", "units", "data"],
                )

    return table.join(wanted, "block").select("chunk", "data", "wanted").mapInArrow(deal, "chunk long, slice int, units binary, data binary")


class _Drawn:
    """The counts of one draw table that a part was sent, by unit."""

    def __init__(self, pieces: Sequence[tuple[bytes, bytes]], width: int):
        known = [np.frombuffer(u, "<i8") for u, _ in pieces]
        counts = [np.frombuffer(d, f"<u{len(d) // (len(u) * width)}").reshape(-1, width) for u, (_, d) in zip(known, pieces)]
        size = max([c.dtype for c in counts], key=lambda d: d.itemsize, default=np.dtype("u1"))
        units = np.concatenate([*known, np.array([np.iinfo(np.int64).max])])  # the last row is of units that are not drawn
        self.counts = np.zeros((len(units), width), size)
        place = np.argsort(np.argsort(units, kind="stable"), kind="stable")
        self.units, start = np.sort(units), 0
        for u, c in zip(known, counts):
            self.counts[place[start : start + len(u)]] = c
            start += len(u)

    def of(self, units: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.units, units)
        return self.counts[np.where(self.units[at] == units, at, len(self.units) - 1)].astype(float)


def _parts(batches: Iterator[pa.RecordBatch], tables: int, width: int, begin: Callable) -> Iterator[pa.RecordBatch]:
    """Runs rows as ``_laid`` leaves them through one worker a part, made by ``begin`` from its number and its counts."""
    part = here = None
    pieces: list[list] = []
    for batch in batches:
        at, kind = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
        edges = np.flatnonzero((at[1:] != at[:-1]) | (kind[1:] != kind[:-1])) + 1
        for low, high in zip([0, *edges], [*edges, len(at)]):
            if low == high:
                continue
            if at[low] != part:
                if here is not None:
                    yield here.told()
                part, here, pieces = int(at[low]), None, [[] for _ in range(tables)]
            run = batch.slice(low, high - low)
            if kind[low] < CELLS:
                pieces[kind[low]] += zip(run.column("units").to_pylist(), run.column("data").to_pylist())
                continue
            if here is None:
                here = begin(part, [_Drawn(p, width) for p in pieces])
                pieces = []
            for start in range(0, run.num_rows, 512):
                here.take(run.slice(start, 512))
    if here is not None:
        yield here.told()


def _floats(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(name).to_numpy(zero_copy_only=False).astype(float)


class _Held:
    """Rows that every iteration draws."""

    def __init__(self, part: int, drawn: _Drawn):
        self.part, self.drawn, self.total = part, drawn, 0.0

    def take(self, rows: pa.RecordBatch) -> None:
        self.total = self.total + _floats(rows, "p") @ self.drawn.of(rows.column("unit_no").to_numpy())

    def told(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([self.part], pa.int32()), pa.array([np.asarray(self.total).astype(np.int64).tobytes()], pa.binary())], ["part", "total"])


class _Middle:
    """Values of the rows at two places of every iteration, where these lie in the slice."""

    def __init__(self, first: int, drawn: _Drawn, low: np.ndarray, high: np.ndarray):
        self.first, self.drawn, self.places = first, drawn, (low, high)
        self.passed = np.zeros(len(low))
        self.found = [np.full(len(low), np.nan), np.full(len(low), np.nan)]
        self.known = [np.zeros(len(low), bool), np.zeros(len(low), bool)]

    def take(self, rows: pa.RecordBatch) -> None:
        counts = self.drawn.of(rows.column("unit_no").to_numpy()) * _floats(rows, "p")[:, None]
        until, s = np.cumsum(counts, axis=0) + self.passed, rows.column("s").to_numpy()
        for place, found, known in zip(self.places, self.found, self.known):
            here = ~known & (place >= self.passed) & (place < until[-1])
            found[here] = s[(until[:, here] <= place[here]).sum(axis=0)]
            known |= here
        self.passed = until[-1]

    def told(self) -> pa.RecordBatch:
        values = [pa.array(found, pa.float64(), mask=~known) for found, known in zip(self.found, self.known)]
        return pa.RecordBatch.from_arrays([pa.array(self.first + np.arange(len(self.passed))), *values], ["iteration", "low", "high"])


class _Sweep:
    """Won pairs, positives and negatives of every iteration over one range of scores, which come sorted."""

    def __init__(self, part: int, drawn: _Drawn):
        self.part, self.drawn = part, drawn
        width = drawn.counts.shape[1]
        self.won, self.ahead, self.behind = (np.zeros(width) for _ in range(3))
        self.score, self.up, self.down = None, np.zeros(width), np.zeros(width)  # the open run of equal scores

    def take(self, rows: pa.RecordBatch) -> None:
        s, p, q = (_floats(rows, c) for c in ("s", "p", "q"))
        weights = self.drawn.of(rows.column("unit_no").to_numpy())
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        up = np.add.reduceat(weights * p[:, None], first, axis=0)
        down = np.add.reduceat(weights * q[:, None], first, axis=0)
        if self.score == s[0]:
            up[0] += self.up
            down[0] += self.down
        else:
            self._close(self.up[None, :], self.down[None, :])
        self._close(up[:-1], down[:-1])
        self.score, self.up, self.down = s[-1], up[-1], down[-1]

    def _close(self, up: np.ndarray, down: np.ndarray) -> None:
        below = np.cumsum(down, axis=0) - down + self.behind
        self.won += (up * (below + down / 2)).sum(axis=0)
        self.ahead += up.sum(axis=0)
        self.behind += down.sum(axis=0)

    def told(self) -> pa.RecordBatch:
        self._close(self.up[None, :], self.down[None, :])
        sums = [pa.array([list(v)], pa.list_(pa.float64())) for v in (self.won, self.ahead, self.behind)]
        return pa.RecordBatch.from_arrays([pa.array([self.part], pa.int32()), *sums], ["part", "won", "p", "q"])


def _swept_auc(cells: DataFrame, weights: DataFrame, metrics: Sequence[str], iterations: int, width: int) -> DataFrame:
    """(iteration, metric, auc) from cells (unit_no, metric, s, p, q) and the draw table of their units."""
    spark, chunks = cells.sparkSession, -(-iterations // width)
    held = {r["metric"]: r["n"] for r in cells.groupBy("metric").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted, share = _slices(spark, sum(held.values()), chunks), max(1, sum(held.values()))
    at, slices, owner = F.lit(0), 0, []  # every metric has slices of its own
    for m in dict.fromkeys(metrics):
        cuts = _cuts(cells.where(F.col("metric") == m), "s", -(-wanted * held.get(m, 0) // share))
        at = F.when(F.col("metric") == m, slices + _slice_of("s", cuts)).otherwise(at)
        owner += [m] * (len(cuts) + 1)
        slices = len(owner)
    line = _laid([weights], cells.withColumn("slice", at).drop("metric"), ["s"], slices, chunks)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _parts(batches, 1, width, lambda part, drawn: _Sweep(part, drawn[0]))

    told = settle(line.mapInArrow(sweep, "part int, won array<double>, p array<double>, q array<double>"))
    low, chunk = F.col("part") % slices, F.floor(F.col("part") / slices)
    metric = F.element_at(F.array(*[F.lit(m) for m in owner]), (low + 1).cast("int"))
    each = told.select(metric.alias("metric"), low.alias("low"), chunk.alias("chunk"), F.posexplode(F.arrays_zip("won", "p", "q")).alias("at", "v")).select(
        "metric", (F.col("chunk") * width + F.col("at")).alias("iteration"), "low", "v.won", "v.p", "v.q"
    )
    # one row per range of scores: what lies before a range is below all its positives
    before = Window.partitionBy("iteration", "metric").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    each = each.where(F.col("iteration") < iterations).withColumn("_below", F.coalesce(F.sum("q").over(before), F.lit(0.0)))
    sums = each.groupBy("iteration", "metric").agg(F.sum(F.col("won") + F.col("p") * F.col("_below")).alias("_won"), F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    return sums.where("_p > 0 and _q > 0").select("iteration", "metric", (F.col("_won") / (F.col("_p") * F.col("_q"))).alias("auc"))


class _TwoWay:
    """Sums of a numerator and a denominator under the products of two draws, and how many rows of each are known."""

    def __init__(self, part: int, small: _Drawn, large: _Drawn):
        self.part, self.small, self.large, self.sums = part, small, large, 0.0

    def take(self, rows: pa.RecordBatch) -> None:
        w = self.small.of(rows.column("other_no").to_numpy()) * self.large.of(rows.column("unit_no").to_numpy())
        x, y = _floats(rows, "x"), _floats(rows, "y")
        none = [rows.column(c).is_null().to_numpy(zero_copy_only=False) for c in ("x", "y")]
        x[none[0]], y[none[1]] = 0.0, 0.0
        self.sums = self.sums + np.stack([x, y, ~none[0], ~none[1]]).astype(float) @ w

    def told(self) -> pa.RecordBatch:
        sums = [pa.array([list(v)], pa.list_(pa.float64())) for v in self.sums]
        return pa.RecordBatch.from_arrays([pa.array([self.part], pa.int32()), *sums], ["part", "x", "y", "nx", "ny"])


def bootstrap_two_way(
    cells: DataFrame, first: str, second: str, numerator: str, denominator: str, iterations: int, seed: str
) -> DataFrame:
    """Interval of sum(num)/sum(den) when ``first`` and ``second`` units are resampled independently.

    A task has a slice of the units of the side with more of them, and holds their draws and those of the units they meet.
    """
    spark = cells.sparkSession
    totals = cells.groupBy(first, second).agg(F.sum(numerator).cast("double").alias("x"), F.sum(denominator).cast("double").alias("y"))
    sides = []
    for name, tag in ((first, "a"), (second, "b")):
        table, n = numbered(cells.select(name).distinct(), name)
        sides.append((n, name, table, f"{seed}-{tag}"))
    sides.sort(key=lambda s: s[0])
    (few, small, _, _), (many, large, _, _) = sides
    width = _width(few, iterations)
    chunks = -(-iterations // width)
    slices = max(1, -(-partitions(spark) // chunks), -(-many // (TABLE_BYTES // CHUNK)))
    drawn = [draw_table(spark, n, iterations, tag, width) for n, _, _, tag in sides]
    at = totals.join(sides[0][2].withColumnRenamed("unit_no", "other_no"), small).join(sides[1][2], large)
    at = settle(at.select("unit_no", "other_no", "x", "y", (F.floor(F.col("unit_no") / BLOCK) % slices).alias("slice")))
    laid = _laid(drawn, at, [], slices, chunks, ["other_no", "unit_no"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _parts(batches, 2, width, lambda part, both: _TwoWay(part, *both))

    told = laid.mapInArrow(run, "part int, x array<double>, y array<double>, nx array<double>, ny array<double>")
    zipped = F.posexplode(F.arrays_zip("x", "y", "nx", "ny")).alias("at", "v")
    each = told.select(F.floor(F.col("part") / slices).alias("chunk"), zipped).select((F.col("chunk") * width + F.col("at")).alias("iteration"), "v.*")
    sums = each.where(F.col("iteration") < iterations).groupBy("iteration").agg(*[F.sum(c).alias(c) for c in ("x", "y", "nx", "ny")])
    known = lambda value, rows: F.when(F.col(rows) > 0, F.col(value))
    return _spread(sums.select(F.try_divide(known("x", "nx"), known("y", "ny")).alias("ratio")), ["ratio"])


def zero_event_bounds(df: DataFrame, keys: Sequence[str], event: str, unit: str) -> DataFrame:
    """One-sided 95 % upper bound 1 - 0.05^(1/n) per row and per unit; NULL when an event was seen."""
    per = df.groupBy(*keys).agg(
        F.sum(event).cast("long").alias("events"),
        F.count(F.lit(1)).alias("configurations"),
        F.count_distinct(unit).alias("units"),
    )
    none = F.col("events") == 0
    bound = lambda n: F.when(none, 1 - F.pow(F.lit(0.05), 1 / F.col(n)))
    return per.withColumn("upper_per_configuration", bound("configurations")).withColumn("upper_per_unit", bound("units"))
