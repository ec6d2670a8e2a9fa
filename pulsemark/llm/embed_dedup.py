"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are turned into the basis of their principal components, largest first. Two linked vectors differ by at
most WIDTH(threshold) = sqrt(2 - 2 threshold), so the leading coordinates cut each label's vectors into cells of that
side: a cell of more than BLOCK vectors is cut along the next axis, up to AXES of them. A vector lives in its own cell and
visits the other cells whose box lies within that distance of it; of two cells only the later one is visited, so a pair
meets once. Cells are dealt over blocks of at most some BLOCK vectors, and a pair of blocks is one tile. Within a tile,
products are summed over leading coordinates first. What the remaining coordinates can still add is bounded by the
product of the two suffix norms (Cauchy-Schwarz), and a pair whose bound stays below the threshold is dropped there.
Survivors are decided by the cosine of the original vectors in double precision.

Scale: exact copies fold into one row with a count first. The more vectors a label has, the more axes cut it, so the
share of its pairs that tiles look at falls; how many cells a vector can visit does not depend on the table. A tile
returns link counts and a spanning forest, never its pairs. The moment matrix (dimension squared numbers) is all that
reaches the driver.

Edge cases: a null label, and vectors that are null, zero, or hold null or non-finite components link with nothing
and keep their own id; vectors of different length are never compared; ties and repeated rows take the smallest id;
an empty table gives an empty result; other columns are ignored. The id must be a unique
integer; rows with a null id are kept, link with nothing and have a null component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsemark.llm.common import Union, by_group, components, sized_join, staged
from pulsemark.session import partitions

THRESHOLD = 0.98
BLOCK = 2048
AXES = 6  # leading coordinates that may cut cells
LEAD = 8  # coordinates summed before the first bound
SLACK = 1e-6  # room for rounding in the bounds; the final cosine has none


def _usable(vector: list | None) -> np.ndarray | None:
    if not vector or any(x is None for x in vector):
        return None
    out = np.array(vector, np.float64)
    if not np.isfinite(out).all() or not out.any():
        return None
    return out


def prepared(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """vec_id, label, dim, class_key (digest of label and vector; null where nothing can link), vec (doubles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, dims, vecs = [], [], []
            for label, vector in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                v = None if label is None else _usable(vector)
                if v is None:
                    keys.append(None), dims.append(None), vecs.append(None)
                else:
                    v = v + 0.0  # no negative zeros
                    keys.append(hashlib.blake2b(label.encode() + b"\0" + v.tobytes(), digest_size=16).digest())
                    dims.append(len(v)), vecs.append(v.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())],
                ["vec_id", "label", "dim", "class_key", "vec"],
            )

    picked = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("string").alias("label"), F.col(vector_column).cast("array<double>").alias("v")
    )
    return picked.mapInArrow(run, "vec_id long, label string, dim int, class_key binary, vec binary")


def principal_axes(reps: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length, the axes (rows) of the unit vectors' second moments, largest variance first."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for d in np.unique(dims):
                rows = np.stack([np.frombuffer(v.as_py()) for v, k in zip(batch.column(1), dims) if k == d])
                rows = rows / np.abs(rows).max(axis=1, keepdims=True)
                rows /= np.linalg.norm(rows, axis=1, keepdims=True)
                sums[d] = sums.get(d, 0.0) + rows.T @ rows
        for d, m in sums.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), d, np.int32)), pa.array((i * d + j).astype(np.int64)), pa.array(m[i, j])], ["dim", "at", "m"]
            )

    summed = reps.select("dim", "vec").mapInArrow(moments, "dim int, at long, m double").groupBy("dim", "at").agg(F.sum("m").alias("m"))
    out: dict[int, np.ndarray] = {}
    for row in summed.toLocalIterator():
        full = out.setdefault(row.dim, np.zeros((row.dim, row.dim)))
        i, j = divmod(row["at"], row.dim)
        full[i, j] = full[j, i] = row.m
    return {d: np.linalg.eigh(m)[1][:, ::-1].T.copy() for d, m in out.items()}


def _leading(reps: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """label, dim, rep and x: the first AXES principal coordinates of the unit vector (fewer for short vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for v in batch.column(3):
                raw = np.frombuffer(v.as_py())
                found.append((axes[len(raw)][:AXES] @ _unit(raw[None, :])[0]).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.float64()))], ["label", "dim", "rep", "x"])

    return reps.select("label", "dim", "rep", "vec").mapInArrow(run, "label string, dim int, rep long, x array<double>")


def _places(reps: DataFrame, axes: dict[int, np.ndarray], width: float) -> DataFrame:
    """label, dim, rep, path, home: the cell of every vector (home) and the cells within ``width`` of it.

    A cell is the path of its steps along the axes; cells of at most BLOCK vectors have shorter paths.
    """
    group = ["label", "dim", "path"]
    rows = staged(
        _leading(reps, axes).select("*", F.array().cast("array<int>").alias("path"), F.lit(0.0).alias("far"), F.lit(True).alias("home")), "places"
    )
    for axis in range(AXES):
        crowded = rows.where("home").groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > BLOCK) & (F.col("dim") > axis) & (F.size("path") == axis))
        crowded = staged(crowded.select(*group, F.lit(True).alias("cut")), "crowded")
        n = crowded.count()
        if n == 0:
            break
        x = F.col("x")[axis]
        step = F.floor(x / width).cast("int")
        ways = [(-1, x - step * width), (0, F.lit(0.0)), (1, (step + 1) * width - x)]
        moves = F.array(
            *[
                F.struct(
                    F.concat("path", F.array(step + by)).alias("path"),
                    (F.col("far") + gap * gap).alias("far"),
                    (F.col("home") & F.lit(by == 0)).alias("home"),
                )
                for by, gap in ways
            ]
        )
        moves = F.filter(moves, lambda m: m["far"] <= width * width)
        stay = F.array(F.struct("path", "far", "home"))
        joined = sized_join(rows, crowded, group, "left", n)
        rows = staged(joined.select("label", "dim", "rep", "x", F.explode(F.when(F.col("cut"), moves).otherwise(stay)).alias("m")).select("label", "dim", "rep", "x", "m.*"), "places")
    return rows.select(*group, "rep", "home")


def candidates(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose product can reach ``threshold``, for unit rows in principal order."""
    dim = a.shape[1]
    cuts = [0]
    while cuts[-1] < dim:
        cuts.append(min(dim, max(LEAD, 2 * cuts[-1])))
    lead = cuts[1]
    rest_a, rest_b = np.sqrt(np.maximum(0, 1 - (a[:, :lead] ** 2).sum(1))), np.sqrt(np.maximum(0, 1 - (b[:, :lead] ** 2).sum(1)))
    part = a[:, :lead] @ b[:, :lead].T
    i, j = np.nonzero(part + np.outer(rest_a, rest_b) >= threshold - SLACK)
    sums = part[i, j]
    for low, high in zip(cuts[1:], cuts[2:]):
        sums = sums + np.einsum("ij,ij->i", a[i, low:high], b[j, low:high])
        rest_a = np.sqrt((a[:, high:] ** 2).sum(1))
        rest_b = np.sqrt((b[:, high:] ** 2).sum(1))
        alive = sums + rest_a[i] * rest_b[j] >= threshold - SLACK
        i, j, sums = i[alive], j[alive], sums[alive]
        if not len(i):
            break
    return i, j


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _tile_solver(axes: dict[int, np.ndarray], threshold: float):
    """One tile: rows (rep, copies, side, vec) -> (a, b, n): a's linked vectors here (b null), or a forest link (n null)."""

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        side = rows.column("side").to_numpy()
        reps, copies = rows.column("rep").to_numpy(), rows.column("copies").to_numpy()
        raw = np.stack([np.frombuffer(v.as_py()) for v in rows.column("vec")])
        unit = _unit(raw)
        turned = unit @ axes[raw.shape[1]].T
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        own = rows.column("kind")[0].as_py() == 0 and rows.column("block_a")[0] == rows.column("block_b")[0]  # a block against itself
        if own:
            right = left
        counts = np.zeros(len(reps), np.int64)
        forest = Union(len(reps))
        for low in range(0, len(left), 256):
            here = left[low : low + 256]
            i, j = candidates(turned[here], turned[right], threshold)
            i, j = here[i], right[j]
            keep = i < j if own else np.ones(len(i), bool)
            i, j = i[keep], j[keep]
            cosine = np.einsum("ij,ij->i", unit[i], unit[j])
            near = np.abs(cosine - threshold) < 1e-9
            if near.any():  # at the threshold: the plain formula on the vectors as given
                x, y = raw[i[near]], raw[j[near]]
                cosine[near] = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            i, j = i[cosine >= threshold], j[cosine >= threshold]
            np.add.at(counts, i, copies[j])
            np.add.at(counts, j, copies[i])
            for x, y in zip(i.tolist(), j.tolist()):
                if forest.sets == 1:
                    break
                forest.join(x, y)
        seen = np.flatnonzero(counts)
        links = [(int(reps[x]), int(reps[forest.find(x)])) for x in range(len(reps)) if forest.find(x) != x]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(x) for x in reps[seen]] + [x for x, _ in links], pa.int64()),
                pa.array([None] * len(seen) + [y for _, y in links], pa.int64()),
                pa.array([int(x) for x in counts[seen]] + [None] * len(links), pa.int64()),
            ],
            ["a", "b", "n"],
        )

    return solve


def _tiles(reps: DataFrame, places: DataFrame) -> DataFrame:
    """Rows dealt to tiles: key columns (label, dim, path, kind, block_a, block_b) and side.

    Kind 0 holds two blocks of a cell's own vectors, kind 1 a block of these and a block of visitors.
    """
    group = ["label", "dim", "path"]
    homes = places.where("home").select("rep", F.col("path").alias("own"))
    met = places.join(homes, "rep").where(F.col("home") | (F.col("path") > F.col("own"))).select(*group, "rep", "home")
    met = staged(met, "met")
    size = F.sum(F.col("home").cast("long")), F.sum((~F.col("home")).cast("long"))
    sizes = met.groupBy(*group).agg(*[F.ceil(n / BLOCK).cast("int").alias(name) for n, name in zip(size, ("blocks", "guests"))]).where("blocks > 0")
    sizes = staged(sizes, "cells")
    dealt = sized_join(met, sizes, group, "inner")
    many = F.when(F.col("home"), F.col("blocks")).otherwise(F.col("guests"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), many.cast("long")).cast("int"))

    def span(low, high, kind: int, first: bool, side: int):
        """Tiles with the blocks low..high-1 of the other part, as structs; ``first`` says which place the own block takes."""
        own = F.col("block")
        return F.transform(
            F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>")),
            lambda k: F.struct(F.lit(kind).alias("kind"), (own if first else k).alias("block_a"), (k if first else own).alias("block_b"), F.lit(side).alias("side")),
        )

    zero, block = F.lit(0), F.col("block")
    as_home = F.concat(
        span(block, F.col("blocks"), 0, True, 0),  # the block itself and later blocks of the cell
        span(zero, block, 0, False, 1),  # earlier blocks of the cell
        span(zero, F.col("guests"), 1, True, 0),
    )
    as_guest = span(zero, F.col("blocks"), 1, False, 1)
    spread = dealt.select(*group, "rep", F.explode(F.when(F.col("home"), as_home).otherwise(as_guest)).alias("p")).select(*group, "p.*", "rep")
    return spread.join(reps.select("rep", "copies", "vec"), "rep")


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label"
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row: links are cosines of at least ``threshold`` under one label."""
    rows = staged(prepared(vectors, id_column, vector_column, label_column), "vectors")
    reps = rows.where("class_key is not null and vec_id is not null").groupBy("class_key").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec")
    )
    reps = staged(reps, "classes")
    axes = principal_axes(reps)
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    keys = ["label", "dim", "path", "kind", "block_a", "block_b"]
    dealt = _tiles(reps, _places(reps, axes, width)).repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    found = staged(dealt.mapInArrow(by_group(keys, _tile_solver(axes, threshold)), "a long, b long, n long"), "tiles")
    counted = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    linked = components(found.where("b is not null").select("a", "b"), "vectors-cc").withColumnRenamed("node", "rep")
    listed = staged(
        reps.select("class_key", "rep", "copies").join(counted, "rep", "left").join(linked, "rep", "left").where("copies > 1 or n > 0").select(
            "class_key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component")
        ),
        "listed",
    )
    out = sized_join(rows.select("vec_id", "class_key"), listed, "class_key", "left")
    named = F.col("vec_id").isNotNull()
    component = F.when(named, F.coalesce("component", "vec_id"))
    links = F.when(named, F.coalesce("links", F.lit(0))).otherwise(0).cast("long")
    return out.select("vec_id", links.alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
