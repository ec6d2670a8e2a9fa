"""Reading, staging and streaming helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsemark.session import ensure_checkpoint_dir

BROADCAST_ROWS = 1_000_000  # a (key, number) table of at most so many rows, some 30 MB, may be broadcast


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage ends there."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str, small_rows: int | None = None) -> DataFrame:
    """Join that broadcasts ``small`` only when it is counted and within BROADCAST_ROWS; else both sides shuffle."""
    n = small.count() if small_rows is None else small_rows
    return big.join(F.broadcast(small) if n <= BROADCAST_ROWS else small, on, how)


def crc_remainder(column: str, parts: int) -> Column:
    """crc32 of an id as text modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b: long): component is the smallest node reachable.

    Large-star and small-star rounds until nothing changes; every round is written to the shared folder.
    Each step is a map-side combined minimum per node and a join back, so that AQE can split a hot node.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    pairs = staged(pairs, name)
    mark = _mark(pairs)
    while mark[0]:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        pairs = staged(small.union(lower.select("a", F.col("m").alias("b"))).distinct(), name)
        now = _mark(pairs)
        if now == mark:
            break
        mark = now
    roots = pairs.select(F.col("b").alias("node")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


def _mark(pairs: DataFrame) -> tuple:
    """Row count and an order-free digest of an edge table, for the test of convergence."""
    digest = F.xxhash64("a", "b")
    row = pairs.agg(F.count(F.lit(1)), F.sum(F.shiftrightunsigned(digest, 40)), F.bit_xor(digest)).first()
    return tuple(row)


class Union:
    """Disjoint sets over 0..n-1 whose root is always the smallest member."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.size = [1] * n
        self.sets = n
        self._largest = 0

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        root = min(x, y)
        self.parent[max(x, y)] = root
        self.size[root] = self.size[x] + self.size[y]
        self.sets -= 1
        if self.size[root] >= self.size[self.find(self._largest)]:
            self._largest = root
        return True

    def largest(self) -> int:
        """Root of a largest set."""
        return self.find(self._largest)


def by_group(
    keys: list[str], solve: Callable[[pa.Table], Iterator[pa.RecordBatch]]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow body over rows sorted by ``keys``: calls ``solve`` once with the rows of each group.

    One group is held at a time; callers bound the groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            marks = list(zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]))
            start = 0
            for i, mark in enumerate(marks):
                if mark != last:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if held:
                        yield from solve(pa.Table.from_batches(held))
                        held = []
                    start, last = i, mark
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a worker holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (wrapping unsigned arithmetic)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and their counts."""
    if not len(sorted_values):
        return sorted_values, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return sorted_values[first], np.diff(np.append(first, len(sorted_values)))
