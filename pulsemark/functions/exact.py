"""Bits of the studied experiments: seeds from SHA-256, draws from NumPy's PCG64 generator.

A chip is the sign of one uniform draw, and a draw is one output of the generator, so a sequence is cut into stretches
that start by jumping ahead: a key of any length spreads over tasks. A block permutation is one shuffle of all blocks of a
capacity and can't be cut; a task holds one capacity's permutation at a time, eight bytes a block.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STRETCH = 1 << 16
ROWS = 1 << 16  # rows given out at a time


def pn_seed(key: str | int) -> int:
    """32-bit seed of a chip key: the first four digest bytes, big-endian."""
    return int.from_bytes(hashlib.sha256(str(key).encode("utf-8")).digest()[:4], "big")


def layout_seed(layout_key: str | int) -> int:
    """64-bit seed of a layout key, of its own domain."""
    return int.from_bytes(hashlib.sha256(f"{layout_key}|payload-layout-v1".encode()).digest()[:8], "big")


def chips(key: str | int, start: int, stop: int) -> np.ndarray:
    """Chips ``start`` to ``stop`` of a key: -1 for a draw below one half, else +1."""
    bits = np.random.PCG64(pn_seed(key))
    bits.advance(start)
    return np.where(np.random.Generator(bits).random(stop - start) < 0.5, -1, 1).astype(np.int32)


def block_order(layout_key: str | int, capacity: int) -> np.ndarray:
    """All blocks of a capacity in the order in which bits take them."""
    return np.random.default_rng(layout_seed(layout_key)).permutation(capacity).astype(np.int64)


def chip_table(keys: DataFrame, key: str, length: int) -> DataFrame:
    """(key, chip_idx, chip) for chip_idx 0..length-1 of every distinct key."""
    if length <= 0:
        raise ValueError(f"a sequence has {length} chips")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"), F.lit(STRETCH).cast("long"))).alias("start")
    todo = keys.select(key).where(F.col(key).isNotNull()).distinct().select(key, F.col(key).cast("string").alias("_text"), starts)
    kind = keys.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for value, text, start in zip(batch[key], batch["_text"], batch["start"].tolist()):
                stop = min(start + STRETCH, length)
                yield pd.DataFrame({key: [value] * (stop - start), "chip_idx": np.arange(start, stop), "chip": chips(text, start, stop)})

    # one row makes up to STRETCH, so rows are dealt out before
    return todo.repartition(key, "start").mapInPandas(run, f"`{key}` {kind}, chip_idx long, chip int")


def placements(capacities: DataFrame, layout_key: str) -> DataFrame:
    """(capacity, block_idx, bit_idx) of every distinct capacity; a shorter message takes a subset of a longer one's blocks."""
    todo = capacities.select(F.col("capacity").cast("long").alias("capacity")).where("capacity > 0").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for capacity in batch["capacity"].tolist():
                order = block_order(layout_key, capacity)
                for at in range(0, capacity, ROWS):
                    part = order[at : at + ROWS]
                    yield pd.DataFrame({"capacity": np.full(len(part), capacity), "block_idx": part, "bit_idx": np.arange(at, at + len(part))})

    return todo.repartition("capacity").mapInPandas(run, "capacity long, block_idx long, bit_idx long")
