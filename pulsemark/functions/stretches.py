"""Batches of whole islands for the few sequential steps that run in Arrow workers."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def breaks(rows: pd.DataFrame) -> np.ndarray:
    """True where a row belongs to another (series, island) than the row before it."""
    series, island = rows["series_id"].values, rows["island"].values
    return (series[1:] != series[:-1]) | (island[1:] != island[:-1])


def whole_islands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Regroup sorted batches so that no island is cut; only the open island is held back."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if batch.empty:
            continue
        first = (batch["series_id"].iloc[0], batch["island"].iloc[0])
        if held and first != last:
            yield pd.concat(held, ignore_index=True)
            held = []
        last = (batch["series_id"].iloc[-1], batch["island"].iloc[-1])
        ends = np.flatnonzero(breaks(batch)) + 1
        if len(ends):
            held.append(batch.iloc[: ends[-1]])
            yield pd.concat(held, ignore_index=True)
            held = [batch.iloc[ends[-1] :]]
        else:
            held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)
