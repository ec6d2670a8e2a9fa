"""Language identification by rank-order profiles.

A language profile is the ranked list of the most frequent letter n-grams (1 to 3 letters, words padded with a blank)
of that language's training rows. A document's own ranked list is compared with every profile by out-of-place
distance: the sum of rank differences, an n-gram missing from the profile costing the list's length. The nearest
profile wins, ties going to the smaller language name. The score is the relative lead over the runner-up,
1 - nearest / second (1 - nearest / worst possible when there is one profile only).

N-grams are counted over every training row, per task first (the distinct n-grams of a language) and then summed in
Spark; only the profiles
(languages x PROFILE rows) reach the driver. Prediction is one pass without a shuffle.

Edge cases: null, empty or letterless text is ``und`` with score 0; so is every text when nothing was learnt. Rows
without a language teach nothing. A null id counts as the empty text in the split. Other columns are ignored, input
rows are kept one to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsemark.llm.common import runs, sliced

PROFILE = 400
HELD_GRAMS = 1_000_000  # n-grams a task holds before it folds them into its counts
UNKNOWN = "und"
_SPACE = 1
_SHIFT = np.uint64(21)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point: itself if it is a letter, else the blank."""
    at = np.arange(0x110000, dtype=np.uint64)
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(letter, at, np.uint64(_SPACE))


def grams(text: str | None) -> np.ndarray:
    """Keys of all n-grams of a text, sorted; a run of other characters is one blank."""
    if not text:
        return np.zeros(0, np.uint64)
    points = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    points = np.concatenate(([np.uint64(_SPACE)], points, [np.uint64(_SPACE)]))
    blank = points == _SPACE
    points = points[~(blank & np.concatenate(([False], blank[:-1])))]
    if len(points) < 3:
        return np.zeros(0, np.uint64)
    one = points[points != _SPACE]
    two = (points[:-1] << _SHIFT) | points[1:]
    inner = points[1:-1] != _SPACE  # no blank inside: an n-gram belongs to one word
    three = ((two[:-1] << _SHIFT) | points[2:])[inner]
    out = np.concatenate((one, two, three))
    out.sort()
    return out


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent keys, most frequent first, ties by key."""
    if len(keys) > size:
        cut = np.partition(counts, len(counts) - size)[len(counts) - size]
        keys, counts = keys[counts >= cut], counts[counts >= cut]
    return keys[np.lexsort((keys, -counts))[:size]]


def learn(rows: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles from rows (text, lang) with a non-null language; every row is counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        held = 0

        def fold():
            nonlocal held
            for lang, parts in waiting.items():
                keys, counts = runs(np.sort(np.concatenate(parts)))
                if lang in totals:
                    both = np.concatenate((totals[lang][0], keys))
                    each = np.concatenate((totals[lang][1], counts))
                    order = np.argsort(both, kind="stable")
                    keys, sizes = runs(both[order])
                    counts = np.add.reduceat(each[order], np.cumsum(sizes) - sizes) if len(keys) else each
                totals[lang] = (keys, counts)
            waiting.clear()
            held = 0

        for batch in sliced(batches):
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                found = grams(text.as_py())
                waiting.setdefault(lang, []).append(found)
                held += len(found)
                if held > HELD_GRAMS:
                    fold()
        fold()
        for lang, (keys, counts) in totals.items():
            if len(keys):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"]
                )

    counted = rows.where("lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    totals = counted.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = totals.withColumn("place", place).where(F.col("place") <= size).orderBy("lang", "place")
    out: dict[str, list[int]] = {}
    for row in top.select("lang", "gram").toLocalIterator():
        out.setdefault(row.lang, []).append(row.gram)
    return {lang: np.array(found, np.uint64) for lang, found in sorted(out.items())}


def predict(
    docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE, text_column: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``keep`` columns (default all) plus lang_pred, score, distance (mean out-of-place share, 0 to 1)."""
    names = docs.columns if keep is None else keep
    names = [n for n in names if n not in ("lang_pred", "score", "distance")]
    langs = list(profiles)
    tables = []
    for lang in langs:
        order = np.argsort(profiles[lang], kind="stable")
        tables.append((profiles[lang][order], order.astype(np.int64)))

    def judge(text: str | None) -> tuple[str, float, float]:
        keys, counts = runs(grams(text))
        if not len(keys) or not langs:
            return UNKNOWN, 0.0, 1.0
        own = ranked(keys, counts, size)
        places = np.arange(len(own))
        costs = []
        for keys_sorted, at in tables:
            found = np.minimum(np.searchsorted(keys_sorted, own), len(keys_sorted) - 1)
            known = keys_sorted[found] == own
            costs.append(int(np.where(known, np.abs(at[found] - places), size).sum()))
        best = min(range(len(langs)), key=lambda i: (costs[i], langs[i]))
        worst = size * len(own)
        second = min((c for i, c in enumerate(costs) if i != best), default=worst)
        return langs[best], (1.0 - costs[best] / second if second else 0.0), costs[best] / worst

    kept = len(names)  # the text is sent once, whether it is kept or not
    at = names.index(text_column) if text_column in names else kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [judge(text.as_py()) for text in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:kept],
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                    pa.array([x[2] for x in found], pa.float64()),
                ],
                [*names, "lang_pred", "score", "distance"],
            )

    extra = [] if at < kept else [F.col(text_column).cast("string").alias("_text")]
    picked = docs.select(*[F.col(n) for n in names], *extra)
    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return picked.mapInArrow(run, f"{schema}{', ' if names else ''}lang_pred string, score double, distance double")
