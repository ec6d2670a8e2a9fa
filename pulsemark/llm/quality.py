"""Quality classifier by supervised subword embeddings.

A document is the mean of learned vectors, one per hash bucket of its words and of the character n-grams inside its
words; a softmax layer over that mean gives class probabilities. Vectors and layer are trained by stochastic gradient
descent in numpy, on labelled rows only.

Training takes at most TRAIN_ROWS labelled rows, those with the smallest id hash: a fixed bound, so that the one task
that trains holds a bounded number of documents whatever the table. Feature extraction and scoring run everywhere,
over whole texts. Only the model (BUCKETS x classes numbers) passes through the driver.

Edge cases: null and blank texts have no features and score by the layer's bias alone; rows with a null label teach
nothing; with no labelled rows every score is 0.5; repeated label rows count each time they are labelled; other
columns are ignored and input rows are kept one to one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsemark.llm.common import mix, runs, sliced

BUCKETS = 1 << 16
DIM = 8
TRAIN_ROWS = 4000
EPOCHS = 6
RATE = 0.5
NGRAMS = (2, 3, 4)
_BLANK = np.uint64(32)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every word and of every n-gram within a padded word, case kept."""
    if not text:
        return np.zeros(0, np.int64)
    words = text.split()
    if not words:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh3_64_intdigest
    parts = [np.fromiter(map(digest, words), np.uint64, len(words))]
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    blank = points == _BLANK
    rolled = points.copy()
    for n in range(2, max(NGRAMS) + 1):
        rolled = rolled[:-1] * _STEP + points[n - 1 :] if len(rolled) > 1 else rolled[:0]
        if n in NGRAMS and len(rolled):
            inside = np.ones(len(rolled), bool)
            for k in range(1, n - 1):  # a blank may only pad an n-gram
                inside &= ~blank[k : k + len(rolled)]
            parts.append(rolled[inside] + np.uint64(n))
    return (mix(np.concatenate(parts)) % np.uint64(buckets)).astype(np.int64)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = EPOCHS, rate: float = RATE) -> np.ndarray:
    """(BUCKETS + 1) x classes: what each bucket adds to the class scores, and the bias in the last row.

    ``bags`` holds (buckets, shares) per document. The embedding times the output layer is folded into one table at
    the end, which scores the same.
    """
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    layer = np.zeros((classes, DIM))
    bias = np.zeros(classes)
    steps, total = 0, max(1, epochs * len(bags))
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            step = rate * (1 - steps / total)
            steps += 1
            ids, share = bags[i]
            hidden = share @ vectors[ids] if len(ids) else np.zeros(DIM)
            score = layer @ hidden + bias
            p = np.exp(score - score.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            back = p @ layer
            layer -= step * np.outer(p, hidden)
            bias -= 0.1 * step * p
            if len(ids):
                # the mean spreads the gradient thin: scale it by the number of features, as a sum would have it
                vectors[ids] -= step * np.outer(share, back) * min(len(ids), 50)
    return np.vstack([vectors @ layer.T, bias])


def learn(labelled: DataFrame, classes: int = 2, max_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Train on rows (doc_id, text, label); the caller bounds them by ``max_rows`` through ``sample``."""

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, shares = [], []
            for text in batch.column(2):
                found = features(text.as_py())
                keys, counts = runs(np.sort(found))
                ids.append(keys.astype(np.int32))
                shares.append((counts / max(1, len(found))).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
                ["doc_id", "label", "ids", "shares"],
            )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for k, y, i, s in zip(*(batch.column(c) for c in range(4))):
                rows.append((k.as_py(), y.as_py(), i.values.to_numpy(), s.values.to_numpy().astype(np.float64)))
        if rows:
            rows.sort(key=lambda r: (r[0], r[1]))
            model = train([(r[2], r[3]) for r in rows], np.array([r[1] for r in rows]), classes)
            yield pa.RecordBatch.from_arrays([pa.array([model.astype("<f4").tobytes()], pa.binary())], ["model"])

    rows = labelled.select("doc_id", F.col("label").cast("int"), F.col("text").cast("string"))
    bags = rows.mapInArrow(bag, "doc_id long, label int, ids array<int>, shares array<float>")
    made = bags.repartition(1).mapInArrow(fit, "model binary").collect()
    if not made:
        return np.zeros((BUCKETS + 1, classes), np.float32)
    return np.frombuffer(bytes(made[0].model), "<f4").reshape(-1, classes)


def sample(labels: DataFrame, docs: DataFrame, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, label, text) of at most ``max_rows`` labelled rows (doc_id, label), those with the smallest id hash."""
    chosen = labels.where("label is not null and doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "label")), "doc_id")


def scores(docs: DataFrame, model: np.ndarray, keep: list[str], text_column: str = "text", target: int = 1) -> DataFrame:
    """``keep`` columns plus score: the probability of class ``target``."""
    table, bias = np.ascontiguousarray(model[:-1]), model[-1].astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for text in batch.column(batch.num_columns - 1):
                found = features(text.as_py())
                z = bias + (table[found].mean(axis=0, dtype=np.float64) if len(found) else 0.0)
                e = np.exp(z - z.max())
                out.append(float(e[target] / e.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], [*keep, "score"])

    picked = docs.select(*[F.col(c) for c in keep], F.col(text_column).cast("string").alias("_text"))
    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in keep)
    return picked.mapInArrow(run, f"{schema}, score double")
