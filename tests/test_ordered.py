"""Ordered primitives: the split path must equal the plain window path."""

import random

import numpy as np
from pyspark.sql import functions as F

from pulsemark.functions.ordered import hot_keys, with_neighbours, with_order, with_position
from pulsemark.functions.ranks import exact_quantiles, rank_auc, with_average_rank


def _rows(n=400):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.6 else rng.choice("abc")
        rows.append((key, rng.randrange(10_000), i, rng.randrange(9), None if rng.random() < 0.5 else rng.randrange(50)))
    return rows


def test_split_equals_plain(spark):
    df = spark.createDataFrame(_rows(), "k string, t long, i long, v long, m long")
    args = dict(
        prefix={"run": F.col("v")},
        prev={"pv": F.col("m")},
        nxt={"nv": F.col("m")},
        prev_valid={"pm": F.col("m")},
        next_valid={"nm": F.col("m")},
        total={"all_v": F.col("v")},
    )
    plain = with_order(df, ["k"], ["t", "i"], hot=None, **args)
    hot = hot_keys(df, ["k"], 60)
    assert {r.k for r in hot.collect()} == {"hot"}
    split = with_order(df, ["k"], ["t", "i"], hot=hot, **args)
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))


def test_global_position(spark):
    df = spark.createDataFrame(_rows(), "k string, t long, i long, v long, m long")
    got = [r.p for r in with_position(df, [], ["t", "i"], "p").orderBy("t", "i").collect()]
    assert got == list(range(400))


def test_neighbours_cross_stretch_edges(spark):
    df = spark.range(50).select(F.lit("s").alias("s"), F.col("id").alias("i"), (F.col("id") * 3).alias("x"))
    got = with_neighbours(df, ["s"], "i", {"a": ("x", 1), "b": ("x", 4)}, chunk=8).orderBy("i").collect()
    assert [r.a for r in got] == [None] + [3 * i for i in range(49)]
    assert [r.b for r in got] == [None] * 4 + [3 * i for i in range(46)]
    assert len(got) == 50


def test_quantiles_ranks_auc(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 30, 301).astype(float)
    y = rng.integers(0, 2, 301)
    df = spark.createDataFrame([(int(i % 2), float(v), int(l)) for i, (v, l) in enumerate(zip(x, y))], "g int, x double, y int")
    probs = {"q10": 0.1, "q50": 0.5, "q90": 0.9}
    row = exact_quantiles(df, [], "x", probs).first()
    assert np.allclose([row.q10, row.q50, row.q90], np.quantile(x, [0.1, 0.5, 0.9]))
    for r in exact_quantiles(df, ["g"], "x", probs).collect():
        assert np.allclose([r.q10, r.q50, r.q90], np.quantile(x[r.g :: 2], [0.1, 0.5, 0.9]))
    pos, neg = x[y == 1], x[y == 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert abs(rank_auc(df, [], "x", "y").first().auc - want) < 1e-12
    import pandas as pd

    got = with_average_rank(df, ["g"], "x", "r").toPandas()
    want = got.groupby("g")["x"].rank(method="average")
    assert np.allclose(got["r"], want)
