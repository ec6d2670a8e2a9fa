"""Near-duplicates, components and decontamination against brute force."""

import random
from collections import Counter

import numpy as np
from helpers import edge_documents, empty, prose

from pulsemark.llm import common, decontaminate, embed_dedup, lsh_forest
from pulsemark.llm.shingles import shingle_set


def plain_groups(rows, size, num=80, den=100):
    """{id: (n, smallest id reachable)} by comparing all pairs, on plain word tuples."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        sets[i] = {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y:
                shared = len(x & y)
                if den * shared >= num * (len(x) + len(y) - shared):
                    p, q = find(ids[a]), find(ids[b])
                    root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, n, spread):
    base = prose(rng, n=80).split()
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, spread)):
            words[rng.randrange(len(words))] = "w" + str(rng.randrange(10**6))
        out.append(" ".join(words))
    return out


def check(spark, texts, words):
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(*r, 7, b"k") for r in rows], "doc_id long, text string, n_shingles int, set_key binary")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in lsh_forest.near_duplicates(docs, words=words).collect()}
    want = plain_groups(rows, words)
    assert {i: v[:2] for i, v in got.items()} == want
    assert all(kept == (i == component) for i, (_, component, kept) in got.items())


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(8)
    texts = [t for _ in range(12) for t in family(rng, 6, 5)] + [prose(rng) for _ in range(30)]
    texts += [None, "", " \t", "one two", "ONE\vtwo", "one two", "É é", "é é", texts[0].upper(), texts[0]]
    rng.shuffle(texts)
    check(spark, texts, 4)


def test_large_clusters_are_split_without_losing_links(spark, monkeypatch):
    """A family far above the block size, with members that only link with few others."""
    monkeypatch.setattr(lsh_forest, "BLOCK", 12)
    monkeypatch.setattr(lsh_forest, "DENSE", 10)
    rng = random.Random(9)
    check(spark, family(rng, 150, 6) + family(rng, 40, 1) + [prose(rng) for _ in range(20)], 5)


def test_near_duplicates_of_edge_rows(spark):
    docs = edge_documents(spark)
    got = {r.doc_id: r for r in lsh_forest.near_duplicates(docs).collect()}
    want = plain_groups([(r.doc_id, r.text) for r in docs.collect()], 5)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert lsh_forest.near_duplicates(empty(docs)).count() == 0
    with_null = docs.selectExpr("nullif(doc_id, 4) doc_id", "text")
    rows = lsh_forest.near_duplicates(with_null).collect()
    assert len(rows) == docs.count() and [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]


def test_shingle_set_sizes():
    assert len(shingle_set("a b a b a b", 4)) == 2 and len(shingle_set("a b", 4)) == 1 and len(shingle_set(None, 4)) == 0
    assert shingle_set("A b\x0bC d", 4).tolist() == shingle_set("a B c D", 4).tolist()


def test_components_equal_union_find(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(2000, 2100)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    assert got == {n: find(n) for n in list(root)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_vectors(rows, threshold):
    ok = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = (label, np.array(v, float))
    links, root = Counter(), {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(ok)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            (a, x), (b, y) = ok[i], ok[j]
            if a == b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in root}


def vectors(seed=3, n=400):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(n):
        c = centres[rng.integers(12)]
        v = c + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.25, 0.4])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3)) if i % 11 else None))
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [1.0, None] + [1.0] * 14, 1), (n + 3, [float("nan")] + [1.0] * 15, 1)]
    rows += [(n + 4, [float("inf")] * 16, 1), (n + 5, [], 1), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1), (n + 8, [-0.0, 1.0], 1), (n + 9, [0.0, 1.0], 1)]
    return rows


def test_embeddings_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, rep int, dim int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect()}
    want = plain_vectors(rows, 0.98)
    assert got == want and sum(v[0] > 0 for v in want.values()) > 100
    assert embed_dedup.near_duplicates(empty(df)).count() == 0


def looked_at(spark, n, dims):
    """(share of the pairs that tiles look at, largest number of cells of a vector) for ``n`` vectors."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, dims)) * np.linspace(2, 0.5, dims)
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    reps = embed_dedup.prepared(df, "vec_id", "embedding", "label").selectExpr("vec_id as rep", "1L as copies", "label", "dim", "vec")
    places = embed_dedup._places(reps, embed_dedup.principal_axes(reps), 0.2).cache()
    tiles = {}
    for r in embed_dedup._tiles(reps, places).collect():
        tiles.setdefault((tuple(r.path), r.kind, r.block_a, r.block_b), [0, 0])[r.side] += 1
    pairs = sum(a * (a - 1) // 2 if k[1] == 0 and k[2] == k[3] else a * b for k, (a, b) in tiles.items())
    return pairs / (n * (n - 1) / 2), places.groupBy("rep").count().agg({"count": "max"}).first()[0]


def test_a_larger_table_looks_at_a_smaller_share_of_its_pairs(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 32)
    shares = [looked_at(spark, n, 12) for n in (100, 400, 1600)]
    assert shares[0][0] > 1.5 * shares[1][0] > 1.5 * shares[2][0] and shares[2][0] < 0.2
    assert all(most <= 3**embed_dedup.AXES for _, most in shares)


def test_no_pair_above_the_threshold_is_pruned():
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(80, 40)), rng.normal(size=(90, 40))
    b[:40] = a[:40] + rng.normal(size=(40, 40)) * 0.25
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    for threshold in (0.5, 0.9, 0.98):
        found = set(zip(*(x.tolist() for x in embed_dedup.candidates(a, b, threshold))))
        assert set(zip(*(x.tolist() for x in np.nonzero(a @ b.T >= threshold)))) <= found


def plain_windows(docs, items, width=5, threshold=0.8):
    import re

    def words(t):
        return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    def count(w, k):
        return Counter(tuple(w[p : p + k]) for p in range(len(w) - k + 1))

    out = {}
    for d, t in docs:
        w = words(t)
        for i, x in items:
            y = words(x)
            if not y:
                continue
            k = min(width, len(y))
            own = count(y, k)
            for s in range(max(0, len(w) - len(y)) + 1):
                there = count(w[s : s + len(y)], k)
                shared = sum((own & there).values())
                total = sum(own.values()) + sum(there.values()) - shared
                if shared and shared / total >= threshold and (d, i) not in out or shared and shared / total > out.get((d, i), (0, 9))[1]:
                    if shared / total >= threshold:
                        out[d, i] = (s, shared / total)
    return out


def test_decontamination_equals_every_window(spark):
    rng = random.Random(12)
    items = [(k, prose(rng, n=rng.choice([3, 5, 8, 20, 41]))) for k in range(12)]
    items += [(50, "rep rep rep rep rep rep rep rep"), (51, None), (52, "!!"), (53, items[3][1])]
    docs = [(k, prose(rng, n=rng.randint(1, 120))) for k in range(30)]
    for k, (i, t) in enumerate(items[:12]):
        w = t.split()
        if len(w) > 30:
            w[rng.choice([0, 1, -1, -2])] = "edit"
        docs.append((100 + k, f"{prose(rng, n=15)}; {' '.join(w).upper()}! {prose(rng, n=9)}"))
        docs.append((200 + k, " ".join(w[:-1])))
    docs += [(300, None), (301, ""), (302, "rep " * 7), (303, "rep " * 40), (304, items[5][1])]
    d = spark.createDataFrame([(*x, 1, "b") for x in docs], "doc_id long, text string, n int, block string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in decontaminate.find(d, i).collect()}
    want = plain_windows(docs, items)
    assert got.keys() == want.keys() and len(want) > 15
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    for a, b in ((empty(d), i), (d, empty(i))):
        assert decontaminate.find(a, b).count() == 0


def test_radius_is_guaranteed_by_the_blocks():
    rng = random.Random(13)
    for _ in range(500):
        apart = sum(1 << b for b in rng.sample(range(decontaminate.BITS), decontaminate.RADIUS))
        step = decontaminate.BLOCK_BITS
        assert any(bin((apart >> (step * k)) & ((1 << step) - 1)).count("1") <= decontaminate.FLIPS for k in range(decontaminate.BLOCKS))
