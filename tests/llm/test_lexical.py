"""Ranked search against scores of every document computed one by one."""

import math
import random
import re
from collections import Counter

from helpers import edge_documents, empty

from pulsemark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    held = [(doc_id, Counter(t), len(t)) for doc_id, t in ((d, terms(x)) for d, x in docs) if t]
    total, length = len(held), sum(n for _, _, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c, n in held:
            m = 75 + 25 * n * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 12 * m)) for w in terms(text) if w in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        for rank, (score, _, doc_id) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:20], 1):
            out.append((item_id, rank, doc_id, -score))
    return out


def tables(spark, n=400):
    rng = random.Random(6)
    words = ["Alpha", "beta", "Été", "x1", "gamma", "delta", "漢字", "BETA", "epsilon", "zeta", "eta", "the"] + [f"w{i}" for i in range(60)]
    text = lambda k: rng.choice([" ", "-", "\n", "_"]).join(rng.choice(words[: rng.choice([4, 12, 72])]) for _ in range(k))
    docs = [(i % 380, text(rng.choice([1, 5, 9, 9, 40, 200]))) for i in range(n)] + [(None, "alpha beta gamma"), (500, None), (501, ""), (502, "--- !!"), (503, "beta " * 20_000)]
    docs += [(600 + i, "alpha beta gamma") for i in range(30)]  # ties beyond the twenty
    items = [(k % 9, text(rng.randint(1, 12))) for k in range(10)] + [(20, None), (21, "nowhere"), (22, "w1 w1 w1 w2"), (None, "alpha beta gamma")]
    return docs, items, spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string"), spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, rank int")


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_ranking_equals_scores_of_every_document(spark):
    docs, items, d, i = tables(spark)
    assert rows_of(lexical.search(d, i)) == sorted(plain(docs, items), key=str)


def test_small_blocks_first_rounds_and_groups_of_items_change_nothing(spark, monkeypatch):
    docs, items, d, i = tables(spark)
    monkeypatch.setattr(lexical, "FIRST_DOCS", 25)
    monkeypatch.setattr(lexical, "GROUP_TERMS", 120)
    assert rows_of(lexical.search(d.repartition(7), i)) == sorted(plain(docs, items), key=str)


def test_the_late_round_skips_strata_that_cannot_rank(spark, monkeypatch):
    seen = []
    plain_round = lexical._round

    def watched(index, visits, query, name):
        seen.append((visits.count(), index.select("m").distinct().count()))
        return plain_round(index, visits, query, name)

    monkeypatch.setattr(lexical, "_round", watched)
    monkeypatch.setattr(lexical, "FIRST_DOCS", 60)
    rng = random.Random(1)
    docs = [(i, "rare word " * 3) for i in range(60)] + [(100 + i, " ".join(f"w{rng.randint(0, 99)}" for _ in range(50 + i)) + " word") for i in range(300)]
    found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "rare word")], "item_id long, text string"))
    assert rows_of(found) == sorted(plain(docs, [(1, "rare word")]), key=str)
    (early, strata), (late, _) = seen
    assert early + late < strata / 2


def test_blocks_are_cut_and_runs_fall(spark, monkeypatch):
    import numpy as np

    block = lexical._Block(80)
    block.add(5, np.array([1, 3]), np.array([2, 9]))
    block.add(None, np.array([1, 2]), np.array([7, 1]))
    row = block.row().to_pylist()[0]
    assert row["run_term"] == [1, 1, 2, 3] and row["run_tf"] == [7, 2, 1, 9] and row["run_end"] == [1, 2, 3, 4] and row["members"] == [1, 0, 1, 0]
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 2)
    assert block.full()


def test_edge_tables(spark):
    docs = edge_documents(spark)
    items = spark.createDataFrame([(1, "short word")], "item_id long, text string")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(lexical.search(docs, items)) == sorted(plain(pairs, [(1, "short word")]), key=str)
    assert lexical.search(empty(docs), items).count() == 0
    assert lexical.search(docs, empty(items)).count() == 0
