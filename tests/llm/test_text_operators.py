"""Packing, quality, personal data, language, licenses on small tables, against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import LONG, edge_documents, empty, prose
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from pulsemark.llm import langid, licenses, packing, pii, quality  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_token_pieces_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    odd = ["don't we'll '''s 4²½ x", "İstanbul ŉa ß", "日本語 テスト é", "<|endoftext|> x", "a\x85b\xa0c", "Ünïcode—dash"]
    docs = edge_documents(spark).select("doc_id", "text").union(spark.createDataFrame(list(enumerate(odd, 900)), "doc_id long, text string"))
    got = {}
    for r in packing.token_pieces(docs, PATH, capacity=64).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        parts = [ids[i : i + 64] for i in range(0, len(ids), 64)]
        want = [(k, 64 * k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(parts)]
        assert sorted(got[r.doc_id]) == want


def test_pack_is_gapless_tight_and_keeps_every_piece(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([1, 3, 50, 900, 2049, 4096, rng.randint(1, 4096)]), "s") for i in range(6000)]
    pieces = spark.createDataFrame(sizes, "doc_id long, length long, offset string").repartition(40)
    rows = packing.pack(pieces).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == sorted((a, b) for a, b, _ in sizes)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    _, _, fill = packing.best_fit(np.array([s for _, s, _ in sizes]), packing.CAPACITY)
    assert len(bins) <= len(fill) * 1.02 + 1  # 40 partitions merged by rounds, against one task for all


def test_pack_of_sorted_lengths_is_as_tight_as_one_best_fit(spark, monkeypatch):
    monkeypatch.setattr(packing, "DEAL", 500)
    rng = random.Random(5)
    for sizes in ([2500] * 4000 + [1500] * 4000, sorted(rng.choice([rng.randint(1, 4096), 2500, 1500, 300]) for _ in range(8000))):
        pieces = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long").repartitionByRange(8, "doc_id")
        found = packing.pack(pieces)
        assert found.count() == len(sizes)
        _, _, fill = packing.best_fit(np.array(sizes), packing.CAPACITY)
        assert found.select("sequence_id").distinct().count() <= len(fill) * 1.02


def test_pack_of_nothing_and_of_bins_that_never_merge(spark):
    pieces = spark.createDataFrame([(i, 2049) for i in range(500)], "doc_id long, length long").repartition(20)
    assert packing.pack(pieces).select("sequence_id").distinct().count() == 500
    assert packing.pack(empty(pieces)).count() == 0


def test_a_merge_group_is_bounded_and_loses_no_merge(spark, monkeypatch):
    groups = []
    plain = packing._round

    def watched(bins, *args):
        groups.append(max(r["count"] for r in bins.groupBy(F.floor(F.col("part") / packing.FAN)).count().collect()))
        return plain(bins, *args)

    monkeypatch.setattr(packing, "_round", watched)
    monkeypatch.setattr(packing, "DEAL", 5000)
    pieces = spark.createDataFrame([(i, 2049) for i in range(20_000)], "doc_id long, length long").repartition(3)
    assert packing.pack(pieces).select("sequence_id").distinct().count() == 20_000
    assert groups and max(groups) <= packing.FAN * (packing.FAN + 1)

    monkeypatch.setattr(packing, "CHUNK", 40)
    rng = random.Random(3)
    sizes = [(i, rng.choice([1000, 1000, 1000, 2100, 700, 3000])) for i in range(3000)]
    groups.clear()
    rows = packing.pack(spark.createDataFrame(sizes, "doc_id long, length long").repartition(4)).collect()
    assert len(groups) == 2 and sorted((r.doc_id, r.length) for r in rows) == sizes
    ends = {}
    for r in rows:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    fills = []
    for parts in ends.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        fills.append(at)
    fills.sort()
    assert fills[-1] <= packing.CAPACITY
    open_bins = [f for f in fills if f <= packing.CAPACITY - packing.NEAR]
    assert all(a + b > packing.CAPACITY for a, b in zip(open_bins, open_bins[1:]))  # no two open bins fit together


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fill = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert fill == [10, 10] and bins[2] == bins[0] and offsets[2] == 6


def test_quality_learns_and_scores_every_row(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng) if i % 2 else prose(rng).upper().replace(" ", "!! "), i % 2) for i in range(240)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y if i % 9 else None) for i, _, y in rows if i % 4] + [(None, 1)], "doc_id long, label int")
    model = quality.learn(quality.sample(labels, docs))
    out = {r.doc_id: r.score for r in quality.scores(docs, model, ["doc_id"]).collect()}
    held = [(out[i] >= 0.7) == bool(y) for i, _, y in rows if i % 4 == 0]
    assert np.mean(held) > 0.95
    edge = quality.scores(edge_documents(spark), model, ["doc_id", "lang"]).collect()
    assert len(edge) == edge_documents(spark).count() and all(0 <= r.score <= 1 for r in edge)
    none = quality.learn(quality.sample(empty(labels), docs))
    assert all(r.score == 0.5 for r in quality.scores(docs, none, ["doc_id"]).collect())
    assert quality.sample(labels, docs, max_rows=10).count() <= 10


def test_added_spans_on_lines_that_no_rule_made():
    model = pii.trained()
    added = lambda text: [s for s in pii.all_spans(text, model)[1] if s not in pii.base_spans(text)]
    assert added("tel 030 1234567") == [("phone", 4, 15)] and added("call 5551234567") == [("phone", 5, 15)]
    assert added("phone (212) 555-0187") == [("phone", 6, 20)]
    assert added("ip fe80::1") == [("ip", 3, 10)]
    assert added("cards 4111111111111111 5500000000000004 ok") == [("card", 6, 22), ("card", 23, 39)]
    assert added("4111 1111 1111 1111 5500 0000 0000 0004") == [("card", 0, 19), ("card", 20, 39)]
    for clean in ("order 123-456-7890", "invoice 555-123-4567", "at 12:30:45", "std::vector a::b", "serial 1234.5678.9012.3456", "ISBN 978-3-16-148410-0", "on 2021-03-14"):
        assert added(clean) == [], clean
    assert all(0.05 < t < 0.95 for t in model.thresholds.values()) and set(model.thresholds) == set(pii.KINDS)


def test_side_by_side_cards_are_whole_runs_or_nothing():
    cards = pii._side_by_side("4111-1111-1111-1111-5500-0000-0000-0004", 10)
    assert cards == [(10, 29), (30, 49)]
    assert pii._side_by_side("4111-1111-1111-1111-5500-0000-0000-0005", 0) == []
    assert pii._side_by_side("4111111111111111", 0) == []
    long = " ".join(["4111111111111111"] * 3000)
    assert len(pii._side_by_side(long, 0)) == 3000


def test_base_spans_equal_plain_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def plain(t):
        out = [("email", *m.span()) for m in email.finditer(t)]
        out += [("ip", *m.span()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
        for m in card.finditer(t):
            d = re.sub("[^0-9]", "", m.group())
            if 13 <= len(d) <= 19 and pii.luhn(d):
                out.append(("card", *m.span()))
        return out + [("phone", *m.span()) for m in phone.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]

    rng = random.Random(3)
    pools = ["ab1.@-% +", "0123.. ", "4111 -", "+1(5) -."]
    for n in range(12_000):
        t = "".join(rng.choice(pools[n % 4]) for _ in range(rng.randint(1, 40)))
        assert pii.base_spans(t) == plain(t), t
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert ("ip", 2, 9) not in pii.base_spans("x 9.9.9.256 " + "9" * 5000 + ".1.1.1")


def test_pii_rows_additions_and_redaction(spark):
    rows = [
        (1, "mail me: jo.doe@mail7.example.com or call +1 (017) 555-7713, ip 10.1.2.3, card 4111 1111 1111 1111"),
        (2, "contact joe [at] host [dot] com, phone (555) 123-4567, é host 2001:db8:0:1:2:3:4:5"),
        (3, "order 4952935900253051 version 1.2.3 and 2024-01-15, at the of ing"),
    ]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[1].n_email, found[1].n_ip, found[1].n_card, found[1].n_phone, found[1].n_added) == (1, 1, 1, 1, 0)
    assert found[1].base_sha256 == hashlib.sha256(found[1].spans.encode()).hexdigest()
    assert found[2].n_added == 3 and found[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert found[3].spans == ""
    edge = edge_documents(spark)
    assert pii.find(edge).count() == edge.count() and pii.find(empty(edge)).count() == 0
    clean = {r.doc_id: r.text for r in pii.redacted(spark.createDataFrame([*rows, (4, None)], "doc_id long, text string")).collect()}
    assert clean[1] == "mail me: [EMAIL] or call [PHONE], ip [IP], card [CARD]" and clean[3] == rows[2][1] and clean[4] is None
    assert pii.redact("abcdef", [("ip", 1, 3), ("card", 2, 5)]) == "a[IP]f"


def test_boosted_thresholds_hold_on_fresh_examples():
    model = pii.trained()
    x, y, kinds = pii.examples(500, seed=77)
    picked = np.array([model.score(r) >= model.thresholds[k] for r, k in zip(x, kinds)])
    assert y[picked].mean() >= 0.95 and picked[y == 1].mean() >= 0.8


def test_language_profiles(spark):
    docs = edge_documents(spark, 60)
    profiles = langid.learn(docs.where("doc_id % 5 != 0").select("text", "lang"))
    assert set(profiles) == {"en", "de"}
    got = {r.doc_id: r for r in langid.predict(docs, profiles, keep=["doc_id", "lang"]).collect()}
    assert len(got) == docs.count()
    for k in (0, 1, 2, 6):
        assert got[k].lang_pred == "und" and got[k].score == 0
    clear = [r for r in got.values() if r.doc_id >= 100]
    assert np.mean([r.lang_pred == r.lang for r in clear]) > 0.97
    assert all(0 <= r.score <= 1 and 0 <= r.distance <= 1 for r in got.values())
    nothing = langid.predict(docs, langid.learn(empty(docs).select("text", "lang")), keep=["doc_id"]).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    one = langid.learn(docs.where("lang = 'de'").select("text", "lang"))
    assert {r.lang_pred for r in langid.predict(docs.where("doc_id >= 100"), one, keep=["doc_id"]).collect()} == {"de"}


def test_language_counts_equal_plain_counts():
    text = "Das ist, ein Tést!"
    words = ["das", "ist", "ein", "tést"]
    want = {}
    for w in words:
        for c in w:
            want[(ord(c),)] = want.get((ord(c),), 0) + 1
    flat = " das ist ein tést "
    for n in (2, 3):
        for i in range(len(flat) - n + 1):
            g = flat[i : i + n]
            if n == 2 or g[1] != " ":
                k = tuple(1 if c == " " else ord(c) for c in g)
                want[k] = want.get(k, 0) + 1
    keys, counts = langid.runs(langid.grams(text))
    got = {}
    for k, c in zip(keys.tolist(), counts.tolist()):
        parts = []
        while k:
            parts.append(k & 0x1FFFFF)
            k >>= 21
        got[tuple(reversed(parts))] = c
    assert got == want


def test_license_matches(spark):
    mit = licenses.TEMPLATES["MIT"]
    words = mit.split()
    edited = " ".join(w for i, w in enumerate(words) if i % 23 != 5)
    rows = [
        (1, f"İ head text.\n{mit}\nmore"), (2, "x " * 400 + "Licensed under CC BY-NC 4.0. and so on"), (3, edited),
        (4, " ".join(words[:20])), (5, LONG), (6, None), (7, ""),
        (8, "Released under the MIT License. " + "gap " * 50 + "Released under the MIT License."),
    ]
    docs = spark.createDataFrame([(*r, "t", 1) for r in rows], "doc_id long, text string, template string, coverage int")
    got = licenses.find(docs).orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.template) for r in got] == [(1, "MIT"), (2, "CC-BY-NC-4.0-line"), (3, "MIT"), (8, "MIT-line"), (8, "MIT-line")]
    texts = dict(rows)
    assert texts[1][got[0].start : got[0].end].startswith("Permission is hereby") and texts[1][got[0].start : got[0].end].endswith("the Software")
    assert texts[2][got[1].start : got[1].end] == "Licensed under CC BY-NC 4.0"
    assert got[0].coverage == 1.0 and 0.9 < got[2].coverage < 1.0
    assert licenses.find(empty(docs)).count() == 0


@pytest.mark.parametrize("name", [n for n in licenses.TEMPLATES if n.endswith("-line")])
@pytest.mark.parametrize("gap", ["", "so it is. ", "a b c d e f g h i. "])
def test_repeated_notices_are_all_found(name, gap):
    text = gap.join([licenses.TEMPLATES[name] + " "] * 3)
    got = licenses.scan(text, licenses.default_index())
    assert [g[:3] for g in got] == [(name, 1.0, got[0][2])] * 3
    size = len(licenses.TEMPLATES[name].rstrip("."))
    starts = [m.start() for m in re.finditer(re.escape(licenses.TEMPLATES[name]), text)]
    assert [g[3:] for g in got] == [(at, at + size) for at in starts]


def test_changed_words_of_short_notices_equal_plain_alignment():
    rng = random.Random(8)
    for name in (n for n in licenses.TEMPLATES if n.endswith("-line")):
        index = licenses.Index({name: licenses.TEMPLATES[name]})
        words = licenses.TEMPLATES[name].rstrip(".").replace("4.0", "4 0").replace("2.0", "2 0").replace("-", " ").replace(",", "").split()
        for i in range(len(words)):
            for put in (["other"], []):
                head = [rng.choice(["one", "two", "six"]) for _ in range(rng.randint(0, 30))]
                text = " ".join([*head, *words[:i], *put, *words[i + 1 :], "end"])
                hashes = licenses.word_hashes(text)
                best = max(licenses.align(hashes, index.words[0], d, 0, len(hashes))[0] for d in range(-3, len(hashes)))
                assert [g[2] for g in licenses.scan(text, index)] == ([best] if best >= licenses.COVERAGE * len(words) else []), text


def test_winnowing_shares_a_fingerprint_with_every_common_run():
    rng = np.random.default_rng(4)
    for _ in range(200):
        run = rng.integers(0, 50, licenses.K + licenses.WINDOW - 1, dtype=np.uint64)
        prints = []
        for _ in range(2):
            line = np.concatenate([rng.integers(100, 200, 9, dtype=np.uint64), run, rng.integers(200, 300, 9, dtype=np.uint64)])
            found = licenses.grams(line)
            prints.append({int(found[p]) for p in licenses.winnow(found)})
        inner = set(licenses.grams(run).tolist())
        assert prints[0] & prints[1] & inner


