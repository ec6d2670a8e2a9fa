"""Secret scan against plain patterns and a plain search for complementary parts."""

import hashlib
import random
import re

from helpers import edge_documents, empty
from oracle import compare

from pulsemark.llm import credentials

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
WEAK = {k: re.compile(p) for k, p in credentials.WEAK.items()}


def base_of(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return out + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def every_span(text):
    base = base_of(text)
    weak = [(m.start(), 3 + i, m.end(), k) for i, (k, p) in enumerate(WEAK.items()) for m in p.finditer(text)]
    weak = [w for w in weak if w[3] != "value" or all(re.search(c, text[w[0] : w[2]]) for c in ("[0-9]", "[a-z]", "[A-Z]"))]
    weak = [w for w in weak if not any(o[1] < w[1] and o[0] < w[2] and w[0] < o[2] for o in base + weak)]
    scope = lambda s: len([m for m in re.finditer(credentials.BREAK, text) if m.start() <= s[0]])
    out = list(base)
    for w in weak:
        beside = {o[3] for o in base + weak if o[3] != "endpoint" and scope(o) == scope(w) and o[0] - w[2] <= 300 and w[0] - o[2] <= 300}
        identifier, secret = beside & set(credentials.IDENTIFIERS), beside & set(credentials.SECRETS)
        if secret if w[3] == "key_id" else identifier if w[3] == "value" else identifier and secret:
            out.append(w)
    return sorted(out)


def written(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))


BITS = [
    "AKIAABCDEFGHIJKL", "AKIASHORT", "ASIAABCDEFGHIJKL12", "client_id: web-7", 'user_name = "bob"', "token=secret : abcdefgh", "Password: hunter2hunter2",
    "a" * 32, "0123456789abcdef0123456789abcdef01", "wJalrXUtnFEMI/K7MDENG/bPxRfiCY", "https://db.example.com:5432/x?y=1", "host = db.example.org", "plain words", "é ü 漢字",
    "api_key='AbCdEf123456'", "\n\n", "\n \t\n", "\n", "x" * 290, "Zm9vYmFyMTIzNDU2Nzg5MEFCQ0RF", "myhost.example", "tokens tokentoken", "AKIA" * 6, "apikey==abcdefgh",
]


def random_documents(spark, n=300):
    rng = random.Random(8)
    rows = [(i % 250, rng.choice(["", " ", ", ", " ; "]).join(rng.choice(BITS) for _ in range(rng.randint(0, 9))), None) for i in range(n)]
    rows += [(None, "AKIAABCDEFGHIJKL", "x"), (7, None, "x"), (8, "", "x"), (9, "token: " + "q" * 300_000, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, kind string")


def test_base_and_linked_spans_equal_plain_search(spark):
    docs = random_documents(spark)
    got = sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in credentials.find(docs).collect())
    want = []
    for r in docs.collect():
        base = base_of(r.text or "")
        count = lambda k: sum(b[3] == k for b in base)  # noqa: B023, E731
        want.append((str(r.doc_id), count("assign"), count("access"), count("hex"), hashlib.sha256(written(base).encode()).hexdigest(), written(every_span(r.text or ""))))
    assert got == sorted(want)
    kinds = {s.split(":")[0] for row in got for s in row[5].split(",") if s}
    assert kinds == set(credentials.KINDS)


def test_sql_gives_the_same_rows(spark):
    import duckdb

    docs = random_documents(spark)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    error, rows = compare(credentials.find(docs), con, credentials.ORACLE_SQL)
    assert error is None and rows == docs.count(), error


def test_weak_parts_need_their_complement_in_reach_and_scope(spark):
    value, far = "wJalrXUtnFEMI/K7MDENG/bPxRfiCY", "x " * 151
    texts = [value, f"ASIAABCDEFGHIJKL12 {value}", f"ASIAABCDEFGHIJKL12\n\n{value}", f"ASIAABCDEFGHIJKL12 {far}{value}", f"https://a.example/ {value}", f"https://a.example/ AKIAABCDEFGHIJKL {value}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [s.split(":")[0] for s in r.spans.split(",") if s] for r in credentials.find(docs).collect()}
    assert got == {0: [], 1: ["key_id", "value"], 2: [], 3: [], 4: [], 5: ["endpoint", "access", "value"]}


def test_edge_tables(spark):
    docs = edge_documents(spark)
    assert credentials.find(docs).count() == docs.count()
    assert credentials.find(empty(docs)).count() == 0


def test_a_document_of_many_parts(spark):
    text = " ".join(f"client_id=user{i} Abcdefghij0123456789{i}" for i in range(4000))
    (row,) = credentials.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(row.spans.split(",")) == 8000
