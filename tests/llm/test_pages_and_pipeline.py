"""WARC round trips, HTML extraction and the pipeline."""

import hashlib
import random

import pytest
from helpers import edge_documents, empty, prose
from pyspark.sql import functions as F

from pulsemark.llm import html_extract, warc
from pulsemark.llm.common import staged_path

pytest.importorskip("public_tokenizers")


def test_archive_round_trip(spark):
    rng = random.Random(4)
    big = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "é" * 50
    pages = [(k, f"http://a/{k}", prose(rng)) for k in range(50)]
    pages += [(100, "u", big), (101, None, big), (99, "", big), (102, "a\r\nb", "short"), (103, "u", "short"), (104, "u", None), (105, "u", ""), (106, "u", "y" * 300_000), (107, "u", "é" * 50), (108, "u", "é" * 50)]
    df = spark.createDataFrame([(*p, "f", 3) for p in pages], "page_id long, url string, html string, first string, row int")
    path = staged_path(spark, "test-warc")
    warc.write_archive(df, path)
    records = warc.read_records(spark, path)
    assert {r["record_type"]: r["count"] for r in records.groupBy("record_type").count().collect()} == {"request": 60, "metadata": 60, "response": 57, "revisit": 3}
    captures = warc.captures(records)
    payloads = {int(r.metadata.fields["page-id"]): bytes(r.response.payload) for r in captures.collect() if r.response.record_type == "response"}
    first = {}
    for page, _, html in sorted(pages, key=lambda p: p[0]):
        if len((html or "").encode()) >= 100:
            first.setdefault(html, page)
    got = {r.page_id: r for r in warc.digest_rows(captures).collect()}
    assert len(got) == len(pages)
    for page, url, html in pages:
        data = (html or "").encode()
        other = first.get(html, page)
        r = got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if other == page else ("revisit", other))
        if other == page:
            assert payloads[page] == data
    assert got[0].target_uri == "http://a/0" and got[101].target_uri is None


def test_archive_of_nothing_and_of_null_ids(spark):
    df = spark.createDataFrame([(None, None, "z" * 150), (7, "u", "z" * 150), (7, "u", "z" * 150)], "page_id long, url string, html string")
    path = staged_path(spark, "test-warc")
    warc.write_archive(df, path)
    rows = warc.digest_rows(warc.captures(warc.read_records(spark, path))).collect()
    assert sorted((r.page_id or 0, r.record_type) for r in rows) == [(0, "revisit"), (7, "response"), (7, "response")]
    path = staged_path(spark, "test-warc")
    warc.write_archive(empty(df), path)
    assert warc.digest_rows(warc.captures(warc.read_records(spark, path))).count() == 0


def test_broken_archives_are_errors():
    import gzip

    with pytest.raises(ValueError):
        list(warc.parse_records(gzip.compress(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc")))
    with pytest.raises(ValueError):
        list(warc.parse_records(gzip.compress(b"nonsense\r\n\r\n")))


ARTICLE = "<article class='post has-sidebar'><header><h1>Title &amp; more</h1></header><p>One <a href=x>link</a> two&nbsp;three.<p>Second\n para<br>line<ul><li>item a</li><li>item b</ul></article>"


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        (f"<html><head><title>T</title><script>if (a<b) x('</p>')</script></head><body><nav><a href=1>a</a></nav>{ARTICLE}<footer>c</footer>", None),
        (f"<header><h1>Site</h1></header><div id='cookie-notice'>We use cookies</div><main><aside>side bar text</aside>{ARTICLE}</main>", None),
        (f"{ARTICLE}<section class='comments'><p>{'nice words here ' * 20}</p></section>", None),
        (ARTICLE.replace("<p>One", "<div class=ad>Buy now</div><form><label>Name</label></form><!-- <p>no</p> --><style>p{}</style><p>One"), None),
        ("<div class=menu><a href=1>a</a> <a href=2>b</a></div><div><p>" + "word " * 60 + "</p><p>tail end.</p></div>", ("word " * 60).strip() + "\ntail end."),
        ("<p>" + "plain " * 30 + "<script>never closed", ("plain " * 30).strip()),
        ("<div class='content has-sidebar'><h2>Head</h2><p>" + "text " * 30 + "</p></div><ol class='commentlist'><li>" + "reply " * 40 + "</ol><div id=adslot2>Buy this now</div>", "Head\n" + ("text " * 30).strip()),
        ("<article>a &lt;b&gt; &#233; &unknown; &amp;amp;</article>", "a <b> é &unknown; &amp;"),
    ],
)
def test_main_text(page, want):
    text = "Title & more\nOne link two three.\nSecond para line\nitem a\nitem b"
    assert html_extract.main_text(page, html_extract.trained()) == (text if want is None else want)


LINES = {k: f"{k} words of the story " * 12 for k in ("First", "Second", "Third")}


def prose_page(*keys):
    return "".join(f"<p>{LINES[k]}</p>" for k in keys)


@pytest.mark.parametrize(
    "page, heading, keys",
    [
        ("<div class='content-with-sidebar'><article><h1>Head line</h1>{}</article></div>", "Head line", ("First", "Second")),
        ("<div class='layout sidebar-right'><main><h2>Top</h2>{}</main></div>", "Top", ("First",)),
        ("<form id='aspnetForm'><div class='post'>{}</div></form>", None, ("First", "Second", "Third")),
        ("<div class='social-history'><h2>History</h2>{}</div>", "History", ("First", "Second")),
        ("<article><h2 id='terms'>Terms of the treaty</h2>{}</article>", "Terms of the treaty", ("First", "Second")),
        ("<article><section id='privacy'>{}</section></article>", None, ("First", "Second")),
        ("<article>{}</article><div class='related'><article><h3>Teaser</h3><p>Short teaser text here</p></article></div>", None, ("First", "Second")),
        ("<main>{}</main><section class='comments'><article class='comment'><p>I agree with all of this and more</p></article></section>", None, ("First", "Second")),
        ("<div class='page sidebar-left'><div class='comments'><article class='comment'><p>Well said, well said</p></article></div><article>{}</article></div>", None, ("First", "Third")),
    ],
)
def test_articles_in_wrappers_keep_their_text(page, heading, keys):
    want = "\n".join(([heading] if heading else []) + [LINES[k].strip() for k in keys])
    assert html_extract.main_text(page.format(prose_page(*keys)), html_extract.trained()) == want


def test_the_tree_overrules_the_region():
    links = "<ul>" + "".join(f"<li><a href={i}>More news item {i} here</a></li>" for i in range(6)) + "</ul>"
    share = "<div class='share'><a href=1>Tweet</a> <a href=2>Mail</a></div>"
    page = f"<article><h1>Title</h1>{prose_page('First')}{share}{prose_page('Second')}{links}</article>"
    found, has_article = html_extract.page_blocks(page)
    regions = [b[3] for b in found]
    kept = html_extract.main_text(page, html_extract.trained()).split("\n")
    assert has_article and regions.count(html_extract.ARTICLE) == 9 and regions.count(html_extract.PART) == 1
    assert kept == ["Title", LINES["First"].strip(), LINES["Second"].strip()]  # seven blocks of the article's region go
    flagged = f"<div class='related-topics'>{prose_page('First', 'Second')}<ul><li><a href=1>One more</a></li><li><a href=2>Two more</a></li></ul></div>"
    assert html_extract.main_text(flagged, html_extract.trained()) == "\n".join(LINES[k].strip() for k in ("First", "Second"))


def test_extract_rows(spark):
    pages = [(1, "u", ARTICLE), (1, "u", ARTICLE), (2, None, None), (None, "v", "<p>" + "é " * 50_000)]
    df = spark.createDataFrame([(*p, "t", 9) for p in pages], "page_id long, url string, html string, text string, n_chars int")
    rows = html_extract.extract(df).collect()
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows) and html_extract.extract(empty(df)).count() == 0


def test_labelled_table_is_learnt():
    rows = html_extract.labelled()
    tree = html_extract.trained()
    assert all((tree.value(r[:-1]) >= 0.5) == (r[-1] == 1) for r in rows)


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline
    from pulsemark.llm.common import staged

    rng = random.Random(3)
    docs = edge_documents(spark, 60)
    item = prose(rng, n=30)
    more = [
        (900, f"start {prose(rng)} {item} end", "en", "s", 1, *"xyzcr"),
        (901, f"{prose(rng)} write to a.b@mail.example.com", "en", "s", 1, *"xyzcr"),
    ]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    folder = staged_path(spark, "pipeline-in")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    before, state, kept = docs, staged(docs, "in"), []
    for name, stage in pipeline.STAGES[:-1]:
        state = staged(stage(spark, state, folder), name)
        assert state.columns == before.columns
        kept.append({r.doc_id: r for r in state.collect()})
    lang, near, clean, private = kept
    assert set(lang) >= {r.doc_id for r in docs.collect()} - {0, 1, 2, 6} and not set(lang) & {0, 1, 2, 6}
    assert not any(200 <= k < 400 for k in near) and {k for k in lang if 100 <= k < 200} <= set(near)
    assert set(near) - set(clean) == {900}
    assert set(private) == set(clean) and private[901].text.endswith("write to [EMAIL]") and private[901].n_chars == len(private[901].text)
    rows = pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == set(private)
    nothing = empty(docs)
    for _, stage in pipeline.STAGES:
        nothing = staged(stage(spark, nothing, folder), "nothing")
    assert nothing.count() == 0


def test_rows_with_null_and_repeated_ids_are_judged_by_their_text(spark):
    import corpus_pipeline as pipeline

    rng = random.Random(8)
    a, b, c, item = (prose(rng, n=60) for _ in range(4))
    rows = [(1, a), (1, a), (2, b), (None, b), (None, b), (None, c), (None, c), (5, c + " more"), (7, item), (None, f"x {item} y"), (None, None), (7, prose(rng))]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, _row string")
    folder = staged_path(spark, "pipeline-in")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    near = pipeline.near_dedup(spark, docs, folder)
    assert near.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in near.collect()), key=str)
    assert got == sorted([(1, a), (2, b), (5, c + " more"), (7, item), (None, None), rows[-1]], key=str)
    clean = pipeline.decontamination(spark, docs, folder).collect()
    assert sorted(((r.doc_id, r.text) for r in clean), key=str) == sorted([r for r in rows if item not in (r[1] or "")], key=str)


def test_language_id_keeps_columns_named_like_its_verdict(spark):
    from corpus_pipeline import language_id

    docs = edge_documents(spark).withColumns({"lang_pred": F.col("doc_id") * 2, "Distance": F.lit("far"), "_score": F.lit(1)})
    got = language_id(spark, docs, "")
    assert got.schema.simpleString() == docs.schema.simpleString()
    given = {r.doc_id: r for r in docs.collect()}
    rows = got.collect()
    assert rows and all(r == given[r.doc_id] for r in rows)


def test_oracles_agree_on_the_smallest_tables(spark):
    import os

    duckdb = pytest.importorskip("duckdb")
    from pulsemark.llm.catalog import ORACLE, QUERIES

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for name, sql in ORACLE.items():
        got = QUERIES[name](spark, folder)
        want = con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns), name
        cols = sorted(got.columns)
        key = lambda r: tuple((x is None, str(x)) for x in r)
        a = sorted((tuple(r) for r in got.select(*cols).collect()), key=key)
        b = sorted((tuple(r) for r in want.select(", ".join(cols)).fetchall()), key=key)
        assert a == b, name
