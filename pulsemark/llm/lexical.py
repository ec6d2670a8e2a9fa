"""Ranked lexical search over a length-stratified index.

A document's length enters its score only through the whole-number normaliser m, so documents of equal m form a stratum in
which a term's impact depends on its frequency tf alone. The index holds, per stratum, blocks of documents with postings
ordered by term and falling tf; an impact is computed once per (stratum, tf) and serves all postings of that run.

Per item, the largest tf of each term in a stratum bounds every score there. Strata are visited in order of that bound: a
first round over the best strata of each item gives the score that its last place needs, and a second round visits only
strata whose bound reaches it. Inside a task the same bound skips single blocks. Bounds only skip what cannot rank, so the
result is exact.

Queries are a stated set: items are taken in groups of at most GROUP_TERMS terms, whose vocabulary, weights and floors are
sent to the tasks; a larger set takes several passes over the documents. Documents are never paired with each other, and
their terms stay in their blocks. Strata are dealt by (m, random number), so a stratum of any size spreads over tasks.

Edge cases: null texts and texts without terms have no rank and count in no statistic; every row is a document of its own,
also with a repeated or null doc_id (null ids come last among ties); every row of the items is an item; items without terms
and items that match nothing have no rows; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsemark.llm.common import sized_join, sliced, staged

TOP = 20
GROUP_TERMS = 500_000  # terms of the items of one pass, with repeats: bounds what is sent to every task
BLOCK_DOCS = 2048
BLOCK_POSTINGS = 1 << 17
FIRST_DOCS = 2048  # documents an item's first round sees at least, best strata first
SCALE = 1_000_000_000

# ASCII capitals become small, all other ASCII but letters and digits separates; bytes of further letters stay
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in order, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split() if text else []


# ---- statistics


def _counter(vocabulary: dict[bytes, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng()
        for batch in sliced(batches):
            ids, sizes, terms, times = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = terms_of(text)
                if not words:
                    continue
                found = sorted((vocabulary[w], k) for w, k in Counter(words).items() if w in vocabulary)
                ids.append(doc_id)
                sizes.append(len(words))
                terms.append([t for t, _ in found])
                times.append([k for _, k in found])
            arrays = [
                pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(rng.integers(0, 1 << 62, len(ids)), pa.int64()),
                pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "spot", "terms", "times"])

    return run


def _list(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    column = batch.column(name)
    offsets = column.offsets
    start, stop = offsets[row].as_py(), offsets[row + 1].as_py()
    return column.values.slice(start, stop - start).to_numpy(zero_copy_only=False)


# ---- index


class _Block:
    """Documents of one stratum, being gathered."""

    def __init__(self, m: int):
        self.m = m
        self.ids: list[int | None] = []
        self.terms: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc_id: int | None, terms: np.ndarray, times: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.terms.append(terms)
        self.times.append(times)
        self.postings += len(terms)

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCS or self.postings >= BLOCK_POSTINGS

    def row(self) -> pa.RecordBatch:
        """Postings by term and falling tf; a run is the postings of one term and tf."""
        member = np.repeat(np.arange(len(self.ids), dtype=np.int32), [len(t) for t in self.terms])
        term, tf = np.concatenate(self.terms), np.concatenate(self.times)
        order = np.lexsort((member, -tf, term))
        term, tf, member = term[order], tf[order], member[order]
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1]))))
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        arrays = [
            pa.array([self.m], pa.int64()), one(self.ids, pa.int64()), one(term[first], pa.int32()), one(tf[first], pa.int64()),
            one(np.append(first[1:], len(term)).astype(np.int32), pa.int32()), one(member, pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["m", "ids", "run_term", "run_tf", "run_end", "members"])


_INDEX = "m long, ids array<long>, run_term array<int>, run_tf array<long>, run_end array<int>, members array<int>"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents that come sorted by m."""
    block = None
    for batch in batches:
        for row, (m, doc_id) in enumerate(zip(batch.column("m").to_pylist(), batch.column("doc_id").to_pylist())):
            if block is not None and (block.m != m or block.full()):
                yield block.row()
                block = None
            block = block or _Block(m)
            block.add(doc_id, _list(batch, "terms", row), _list(batch, "times", row))
    if block is not None:
        yield block.row()


# ---- search


class Query:
    """Items of one pass: term ids with weight times repeats, most valuable first."""

    def __init__(self, items: list[dict[int, int]], weights: list[int]):
        self.terms: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        for counts in items:
            pairs = sorted(((weights[t] * k, t) for t, k in counts.items() if weights[t]), reverse=True)
            self.terms.append(np.array([t for _, t in pairs], np.int64))
            self.values.append(np.array([v for v, _ in pairs], np.int64))
        self.size = len(weights)

    def bound(self, item: int, impacts: np.ndarray) -> int:
        """Most that a document can score, given the largest impact of every term."""
        return int(self.values[item] @ impacts[self.terms[item]])


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    return SCALE * tf // (1000 * tf + 12 * m)


def _bounds(query: Query) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(m, docs, item, bound) of every stratum and item that can score there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (m, docs) in enumerate(zip(batch.column("m").to_pylist(), batch.column("docs").to_pylist())):
                largest = np.zeros(query.size, np.int64)
                largest[_list(batch, "terms", row)] = impacts(_list(batch, "tfs", row), m)
                bound = np.array([query.bound(i, largest) for i in range(len(query.terms))], np.int64)
                item = np.flatnonzero(bound > 0)
                arrays = [pa.array(np.full(len(item), v), pa.int64()) for v in (m, docs)] + [pa.array(item, pa.int64()), pa.array(bound[item], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["m", "docs", "item", "bound"])

    return run


class _Best:
    """The best scores of one item seen by a task."""

    def __init__(self):
        self.scores = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.known = np.zeros(0, bool)

    def floor(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == TOP else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        scores, ids, known = np.append(self.scores, scores), np.append(self.ids, ids), np.append(self.known, known)
        order = np.lexsort((ids, ~known, -scores))[:TOP]
        self.scores, self.ids, self.known = scores[order], ids[order], known[order]


def _scorer(query: Query) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        for batch in batches:
            for row, m in enumerate(batch.column("m").to_pylist()):
                visit = zip(_list(batch, "items", row).tolist(), _list(batch, "floors", row).tolist())
                run_term, run_tf, run_end, members = (_list(batch, c, row) for c in ("run_term", "run_tf", "run_end", "members"))
                first = np.flatnonzero(np.concatenate(([True], run_term[1:] != run_term[:-1])))
                term = run_term[first]
                begin = np.append(0, run_end)[first]
                end = np.append(begin[1:], len(members))
                run_impact = impacts(run_tf, m)
                impact = np.repeat(run_impact, np.diff(run_end, prepend=0))
                largest = np.zeros(query.size, np.int64)
                largest[term] = run_impact[first]
                place = np.full(query.size, -1, np.int64)
                place[term] = np.arange(len(term))
                ids = batch.column("ids")
                slot = ids.values.slice(ids.offsets[row].as_py(), ids.offsets[row + 1].as_py() - ids.offsets[row].as_py())
                known = slot.is_valid().to_numpy(zero_copy_only=False)
                numbers = slot.fill_null(0).to_numpy(zero_copy_only=False)
                for item, floor in visit:
                    top = best.setdefault(item, _Best())
                    floor = max(floor, top.floor())
                    if query.bound(item, largest) < floor:
                        continue
                    scores = np.zeros(len(numbers), np.int64)
                    spots = place[query.terms[item]]
                    for at, value in zip(spots.tolist(), query.values[item].tolist()):
                        if at >= 0:
                            a, b = begin[at], end[at]
                            scores[members[a:b]] += value * impact[a:b]
                    good = np.flatnonzero(scores >= floor)
                    if len(good) > TOP:  # keep whatever ties with the last place
                        least = np.partition(scores[good], len(good) - TOP)[len(good) - TOP]
                        good = good[scores[good] >= least]
                    if len(good):
                        top.add(scores[good], numbers[good], known[good])
        for item, top in best.items():
            ids = pa.array(top.ids, pa.int64(), mask=~top.known)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top.ids), item), pa.int64()), ids, pa.array(top.scores, pa.int64())], names=["item", "doc_id", "score"])

    return run


_FOUND = "item long, doc_id long, score long"


def _round(index: DataFrame, visits: DataFrame, query: Query, name: str) -> DataFrame:
    """Best documents per item and task; ``visits`` has (m, item, floor)."""
    pairs = F.array_sort(F.collect_list(F.struct("item", "floor")))
    grouped = visits.groupBy("m").agg(pairs.alias("pairs"))
    grouped = staged(grouped.select("m", F.transform("pairs", lambda x: x["item"]).alias("items"), F.transform("pairs", lambda x: x["floor"]).alias("floors")), f"{name}-visits")
    weight = grouped.agg(F.sum(F.size("items"))).first()[0] or 0
    due = sized_join(index, grouped, "m", "inner", weight)
    return staged(due.select("m", "ids", "run_term", "run_tf", "run_end", "members", "items", "floors").mapInArrow(_scorer(query), _FOUND), name)


def _ranked(found: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", place).where(F.col("rank") <= TOP)


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the TOP best documents of every item."""
    listed = staged(items.select("item_id", F.col("text").cast("string").alias("text")), "search-items")
    size = listed.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(1, math.ceil(size / 2 / GROUP_TERMS))  # a term and its separator are two characters at least
    deal = F.pmod(F.xxhash64("item_id", "text"), F.lit(groups))
    out = None
    for g in range(groups):
        part = _pass(docs, listed.where(deal == g).collect(), items)
        out = part if out is None else out.unionByName(part)
    return out


def _pass(docs: DataFrame, items: list, table: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    counts = [{vocabulary.setdefault(w, len(vocabulary)): k for w, k in Counter(terms_of(r.text)).items()} for r in items]
    kind = table.schema["item_id"].dataType
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], "item long, item_id " + kind.simpleString())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = staged(texts.mapInArrow(_counter(vocabulary), "doc_id long, n long, spot long, terms array<int>, times array<long>"), "search-terms")
    total, length = counted.agg(F.count(F.lit(1)), F.sum(F.col("n").cast("decimal(38,0)"))).first()
    weights = [0] * len(vocabulary)
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most the vocabulary
        weights[r.term] = math.floor(1000 * math.log((2 * total + 2) / (2 * r["count"] + 1)))
    query = Query(counts, weights)
    m = F.lit(75) + F.expr(f"(cast(n as decimal(18,0)) * {25 * total}BD) div {length or 1}BD")
    held = counted.where(F.size("terms") > 0).select(m.cast("long").alias("m"), "doc_id", "spot", "terms", "times")
    index = staged(held.repartitionByRange("m", "spot").sortWithinPartitions("m", "spot").mapInArrow(_index, _INDEX), "search-index")

    runs = index.select("m", F.inline(F.arrays_zip(F.col("run_term").alias("term"), F.col("run_tf").alias("tf"))))
    peaks = runs.groupBy("m", "term").agg(F.max("tf").alias("tf")).groupBy("m").agg(F.collect_list(F.struct("term", "tf")).alias("peaks"))
    sizes = index.groupBy("m").agg(F.sum(F.size("ids")).alias("docs"))
    peaks = peaks.join(sizes, "m").select("m", "docs", F.transform("peaks", lambda x: x["term"]).alias("terms"), F.transform("peaks", lambda x: x["tf"]).alias("tfs"))
    bounds = staged(peaks.mapInArrow(_bounds(query), "m long, docs long, item long, bound long"), "search-bounds")
    before = Window.partitionBy("item").orderBy(F.col("bound").desc(), "m").rowsBetween(Window.unboundedPreceding, -1)
    early = F.coalesce(F.sum("docs").over(before), F.lit(0)) < FIRST_DOCS
    bounds = staged(bounds.withColumn("early", early), "search-order")
    first = _round(index, bounds.where("early").select("m", "item", F.lit(1).cast("long").alias("floor")), query, "search-first")
    floors = _ranked(first).groupBy("item").agg(F.when(F.max("rank") == TOP, F.min("score")).otherwise(F.lit(1)).cast("long").alias("floor"))
    late = bounds.where("not early").join(floors, "item", "left").withColumn("floor", F.coalesce("floor", F.lit(1).cast("long")))
    second = _round(index, late.where("bound >= floor").select("m", "item", "floor"), query, "search-second")
    best = _ranked(first.unionByName(second)).join(names, "item")
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT row_number() OVER () AS item, item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(t) AS term FROM i) GROUP BY ALL),
v AS (SELECT DISTINCT term FROM q),
s AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS length FROM d WHERE len(t) > 0),
p AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(t) AS term FROM d) JOIN v USING (term) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, s),
z AS (SELECT row, doc_id, 75 + (25 * len(t) * docs) // length AS m FROM d, s WHERE len(t) > 0),
scores AS (SELECT item, item_id, z.row, z.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN z USING (row) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
