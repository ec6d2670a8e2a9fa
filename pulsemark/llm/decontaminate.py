"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming search, exact verification.

A document window with as many words as a benchmark item gets a 60-bit SimHash of its word shingles, weighted by how
often they occur. Item fingerprints are indexed by five 12-bit blocks, each under all values within three flips: two
fingerprints at most RADIUS = 19 bits apart agree on some block up to three flips, so the index finds every pair
within the radius. Pairs found are verified by the exact weighted-shingle similarity, the sum of smaller counts over
the sum of larger counts. The radius holds pairs of similarity 0.8 (expected distance 9 bits, deviation under 3) with
room to spare.

Windows that share no shingle with any item of their size have similarity 0 and are passed over; that is read off
one join of the documents' shingles with the items' shingles. Everything is built-in functions: no Python runs in a
task. The benchmark side is broadcast only when counted and small, else it is shuffled.

Words are runs of letters and digits, lower-cased. An item below the shingle width counts as one shingle. A document
shorter than an item is one window. Edge cases: null and wordless texts match nothing, nor do rows with a null id;
repeated ids are searched together; ties between windows take the smallest start; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsemark.llm.common import sized_join, staged

WORDS = 5
THRESHOLD = 0.8
BITS = 60
BLOCKS = 5
BLOCK_BITS = BITS // BLOCKS
FLIPS = 3
RADIUS = BLOCKS * (FLIPS + 1) - 1
_GAP = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _GAP), lambda w: w != "")


def shingles_of(words: Column, width: int) -> Column:
    """Hash of every run of ``width`` words, in order."""
    return F.when(
        F.size(words) >= width,
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, width))),
    ).otherwise(F.array().cast("array<bigint>"))


def _lanes(lane: int) -> tuple[int, int]:
    """Counters per long and longs needed, for counters of ``lane`` bits."""
    per = BITS // lane
    return per, -(-BITS // per)


def simhash(shingles: Column, lane: int) -> Column:
    """Bit k is set when more than half of the shingles have it; counters of ``lane`` bits are summed side by side."""
    per, longs = _lanes(lane)
    spread = F.array(*[F.lit(sum(((v >> b) & 1) << (lane * b) for b in range(per))).cast("long") for v in range(1 << per)])

    def part(x: Column, j: int) -> Column:
        bits = F.shiftrightunsigned(x, per * j).bitwiseAND(F.lit((1 << min(per, BITS - per * j)) - 1))
        return F.element_at(spread, (bits + 1).cast("int"))

    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{j}") for j in range(longs)])
    sums = F.aggregate(shingles, zero, lambda acc, x: F.struct(*[(acc[f"c{j}"] + part(x, j)).alias(f"c{j}") for j in range(longs)]))
    return F.transform(F.array(sums), lambda s: _bits(s, shingles, lane, per))[0]


def _bits(sums: Column, shingles: Column, lane: int, per: int) -> Column:
    out = F.lit(0).cast("long")
    size = F.size(shingles).cast("long")
    for k in range(BITS):
        count = F.shiftrightunsigned(sums[f"c{k // per}"], lane * (k % per)).bitwiseAND(F.lit((1 << lane) - 1).cast("long"))
        out = out.bitwiseOR(F.when(count * 2 > size, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def _block(fingerprint: Column, k: int) -> Column:
    return F.shiftrightunsigned(fingerprint, BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long"))


def overlap(a: Column, b: Column) -> Column:
    """Sum over shingles of the smaller count; a set intersection is enough where neither side repeats a shingle."""
    times = lambda xs, v: F.size(F.filter(xs, lambda y: y == v))
    repeats = (F.size(F.array_distinct(a)) < F.size(a)) | (F.size(F.array_distinct(b)) < F.size(b))
    exact = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, v: acc + F.least(times(a, v), times(b, v)))
    return F.when(repeats, exact).otherwise(F.size(F.array_intersect(a, b)))


def find(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """doc_id, item_id, start (word), n_words, similarity, hamming: the best window of each matching pair.

    ``docs`` has doc_id and text, ``items`` has item_id and text.
    """
    base = items.where("item_id is not null").select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    base = base.select("item_id", "w", F.size("w").alias("n"), F.least(F.size("w"), F.lit(words)).alias("k"))
    shapes = base.groupBy("k").agg(F.max("n").alias("longest")).collect()  # at most ``words`` rows
    if not shapes:
        return _empty(docs, items)
    lane = 12 if max(r.longest for r in shapes) < 4096 else 20
    found = None
    for shape in sorted(r.k for r in shapes):
        part = _search(docs, base.where(F.col("k") == shape), shape, threshold, lane)
        found = part if found is None else found.unionByName(part)
    return found


def _empty(docs: DataFrame, items: DataFrame) -> DataFrame:
    types = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = "doc_id {}, item_id {}, start int, n_words int, similarity double, hamming int".format(*types)
    return docs.sparkSession.createDataFrame([], schema)


def _search(docs: DataFrame, base: DataFrame, width: int, threshold: float, lane: int) -> DataFrame:
    known = staged(
        base.select("item_id", "n", shingles_of(F.col("w"), width).alias("item_shingles")).withColumn("item_fp", simhash(F.col("item_shingles"), lane)),
        "items",
    )
    sizes = staged(known.select("n", F.explode("item_shingles").alias("sh")).distinct(), "item-shingles")
    source = docs.where("doc_id is not null").select("doc_id", words_of(F.col("text")).alias("w"))
    each = source.select("doc_id", F.size("w").alias("len"), F.posexplode(shingles_of(F.col("w"), width)).alias("pos", "sh"))
    hits = sized_join(each, sizes, "sh", "inner")
    low = F.greatest(F.col("pos") - F.col("n") + width, F.lit(0))
    high = F.least("pos", F.greatest(F.col("len") - F.col("n"), F.lit(0)))
    starts = hits.select("doc_id", "n", F.explode(F.when(high >= low, F.sequence(low, high))).alias("start")).distinct()
    starts = staged(starts, "windows")
    marked = staged(starts.select("doc_id").distinct(), "marked")
    texts = sized_join(source, marked, "doc_id", "left_semi").select("doc_id", shingles_of(F.col("w"), width).alias("shingles"))
    texts = staged(texts, "marked-texts")
    window = F.slice("shingles", F.col("start") + 1, F.col("n") - (width - 1))
    windows = starts.join(texts, "doc_id").select("doc_id", "n", "start", window.alias("window"))
    windows = staged(windows.withColumn("fp", simhash(F.col("window"), lane)), "fingerprints")

    masks = [sum(1 << b for b in bits) for r in range(FLIPS + 1) for bits in combinations(range(BLOCK_BITS), r)]
    flips = F.array(*[F.lit(m).cast("long") for m in masks])
    blocks = lambda fp: F.array(*[F.struct(F.lit(k).alias("block"), _block(F.col(fp), k).alias("value")) for k in range(BLOCKS)])
    index = known.select("item_id", "n", "item_fp", F.explode(blocks("item_fp")).alias("b"))
    index = index.select("item_id", "n", "item_fp", "b.block", F.col("b.value").alias("plain"), F.explode(flips).alias("flip"))
    index = index.select("item_id", "n", "item_fp", "block", F.col("plain").bitwiseXOR(F.col("flip")).alias("value"))
    probes = windows.select("doc_id", "n", "start", "fp", F.explode(blocks("fp")).alias("b")).select("doc_id", "n", "start", "fp", "b.block", "b.value")
    met = sized_join(probes, index, ["n", "block", "value"], "inner", known.count() * BLOCKS * len(masks))
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    earlier = F.lit(False)  # the pair also meets in an earlier block
    for k in range(BLOCKS - 1):
        earlier = earlier | ((F.col("block") > k) & (F.bit_count(_block(apart, k)) <= FLIPS))
    pairs = met.where((F.bit_count(apart) <= RADIUS) & ~earlier).select(
        "doc_id", "item_id", "n", "start", F.bit_count(apart).cast("int").alias("hamming")
    )
    full = sized_join(pairs, known.select("item_id", "item_shingles"), "item_id", "inner")
    full = full.join(windows.select("doc_id", "n", "start", "window"), ["doc_id", "n", "start"])
    shared = overlap(F.col("window"), F.col("item_shingles"))
    similarity = shared / (F.size("window") + F.size("item_shingles") - shared)
    good = full.withColumn("similarity", similarity.cast("double")).where(F.col("similarity") >= threshold)
    order = F.struct((-F.col("similarity")).alias("s"), F.col("start"), F.col("hamming"), F.col("n"))
    best = good.groupBy("doc_id", "item_id").agg(F.min(order).alias("b"))
    return best.select(
        "doc_id", "item_id", F.col("b.start").alias("start"), F.col("b.n").alias("n_words"), (-F.col("b.s")).alias("similarity"), F.col("b.hamming").alias("hamming")
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
i AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
items AS (SELECT item_id, w, len(w) AS n, least(len(w), 5) AS k FROM i WHERE len(w) > 0),
ish AS (SELECT item_id, k, n, array_to_string(w[p:p + k - 1], ' ') AS sh FROM (SELECT item_id, w, n, k, unnest(range(1, n - k + 2)) AS p FROM items)),
icount AS (SELECT item_id, sh, count(*) AS c FROM ish GROUP BY ALL),
ksizes AS (SELECT DISTINCT k FROM items),
dsh AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS sh
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ksizes WHERE len(w) >= k)),
pairs AS (SELECT DISTINCT dsh.doc_id, ish.item_id, ish.n, ish.k FROM dsh JOIN ish ON dsh.k = ish.k AND dsh.sh = ish.sh),
starts AS (SELECT pairs.*, len(d.w) AS len, unnest(range(0, greatest(len(d.w) - n, 0) + 1)) AS start FROM pairs JOIN d USING (doc_id)),
wcount AS (SELECT s.doc_id, s.item_id, s.n, s.k, s.start, dsh.sh, count(*) AS c
           FROM starts s JOIN dsh ON dsh.doc_id = s.doc_id AND dsh.k = s.k AND dsh.p > s.start AND dsh.p <= s.start + s.n - s.k + 1 GROUP BY ALL),
sums AS (SELECT w.doc_id, w.item_id, w.n, w.k, w.start, sum(w.c) AS size, sum(least(w.c, coalesce(icount.c, 0))) AS shared
         FROM wcount w LEFT JOIN icount ON icount.item_id = w.item_id AND icount.sh = w.sh GROUP BY ALL),
scored AS (SELECT *, CAST(shared AS DOUBLE) / CAST(size + (n - k + 1) - shared AS DOUBLE) AS similarity FROM sums),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS place FROM scored WHERE similarity >= 0.8)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, CAST(n AS INTEGER) AS n_words, similarity FROM ranked WHERE place = 1
"""
