"""MinHash near-duplicates by an LSH forest.

Every document becomes a set of word shingles and, per tree, a key of DEPTH MinHash values. The keys of a tree are
sorted over the whole corpus (range partitions), so documents with a long common prefix are neighbours. A region of
neighbours that agree on MIN_DEPTH values makes candidates; where a region is dense (more than DENSE rows) the tree
is followed down to its full depth, so depth adapts to each region. Candidates only say which documents are compared:
clusters of candidates are then solved on full shingle sets, pivot by pivot, until one linked set is left.

Scale: exact copies fold into one row first; a candidate text is shuffled once; a cluster above BLOCK documents is
dealt over blocks that share a few central documents, and only what those blocks leave unconnected is compared across
blocks. No pairs are listed, no group is held whole, and nothing but counts reaches the driver.

Edge cases: null or blank texts have an empty set, link with nothing and keep their own id; repeated rows and ties
take the smallest id; an empty table gives an empty result; other columns are ignored. ``id_column`` must be a
unique integer; rows with a null id are kept, link with nothing and have a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsemark.llm.common import Union, by_group, components, sized_join, sliced, staged
from pulsemark.llm.shingles import shingle_set
from pulsemark.session import partitions

TREES = 32
DEPTH = 8
MIN_DEPTH = 5
DENSE = 64
BLOCK = 512  # documents of one cluster that a task holds
BLOCK_SHINGLES = 2_000_000
HUBS = 8
_SEED = 20240607


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    n = TREES * DEPTH
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def _minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest (a * x + b) >> 32 per function, in slices so that long texts need little memory."""
    least = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), 2048):
        values = np.multiply.outer(a, shingles[i : i + 2048])
        values += b[:, None]
        values >>= np.uint64(32)
        np.minimum(least, values.min(axis=1), out=least)
    return least


def signatures(docs: DataFrame, words: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit digest of the set), tree_keys (TREES keys of DEPTH two-byte values)."""
    schema = "doc_id long, n_shingles long, set_key binary, tree_keys array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        a, b = _functions()
        for batch in sliced(batches):
            ids, texts = batch.column(0), batch.column(1)
            counts, keys, trees = [], [], []
            for text in texts:
                found = shingle_set(text.as_py(), words)
                counts.append(len(found))
                if len(found):
                    keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                    low = _minhash(found, a, b).astype(np.uint16).byteswap().tobytes()
                    trees.append([low[2 * DEPTH * t : 2 * DEPTH * (t + 1)] for t in range(TREES)])
                else:
                    keys.append(None)
                    trees.append(None)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(trees, pa.list_(pa.binary()))],
                ["doc_id", "n_shingles", "set_key", "tree_keys"],
            )

    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return picked.mapInArrow(run, schema)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (tree, key, rep) -> candidate links (a, b, weight) and the first and last row of the partition.

    A region is a run with a common prefix of MIN_DEPTH; rows are linked to the run's first. Beyond DENSE rows only
    runs with a common full key are linked, their weight being the run's length: it marks central documents.
    """
    width = 2 * MIN_DEPTH
    a: list[int] = []
    b: list[int] = []
    w: list[int] = []
    first = last = None
    region: bytes | None = None
    shallow: list[tuple[bytes, int]] = []  # the region's rows while it is not dense
    dense = False
    deep: bytes | None = None
    members: list[int] = []

    def close_deep():
        if len(members) > 1:
            a.extend(members)
            b.extend([members[0]] * len(members))
            w.extend([len(members)] * len(members))
        members.clear()

    def close_region():
        if dense:
            close_deep()
        elif len(shallow) > 1:
            a.extend(rep for _, rep in shallow[1:])
            b.extend([shallow[0][1]] * (len(shallow) - 1))
            w.extend([1] * (len(shallow) - 1))
        shallow.clear()

    def take(key: bytes, rep: int):
        nonlocal deep
        if key != deep:
            close_deep()
            deep = key
        members.append(rep)

    def out(edge_rows: list, links: list):
        n = len(a)
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array(a + [x[1] for x in links], pa.int64()),
                pa.array(b + [None] * len(links), pa.int64()),
                pa.array(w + [x[2] for x in links], pa.int64()),
                pa.array([None] * n + [x[0] for x in links], pa.binary()),
            ],
            ["a", "b", "weight", "edge_key"],
        )
        a.clear(), b.clear(), w.clear()
        return batch

    for batch in batches:
        trees, keys, reps = (batch.column(i).to_pylist() for i in range(3))
        for tree, key, rep in zip(trees, keys, reps):
            full = tree.to_bytes(1, "big") + key
            if first is None:
                first = (full, rep, 0)
            last = (full, rep, 1)
            prefix = full[: width + 1]
            if prefix != region:
                close_region()
                region, dense, deep = prefix, False, None
            if dense:
                take(full, rep)
                continue
            shallow.append((full, rep))
            if len(shallow) > DENSE:
                dense = True
                for k, r in shallow:
                    take(k, r)
                shallow.clear()
        if len(a) > 20_000:
            yield out(a, [])
    close_region()
    yield out(a, [first, last] if first is not None else [])


def candidate_links(reps: DataFrame) -> DataFrame:
    """Candidate links (a, b, weight) between representatives, from the sorted orders of all trees."""
    rows = reps.select(F.posexplode("tree_keys").alias("tree", "key"), F.col("rep"))
    order = ["tree", "key", "rep"]
    spread = rows.repartitionByRange(partitions(reps.sparkSession), *order).sortWithinPartitions(*order)
    found = spread.mapInArrow(_neighbours, "a long, b long, weight long, edge_key binary")
    found = staged(found.withColumn("part", F.spark_partition_id()), "forest")
    # a region cut by a partition's end: two rows per partition say where it goes on
    ends = found.where("edge_key is not null").select("part", F.col("weight").alias("side"), "edge_key", F.col("a").alias("rep"))
    line = Window.orderBy("part", "side")
    step = ends.select(
        "rep", "side", "edge_key", F.lag("edge_key").over(line).alias("before"), F.lag("rep").over(line).alias("other")
    )
    width = 2 * MIN_DEPTH + 1
    bridged = step.where((F.col("side") == 0) & (F.substring("before", 1, width) == F.substring("edge_key", 1, width)))
    links = found.where("edge_key is null").select("a", "b", "weight")
    return links.union(bridged.select(F.col("rep").alias("a"), F.col("other").alias("b"), F.lit(1).cast("long")))


def _compare(sets: list[np.ndarray], pivots: list[int], linked: Union, others: np.ndarray | None, threshold: tuple[int, int]) -> None:
    """Join pivots with every set they link with, by exact counts; ``others`` limits what they are compared with.

    Without ``others`` a pivot inside the largest linked set is passed over after the first HUBS: pairs inside that
    set change nothing, and every pair with a member outside is compared when that member is the pivot.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    num, den = threshold

    def compare(p: int) -> None:
        own = sets[p]
        at = np.searchsorted(own, flat)
        at[at == len(own)] = 0
        shared = np.add.reduceat((own[at] == flat).astype(np.int64), starts)
        near = den * shared >= num * (sizes + len(own) - shared)
        near[p] = False
        if others is not None:
            near &= others
        for q in np.flatnonzero(near):
            linked.join(p, int(q))

    waiting = list(pivots)
    lead = HUBS
    while waiting and linked.sets > 1:
        skipped = []
        for p in waiting:
            if others is None and lead <= 0 and linked.find(p) == linked.largest():
                skipped.append(p)
                continue
            lead -= 1
            compare(p)
            if linked.sets == 1:
                return
        if len(skipped) == len(waiting):
            return
        waiting = skipped


def _solver(words: int, threshold: tuple[int, int], across: bool):
    """Solve one block: rows (rep, role, text) -> links (a, b) of a spanning forest of the exact links.

    Roles: 0 member, 1 hub (compared first), 2 leftover (``across``: compared with the members of another block).
    """

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        roles = rows.column("role").to_numpy()
        order = np.argsort(-roles, kind="stable") if not across else np.argsort(roles, kind="stable")
        reps = rows.column("rep").to_numpy()[order]
        roles = roles[order]
        texts = rows.column("text")
        sets = [shingle_set(texts[int(i)].as_py(), words) for i in order]
        keep = [i for i, s in enumerate(sets) if len(s)]
        sets, reps, roles = [sets[i] for i in keep], reps[keep], roles[keep]
        linked = Union(len(sets))
        if across:
            pivots = [int(i) for i in np.flatnonzero(roles == 2)]
            others = roles == 0
        else:
            pivots, others = list(range(len(sets))), None
        if len(sets) > 1:
            _compare(sets, pivots, linked, others, threshold)
        pairs = [(int(reps[i]), int(reps[linked.find(i)])) for i in range(len(sets)) if linked.find(i) != i]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["a", "b"]
        )

    return solve


def _solved(rows: DataFrame, keys: list[str], words: int, threshold: tuple[int, int], across: bool = False) -> DataFrame:
    dealt = rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    body = by_group(keys, _solver(words, threshold, across))
    return dealt.select(*keys, "rep", "role", "text").mapInArrow(body, "a long, b long")


def _verified(docs: DataFrame, reps: DataFrame, links: DataFrame, words: int, threshold: tuple[int, int]) -> DataFrame:
    """(rep, component) for the representatives that truly link with others."""
    clusters = components(links, "candidates").withColumnRenamed("node", "rep").withColumnRenamed("component", "cluster")
    degree = links.groupBy(F.col("a").alias("rep")).agg(F.sum("weight").alias("degree"))
    members = staged(
        clusters.join(reps.select("rep", "n_shingles"), "rep").join(degree, "rep", "left").fillna(0, ["degree"]), "clusters"
    )
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("volume"))
    large = sizes.where((F.col("size") > BLOCK) | (F.col("volume") > BLOCK_SHINGLES)).select(
        "cluster",
        F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("volume") / BLOCK_SHINGLES)).cast("int").alias("blocks"),
    )
    large = staged(large, "large")
    n_large = large.count()
    members = sized_join(members, large, "cluster", "left", n_large)
    members = members.withColumn(
        "block", F.coalesce(F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")), F.lit(0).cast("long")).cast("int")
    ).withColumn("role", F.lit(0))
    with_text = staged(
        sized_join(docs.select(F.col("doc_id").alias("rep"), "text"), members, "rep", "inner"), "candidate-texts"
    )
    keys = ["cluster", "block"]
    if n_large == 0:
        return components(_solved(with_text, keys, words, threshold), "verified")
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("degree"), "rep"))
    hubs = members.where("blocks is not null").withColumn("place", rank).where(F.col("place") <= HUBS).select("rep")
    hub_rows = sized_join(with_text, hubs, "rep", "left_semi").withColumn("role", F.lit(1))
    # hubs go to every block but their own, where they already are: there their role is hub, too
    hub_rows = hub_rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    plain = sized_join(with_text, hubs, "rep", "left_anti")
    first = staged(_solved(plain.unionByName(hub_rows.select(*plain.columns)), keys, words, threshold), "blocks")
    joined = staged(components(first, "blocks-cc"), "blocks-components")
    # leftovers of a large cluster: outside its largest linked set; only they can have a link that no block saw
    state = (
        members.where("blocks is not null")
        .select("rep", "cluster", "blocks", "block")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
    )
    per = state.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("size"))
    main = per.groupBy("cluster").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
    left = sized_join(state, main, "cluster", "inner", n_large).where(F.col("component") != F.col("main"))
    left = staged(left.select("rep", "cluster", "blocks", "block"), "leftovers")
    counts = staged(left.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks")), "leftover-counts")
    n_left = counts.count()
    links_found = first
    if n_left:
        chunk = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("chunks").cast("long")).cast("int")
        ours = sized_join(with_text, left.select("rep"), "rep", "left_semi")
        ours = sized_join(ours, counts, "cluster", "inner", n_left).withColumn("chunk", chunk)
        # one leftover chunk meets every block of its cluster
        ours = ours.select("cluster", "rep", "text", "chunk", F.lit(2).alias("role"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        theirs = sized_join(with_text.where("blocks is not null"), counts, "cluster", "inner", n_left).select(
            "cluster", "rep", "text", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), "block"
        )
        tiles = ours.unionByName(theirs)
        links_found = first.union(_solved(tiles, ["cluster", "block", "chunk"], words, threshold, across=True))
    return components(links_found, "verified")


def near_duplicates(
    docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (80, 100), id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept, for every row of ``docs``.

    Two documents link when intersection / union of their shingle sets is at least threshold[0] / threshold[1].
    """
    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    signed = staged(signatures(picked, words), "signatures")
    reps = signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"),
        F.count(F.lit(1)).alias("copies"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("tree_keys").alias("tree_keys"),
    )
    reps = staged(reps, "classes")
    links = staged(candidate_links(reps), "links")
    found = staged(_verified(picked, reps, links, words, threshold), "found")
    # only classes with copies or links need their component looked up
    classes = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("component_id"), (F.col("component").isNotNull() | (F.col("copies") > 1)).alias("listed")
    )
    listed = staged(classes.where("listed").select("set_key", "component_id"), "listed")
    out = sized_join(signed.select("doc_id", "n_shingles", "set_key"), listed, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
