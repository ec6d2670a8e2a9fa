"""Best-fit packing of token sequences by hierarchical residual packing.

Texts are tokenised where they lie; only piece sizes move on. Pieces are dealt out one by one, so that every partition sees
all lengths even where the table is sorted by them, and every partition packs its pieces by best fit, longest first, in
chunks; its nearly full bins (free space below NEAR) are final. The underfull bins become items of the
next round: those of FAN chunks meet in one task, which packs them by best fit, and so on until one group is left. A
bin's place is the sum of the shifts along its way up, so pieces are never moved, only renumbered.

Memory: a task packs at most CHUNK pieces at a time. Best fit leaves at most one bin of a chunk or group half full or
less, and two bins over half full never fit together, so a round of FAN chunks makes fewer than FAN merges. Of bins
with the same fill it can therefore use FAN at most, and a chunk sends FAN for every round still to come; the others
couldn't merge in any round. A group thus holds at most FAN * (1 + FAN * rounds * capacity / 2) rows, where rounds is
the logarithm of the number of chunks to base FAN, and no merge is lost.

Edge cases: a null text is empty and gives one piece holding the end id; a null id is passed through; repeated rows
give repeated pieces; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsemark.llm.common import sized_join, sliced, staged

CAPACITY = 4096
END_ID = 1
NEAR = 32
FAN = 16
CHUNK = 1 << 18
DEAL = 1 << 14  # pieces a partition gets at least: enough for a tight local fit
CACHE_WORDS = 200_000  # per generation of the word cache; two are held
BATCH_CHARS = 1_000_000


class Tokens:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    The vocabulary encodes each word of its pre-tokenizer alone, so plain Latin texts are cut into those words here
    and looked up in a cache of encoded words. Any other text goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        latin = [chr(c) for c in range(0xA1, 0x250)]
        letters = "a-z" + "".join(c for c in latin if unicodedata.category(c)[0] == "L")
        numbers = "0-9" + "".join(c for c in latin if unicodedata.category(c)[0] == "N")
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")
        self.odd = re.compile("[^\t\n\r -~¡-įı-ɏ]|<\\|")
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode new words, many in one text; a group that doesn't come apart word by word is encoded singly."""
        if len(self.cache) > CACHE_WORDS:
            self.older, self.cache = self.cache, {}
        groups = [words[i : i + 500] for i in range(0, len(words), 500)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            found = np.array(e.ids, "<u4")
            ids = found.tobytes()
            cuts = [0, *(4 * (np.flatnonzero(self.ends_word[found]) + 1)).tolist()]
            if len(cuts) == len(group) + 1:
                self.cache.update(zip(group, (ids[x:y] for x, y in zip(cuts, cuts[1:]))))
            else:
                self.cache.update((w, self._whole(w)) for w in group)

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, in order."""
        low = 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high]) <= BATCH_CHARS):
                size += len(texts[high])
                high += 1
            part = texts[low:high]
            words = [None if self.odd.search(t) else self.words.findall(t.lower()) for t in part]
            cache, older = self.cache, self.older
            new: dict[str, None] = {}
            for found in words:
                for w in set(found or ()).difference(cache):
                    if w in older:
                        cache[w] = older[w]
                    else:
                        new[w] = None
            if new:
                self._learn(list(new))
                if self.cache is not cache:  # a new generation: bring over what this part needs
                    for found in words:
                        self.cache.update((w, cache[w]) for w in set(found or ()).difference(self.cache))
                    cache = self.cache
            for text, found in zip(part, words):
                yield self._whole(text) if found is None else b"".join([cache[w] for w in found])
            low = high


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids plus ``end_id``, cut only beyond ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = Tokens(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for batch in sliced(batches):
            rows: list[tuple] = []
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.encode_all(texts)):
                ids += end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    rows.append((doc, at // step, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, longest items first, and the fill of each bin.

    A bit mask of the free spaces in use finds the tightest bin that fits in one step.
    """
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    free: dict[int, list[int]] = {}
    mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, at = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = at, fill[at]
        fill[at] += size
        room -= size
        if room:
            free.setdefault(room, []).append(at)
            mask |= 1 << room
    return bins, offsets, fill


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to capacity) plus sequence_id and offset: gapless from 0 in each sequence."""
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    size_at = names.index("length")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        made = chunk = 0
        held: list[pa.RecordBatch] = []

        def solve():
            nonlocal made, chunk
            rows = pa.Table.from_batches(held).combine_chunks()
            at, offset, fill = best_fit(rows.column(size_at).to_numpy(), capacity)
            fills = np.array(fill, np.int64)
            made_here, made = made, made + len(fill)
            extra = [at + made_here + (part << 33), offset, fills[at], np.full(len(at), part), np.full(len(at), chunk), _places(fills)[at]]
            for name, column in zip(("sequence_id", "offset", "_fill", "_part", "_chunk", "_place"), extra):
                rows = rows.append_column(name, pa.array(column, pa.int64()))
            chunk += 1
            return rows.to_batches(max_chunksize=20_000)

        count = 0
        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                held.append(batch.slice(begin, CHUNK - count))
                begin += held[-1].num_rows
                count += held[-1].num_rows
                if count >= CHUNK:
                    yield from solve()
                    held, count = [], 0
        if count:
            yield from solve()

    schema = ", ".join(f"`{n}` {pieces.schema[n].dataType.simpleString()}" for n in names)
    pieces = staged(pieces.select(*names), "pieces")  # else a task would run two Python workers, one for the tokens
    count = pieces.count()
    dealt = max(1, -(-count // CHUNK), min(count // DEAL, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    placed = pieces.repartition(dealt).mapInArrow(local, f"{schema}, sequence_id long, offset long, _fill long, _part long, _chunk long, _place long")
    placed = staged(placed, "packed")

    last = placed.agg(F.max("_part").alias("part"), F.max("_chunk").alias("chunk")).first()
    width = 1 + (last.chunk or 0)
    groups = 0 if last.part is None else (last.part + 1) * width
    rounds = 0
    while FAN**rounds < groups:
        rounds += 1
    # every bin has one piece at offset 0
    bins = placed.where((F.col("offset") == 0) & (F.col("_fill") <= capacity - NEAR) & (F.col("_place") < FAN * rounds))
    bins = bins.select("sequence_id", F.col("_fill").alias("fill"), (F.col("_part") * width + F.col("_chunk")).alias("part"))
    moves: DataFrame | None = None
    for left in reversed(range(rounds)):
        level = staged(_round(bins, capacity, FAN * left), "round")
        step = level.select("sequence_id", "parent", "shift")
        if moves is None:
            moves = step
        else:
            up = step.select(F.col("sequence_id").alias("parent"), F.col("parent").alias("_up"), F.col("shift").alias("_more"))
            moves = moves.join(up, "parent", "left").select(
                "sequence_id", F.coalesce("_up", "parent").alias("parent"), (F.col("shift") + F.coalesce("_more", F.lit(0))).alias("shift")
            )
        bins = level.where("heir").select(F.col("parent").alias("sequence_id"), "fill", F.floor(F.col("part") / FAN).alias("part"))
    out = [F.col(n) for n in names]
    if moves is None:
        return placed.select(*out, "sequence_id", "offset")
    moved = staged(moves.where("parent != sequence_id or shift != 0"), "moves")
    joined = sized_join(placed, moved, "sequence_id", "left")
    return joined.select(
        *out, F.coalesce("parent", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
    )


def _places(fills: np.ndarray) -> np.ndarray:
    """Place of each bin among the bins of the same fill, from 0."""
    order = np.argsort(fills, kind="stable")
    ordered = fills[order]
    places = np.empty(len(fills), np.int64)
    places[order] = np.arange(len(fills)) - np.searchsorted(ordered, ordered, "left")
    return places


def _round(bins: DataFrame, capacity: int, keep: int) -> DataFrame:
    """One merge round: bins (sequence_id, fill, part) -> their parent and shift; ``heir`` marks bins that go on.

    At most ``keep`` bins of one fill go on: as many as later rounds can use.
    """

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        ids, fills, parts = (rows.column(n).to_numpy() for n in ("sequence_id", "fill", "part"))
        order = np.lexsort((ids, -fills))
        ids, fills = ids[order], fills[order]
        small = 2 * fills <= capacity
        used = np.flatnonzero(small | (_places(fills) < small.sum()))
        at, offset, found = best_fit(fills[used], capacity)
        parent, shift, fill = ids.copy(), np.zeros(len(ids), np.int64), fills.copy()
        least = np.full(len(found), np.iinfo(np.int64).max)
        np.minimum.at(least, at, ids[used])
        parent[used], shift[used], fill[used] = least[at], offset, np.array(found, np.int64)[at]
        going = np.flatnonzero((parent == ids) & (fill <= capacity - NEAR))
        heir = np.zeros(len(ids), bool)
        heir[going[_places(fill[going]) < keep]] = True
        return pa.table(
            {"sequence_id": ids, "parent": parent, "shift": shift, "fill": fill, "part": np.full(len(ids), int(parts.min())), "heir": heir}
        )

    grouped = bins.withColumn("_group", F.floor(F.col("part") / FAN)).groupBy("_group")
    return grouped.applyInArrow(merge, "sequence_id long, parent long, shift long, fill long, part long, heir boolean")
