"""Conversation repair: bidirectional Dijkstra over the lattice of edits.

A node of the lattice is (rows consumed, state of the role pattern ``(s?(ua)+)?``). Keep, Rerole and Delete consume a
row, Insert adds an empty turn. A forward heap from the start and a reverse heap from the accepting ends meet; the search
goes on until no crossing of equal cost can be open, and of all cheapest crossings the least concatenated audit is taken.
Equal-cost audits that end at one node are never prefixes of each other (they consume the same rows, and an insertion has
its price), so the least audit can be kept per node.

A conversation of at most LONG rows is repaired by one task, in stretches of BLOCK rows: each stretch gives the cheapest
edits between every two pattern states, and stretches are joined at their states. Longer ones take the same stretches
over many tasks: positions come from a split sort, stretches are solved side by side, two passes that stream one row per
stretch join them, and repaired turns are made per stretch. Only the hash of a conversation's whole text runs through one
task, which streams it.

Edge cases: null role or text is one space (a blank row); null turns come first and are left out of gaps; rows of one turn
are ordered by role, then text; a null conv_id is a conversation of its own; an empty or unknown role is legal only when
reroled; repeated rows are duplicates; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsemark.functions.ordered import with_order
from pulsemark.llm.common import by_group, staged

BLOCK = 256  # rows of a stretch of the lattice
LONG = 4096  # rows above which a conversation is repaired over many tasks
DAMAGES = 20

_KEEP, _REROLE, _DELETE, _INSERT, _CUT = 0, 1, 2, 5, 5
_STATES = 4  # nothing yet, after s, after u, after a
_ENDS = (0, 3)
_NEXT = (2, 2, 3, 2)  # state after the one turn of user or assistant that the pattern takes next
_AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_NOWHERE = (None,) * _STATES
_SPACE = " \t\n\v\f\r"

Row = tuple[str, bool, bool]  # role initial, must go, cut short
Found = tuple[int, str]


def _ahead(rows: list[Row], node: int, tail: bool) -> Iterator[tuple[int, int, str]]:
    at, state = divmod(node, _STATES)
    if at < len(rows):
        initial, must_go, cut = rows[at]
        yield node + _STATES, _DELETE, "D"
        base = (at + 1) * _STATES
        if not must_go:
            extra = _CUT if cut else 0
            kept = _AFTER.get(initial, _NOWHERE)[state]
            if kept is not None:
                yield base + kept, _KEEP + extra, "K"
            yield base + _NEXT[state], _REROLE + extra, "R"
    if tail or at < len(rows):
        yield at * _STATES + _NEXT[state], _INSERT, "I"


def _behind(rows: list[Row], node: int, tail: bool) -> Iterator[tuple[int, int, str]]:
    at, state = divmod(node, _STATES)
    if at:
        initial, must_go, cut = rows[at - 1]
        yield node - _STATES, _DELETE, "D"
        base = (at - 1) * _STATES
        if not must_go:
            extra = _CUT if cut else 0
            kept = _AFTER.get(initial, _NOWHERE)
            for before in range(_STATES):
                if kept[before] == state:
                    yield base + before, _KEEP + extra, "K"
                if _NEXT[before] == state:
                    yield base + before, _REROLE + extra, "R"
    if tail or at < len(rows):
        for before in range(_STATES):
            if _NEXT[before] == state:
                yield at * _STATES + before, _INSERT, "I"


def search(rows: list[Row], start: int, ends: tuple[int, ...], tail: bool) -> Found | None:
    """Cheapest (cost, least audit) from pattern state ``start`` to one of ``ends``; ``tail`` allows inserts at the end."""
    first, lasts = start, [len(rows) * _STATES + e for e in ends]
    ahead: dict[int, Found] = {first: (0, "")}
    behind: dict[int, Found] = {v: (0, "") for v in lasts}
    best = 0 if first in behind else None
    # zero-cost edges only move along rows, so equal costs are settled in row order (reverse: against it)
    fronts = [[(0, first)], [(0, -v) for v in lasts]]
    heapq.heapify(fronts[1])
    done: tuple[set[int], set[int]] = (set(), set())
    while fronts[0] and fronts[1]:
        low = fronts[0][0][0] + fronts[1][0][0]
        if best is not None and low > best and done[0] and done[1]:
            break
        side = 0 if not done[0] else 1 if not done[1] else int(fronts[1][0][0] < fronts[0][0][0])
        cost, node = heapq.heappop(fronts[side])
        node = abs(node)
        if node in done[side]:
            continue
        done[side].add(node)
        mine, other = (ahead, behind) if side == 0 else (behind, ahead)
        audit = mine[node][1]
        for to, price, edit in (_ahead if side == 0 else _behind)(rows, node, tail):
            label = (cost + price, audit + edit if side == 0 else edit + audit)
            if to not in mine or label < mine[to]:
                mine[to] = label
                heapq.heappush(fronts[side], (label[0], to if side == 0 else -to))
            if to in other:
                met = mine[to][0] + other[to][0]
                best = met if best is None or met < best else best
    if best is None:
        return None
    crossings = [ahead[v][1] + behind[v][1] for v in ahead.keys() & behind.keys() if ahead[v][0] + behind[v][0] == best]
    for node in done[0]:
        cost, audit = ahead[node]
        for to, price, edit in _ahead(rows, node, tail):
            if to in done[1] and cost + price + behind[to][0] == best:
                crossings.append(audit + edit + behind[to][1])
    return best, min(crossings)


def stretch(rows: list[Row], last: bool) -> list[Found | None]:
    """Cheapest edits of a stretch between every two states, row by row of the matrix."""
    return [search(rows, q, (r,), last) for q in range(_STATES) for r in range(_STATES)]


def _onward(costs: list[int | None], to_go: list[int | None]) -> list[int | None]:
    """Cheapest cost from each state before a stretch to the end, given the costs after it."""
    out: list[int | None] = []
    for q in range(_STATES):
        sums = [costs[q * _STATES + r] + to_go[r] for r in range(_STATES) if costs[q * _STATES + r] is not None and to_go[r] is not None]
        out.append(min(sums, default=None))
    return out


def _choose(states: list[int], costs: list[int | None], audits: list[str | None], to_go: list[int | None], total: list[int | None]) -> tuple[str, list[int]]:
    """Least audit of a stretch on a cheapest way, and the states it may end in."""
    found: dict[str, set[int]] = {}
    for q in states:
        for r in range(_STATES):
            k = q * _STATES + r
            if costs[k] is not None and to_go[r] is not None and costs[k] + to_go[r] == total[q]:
                found.setdefault(audits[k], set()).add(r)
    audit = min(found)
    return audit, sorted(found[audit])


_DONE = [0 if q in _ENDS else None for q in range(_STATES)]


def repair_rows(rows: list[Row]) -> Found:
    """Cost and audit of one conversation's rows."""
    if len(rows) <= BLOCK:
        return search(rows, 0, _ENDS, True)
    parts = [rows[i : i + BLOCK] for i in range(0, len(rows), BLOCK)]
    found = [stretch(p, k == len(parts) - 1) for k, p in enumerate(parts)]
    costs = [[None if f is None else f[0] for f in s] for s in found]
    after = [_DONE]
    for c in reversed(costs):
        after.append(_onward(c, after[-1]))
    after.reverse()
    audits, states = [], [0]
    for k, s in enumerate(found):
        audit, states = _choose(states, costs[k], [None if f is None else f[1] for f in s], after[k + 1], after[k])
        audits.append(audit)
    return after[0][0], "".join(audits)


def turns(audit: str, odd: bool, first: int, rows: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Repaired (role, text) of a stretch; ``first`` turns stand before it, ``odd`` when the whole count of turns is odd."""
    at, place = 0, first
    for edit in audit:
        if edit != "I":
            role, text = rows[at]
            at += 1
        if edit == "D":
            continue
        due = "user" if (place - odd) % 2 == 0 else "assistant"
        yield (role, text) if edit == "K" else (due, text) if edit == "R" else (due, "")
        place += 1


def _cut(text: str) -> bool:
    return text.rstrip(_SPACE)[-1:] not in (".", "!", "?")


def faults(rows: list[tuple[str, str]]) -> tuple[list[Row], int, int, int]:
    """Rows of the lattice, and how many are blank, duplicate and truncated."""
    seen: set[tuple[str, str]] = set()
    out, blank, duplicate, truncated = [], 0, 0, 0
    for role, text in rows:
        mark = (role, text)
        empty = not text.strip(_SPACE)
        again = not empty and mark in seen
        cut = not empty and not again and _cut(text)
        seen.add(mark)
        blank += empty
        duplicate += again
        truncated += cut
        out.append((role[:1], empty or again, cut))
    return out, blank, duplicate, truncated


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_FIELDS = [pa.field(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in [x.split()[0] for x in _COUNTS.split(", ")]]


def _solve(group: pa.Table) -> Iterator[pa.RecordBatch]:
    kept = group.filter(group.column("present"))
    pairs = list(zip(kept.column("role").to_pylist(), kept.column("text").to_pylist()))
    times = [t for t in kept.column("turn").to_pylist() if t is not None]
    rows, blank, duplicate, truncated = faults(pairs)
    illegal = sum(not _legal(a[0], b[0]) for a, b in zip(rows, rows[1:]))
    cost, audit = repair_rows(rows)
    odd = sum(e != "D" for e in audit) % 2 == 1
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns(audit, odd, 0, pairs)).encode("utf-8", "surrogatepass"))
    gaps = max(times) - min(times) + 1 - len(set(times)) if times else 0
    values = [gaps, blank, duplicate, truncated, illegal, cost, audit, digest.hexdigest()]
    columns = [pa.array([group.column("conv_key")[0].as_py()]), *[pa.array([v], f.type) for v, f in zip(values, _FIELDS)]]
    yield pa.RecordBatch.from_arrays(columns, names=["conv_key", *[f.name for f in _FIELDS]])


def conversation_key(column: str = "conv_id") -> Column:
    """Text that is never null and differs for a null id and any id."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def prepared(rows: DataFrame) -> DataFrame:
    """conv_key, turn, role, text, present: rows with nulls as one space."""
    return rows.select(
        conversation_key().alias("conv_key"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        F.lit(True).alias("present"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with repeatable faults: by crc32 of ``conv_id:turn`` modulo 20, 0 drops a row, 1 empties its text, 2 removes
    its sentence ends, 3 repeats it, 4 makes it the user's. ``present`` is false where a row was dropped."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % DAMAGES
    out = rows.select(
        conversation_key().alias("conv_key"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(part("role")).alias("role"),
        F.when(kind == 0, F.lit(None)).when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text")).alias("text"),
        (kind != 0).alias("present"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return out.drop("copy")


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conv_key of ``rows`` (as from ``prepared`` or ``damaged``): fault counts, cost, audit, hash of the result."""
    size = F.sum(F.col("present").cast("long"))
    long = staged(rows.groupBy("conv_key").agg(size.alias("size")).where(F.col("size") > LONG).select("conv_key"), "long-conversations")
    if long.isEmpty():
        return _short(rows)
    return _short(rows.join(long, "conv_key", "left_anti")).unionByName(_long(rows.join(long, "conv_key", "left_semi")))


def _short(rows: DataFrame) -> DataFrame:
    ordered = rows.repartition("conv_key").sortWithinPartitions("conv_key", "turn", "role", "text")
    return ordered.mapInArrow(by_group(["conv_key"], _solve), f"conv_key string, {_COUNTS}")


# ---- conversations over many tasks


def _blocks(group: pa.Table) -> Iterator[pa.RecordBatch]:
    rows = list(zip(*[group.column(c).to_pylist() for c in ("initial", "must_go", "cut")]))
    found = stretch(rows, group.column("last")[0].as_py())
    arrays = [
        pa.array([group.column("conv_key")[0].as_py()]),
        pa.array([group.column("block")[0].as_py()], pa.int64()),
        pa.array([[None if f is None else f[0] for f in found]], pa.list_(pa.int64())),
        pa.array([[None if f is None else f[1] for f in found]], pa.list_(pa.string())),
    ]
    yield pa.RecordBatch.from_arrays(arrays, names=["conv_key", "block", "costs", "audits"])


def _sweep_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs to the end before and after each stretch; stretches come last first."""
    key, after = None, _DONE
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["conv_key"] != key:
                key, after = r["conv_key"], _DONE
            before = _onward(r["costs"], after)
            out.append({"conv_key": key, "block": r["block"], "total": before, "to_go": after})
            after = before
        schema = pa.schema([("conv_key", pa.string()), ("block", pa.int64()), ("total", pa.list_(pa.int64())), ("to_go", pa.list_(pa.int64()))])
        yield pa.RecordBatch.from_pylist(out, schema)


def _sweep_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of each stretch; stretches come in order."""
    key, states = None, [0]
    for batch in batches:
        out = []
        for at in range(batch.num_rows):
            r = batch.slice(at, 1).to_pylist()[0]
            if r["conv_key"] != key:
                key, states, cost = r["conv_key"], [0], r["total"][0]
            audit, states = _choose(states, r["costs"], r["audits"], r["to_go"], r["total"])
            out.append({"conv_key": key, "block": r["block"], "cost": cost, "audit": audit})
        schema = pa.schema([("conv_key", pa.string()), ("block", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
        yield pa.RecordBatch.from_pylist(out, schema)


def _block_turns(group: pa.Table) -> Iterator[pa.RecordBatch]:
    audit, odd, first = (group.column(c)[0].as_py() for c in ("audit", "odd", "first"))
    pairs = list(zip(group.column("role").to_pylist(), group.column("text").to_pylist()))
    out = list(turns(audit, odd, first, pairs))
    arrays = [
        pa.array([group.column("conv_key")[0].as_py()] * len(out), pa.string()),
        pa.array(range(first, first + len(out)), pa.int64()),
        pa.array([r for r, _ in out], pa.string()),
        pa.array([t for _, t in out], pa.string()),
    ]
    yield pa.RecordBatch.from_arrays(arrays, names=["conv_key", "place", "role", "text"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's turns, which come in order; nothing but the state of the hash is held."""
    key, digest = None, None
    names = ["conv_key", "repaired_sha256"]
    for batch in batches:
        for at in range(batch.num_rows):
            now, role, text = (batch.column(c)[at].as_py() for c in (0, 2, 3))
            if now != key:
                if key is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=names)
                key, digest = now, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=names)


def _grouped(df: DataFrame, solve, schema: str, order: list[str]) -> DataFrame:
    return df.repartition("conv_key", "block").sortWithinPartitions("conv_key", "block", *order).mapInArrow(by_group(["conv_key", "block"], solve), schema)


def _long(rows: DataFrame) -> DataFrame:
    here = rows.where("present").drop("present").withColumn("tie", F.monotonically_increasing_id())
    here = staged(here, "long-rows")
    initial = F.substring("role", 1, 1)
    placed = with_order(here, ["conv_key"], ["turn", "role", "text", "tie"], prefix={"pos": F.lit(1)}, prev={"before": initial}, nxt={"after": F.lit(1)})
    digest = F.sha2(F.col("text"), 256)
    placed = staged(placed.withColumn("pos", F.col("pos").cast("long")).withColumn("digest", digest), "long-placed")
    earliest = placed.groupBy("conv_key", "role", "digest").agg(F.min("pos").alias("earliest"))
    marked = placed.join(earliest, ["conv_key", "role", "digest"])
    empty = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    again = ~empty & (F.col("pos") > F.col("earliest"))
    cut = ~empty & ~again & ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    marked = staged(
        marked.select(
            "conv_key", "turn", "role", "text", "pos", F.expr(f"pos div {BLOCK}").alias("block"), initial.alias("initial"), (empty | again).alias("must_go"), cut.alias("cut"),
            F.col("after").isNull().alias("end"), empty.alias("empty"), again.alias("again"),
            (F.col("before").isNotNull() & ~F.concat("before", initial).isin("su", "ua", "au")).alias("illegal"),
        ),
        "long-marked",
    )
    total = lambda c: F.sum(F.col(c).cast("long"))
    counts = marked.groupBy("conv_key").agg(
        total("empty").alias("blank"), total("again").alias("duplicate"), total("cut").alias("truncated"), total("illegal").alias("illegal"),
        F.min("turn").alias("low"), F.max("turn").alias("high"),
    )
    seen = marked.where("turn is not null").select("conv_key", "turn").distinct().groupBy("conv_key").agg(F.count("turn").alias("seen"))
    last = marked.where("end").select("conv_key", F.col("block").alias("end_block"))
    flags = marked.select("conv_key", "block", "pos", "initial", "must_go", "cut").join(last, "conv_key").withColumn("last", F.col("block") == F.col("end_block"))
    blocks = staged(_grouped(flags, _blocks, "conv_key string, block long, costs array<long>, audits array<string>", ["pos"]), "long-blocks")
    back = blocks.select("conv_key", "block", "costs").repartition("conv_key").sortWithinPartitions("conv_key", F.col("block").desc())
    back = staged(back.mapInArrow(_sweep_back, "conv_key string, block long, total array<long>, to_go array<long>"), "long-costs")
    on = blocks.join(back, ["conv_key", "block"]).select("conv_key", "block", "costs", "audits", "total", "to_go")
    on = on.repartition("conv_key").sortWithinPartitions("conv_key", "block").mapInArrow(_sweep_on, "conv_key string, block long, cost long, audit string")
    on = on.withColumn("kept", F.char_length(F.translate("audit", "D", "")).cast("long"))
    on = staged(with_order(on, ["conv_key"], ["block"], prefix={"first": F.col("kept")}, total={"whole": F.col("kept")}), "long-audits")
    audits = on.groupBy("conv_key").agg(
        F.first("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit")
    )
    plan = on.select("conv_key", "block", "audit", F.col("first").cast("long").alias("first"), (F.col("whole") % 2 == 1).alias("odd"))
    made = marked.select("conv_key", "block", "pos", "role", "text").join(plan, ["conv_key", "block"])
    made = _grouped(made, _block_turns, "conv_key string, place long, role string, text string", ["pos"])
    hashes = made.repartition("conv_key").sortWithinPartitions("conv_key", "place").mapInArrow(_hashed, "conv_key string, repaired_sha256 string")
    out = counts.join(seen, "conv_key", "left").join(audits, "conv_key").join(hashes, "conv_key", "left")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("seen"), F.lit(0).cast("long"))
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_key", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )


def report(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``repaired`` under the original conv_id, one row per distinct id of ``conversations``.

    ``rows`` are the prepared rows to repair, by default those of ``conversations``.
    """
    kind = conversations.schema["conv_id"].dataType
    done = repaired(prepared(conversations) if rows is None else rows)
    conv_id = F.when(F.col("conv_key") != "", F.expr("substring(conv_key, 2)").cast(kind))
    return done.select(conv_id.alias("conv_id"), *[f.name for f in _FIELDS])
