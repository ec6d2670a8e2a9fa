"""Secret scan that links the parts of multipart credentials; built-in functions only.

Three base formats always count: ``assign`` (a password, secret, token or API key given a value), ``access`` (an access
identifier) and ``hex`` (a long run of hex digits). Three weak formats count only beside what they need: ``key_id`` (a named
identifier, or a short-lived access identifier) beside a secret, ``value`` (a long token of upper and lower case letters
and digits) beside an identifier, ``endpoint`` (a URL or a named host) beside both. Beside means in the same scope, a
stretch of text without a blank line, at most REACH code points apart. Weak parts that overlap a base part, or a weak part
of a surer kind, are not looked at.

Positions come from the texts between the matches, summed by a window over a document's few matches; the texts
themselves never move. Parts meet in an interval join on (row, scope, bucket of REACH code points). Parts of one kind don't
overlap, so a bucket holds a bounded number of them and no document makes all pairs of its parts.

Edge cases: a null text is empty and has no spans; every row, also of a repeated or null doc_id, gets a row of its own;
matches of one kind are leftmost and don't overlap, and a match that fails its length is dropped without another try;
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsemark.llm.common import staged

REACH = 300

_QUOTE = r"""["']?\x20*[:=]\x20*["']?"""


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# kind: pattern, in the order in which kinds are listed
BASE = {
    "assign": "(" + "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")" + _QUOTE + "([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
}
_NAMES = ("access_?key_?id", "key_?id", "client_?id", "tenant_?id", "account_?id", "user_?name", "login")
_HOSTS = ("endpoint", "hostname", "host", "server", "bucket")
WEAK = {
    "key_id": "(" + "|".join(_any_case(w) for w in _NAMES) + ")" + _QUOTE + r"([A-Za-z0-9._@-]{3,})|ASIA[A-Z0-9]{12,}",
    "endpoint": r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20"'<>]+|(""" + "|".join(_any_case(w) for w in _HOSTS) + ")" + _QUOTE + r"([A-Za-z0-9-]+[.][A-Za-z0-9.:/-]+)",
    "value": r"[A-Za-z0-9+/_-]{20,}",
}
BREAK = r"\n[\x20\t\r]*\n"
KINDS = [*BASE, *WEAK]
IDENTIFIERS, SECRETS = ("access", "key_id"), ("assign", "hex", "value")


def _holds(kind: str, hit: Column) -> Column:
    """Whether a match of the kind's pattern counts."""
    if kind == "assign":
        return F.char_length(F.regexp_extract(hit, BASE["assign"], 2)) >= 8
    if kind == "access":
        return F.char_length(hit) >= 16
    if kind == "value":
        return hit.rlike("[0-9]") & hit.rlike("[a-z]") & hit.rlike("[A-Z]")
    return F.lit(True)


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """(kind, place, gap before, length, holds, hit) of every match in a text, in order."""
    # zipped, so that both lists are made once per text; the text after the last match has no match
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, h: F.struct(F.char_length(g).alias("gap"), h.alias("hit")))
    part = lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("place"), x["gap"].alias("gap"), F.char_length(x["hit"]).alias("length"), _holds(kind, x["hit"]).alias("holds"), x["hit"].alias("hit")
    )
    return F.transform(F.filter(pairs, lambda x: x["hit"].isNotNull()), part)


def parts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id), and parts (row, kind, start, end, hit): matches that hold, and scope breaks."""
    nothing = F.array().cast("array<struct<kind:string,place:int,gap:int,length:int,holds:boolean,hit:string>>")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    here = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    # a weak kind is looked for only where what it needs may be
    identified = F.col("text").rlike(f"{BASE['access']}|{WEAK['key_id']}")
    base = [F.when(F.col("text").rlike(p), _matches(F.col("text"), k, p)).otherwise(nothing) for k, p in BASE.items()]
    weak = [_matches(F.col("text"), k, p) for k, p in [*WEAK.items(), ("break", BREAK)]]
    found = staged(here.select("row", "doc_id", F.concat(*base, F.when(identified, F.concat(*weak)).otherwise(nothing)).alias("parts")), "secret-parts")
    each = found.select("row", F.inline("parts"))
    done = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("length")).over(done)
    placed = each.withColumn("end", end).where("holds").select("row", "kind", (F.col("end") - F.col("length")).alias("start"), "end", "hit")
    return found.select("row", "doc_id"), placed


def _buckets(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / REACH), F.floor(high / REACH)))


def _rank(kind: str | Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col(kind) if isinstance(kind, str) else kind)


def linked(found: DataFrame) -> DataFrame:
    """Weak parts (row, kind, start, end, hit) that count: clear of surer parts and beside what they need."""
    weak_rows = found.where(F.col("kind").isin(*WEAK)).select("row").distinct()
    near = found.join(weak_rows, "row", "left_semi")
    in_order = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    scope = F.sum((F.col("kind") == "break").cast("long")).over(in_order)
    near = staged(near.withColumn("scope", scope).where("kind != 'break'").withColumn("rank", _rank("kind")), "secret-scopes")
    weak = near.where(F.col("kind").isin(*WEAK))

    def other(rows: DataFrame) -> DataFrame:
        return rows.select("row", "scope", F.col("kind").alias("kind2"), F.col("rank").alias("rank2"), F.col("start").alias("start2"), F.col("end").alias("end2"), _buckets(F.col("start"), F.col("end")).alias("bucket"))

    key = ["row", "scope", "bucket"]
    touching = (F.col("rank2") < F.col("rank")) & (F.col("start2") < F.col("end")) & (F.col("start") < F.col("end2"))
    hidden = weak.withColumn("bucket", _buckets(F.col("start"), F.col("end"))).join(other(near), key).where(touching).select("row", "kind", "start").distinct()
    clear = staged(near.join(hidden, ["row", "kind", "start"], "left_anti"), "secret-clear")
    seek = clear.where(F.col("kind").isin(*WEAK)).withColumn("bucket", _buckets(F.col("start") - REACH, F.col("end") + REACH))
    beside = (F.col("start2") - F.col("end") <= REACH) & (F.col("start") - F.col("end2") <= REACH)
    met = seek.join(other(clear.where(F.col("kind") != "endpoint")), key).where(beside)
    roles = met.groupBy("row", "kind", "start", "end", "hit").agg(
        F.max(F.col("kind2").isin(*IDENTIFIERS)).alias("identifier"), F.max(F.col("kind2").isin(*SECRETS)).alias("secret")
    )
    needs = F.when(F.col("kind") == "key_id", F.col("secret")).when(F.col("kind") == "value", F.col("identifier")).otherwise(F.col("identifier") & F.col("secret"))
    return roles.where(needs).select("row", "kind", "start", "end", "hit")


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id) of ``docs``, and the spans found in them (row, kind, start, end, hit)."""
    rows, found = parts(docs)
    found = staged(found, "secret-found")
    return rows, found.where(F.col("kind").isin(*BASE)).unionByName(linked(found))


def find(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans), spans (all of them)."""
    rows, found = spans(docs)
    span = F.struct("start", _rank("kind").alias("rank"), "end", "kind")
    every = rows.select("row", "doc_id", F.lit(None).cast("struct<start:bigint,rank:bigint,end:bigint,kind:string>").alias("span"))
    every = every.unionByName(found.select("row", span.alias("span")), allowMissingColumns=True)
    listed = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list("span")).alias("found"))
    written = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return listed.select(
        "doc_id", *[of(k) for k in BASE], F.sha2(written(F.filter("found", lambda s: s["rank"] <= len(BASE))), 256).alias("base_sha256"), written(F.col("found")).alias("spans")
    )


def _oracle() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    holds = {
        "assign": f"length(regexp_extract(hit, {quoted(BASE['assign'])}, 2)) >= 8",
        "access": "length(hit) >= 16",
        "value": "regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]')",
    }
    kinds = {**BASE, **WEAK, "break": BREAK}
    # lists are unnested beside their places; the text after the last match has no match
    matches = "\nUNION ALL ".join(
        f"SELECT row, kind, rank, hit, ends - length(hit) AS start, ends AS stop FROM (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY row ORDER BY place) AS ends FROM ("
        f"SELECT row, '{k}' AS kind, {i} AS rank, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(range(1, len(hits) + 1)) AS place "
        f"FROM (SELECT row, regexp_extract_all(text, {quoted(p)}) AS hits, string_split_regex(text, {quoted(p)}) AS gaps FROM d) WHERE len(hits) > 0)) WHERE {holds.get(k, 'true')}"
        for i, (k, p) in enumerate(kinds.items(), 1)
    )
    weak, ids, secrets = (", ".join(f"'{k}'" for k in ks) for ks in (WEAK, IDENTIFIERS, SECRETS))
    base = ", ".join(f"'{k}'" for k in BASE)
    text = "kind || ':' || CAST(start AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY start, rank, stop"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({matches}),
scoped AS (SELECT *, sum(CASE WHEN kind = 'break' THEN 1 ELSE 0 END) OVER (PARTITION BY row ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS scope FROM found),
part AS (SELECT * FROM scoped WHERE kind <> 'break'),
hidden AS (SELECT DISTINCT w.row, w.kind, w.start FROM part w JOIN part o ON o.row = w.row AND o.rank < w.rank AND o.start < w.stop AND w.start < o.stop WHERE w.kind IN ({weak})),
clear AS (SELECT p.* FROM part p LEFT JOIN hidden h ON h.row = p.row AND h.kind = p.kind AND h.start = p.start WHERE h.row IS NULL),
met AS (SELECT w.row, w.kind, w.rank, w.start, w.stop, max(CASE WHEN o.kind IN ({ids}) THEN 1 ELSE 0 END) AS identifier, max(CASE WHEN o.kind IN ({secrets}) THEN 1 ELSE 0 END) AS secret
  FROM clear w JOIN clear o ON o.row = w.row AND o.scope = w.scope AND o.start - w.stop <= {REACH} AND w.start - o.stop <= {REACH}
  WHERE w.kind IN ({weak}) AND o.kind <> 'endpoint' GROUP BY ALL),
spans AS (SELECT row, kind, rank, start, stop FROM found WHERE kind IN ({base})
  UNION ALL SELECT row, kind, rank, start, stop FROM met
  WHERE CASE kind WHEN 'key_id' THEN secret WHEN 'value' THEN identifier ELSE identifier * secret END = 1),
listed AS (SELECT row, {", ".join(f"sum(CASE WHEN kind = '{k}' THEN 1 ELSE 0 END) AS n_{k}" for k in BASE)},
  string_agg({text}) FILTER (WHERE kind IN ({base})) AS based, string_agg({text}) AS spans FROM spans GROUP BY row)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in BASE)}, sha256(coalesce(based, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed ON listed.row = d.row"""


ORACLE_SQL = _oracle()
