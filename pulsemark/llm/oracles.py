"""SQL twins of the queries that SQL can state."""

from __future__ import annotations

from pulsemark.llm.credentials import ORACLE_SQL as SECRETS
from pulsemark.llm.decontaminate import ORACLE_SQL as DECONTAMINATION
from pulsemark.llm.lexical import ORACLE_SQL as RANKED

# links (a, b) in both directions -> smallest node reachable
_REACH = """
reach AS (SELECT a AS node, a AS seen FROM links UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen),
component AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"""

NEAR_DUPLICATES = (
    r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
spread AS (SELECT doc_id, w, least(len(w), 4) AS k, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS p FROM words WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, hash(array_to_string(w[p:p + k - 1], ' ')) AS sh FROM spread),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * shared.n >= 80 * (s.n + t.n - shared.n)),"""
    + _REACH
    + """
SELECT doc_id, coalesce(sizes.n, 0) AS n_shingles, least(coalesce(component, doc_id), doc_id) AS component_id,
  least(coalesce(component, doc_id), doc_id) = doc_id AS kept
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN component ON node = doc_id"""
)

EMBEDDINGS = (
    """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.98),"""
    + _REACH
    + """,
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(coalesce(component, vec_id), vec_id) AS component_id,
  least(coalesce(component, vec_id), vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN degrees ON a = vec_id LEFT JOIN component ON node = vec_id"""
)

ARCHIVE = """
WITH p AS (SELECT page_id, nullif(replace(replace(url, chr(13), '%0D'), chr(10), '%0A'), '') AS url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, strlen(html) AS n, sha256(html) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN coalesce(first, page_id) = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to, url AS target_uri
FROM d LEFT JOIN f ON f.digest = d.digest"""


def _crc_table() -> list[int]:
    """The byte table of crc32, from its polynomial."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


def _plus(label: str, cost: int | str, edits: str) -> str:
    """SQL for a label, nine digits of cost and then the audit, after further edits."""
    return f"(lpad(CAST(CAST(substr({label}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({label}, 10) || '{edits}')"


def _repair_sql() -> str:
    # states of the role pattern: 0 nothing yet, 1 after s, 2 after u, 3 after a
    inserted = f"""conv_id, i, l0 AS m0, l1 AS m1,
    least(l2, {_plus("l0", 5, "I")}, {_plus("l1", 5, "I")}, {_plus("l3", 5, "I")}) AS m2,
    least(l3, {_plus("l2", 5, "I")}, {_plus("l0", 10, "II")}, {_plus("l1", 10, "II")}) AS m3"""
    keep = lambda m, initial: f"CASE WHEN NOT must AND initial = '{initial}' THEN {_plus(m, 'extra', 'K')} END"
    rerole = lambda m: f"CASE WHEN NOT must THEN {_plus(m, '1 + extra', 'R')} END"
    return rf"""
WITH RECURSIVE crc AS (SELECT {_crc_table()} AS tab),
ids AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(id, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 20 AS kind FROM ids, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT conv_id, turn, role, text, substr(role, 1, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
judged AS (SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
flags AS (SELECT conv_id, turn, role, text, i, initial, blank, again AND NOT blank AS dup, cut AND NOT again AND NOT blank AS trunc,
    before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au') AS bad, blank OR again AS must,
    CASE WHEN cut AND NOT again AND NOT blank THEN 5 ELSE 0 END AS extra FROM judged),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS l0, CAST(NULL AS VARCHAR) AS l1, CAST(NULL AS VARCHAR) AS l2, CAST(NULL AS VARCHAR) AS l3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT m.conv_id, f.i, {_plus("m0", 2, "D")}, least({_plus("m1", 2, "D")}, {keep("m0", "s")}),
    least({_plus("m2", 2, "D")}, {keep("m0", "u")}, {keep("m1", "u")}, {keep("m3", "u")}, {rerole("m0")}, {rerole("m1")}, {rerole("m3")}),
    least({_plus("m3", 2, "D")}, {keep("m2", "a")}, {rerole("m2")})
  FROM (SELECT {inserted} FROM walk) m JOIN flags f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.i = m.i + 1),
ends AS (SELECT conv_id, max(i) AS n FROM walk GROUP BY conv_id),
best AS (SELECT w.conv_id, least(m0, m3) AS label FROM (SELECT {inserted} FROM walk) w JOIN ends ON ends.conv_id IS NOT DISTINCT FROM w.conv_id AND ends.n = w.i),
plans AS (SELECT conv_id, CAST(substr(label, 1, 9) AS BIGINT) AS cost, substr(label, 10) AS audit FROM best),
edits AS (SELECT conv_id, audit, k, substr(audit, k, 1) AS e FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM plans)),
steps AS (SELECT conv_id, k, e, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER w AS place,
    length(replace(audit, 'D', '')) % 2 AS odd FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
made AS (SELECT s.conv_id, k, CASE WHEN e = 'K' THEN role WHEN (place - 1 - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END AS role,
    CASE WHEN e = 'I' THEN '' ELSE text END AS text FROM steps s LEFT JOIN flags f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i AND e <> 'I' WHERE e <> 'D'),
texts AS (SELECT conv_id, string_agg(role || ':' || text, chr(10) ORDER BY k) AS whole FROM made GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(CASE WHEN blank THEN 1 ELSE 0 END) AS blank,
    sum(CASE WHEN dup THEN 1 ELSE 0 END) AS duplicate, sum(CASE WHEN trunc THEN 1 ELSE 0 END) AS truncated, sum(CASE WHEN bad THEN 1 ELSE 0 END) AS illegal FROM flags GROUP BY conv_id)
SELECT p.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM plans p LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id LEFT JOIN texts x ON x.conv_id IS NOT DISTINCT FROM p.conv_id"""


ORACLE = {
    "op2_embedding_near_dedup": EMBEDDINGS,
    "op8_warc_transactions": ARCHIVE,
    "op9_minhash_near_dedup": NEAR_DUPLICATES,
    "op10_benchmark_decontamination": DECONTAMINATION,
    "op11_secret_scan": SECRETS,
    "op12_ranked_search": RANKED,
    "op13_conversation_repair": _repair_sql(),
}
