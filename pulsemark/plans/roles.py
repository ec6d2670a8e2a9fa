"""Roles the driver tables play, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsemark.functions.ordered import hot_keys, with_order, with_position
from pulsemark.plans.registry import table

MATCH_WINDOW_MS = 86_400_000  # near the spacing of a user's notes, so islands stay short as users grow


def epoch_ms(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1000).cast("long")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def hot_users(spark: SparkSession, sf: str) -> DataFrame | None:
    """Hot series of every role keyed by user_id, found by one count over the raw table."""
    return hot_keys(events(spark, sf).select(F.col("user_id").alias("series_id")), ["series_id"])


BUTTON_OF = {"click": 1, "view": 2, "purchase": 4, "signup": 8, "error": 0}


def frames(spark: SparkSession, sf: str, hot) -> DataFrame:
    """Raw frame stream per user: dense index, ms deltas, button bits, sentinel rows."""
    ms = epoch_ms(F.col("ts"))
    button = F.lit(0)
    for kind, bit in BUTTON_OF.items():
        button = F.when(F.col("event_type") == kind, bit).otherwise(button)
    base = events(spark, sf).select(
        F.col("user_id").alias("series_id"), "ts", "event_id", ms.alias("ms"), button.alias("keys"), "value"
    )
    placed = with_order(
        base, ["series_id"], ["ts", "event_id"], prefix={"frame_idx": F.lit(1)}, prev={"_p": F.col("ms")}, hot=hot
    )
    delta = F.when(F.col("value") < 0.05, -12345).otherwise(F.col("ms") - F.coalesce(F.col("_p"), F.lit(0)))
    return placed.select("series_id", F.col("frame_idx").cast("long"), delta.cast("long").alias("time_delta_ms"), "keys")


FRAMES_SQL = """frames AS (
  SELECT user_id AS series_id, row_number() OVER w - 1 AS frame_idx,
         CASE WHEN value < 0.05 THEN -12345
              ELSE epoch_us(ts)//1000 - coalesce(lag(epoch_us(ts)//1000) OVER w, 0) END AS time_delta_ms,
         CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 8 ELSE 0 END AS keys
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""

TIMED_SQL = (
    FRAMES_SQL
    + """,
timed AS (
  SELECT *, sum(time_delta_ms) OVER (PARTITION BY series_id ORDER BY frame_idx)::BIGINT AS abs_ms
  FROM frames WHERE time_delta_ms <> -12345),
stepped AS (
  SELECT *, coalesce(lag(keys) OVER (PARTITION BY series_id ORDER BY frame_idx), 0) AS prev_keys FROM timed),
presses AS (
  SELECT series_id, frame_idx, abs_ms AS press_ms, b AS button,
         row_number() OVER (PARTITION BY series_id ORDER BY abs_ms, b, frame_idx) - 1 AS press_idx
  FROM (SELECT *, unnest([1,2,4,8]) AS b FROM stepped) WHERE (keys & b) <> 0 AND (prev_keys & b) = 0)"""
)


def presses_notes(spark: SparkSession, sf: str, hot) -> tuple[DataFrame, DataFrame]:
    """Clicks as presses and views as notes, one series per user: more data means more series."""
    base = events(spark, sf).select(
        F.col("user_id").alias("series_id"), "ts", "event_id", epoch_ms(F.col("ts")).alias("ms"), "event_type"
    )

    def side(kind: str, index: str, time: str) -> DataFrame:
        rows = with_position(base.where(F.col("event_type") == kind), ["series_id"], ["ts", "event_id"], index, hot)
        return rows.select("series_id", index, F.col("ms").alias(time), F.col("event_id").alias("frame_idx"))

    return side("click", "press_idx", "press_ms"), side("view", "note_idx", "note_ms").drop("frame_idx")


MATCH_SQL = """presses AS (
  SELECT user_id AS series_id, epoch_us(ts)//1000 AS press_ms, event_id AS frame_idx,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS press_idx
  FROM events WHERE event_type = 'click'),
notes AS (
  SELECT user_id AS series_id, epoch_us(ts)//1000 AS note_ms,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS note_idx
  FROM events WHERE event_type = 'view')"""


def chain_sql(window: int, tag: str = "", presses: str = "presses", notes: str = "notes") -> str:
    """CTEs pairs, chain and longest: the best chain of non-crossing pairs by its length and last pair."""
    return f"""pairs{tag} AS (SELECT p.series_id, press_idx AS p, note_idx AS n, abs(press_ms - note_ms) AS c
              FROM {presses} p JOIN {notes} n ON p.series_id = n.series_id AND abs(press_ms - note_ms) <= {window}),
    chain{tag} AS (
      SELECT series_id, 1::BIGINT AS k, p, n, c AS cost FROM pairs{tag}
      UNION ALL
      SELECT q.series_id, z.k + 1 AS k, q.p, q.n, min(z.cost) + min(q.c) AS cost
      FROM chain{tag} z JOIN pairs{tag} q ON q.series_id = z.series_id AND q.p > z.p AND q.n > z.n
      GROUP BY q.series_id, z.k, q.p, q.n),
    longest{tag} AS (SELECT series_id, max(k) AS k FROM chain{tag} GROUP BY series_id)"""


def walk_sql(window: int, tag: str = "", presses: str = "presses", notes: str = "notes") -> str:
    """``chain_sql`` and the walk back from the best end: matched and indexed; equal costs go to the smaller press, then note."""
    return chain_sql(window, tag, presses, notes) + f""",
    walk{tag} AS (
      SELECT series_id, k, x.p AS p, x.n AS n, x.cost AS cost FROM
        (SELECT c.series_id, c.k, min(struct_pack(cost := cost, p := p, n := n)) AS x
         FROM chain{tag} c JOIN longest{tag} l ON l.series_id = c.series_id AND l.k = c.k GROUP BY c.series_id, c.k)
      UNION ALL
      SELECT series_id, k, x.p, x.n, x.cost FROM
        (SELECT w.series_id, c.k, min(struct_pack(p := c.p, n := c.n, cost := c.cost)) AS x
         FROM walk{tag} w JOIN pairs{tag} q ON q.series_id = w.series_id AND q.p = w.p AND q.n = w.n
         JOIN chain{tag} c ON c.series_id = w.series_id AND c.k = w.k - 1 AND c.p < w.p AND c.n < w.n AND c.cost = w.cost - q.c
         GROUP BY w.series_id, c.k)),
    matched{tag} AS (SELECT w.series_id, w.n AS note_idx, note_ms, w.p AS press_idx, press_ms, frame_idx FROM walk{tag} w
      JOIN {presses} p ON p.series_id = w.series_id AND press_idx = w.p
      JOIN {notes} n ON n.series_id = w.series_id AND note_idx = w.n),
    indexed{tag} AS (SELECT n.series_id, n.note_idx, (press_ms - n.note_ms)::DOUBLE AS residual, frame_idx
      FROM {notes} n LEFT JOIN matched{tag} m ON m.series_id = n.series_id AND m.note_idx = n.note_idx)"""


def residuals_events(spark: SparkSession, sf: str, hot) -> DataFrame:
    """R1: one residual per event of a user, missing for errors; frame_idx is the event's minute (reused)."""
    base = events(spark, sf).select(F.col("user_id").alias("series_id"), "ts", "event_id", "event_type", "value")
    placed = with_position(base, ["series_id"], ["ts", "event_id"], "note_idx", hot)
    value = F.when(F.col("event_type") != "error", F.rint("value") + F.lit(0.0))
    frame = F.when(F.col("event_type") != "error", F.floor(F.col("note_idx") / 3).cast("long"))
    return placed.select("series_id", "note_idx", value.alias("residual"), frame.alias("frame_idx"))


R1_SQL = """r1 AS (
  SELECT series_id, note_idx, CASE WHEN event_type <> 'error' THEN round_even(value, 0) + 0.0::DOUBLE END AS residual,
         CASE WHEN event_type <> 'error' THEN note_idx // 3 END AS frame_idx
  FROM (SELECT user_id AS series_id, event_type, value,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS note_idx FROM events))"""


def residuals_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """R2: a vector's 64 values as residuals with a fixed gap pattern, and a label."""
    at = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("series_id"), (F.col("label") % 2).alias("label"), F.posexplode("embedding").alias("pos", "x")
    )
    gap = (F.col("pos") + F.col("series_id")) % 7 == 0
    value = F.when(~gap, F.rint(F.col("x").cast("double") * 100) + F.lit(0.0))
    return at.select("series_id", "label", F.col("pos").cast("long").alias("note_idx"), value.alias("residual"))


R2_SQL = """r2 AS (
  SELECT vec_id AS series_id, label % 2 AS label, (i - 1)::BIGINT AS note_idx,
         CASE WHEN (i - 1 + vec_id) % 7 <> 0 THEN round_even(embedding[i]::DOUBLE * 100.0::DOUBLE, 0) + 0.0::DOUBLE END AS residual
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


def headers(spark: SparkSession, sf: str) -> DataFrame:
    """One header per customer with orders: hit counts by priority, map = nation, category = segment."""
    rank = F.substring("o_orderpriority", 1, 1).cast("int")

    def n(cond) -> Column:
        return F.sum(cond.cast("int")).cast("long")

    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("series_id")).agg(
        n(rank <= 2).alias("count_300"), n(rank == 3).alias("count_100"), n(rank == 4).alias("count_50"), n(rank >= 5).alias("count_miss")
    )
    who = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("series_id"), F.col("c_nationkey").alias("map_id"), F.col("c_mktsegment").alias("category")
    )
    return counts.join(who, "series_id")


HEADERS_SQL = """headers AS (
  SELECT o_custkey AS series_id, c_nationkey AS map_id, c_mktsegment AS category,
         sum((substr(o_orderpriority,1,1)::INT <= 2)::INT)::BIGINT AS count_300,
         sum((substr(o_orderpriority,1,1)::INT = 3)::INT)::BIGINT AS count_100,
         sum((substr(o_orderpriority,1,1)::INT = 4)::INT)::BIGINT AS count_50,
         sum((substr(o_orderpriority,1,1)::INT >= 5)::INT)::BIGINT AS count_miss
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Experiment result rows from lineitem, one per (map, series, condition, seed) after combining."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("map_id"),
        F.col("l_partkey").alias("series_id"),
        F.col("l_returnflag").alias("condition"),
        (F.col("l_orderkey") % 5).alias("seed"),
        F.col("l_quantity").cast("long").alias("bits"),
        F.col("l_linenumber").cast("long").alias("errors"),
        F.col("l_linestatus").alias("status"),
        (F.col("l_discount") * 100).cast("double").alias("shift"),
        F.col("l_extendedprice").alias("score"),
    )


RESULTS_SQL = """results AS (
  SELECT l_suppkey AS map_id, l_partkey AS series_id, l_returnflag AS condition, l_orderkey % 5 AS seed,
         l_quantity::BIGINT AS bits, l_linenumber::BIGINT AS errors, l_linestatus AS status,
         (l_discount * 100::DOUBLE)::DOUBLE AS shift, l_extendedprice AS score FROM lineitem)"""


def bit_rows(spark: SparkSession, sf: str, hot) -> DataFrame:
    """Decoded bit rows: config = user, is_error = error event, abs_correlation = value."""
    base = events(spark, sf).select(F.col("user_id").alias("config_id"), "ts", "event_id", "event_type", "value")
    renamed = None if hot is None else hot.withColumnRenamed("series_id", "config_id")
    placed = with_position(base, ["config_id"], ["ts", "event_id"], "bit_index", renamed)
    return placed.select(
        "config_id",
        (F.col("config_id") % 2).alias("side"),
        "bit_index",
        (F.col("event_type") == "error").cast("int").alias("is_error"),
        F.when(F.col("event_type").isin("click", "view"), 1).otherwise(0).alias("true_bit"),
        F.col("value").alias("abs_correlation"),
        F.col("event_id"),
    )


BITS_SQL = """bit_rows AS (
  SELECT user_id AS config_id, user_id % 2 AS side,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS bit_index,
         (event_type = 'error')::INT AS is_error, (event_type IN ('click','view'))::INT AS true_bit,
         value AS abs_correlation, event_id FROM events)"""


def words(spark: SparkSession, sf: str) -> DataFrame:
    """Four coded words per document from its whole text's digest, with hash-made noise.

    word_idx, info (sent nibble), weights (8 confidences), flips (error mask).
    """
    from pulsemark.operators.coding import encode

    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("msg_id"), "lang", "n_chars", F.sha2("text", 256).alias("base")
    )
    at = docs.withColumn("word_idx", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    d = at.withColumn("d", F.sha2(F.concat_ws("|", "base", F.col("word_idx").cast("string")), 256))
    def num(start: int, size: int) -> Column:
        return F.conv(F.substring("d", start, size), 16, 10).cast("int")

    weak = [num(j * 2 + 3, 2) for j in range(8)]
    noisy = [F.when((weak[j] < 24) | (num(j * 2 + 21, 2) < 4), F.lit(1 << j)).otherwise(0) for j in range(8)]
    out = d.select(
        "msg_id", "lang", "n_chars", "word_idx", num(1, 1).alias("info"), F.array(*weak).alias("weights"), sum(noisy, F.lit(0)).alias("flips")
    )
    sent = encode(F.col("info"))
    return out.withColumn("sent", sent).withColumn("word", F.col("sent").bitwiseXOR(F.col("flips")).cast("int"))


WORDS_SQL = """words0 AS (
  SELECT doc_id AS msg_id, lang, n_chars, w::INT AS word_idx, sha256(sha256(text) || '|' || w) AS d
  FROM (SELECT *, unnest([0,1,2,3]) AS w FROM documents)),
words1 AS (
  SELECT msg_id, lang, n_chars, word_idx, ('0x' || substr(d,1,1))::INT AS info,
         list_transform(range(0,8), lambda j: ('0x' || substr(d, (j*2+3)::INT, 2))::INT) AS weights,
         list_sum(list_transform(range(0,8), lambda j:
            CASE WHEN ('0x' || substr(d,(j*2+3)::INT,2))::INT < 24 OR ('0x' || substr(d,(j*2+21)::INT,2))::INT < 4
                 THEN (1::INT << j::INT) ELSE 0 END))::INT AS flips
  FROM words0),
words2 AS (
  SELECT *, info & 1 AS i0, (info >> 1) & 1 AS i1, (info >> 2) & 1 AS i2, (info >> 3) & 1 AS i3 FROM words1),
words3 AS (
  SELECT *, xor(xor(i0,i1),i3) AS p0, xor(xor(i0,i2),i3) AS p1, xor(xor(i1,i2),i3) AS p3 FROM words2),
words4 AS (
  SELECT *, p0 + 2*p1 + 4*i0 + 8*p3 + 16*i1 + 32*i2 + 64*i3 AS seven FROM words3),
words AS (
  SELECT msg_id, lang, n_chars, word_idx, info, weights, flips,
         (seven + 128 * (bit_count(seven) % 2))::INT AS sent,
         xor((seven + 128 * (bit_count(seven) % 2))::INT, flips) AS word FROM words4),
decoded0 AS (
  SELECT *, (bit_count(word & 85) % 2 + 2 * (bit_count(word & 102) % 2) + 4 * (bit_count(word & 120) % 2))::INT AS syndrome,
         (bit_count(word) % 2)::INT AS overall FROM words),
decoded1 AS (
  SELECT *, CASE WHEN overall = 1 THEN 'corrected_single' WHEN syndrome = 0 THEN 'clean' ELSE 'detected_double' END AS status,
         CASE WHEN overall = 1 THEN CASE WHEN syndrome = 0 THEN 7 ELSE syndrome - 1 END END AS position FROM decoded0),
decoded2 AS (
  SELECT *, CASE WHEN position IS NULL THEN word ELSE xor(word, (1::INT << position::INT)) END AS fixed FROM decoded1),
decoded AS (
  SELECT *, (((fixed >> 2) & 1) + 2*((fixed >> 4) & 1) + 4*((fixed >> 5) & 1) + 8*((fixed >> 6) & 1))::INT AS decoded_info,
         CASE WHEN status = 'detected_double' THEN 'secded_detected_uncorrectable' ELSE 'accepted' END AS reason_base,
         CASE WHEN status = 'detected_double' THEN 'secded_detected_uncorrectable'
              WHEN status = 'corrected_single' AND len(list_filter(weights, lambda c: c <= 40)) >= 2
              THEN 'confidence_multiple_low_bits' ELSE 'accepted' END AS reason_low,
         CASE WHEN status = 'detected_double' THEN 'secded_detected_uncorrectable'
              WHEN status = 'corrected_single' AND weights[position + 1] > list_min(weights)
              THEN 'confidence_corrected_bit_not_minimum' ELSE 'accepted' END AS reason FROM decoded2)"""


def decoded_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words with hard decode, status and the three integrity reasons."""
    from pulsemark.operators import coding as C

    w = words(spark, sf)
    word, weights = F.col("word"), F.col("weights")
    return w.select(
        "*",
        C.syndrome(word).alias("syndrome"),
        C.parity(word).cast("int").alias("overall"),
        C.hard_status(word).alias("status"),
        C.corrected_position(word).alias("position"),
        C.hard_decode(word).alias("decoded_info"),
        C.integrity_reason("baseline", word, weights).alias("reason_base"),
        C.integrity_reason("low_bits", word, weights, 40).alias("reason_low"),
        C.integrity_reason("not_minimum", word, weights).alias("reason"),
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Message outcomes of the documents under both decision layers."""
    from pulsemark.operators import coding as C

    w = decoded_words(spark, sf)
    bad = lambda c: F.bit_count(F.col(c).bitwiseXOR(F.col("info")))
    return w.groupBy("msg_id", "lang", "n_chars").agg(
        F.sum(F.bit_count("flips")).cast("long").alias("raw_bit_errors"),
        (F.count(F.lit(1)) * 8).alias("coded_bits"),
        F.sum(bad("decoded_info")).cast("long").alias("post_bit_errors"),
        (F.count(F.lit(1)) * 4).alias("useful_bits"),
        C.outcome(F.min(F.col("reason_base") == C.ACCEPTED), F.sum(bad("decoded_info")) == 0).alias("baseline"),
        C.outcome(F.min(F.col("reason") == C.ACCEPTED), F.sum(bad("decoded_info")) == 0).alias("integrity"),
    ).withColumn("map_id", F.col("msg_id") % 40).withColumn("layout_seed", F.col("msg_id") % 3)


MESSAGES_SQL = (
    WORDS_SQL
    + """,
messages0 AS (
  SELECT msg_id, lang, n_chars, sum(bit_count(flips))::BIGINT AS raw_bit_errors, (count(*) * 8)::BIGINT AS coded_bits,
         sum(bit_count(xor(decoded_info, info)))::BIGINT AS post_bit_errors, (count(*) * 4)::BIGINT AS useful_bits,
         bool_and(reason_base = 'accepted') AS ok_base, bool_and(reason = 'accepted') AS ok
  FROM decoded GROUP BY msg_id, lang, n_chars),
messages AS (
  SELECT msg_id, lang, n_chars, raw_bit_errors, coded_bits, post_bit_errors, useful_bits,
         CASE WHEN NOT ok_base THEN 'REJECT' WHEN post_bit_errors = 0 THEN 'CORRECT_ACCEPT' ELSE 'WRONG_ACCEPT' END AS baseline,
         CASE WHEN NOT ok THEN 'REJECT' WHEN post_bit_errors = 0 THEN 'CORRECT_ACCEPT' ELSE 'WRONG_ACCEPT' END AS integrity,
         msg_id % 40 AS map_id, msg_id % 3 AS layout_seed FROM messages0)"""
)


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
