"""Coded word queries (W19, W21-W26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsemark.operators import coding as C
from pulsemark.operators import marking
from pulsemark.plans import roles as R
from pulsemark.plans.registry import query, table
from pulsemark.plans.roles import with_sql


@query(
    "w19_blind_decision",
    with_sql(R.WORDS_SQL)
    + """SELECT msg_id, n AS accepted_hypotheses, CASE WHEN lo IS NULL THEN 'no_accepted_hypothesis' WHEN lo <> hi THEN 'ambiguous_messages' ELSE 'accepted' END AS decision,
         CASE WHEN lo = hi THEN lo END AS message FROM
         (SELECT msg_id, count(*) FILTER (reason = 'accepted') AS n, min(decoded_info) FILTER (reason = 'accepted') AS lo,
                 max(decoded_info) FILTER (reason = 'accepted') AS hi FROM decoded GROUP BY msg_id)""",
)
def _(spark, sf):
    w = R.decoded_words(spark, sf)
    hyp = w.select("msg_id", (F.col("reason") == C.ACCEPTED).alias("accepted"), F.col("decoded_info").alias("message"))
    return marking.blind_decision(hyp, ["msg_id"])


@query(
    "w21_bit_conversions",
    """SELECT doc_id, h AS hex, list_transform(range(0, 128), lambda k: (('0x' || substr(h, (k // 4 + 1)::INT, 1))::INT >> (3 - k % 4)::INT) & 1)::INT[] AS bits,
         list_transform(range(0, 128), lambda k: 2 * ((('0x' || substr(h, (k // 4 + 1)::INT, 1))::INT >> (3 - k % 4)::INT) & 1) - 1)::INT[] AS bipolar
       FROM (SELECT doc_id, md5(text) AS h FROM documents)""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.unhex(F.md5("text")).alias("data"))
    at = docs.withColumn("bits", C.bytes_to_bits(F.col("data"))).withColumn("bipolar", C.to_bipolar(F.col("bits")))
    back = C.bits_to_bytes(C.from_bipolar(F.col("bipolar")))
    return at.select("doc_id", F.lower(F.hex(back)).alias("hex"), "bits", "bipolar")


@query(
    "w22_secded_decode",
    with_sql(R.WORDS_SQL)
    + "SELECT msg_id, word_idx, info, sent, word, syndrome, overall, status, position, decoded_info FROM decoded",
)
def _(spark, sf):
    return R.decoded_words(spark, sf).select(
        "msg_id", "word_idx", "info", "sent", "word", "syndrome", "overall", "status", "position", "decoded_info"
    )


@query(
    "w23_erasure_decode",
    with_sql(
        R.WORDS_SQL,
        """book AS (SELECT info, (seven + 128 * (bit_count(seven) % 2))::INT AS cw FROM (
             SELECT i AS info, xor(xor(i & 1, (i>>1) & 1), (i>>3) & 1) + 2*xor(xor(i & 1, (i>>2) & 1), (i>>3) & 1) + 4*(i & 1)
               + 8*xor(xor((i>>1) & 1, (i>>2) & 1), (i>>3) & 1) + 16*((i>>1) & 1) + 32*((i>>2) & 1) + 64*((i>>3) & 1) AS seven
             FROM (SELECT unnest(range(0,16))::INT AS i))),
        er AS (SELECT msg_id, word_idx, word, greatest(1, list_sum(list_transform(range(0,8), lambda j:
               CASE WHEN weights[j + 1] <= 60 THEN (1::INT << j::INT) ELSE 0 END))::INT) AS erased FROM words),
        near AS (SELECT msg_id, word_idx, info, bit_count(xor(cw, word) & (255 - erased)) AS dist FROM er, book
                 WHERE bit_count(xor(cw, word) & (255 - erased)) <= 1),
        agg AS (SELECT msg_id, word_idx, count(*) AS n, min(info) AS info, min(dist) AS dist FROM near GROUP BY ALL)""",
    )
    + """SELECT er.msg_id, er.word_idx, er.erased, CASE WHEN n = 1 THEN info END AS decoded_info,
          CASE WHEN n IS DISTINCT FROM 1 THEN 'erasure_unrecoverable' WHEN dist = 0 THEN 'erasures_recovered'
               ELSE 'erasures_plus_error_corrected' END AS erasure_status
        FROM er LEFT JOIN agg ON agg.msg_id = er.msg_id AND agg.word_idx = er.word_idx""",
)
def _(spark, sf):
    w = R.words(spark, sf)
    mask = F.lit(0)
    for j in range(8):
        mask = mask + F.when(F.col("weights")[j] <= 60, 1 << j).otherwise(0)
    w = w.withColumn("erased", F.greatest(F.lit(1), mask).cast("int"))
    return C.erasure_decode(w, ["msg_id", "word_idx", "erased"], 1)


@query("w24_integrity_reasons", with_sql(R.WORDS_SQL) + "SELECT msg_id, word_idx, reason_base, reason_low, reason FROM decoded")
def _(spark, sf):
    return R.decoded_words(spark, sf).select("msg_id", "word_idx", "reason_base", "reason_low", "reason")


@query(
    "w25_message_decisions",
    with_sql(R.WORDS_SQL)
    + """SELECT msg_id, bool_and(reason = 'accepted') AS accepted,
          coalesce(arg_min(reason, word_idx) FILTER (reason <> 'accepted'), 'accepted') AS reason, count(*) AS words FROM decoded GROUP BY msg_id""",
)
def _(spark, sf):
    return C.message_decisions(R.decoded_words(spark, sf), ["msg_id"])


@query("w26_message_outcomes", with_sql(R.MESSAGES_SQL) + "SELECT * FROM messages")
def _(spark, sf):
    return R.messages(spark, sf)
