"""Block code, integrity rules, conversions."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pulsemark.operators import coding as C


def test_single_and_double_errors(spark):
    base = spark.range(16).select(F.col("id").cast("int").alias("info")).withColumn("sent", C.encode(F.col("info")))
    masks = [1 << i for i in range(8)] + [(1 << a) | (1 << b) for a, b in combinations(range(8), 2)] + [0]
    noisy = base.withColumn("mask", F.explode(F.array(*[F.lit(m) for m in masks])))
    got = noisy.withColumn("word", F.col("sent").bitwiseXOR(F.col("mask"))).select(
        "info", "mask", C.hard_status(F.col("word")).alias("status"), C.hard_decode(F.col("word")).alias("decoded")
    ).collect()
    singles = [r for r in got if bin(r.mask).count("1") == 1]
    doubles = [r for r in got if bin(r.mask).count("1") == 2]
    assert len(singles) == 128 and all(r.status == C.CORRECTED and r.decoded == r.info for r in singles)
    assert len(doubles) == 448 and all(r.status == C.DETECTED for r in doubles)
    assert all(r.status == C.CLEAN and r.decoded == r.info for r in got if r.mask == 0)
    words = [r.sent for r in base.collect()]
    assert min(bin(a ^ b).count("1") for a, b in combinations(words, 2)) == 4


def test_erasures(spark):
    base = spark.range(16).select(F.col("id").cast("int").alias("info")).withColumn("word", C.encode(F.col("info")))

    def run(size, errors, limit):
        masks = [sum(1 << i for i in c) for c in combinations(range(8), size)]
        at = base.withColumn("erased", F.explode(F.array(*[F.lit(m) for m in masks])))
        if errors:
            flips = [sum(1 << i for i in c) for c in combinations(range(8), errors)]
            at = at.withColumn("f", F.explode(F.array(*[F.lit(m) for m in flips]))).where(F.col("f").bitwiseAND(F.col("erased")) == 0)
            at = at.withColumn("word", F.col("word").bitwiseXOR(F.col("f"))).drop("f")
        out = C.erasure_decode(at, ["info", "erased"], limit).groupBy("erasure_status", (F.col("decoded_info") == F.col("info")).alias("right"))
        return {(r.erasure_status, r.right): r["count"] for r in out.count().collect()}

    for size, n in ((1, 128), (2, 448), (3, 896)):
        assert run(size, 0, 0) == {("erasures_recovered", True): n}
    four = run(4, 0, 0)
    assert four[("erasures_recovered", True)] == 896 and four[("erasure_unrecoverable", None)] == 224
    wrong = run(1, 2, 1)
    assert sum(wrong.values()) == 2688 and wrong == {("erasures_plus_error_corrected", False): 2688} or ("erasure_unrecoverable", None) in wrong


def test_integrity_rules(spark):
    # word with one flipped bit at position 0, info 0
    rows = [(1, [9, 5, 6, 7, 8, 9, 9, 9]), (1, [1, 5, 6, 7, 8, 9, 9, 9]), (3, [1, 1, 9, 9, 9, 9, 9, 9]), (0, [0] * 8)]
    df = spark.createDataFrame(rows, "word int, weights array<int>")
    w, c = F.col("word"), F.col("weights")
    got = df.select(
        C.integrity_reason("baseline", w, c), C.integrity_reason("low_bits", w, c, 5), C.integrity_reason("low_bits", w, c, 6), C.integrity_reason("not_minimum", w, c)
    ).collect()
    assert list(got[0]) == [C.ACCEPTED, C.ACCEPTED, C.LOW_BITS, C.NOT_MINIMUM]
    assert list(got[1]) == [C.ACCEPTED, C.LOW_BITS, C.LOW_BITS, C.ACCEPTED]
    assert list(got[2]) == [C.UNCORRECTABLE] * 4
    assert list(got[3]) == [C.ACCEPTED] * 4
    with pytest.raises(ValueError):
        C.integrity_reason("other", w, c)


def test_message_rule_takes_first_rejected_word(spark):
    df = spark.createDataFrame(
        [("m", 0, C.ACCEPTED), ("m", 1, C.LOW_BITS), ("m", 2, C.UNCORRECTABLE), ("n", 0, C.ACCEPTED)], "msg string, word_idx int, reason string"
    )
    got = {r.msg: (r.accepted, r.reason, r.words) for r in C.message_decisions(df, ["msg"]).collect()}
    assert got == {"m": (False, C.LOW_BITS, 3), "n": (True, C.ACCEPTED, 1)}


def test_ranks_and_conversions(spark):
    df = spark.createDataFrame([([3, 1, 1, 8, 0, 8, 2, 5], bytearray(b"\x01\xa5"))], "w array<int>, b binary")
    r = df.select(C.weak_ranks(F.col("w")), C.bytes_to_bits(F.col("b")), C.bits_to_bytes(C.from_bipolar(C.to_bipolar(C.bytes_to_bits(F.col("b")))))).first()
    assert list(r[0]) == [4, 1, 2, 6, 0, 7, 3, 5]
    assert list(r[1]) == [0, 0, 0, 0, 0, 0, 0, 1, 1, 0, 1, 0, 0, 1, 0, 1]
    assert bytes(r[2]) == b"\x01\xa5"
