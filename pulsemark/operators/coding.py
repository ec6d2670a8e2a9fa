"""Extended Hamming (8,4) words as integers: bit i of the number is position i of the word."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: information positions, the positions each check covers, and the labels
INFO_POSITIONS = (2, 4, 5, 6)
CHECKS = ((0, (0, 2, 4, 6)), (1, (1, 2, 5, 6)), (3, (3, 4, 5, 6)))
CLEAN, CORRECTED, DETECTED = "clean", "corrected_single", "detected_double"
ACCEPTED = "accepted"
UNCORRECTABLE = "secded_detected_uncorrectable"
LOW_BITS = "confidence_multiple_low_bits"
NOT_MINIMUM = "confidence_corrected_bit_not_minimum"


def _odd(n: int) -> int:
    return bin(n).count("1") & 1


def _mask(positions: Sequence[int]) -> int:
    return sum(1 << p for p in positions)


def _word_of(info: int) -> int:
    word = sum(((info >> i) & 1) << p for i, p in enumerate(INFO_POSITIONS))
    word += sum(_odd(word & _mask(covered)) << p for p, covered in CHECKS)
    return word + (_odd(word) << 7)


def _syndrome_of(word: int) -> int:
    return sum(_odd(word & _mask(covered)) << i for i, (_, covered) in enumerate(CHECKS))


def _flip_of(word: int) -> int | None:
    """Position the decoder flips."""
    if not _odd(word):
        return None
    return _syndrome_of(word) - 1 if _syndrome_of(word) else 7


def _info_of(word: int) -> int:
    flip = _flip_of(word)
    fixed = word if flip is None else word ^ (1 << flip)
    return sum(((fixed >> p) & 1) << i for i, p in enumerate(INFO_POSITIONS))


def _status_of(word: int) -> str:
    if _odd(word):
        return CORRECTED
    return DETECTED if _syndrome_of(word) else CLEAN


def _lookup(values: Sequence, at: Column) -> Column:
    """values[at] through one constant array: a single reference to ``at``, so plans stay small."""
    items = ", ".join("null" if v is None else repr(v) for v in values)
    return F.element_at(F.expr(f"array({items})"), at + 1)


def encode(info: Column) -> Column:
    """4-bit number (bit i = i-th information bit) to its 8-bit word."""
    return _lookup([_word_of(i) for i in range(16)], info)


def parity(word: Column) -> Column:
    return (F.bit_count(word) % 2).cast("int")


def syndrome(word: Column) -> Column:
    return _lookup([_syndrome_of(w) for w in range(256)], word)


def corrected_position(word: Column) -> Column:
    """Position the decoder flips, NULL when it flips none."""
    return _lookup([_flip_of(w) for w in range(256)], word)


def hard_status(word: Column) -> Column:
    return _lookup([_status_of(w) for w in range(256)], word)


def hard_decode(word: Column) -> Column:
    """Decoded 4-bit number (the received information bits when only detected)."""
    return _lookup([_info_of(w) for w in range(256)], word)


def erasure_decode(words: DataFrame, keys: Sequence[str], max_unknown_errors: int) -> DataFrame:
    """Unique word within ``max_unknown_errors`` of ``word`` on the positions not in ``erased`` (a bit mask).

    The 16-row codebook is a literal array, so this is a projection without a shuffle.
    """
    book = F.array(*[F.struct(F.lit(i).alias("info"), encode(F.lit(i)).alias("word")) for i in range(16)])
    known = F.bitwise_not(F.col("erased")).bitwiseAND(F.lit(0xFF))
    scored = F.transform(
        book,
        lambda c: F.struct(
            c["info"].alias("info"),
            F.bit_count(c["word"].bitwiseXOR(F.col("word")).bitwiseAND(known)).alias("distance"),
        ),
    )
    near = words.withColumn("_near", F.filter(scored, lambda c: c["distance"] <= max_unknown_errors))
    only = F.when(F.size("_near") == 1, F.col("_near")[0])
    status = (
        F.when(only.isNull(), "erasure_unrecoverable")
        .when(only["distance"] == 0, "erasures_recovered")
        .otherwise("erasures_plus_error_corrected")
    )
    return near.select(*keys, only["info"].alias("decoded_info"), status.alias("erasure_status"))


def integrity_reason(rule: str, word: Column, weights: Column, threshold: float | None = None) -> Column:
    """Accept/reject reason of one word under a rule: "baseline", "low_bits" or "not_minimum".

    ``weights`` is the array of the eight absolute correlations.
    """
    status = hard_status(word)
    reason = F.when(status == DETECTED, UNCORRECTABLE)
    if rule == "low_bits":
        weak = F.size(F.filter(weights, lambda c: c <= F.lit(threshold)))
        reason = reason.when((status == CORRECTED) & (weak >= 2), LOW_BITS)
    elif rule == "not_minimum":
        at = F.element_at(weights, F.coalesce(corrected_position(word), F.lit(0)) + 1)
        reason = reason.when((status == CORRECTED) & (at > F.array_min(weights)), NOT_MINIMUM)
    elif rule != "baseline":
        raise ValueError(rule)
    return reason.otherwise(ACCEPTED)


def message_decisions(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Any rejected word rejects the message; the reason is that of its first rejected word."""
    bad = F.col("reason") != ACCEPTED
    return words.groupBy(*keys).agg(
        (~F.max(bad)).alias("accepted"),
        F.coalesce(F.min_by(F.when(bad, F.col("reason")), F.when(bad, F.col("word_idx"))), F.lit(ACCEPTED)).alias("reason"),
        F.count(F.lit(1)).alias("words"),
    )


def outcome(accepted: Column, correct: Column) -> Column:
    return F.when(~accepted, "REJECT").when(correct, "CORRECT_ACCEPT").otherwise("WRONG_ACCEPT")


def weak_rank(weights: Column, position: int) -> Column:
    """Rank 0..7 of one position's confidence within its word (ties by position)."""
    mine = weights[position]
    below = F.lit(0)
    for i in range(8):
        if i != position:
            lower = weights[i] <= mine if i < position else weights[i] < mine
            below = below + lower.cast("int")
    return below


def weak_ranks(weights: Column) -> Column:
    """Array of the eight confidence ranks; plain comparisons, so it stays inside generated code."""
    return F.array(*[weak_rank(weights, p) for p in range(8)])


def bits_of(word: Column, width: int = 8) -> Column:
    """Array of 0/1, position 0 first."""
    return F.array(*[F.getbit(word, F.lit(i)).cast("int") for i in range(width)])


def to_bipolar(bits: Column) -> Column:
    return F.transform(bits, lambda b: (b * 2 - 1).cast("int"))


def from_bipolar(bits: Column) -> Column:
    return F.transform(bits, lambda b: F.when(b > 0, 1).otherwise(0).cast("int"))


def bytes_to_bits(data: Column) -> Column:
    """Bits of a binary value, most significant bit of each byte first."""
    digits = F.split(F.hex(data), "(?<=.)(?=.)")
    nibbles = F.transform(digits, lambda d: F.conv(d, 16, 10).cast("int"))
    return F.flatten(F.transform(nibbles, lambda v: F.transform(F.array(*[F.lit(k) for k in (3, 2, 1, 0)]), lambda k: F.getbit(v, k).cast("int"))))


def bits_to_bytes(bits: Column) -> Column:
    """Inverse of ``bytes_to_bits``."""
    text = F.array_join(bits, "")
    groups = F.sequence(F.lit(0), F.floor(F.size(bits) / 4).cast("int") - 1)
    return F.unhex(F.array_join(F.transform(groups, lambda g: F.conv(F.substr(text, g * 4 + 1, F.lit(4)), 2, 16)), ""))
