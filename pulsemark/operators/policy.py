"""Capacity and strength policies in exact integer arithmetic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PayloadPolicy:
    # fixed values: positions per bit, code size and the two rational fractions
    positions_per_bit: int = 8
    word_bits: int = 8
    useful_bits: int = 4
    normal_num: int = 3
    normal_den: int = 40
    floor_num: int = 1
    floor_den: int = 8


@dataclass(frozen=True)
class StrengthPolicy:
    # fixed values: rational accuracy thresholds and the strength of each interval
    thresholds: tuple[tuple[int, int], ...] = ((8350645, 9681588), (29, 31), (6041359, 6184332))
    alphas: tuple[float, ...] = (20.0, 16.0, 12.0, 10.0)


def capacity(num_positions: Column, positions_per_bit: int = 8) -> Column:
    """Whole blocks that fit, missing positions counted."""
    return F.floor(num_positions / positions_per_bit).cast("long")


def fraction_bits(cap: Column, num: int, den: int) -> Column:
    """0 without capacity, else at least one bit."""
    return F.when(cap == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(cap * num / den))).cast("long")


def payload_decision(num_positions: Column, policy: PayloadPolicy = PayloadPolicy()) -> Column:
    """Struct (capacity_class, capacity, allocated, transmitted, useful)."""
    cap = capacity(num_positions, policy.positions_per_bit)
    allocated = fraction_bits(cap, policy.normal_num, policy.normal_den)
    words = F.floor(allocated / policy.word_bits)
    floor_ok = cap * policy.floor_num >= policy.word_bits * policy.floor_den
    kind = F.when(words >= 1, "NORMAL_7_5").when(floor_ok, "FLOOR_12_5").otherwise("NO_CAPACITY")
    sent_words = F.when(words >= 1, words).when(floor_ok, 1).otherwise(0).cast("long")
    return F.struct(
        kind.alias("capacity_class"),
        cap.alias("capacity"),
        allocated.alias("allocated"),
        (sent_words * policy.word_bits).alias("transmitted"),
        (sent_words * policy.useful_bits).alias("useful"),
    )


def accuracy_ratio(c300: Column, c100: Column, c50: Column, miss: Column) -> tuple[Column, Column]:
    """Exact accuracy numerator and denominator; NULL denominator when nothing was judged."""
    total = c300 + c100 + c50 + miss
    return (300 * c300 + 100 * c100 + 50 * c50).cast("long"), F.when(total > 0, 300 * total).cast("long")


def quality(c300: Column, c100: Column, c50: Column, miss: Column) -> Column:
    num, den = accuracy_ratio(c300, c100, c50, miss)
    total = c300 + c100 + c50 + miss
    return F.struct(
        total.cast("long").alias("total_judgements"),
        F.try_divide(num.cast("double"), den.cast("double")).alias("accuracy"),
        F.try_divide(miss.cast("double"), total.cast("double")).alias("miss_fraction"),
    )


def strength(num: Column, den: Column, policy: StrengthPolicy = StrengthPolicy()) -> Column:
    """Strength by exact cross products: a threshold is passed when num/den >= it."""
    wide = "decimal(20,0)"
    passed = F.lit(0)
    for t_num, t_den in policy.thresholds:
        holds = num.cast(wide) * F.lit(t_den).cast("decimal(18,0)") >= den.cast(wide) * F.lit(t_num).cast("decimal(18,0)")
        passed = passed + holds.cast("int")
    return F.element_at(F.array(*[F.lit(a) for a in policy.alphas]), passed + 1)


def strength_float(accuracy: Column, thresholds: Sequence[float], alphas: Sequence[float]) -> Column:
    """Float variant: the number of thresholds not above the accuracy picks the strength."""
    passed = sum(((accuracy >= t).cast("int") for t in thresholds), F.lit(0))
    return F.element_at(F.array(*[F.lit(float(a)) for a in alphas]), passed + 1)


def strength_by_category(category: Column, mapping: Mapping[str, float]) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), category)


def validate_policy(policy: StrengthPolicy) -> None:
    """Configuration rules: one more strength than thresholds, rising thresholds in (0,1), strengths in [10,20]."""
    if len(policy.alphas) != len(policy.thresholds) + 1:
        raise ValueError("need one more strength than thresholds")
    previous = (0, 1)
    for num, den in policy.thresholds:
        if not 0 < num < den:
            raise ValueError("a threshold must lie in (0, 1)")
        if num * previous[1] <= previous[0] * den:
            raise ValueError("thresholds must rise")
        previous = (num, den)
    if any(not 10.0 <= a <= 20.0 for a in policy.alphas):
        raise ValueError("a strength must lie in [10, 20]")
