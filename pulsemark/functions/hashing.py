"""Deterministic ids, seeds and draws from SHA-256 (same value in any engine)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def digest(*parts) -> Column:
    """Hex SHA-256 of the '|'-joined parts."""
    return F.sha2(joined(*parts), 256)


def _number(hex_text: Column) -> Column:
    return F.conv(hex_text, 16, 10).cast("long")


def seed32(*parts) -> Column:
    """First four digest bytes, big-endian."""
    return _number(F.substring(digest(*parts), 1, 8))


def seed_bytes(*parts) -> Column:
    """The four bytes of ``seed32``."""
    return F.unhex(F.substring(digest(*parts), 1, 8))


def seed31(*parts) -> Column:
    """``seed32`` masked to a non-negative 31-bit number."""
    return seed32(*parts).bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))


def seed60(*parts) -> Column:
    """First fifteen hex digits, the widest prefix that fits a signed long."""
    return _number(F.substring(digest(*parts), 1, 15))


def short_id(*parts) -> Column:
    """16 hex digit identifier."""
    return F.substring(digest(*parts), 1, 16)


def draw(n: Column, *parts) -> Column:
    """Uniform integer in [0, n)."""
    return seed32(*parts) % n


def sign(*parts) -> Column:
    """+1 or -1 from the parity of the first hex digit."""
    first = _number(F.substring(digest(*parts), 1, 1))
    return F.when(first % 2 == 1, F.lit(1)).otherwise(F.lit(-1)).cast("int")
