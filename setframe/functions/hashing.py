"""Seeded, engine-independent pseudo-random order.

MD5 digests are uniform, so a prefix of the digest is an even bucket of the order: no sampling
pass is needed to balance partitions, and re-running a lost task gives the same answer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_LENGTH = 16


def order_key(value: Column, seed: int | str) -> Column:
    """First 16 hex digits of ``md5(seed:value)``; sort by it for a seeded shuffle."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), value.cast("string"))), 1, KEY_LENGTH)


def key_bucket(key: Column, hex_digits: int) -> Column:
    """Order-preserving bucket out of ``16 ** hex_digits``."""
    return F.substring(key, 1, hex_digits)


def below_fraction(key: Column, fraction: float) -> Column:
    """True for about ``fraction`` of all keys, decided by the first 8 hex digits."""
    if not 0 <= fraction <= 1:
        raise ValueError(f"not a fraction: {fraction}")
    if fraction == 1:
        return key.isNotNull()
    return F.substring(key, 1, 8) < F.lit(hex_threshold(fraction))


def hex_threshold(fraction: float) -> str:
    return f"{int(fraction * 16 ** 8):08x}"
