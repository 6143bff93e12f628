"""Seeded, engine-independent hashing. Only md5 is used: any SQL engine can reproduce the order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_digest(seed: int | str, key: Column) -> Column:
    """Hex digest of `seed|key`. Sorting by it is a reproducible permutation of unique keys."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def digest_int(digest: Column, digits: int = 8) -> Column:
    """The leading hex digits of a digest as a non-negative long."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def hash_int(value: Column, digits: int = 8) -> Column:
    """Non-negative hash integer of a string."""
    return digest_int(F.md5(value), digits)
