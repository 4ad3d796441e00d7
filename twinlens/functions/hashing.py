"""Row hashes that stand in for seeded random numbers: the same on every run and every cluster."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def row_hash(key: Column, seed: int | str) -> Column:
    """32 hex digits, uniform over keys and independent between seeds."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def hash_number(key: Column, seed: int | str, modulus: int) -> Column:
    """Uniform integer in ``[0, modulus)`` from the first 12 hex digits of :func:`row_hash`."""
    return (F.conv(F.substring(row_hash(key, seed), 1, 12), 16, 10).cast("bigint") % F.lit(modulus)).cast("int")
