"""Assigning keys to buckets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def string_hash(key: Column | str) -> Column:
    """The 32-bit signed polynomial hash (factor 31) of the key's text."""
    text = (F.col(key) if isinstance(key, str) else key).cast("string")
    modulus, half = F.lit(1 << 32), F.lit(1 << 31)
    unsigned = F.aggregate(
        F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint")),
        F.lit(0).cast("bigint"),
        lambda h, c: F.pmod(h * F.lit(31) + c, modulus),
    )
    return F.pmod(unsigned + half, modulus) - half


def key_bucket(key: Column | str, buckets: int) -> Column:
    """Bucket by :func:`string_hash`. Where a budget is applied per bucket the
    result depends on this exact rule. Apply it per key, after aggregating."""
    return F.abs(string_hash(key) % F.lit(buckets)).cast("int")


def layout_bucket(key: Column | str, buckets: int) -> Column:
    """A cheaper bucket for physical layout only."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
