"""Blocked Bloom filter bits as column expressions.

A key sets three bits in one block, so a probe needs a single look-up. Both expressions
depend on the key alone.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bits_of(key: Column, width: int) -> Column:
    """Three (possibly equal) bits of a block of ``width`` bits, a power of two up to 64."""
    spread = F.xxhash64(key, F.lit("bits"))
    mask = F.lit(0).cast("long")
    for turn in range(3):
        at = F.shiftrightunsigned(spread, 8 * turn).bitwiseAND(width - 1).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return mask


def block_count(rows: int, width: int, most: int, bits_per_row: int = 16) -> int:
    """A power of two of blocks with about ``bits_per_row`` bits per row, between 1,024 and ``most``.
    Beyond ``most`` the filter keeps its size and lets more keys pass."""
    blocks = 1024
    while blocks < most and blocks * width < bits_per_row * rows:
        blocks *= 2
    return blocks
