"""Exponential weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# A block of slices spans at most this many natural-log units of decay, so a
# weight taken relative to the block's end can be undone by division without
# overflow or underflow (doubles reach about 700 units either way).
BLOCK_LOG_SPAN = 300.0


def decay(alpha: float, exponent: Column | int) -> Column:
    """``(1 - alpha) ** exponent``."""
    power = exponent if isinstance(exponent, Column) else F.lit(exponent)
    return F.pow(F.lit(1.0 - alpha), power)


def weight(alpha: float, exponent: Column | int) -> Column:
    """What one counted access adds, ``exponent`` slices later."""
    return F.lit(alpha) * decay(alpha, exponent)


def block_span(alpha: float) -> int:
    """Slices per block for which weights stay well inside double range."""
    return max(1, int(BLOCK_LOG_SPAN / -math.log1p(-alpha)))


def slices_to_reach(alpha: float, value: float) -> float:
    """How many slices of decay bring 1.0 down to ``value``."""
    return math.log(value) / math.log(1.0 - alpha)
