"""Slice and time-partition numbers as plain column expressions.

``n`` is the 0-based arrival ordinal. All divisions are integral and truncate.
The variants differ by one on purpose: each classifier has its own rule.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from heatlens.params import FIXED_INTERVAL


def _col(value: Column | str | int) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def int_div(a: Column | str | int, b: Column | str | int) -> Column:
    return F.call_function("div", _col(a), _col(b))


def forward_slice(n: Column | str, size: int) -> Column:
    """Slice 1 is the first access alone, then ``size`` accesses per slice."""
    return int_div(_col(n) + F.lit(size - 1), size) + F.lit(1)


def reversed_slice(n: Column | str, total: int, size: int, slices: int) -> Column:
    """Counted from the end; reflects when there are more rows than slices hold."""
    from_end = F.lit(total) - _col(n)
    return int_div(F.abs(F.lit(size * (slices + 1)) - from_end), size) + F.lit(1)


def tail_slice(n: Column | str, total: int, size: int, end: int) -> Column:
    """Like :func:`reversed_slice` without the reflection: the newest ``size``
    accesses are slice ``end``, the ``size`` before them ``end - 1``, ..."""
    return F.lit(end) - int_div(F.lit(total - 1) - _col(n), size)


def tail_end(total: int, size: int, slices: int) -> int:
    """End slice for :func:`tail_slice`, high enough that slices start at 1."""
    return max(slices + 1, -(-total // size))


def bucketed_slice(n: Column | str, size: int) -> Column:
    return int_div(_col(n) + F.lit(1), size) + F.lit(1)


def fixed_slice(n: Column | str, interval: int = FIXED_INTERVAL) -> Column:
    """The slice grows with every ``interval``-th access, counting from two."""
    return int_div(_col(n) + F.lit(2), interval) + F.lit(1)


def fixed_end(rows: int, interval: int = FIXED_INTERVAL) -> int:
    return (rows + 1) // interval + 1


def total_slice(n: Column | str, interval: int) -> Column:
    return int_div(n, interval) + F.lit(1)


def ordinal_part(n: Column | str, total: int, parts: int) -> Column:
    """Contiguous runs of arrivals, as input splits would hold them."""
    return F.least(int_div(n, max(1, total // parts)), F.lit(parts - 1).cast("bigint"))


def timestamp_slice(ts: Column | str, first: int, interval: int) -> Column:
    """0-based and unclamped: the newest access may land past the last slice."""
    return int_div(_col(ts) - F.lit(first), interval)


def file_time_partition(
    ts: Column | str, first: int, interval: int, slices: int, parts: int
) -> tuple[Column, Column]:
    """(part, slice) with the part taken from the 1-based slice. Times past the last
    part belong to the last slice, times before the first access to the first."""
    raw = F.greatest(timestamp_slice(ts, first, interval), F.lit(0).cast("bigint")) + F.lit(1)
    part = int_div(raw, slices // parts)
    late = part >= F.lit(parts)
    return (
        F.when(late, F.lit(parts - 1).cast("bigint")).otherwise(part),
        F.when(late, F.lit(slices).cast("bigint")).otherwise(raw),
    )


def memory_time_partition(
    ts: Column | str, first: int, interval: int, slices: int, parts: int
) -> tuple[Column, Column]:
    """(part, slice) with the part taken from the 0-based slice, bounded as in
    :func:`file_time_partition`."""
    raw = F.greatest(timestamp_slice(ts, first, interval), F.lit(0).cast("bigint"))
    part = int_div(raw, slices // parts)
    late = part >= F.lit(parts)
    return (
        F.when(late, F.lit(parts - 1).cast("bigint")).otherwise(part),
        F.when(late, F.lit(slices).cast("bigint")).otherwise(raw) + F.lit(1),
    )


def slice_size_from_bytes(file_bytes: int, slices: int) -> int:
    """Accesses per slice estimated from the size of a text trace.

    Fixed values: a 1024-byte header and 75 bytes per line.
    """
    return max(1, ((file_bytes - 1024) // 75) // slices)
