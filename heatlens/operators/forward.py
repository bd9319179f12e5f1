"""Forward heat: the smoothed estimate as of a key's last access.

A key's counted accesses are the ones that open a slice for it. The first counted
access scores 0 and each later one adds ``alpha`` after decaying what was there,
so with counted slices ``s_1 .. s_m`` the estimate is the sum over ``i >= 2`` of
``alpha * (1 - alpha) ** (s_m - s_i)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from heatlens.functions.decay import block_span, decay, weight
from heatlens.functions.slices import int_div
from heatlens.params import DEFAULT_ALPHA


def slice_dedup(df: DataFrame, key: str = "key", slice_col: str = "slice", order: str | None = None) -> DataFrame:
    """One row per (key, slice), with the first ``order`` value if asked for.

    Right when slices never decrease in arrival order. The partial aggregate
    leaves at most one row per key, slice and task for the shuffle, however hot
    a key is.
    """
    grouped = df.groupBy(key, slice_col)
    if order is None:
        return grouped.agg(F.count("*").alias("accesses"))
    return grouped.agg(F.count("*").alias("accesses"), F.min(order).alias(order))


def run_starts(
    df: DataFrame, key: str = "key", slice_col: str = "slice", order: str = "n", rows_per_bin: int = 1_000_000,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows whose slice differs from the same key's previous row in arrival order;
    ``opens`` marks a key's very first one. Columns in ``keep`` come along.

    Needed when slices may go back in time. ``order`` is the dense arrival
    ordinal. A hot key is cut into runs of ``rows_per_bin`` arrivals, each checked
    on its own; only the first row of each run looks back to the key's run before.
    """
    rows = df.select(key, slice_col, order, *keep).withColumn("__bin", int_div(order, rows_per_bin))
    inside = Window.partitionBy(key, "__bin").orderBy(order)
    # over the whole run: a frame from here on would be summed anew for every row
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = rows.withColumn("__before", F.lag(slice_col).over(inside)).withColumn(
        "__last", F.last(slice_col).over(whole)
    )
    changed = marked.filter(F.col("__before").isNotNull() & (F.col("__before") != F.col(slice_col)))
    changed = changed.withColumn("opens", F.lit(False))
    across = Window.partitionBy(key).orderBy("__bin")
    opened = (
        marked.filter(F.col("__before").isNull())
        .withColumn("__before", F.lag("__last").over(across))
        .filter(F.col("__before").isNull() | (F.col("__before") != F.col(slice_col)))
        .withColumn("opens", F.col("__before").isNull())
    )
    return changed.unionByName(opened).select(key, slice_col, order, "opens", *keep)


def heat_forward(
    counted: DataFrame,
    alpha: float = DEFAULT_ALPHA,
    max_slices: int | None = None,
    key: str = "key",
    slice_col: str = "slice",
    order: str | None = None,
) -> DataFrame:
    """``(key, est, first_slice, last_slice, counted)`` from counted accesses.

    ``order`` names the arrival column when slices may go back in time, and ``counted``
    comes from :func:`run_starts`; without it the slice number itself is the order.
    Weights are summed relative to the end of a block of slices, which needs no
    knowledge of the key's last slice and so aggregates map-side. With at most one
    block (``max_slices``) that sum is rescaled at once; otherwise a key's few block
    rows are combined by a window.

    A key's first access scores nothing. On a clock that goes back it may be the largest
    term of all, so there it is never added; otherwise it is the smallest term and is
    taken out of the sum.
    """
    span = block_span(alpha)
    block_end = int_div(slice_col, span) * F.lit(span) + F.lit(span - 1)
    if order is None:
        scores = F.lit(True)
        extent = [F.min(slice_col).alias("first_slice"), F.max(slice_col).alias("last_slice")]
    else:
        scores = ~F.col("opens")
        extent = [
            F.min_by(slice_col, order).alias("first_slice"),
            F.max_by(slice_col, order).alias("last_slice"),
        ]
    finish = _without_first if order is None else _as_summed
    if max_slices is not None and max_slices < span:
        # slices 0 .. span-1 share the one block that ends at span-1
        term = F.when(scores, weight(alpha, F.lit(span - 1) - F.col(slice_col))).otherwise(0.0)
        folded = counted.groupBy(key).agg(
            F.sum(term).alias("mass"), F.count("*").alias("counted"), *extent
        ).withColumn("mass", _scaled(alpha, "mass", F.col("last_slice") - F.lit(span - 1)))
        return finish(folded, alpha, key)
    ordering = [] if order is None else [
        F.min(order).alias("first_at"), F.max(order).alias("last_at"),
    ]
    term = F.when(scores, weight(alpha, F.col("block_end") - F.col(slice_col))).otherwise(0.0)
    blocks = counted.withColumn("block_end", block_end).groupBy(key, "block_end").agg(
        F.sum(term).alias("mass"), F.count("*").alias("counted"), *extent, *ordering
    )
    whole = Window.partitionBy(key)
    if order is None:
        last_of_key, first_of_key = F.max("last_slice"), F.min("first_slice")
    else:
        last_of_key = F.max_by("last_slice", "last_at")
        first_of_key = F.min_by("first_slice", "first_at")
    folded = (
        blocks.withColumn("__last", last_of_key.over(whole))
        .withColumn("__first", first_of_key.over(whole))
        .groupBy(key)
        .agg(
            F.sum(_scaled(alpha, "mass", F.col("__last") - F.col("block_end"))).alias("mass"),
            F.sum("counted").alias("counted"),
            F.max("__first").alias("first_slice"),
            F.max("__last").alias("last_slice"),
        )
    )
    return finish(folded, alpha, key)


def _scaled(alpha: float, mass: str, slices: Column) -> Column:
    """``mass`` decayed. Nothing stays nothing, however far a clock jumped back."""
    return F.when(F.col(mass) == 0.0, F.lit(0.0)).otherwise(F.col(mass) * decay(alpha, slices))


def _as_summed(folded: DataFrame, alpha: float, key: str) -> DataFrame:
    return folded.select(key, F.col("mass").alias("est"), "first_slice", "last_slice", "counted")


def _without_first(folded: DataFrame, alpha: float, key: str) -> DataFrame:
    """Take the key's first access, which scores nothing, back out of the mass.

    It is the smallest term of the sum, so little precision is lost.
    """
    est = F.when(F.col("counted") == 1, F.lit(0.0)).otherwise(
        F.col("mass") - weight(alpha, F.col("last_slice") - F.col("first_slice"))
    )
    return folded.select(key, est.alias("est"), "first_slice", "last_slice", "counted")


def heat_as_of(heat: DataFrame, as_of: Column | int, alpha: float = DEFAULT_ALPHA) -> DataFrame:
    """Decay each estimate from its last slice to slice ``as_of``."""
    until = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return heat.withColumn("est", F.col("est") * decay(alpha, until - F.col("last_slice")))
