"""Time-partition partials and their roll-up.

Each time partition scores its keys on its own; the roll-up then folds a key's
partials in partition order. Both steps are sums with closed-form weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from heatlens.functions.decay import decay
from heatlens.functions.slices import int_div
from heatlens.operators.forward import run_starts
from heatlens.params import DEFAULT_ALPHA

# More (part, slice) rows than this are joined by shuffle, not by broadcast.
BROADCAST_SLICES = 1_000_000


def partial_by_slice_rank(
    df: DataFrame,
    slices_per_part: int,
    slices: int,
    alpha: float = DEFAULT_ALPHA,
    order: str = "arrival",
) -> DataFrame:
    """``(part, key, partial)``: a key's later counted accesses in a part, each
    weighted by where its slice stands among the slices seen in that part.

    The access that opens the part's j-th seen slice weighs one step more
    (``slices_per_part - j + 1``) than the others of that slice; neither falls
    below -1. Slices must not decrease along ``order`` within a part. ``slices``
    bounds the number of (part, slice) rows.
    """
    counted = df.groupBy("part", "slice", "key").agg(F.min(order).alias("at"))
    seen = (
        counted.groupBy("part", "slice").agg(F.min("at").alias("opened_at"))
        .withColumn("j", F.dense_rank().over(Window.partitionBy("part").orderBy("slice")))
    )
    if slices <= BROADCAST_SLICES:
        seen = F.broadcast(seen)
    step = F.when(F.col("at") == F.col("opened_at"), F.lit(slices_per_part + 1)).otherwise(F.lit(slices_per_part))
    power = F.greatest(step - F.col("j"), F.lit(-1))
    first = F.min("slice").over(Window.partitionBy("part", "key"))
    return (
        counted.withColumn("first_slice", first)
        .join(seen, ["part", "slice"])
        .groupBy("part", "key")
        .agg(
            F.coalesce(
                F.sum(F.when(F.col("slice") > F.col("first_slice"), decay(alpha, power))), F.lit(0.0)
            ).alias("partial")
        )
    )


def partial_by_slice_run(
    df: DataFrame,
    slices_per_part: int,
    alpha: float = DEFAULT_ALPHA,
    order: str = "n",
    rows_per_bin: int = 1_000_000,
) -> DataFrame:
    """As :func:`partial_by_slice_rank`, for slices that may go back: ``j`` counts the changes
    of slice in the part so far, and a key counts each change of its own slice.

    ``order`` is the dense arrival ordinal. A part is cut into runs of ``rows_per_bin``
    arrivals; only the edges of runs are compared across runs. The join with them finds rows where the windows
    have put them; it is broadcast only where the session's own size limit says so.
    """
    rows = df.select("part", "key", "slice", order).withColumn("__bin", int_div(order, rows_per_bin))
    inside = Window.partitionBy("part", "__bin").orderBy(order)
    before = F.lag("slice").over(inside)
    rows = rows.withColumn("__before", before).withColumn(
        "__change", F.coalesce(F.col("__before") != F.col("slice"), F.lit(False)).cast("long")
    )
    rows = rows.withColumn("__run", F.sum("__change").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    bins = rows.groupBy("part", "__bin").agg(
        F.sum("__change").alias("changes"), F.min_by("slice", order).alias("head"), F.max_by("slice", order).alias("last")
    )
    along = Window.partitionBy("part").orderBy("__bin")
    bins = bins.withColumn("__opened", F.coalesce(F.lag("last").over(along) != F.col("head"), F.lit(True)).cast("long"))
    so_far = F.sum(F.col("changes") + F.col("__opened")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    bins = bins.select("part", "__bin", "__opened", (so_far - F.col("changes")).alias("__offset"))
    opens_run = F.when(F.col("__before").isNull(), F.col("__opened")).otherwise(F.col("__change"))
    step = F.lit(slices_per_part) - F.col("__offset") - F.col("__run") + opens_run
    placed = rows.join(bins, ["part", "__bin"]).select(
        F.struct("part", "key").alias("__key"), "slice", order, F.greatest(step, F.lit(-1)).alias("__power")
    )
    counted = run_starts(placed, "__key", order=order, rows_per_bin=rows_per_bin, keep=("__power",))
    scored = F.when(F.col("opens"), F.lit(0.0)).otherwise(decay(alpha, F.col("__power")))
    return counted.groupBy("__key").agg(F.sum(scored).alias("partial")).select("__key.part", "__key.key", "partial")


def partial_by_slice_number(df: DataFrame, alpha: float = DEFAULT_ALPHA, order: str = "arrival") -> DataFrame:
    """``(part, key, partial)``: every access of a key in a part but its first
    adds ``(1 - alpha) ** slice``; accesses of one slice are not merged."""
    per_slice = df.groupBy("part", "key", "slice").agg(
        F.count("*").alias("accesses"), F.min(order).alias("at")
    )
    first = F.min("at").over(Window.partitionBy("part", "key"))
    repeats = F.col("accesses") - F.when(F.col("at") == F.col("first_at"), F.lit(1)).otherwise(F.lit(0))
    return (
        per_slice.withColumn("first_at", first)
        .groupBy("part", "key")
        .agg(F.sum(repeats * decay(alpha, F.col("slice"))).alias("partial"))
    )


def roll_up(partials: DataFrame, slices_per_part: int, alpha: float = DEFAULT_ALPHA) -> DataFrame:
    """Fold a key's partials: each appearance decays the estimate so far by
    ``slices_per_part - 1``. Parts without the key do not decay it."""
    return _fold(partials, F.lit(slices_per_part - 1), alpha)


def roll_up_growing(partials: DataFrame, slices_per_part: int, alpha: float = DEFAULT_ALPHA) -> DataFrame:
    """Like :func:`roll_up`, with a decay that grows with the part number."""
    return _fold(partials, (F.col("part") + F.lit(1)) * F.lit(slices_per_part) - F.lit(1), alpha)


def _fold(partials: DataFrame, step: Column, alpha: float) -> DataFrame:
    # a partial is decayed by the steps of all later appearances of its key;
    # a key has at most one row per part here
    later = Window.partitionBy("key").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    power = F.coalesce(F.sum("__step").over(later), F.lit(0))
    return (
        partials.withColumn("__step", step)
        .withColumn("__power", power)
        .groupBy("key")
        .agg(F.sum(F.lit(alpha) * F.col("partial") * decay(alpha, F.col("__power"))).alias("est"))
    )
