"""Comparing, labelling and printing hot sets, and run counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from heatlens.operators.selection import at_or_before, kth_row, top_k


def hot_set_overlap(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """``(n_both, n_a, n_b, recall)``: how much of hot set ``a`` is also in ``b``."""
    tagged = a.select(key, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(
        b.select(key, F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))
    )
    per_key = tagged.groupBy(key).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    return per_key.agg(
        F.coalesce(F.sum(F.col("in_a") * F.col("in_b")), F.lit(0)).alias("n_both"),
        F.coalesce(F.sum("in_a"), F.lit(0)).alias("n_a"),
        F.coalesce(F.sum("in_b"), F.lit(0)).alias("n_b"),
    ).withColumn("recall", F.try_divide("n_both", "n_a"))


def label_hot(heat: DataFrame, k: int, key: str = "key") -> DataFrame:
    """Every key with ``is_hot``; the cold side is ``~is_hot``.

    The K-th row is looked up first, so labelling is a projection without a join. A row
    without a key or an estimate has no rank and is cold.
    """
    if k <= 0:
        return heat.withColumn("is_hot", F.lit(False))
    cut = kth_row(heat, k, tie=key)
    if cut is None:
        return heat.withColumn("is_hot", F.col("est").isNotNull() & F.col(key).isNotNull())
    return heat.withColumn("is_hot", at_or_before(F.lit(cut[0]), F.lit(cut[1]), tie=key))


def merge_ranked(lists: list[DataFrame], k: int, by: str = "est", tie: str = "key") -> DataFrame:
    """The ``k`` hottest rows of several ranked lists."""
    merged = lists[0]
    for other in lists[1:]:
        merged = merged.unionByName(other)
    return top_k(merged, k, by, tie)


def report_lines(hot: DataFrame, key: str = "key", digits: int | None = None) -> DataFrame:
    """One printable line per hot key."""
    est = F.col("est").cast("string") if digits is None else F.format_string(f"%.{digits}f", "est")
    return hot.select(
        F.concat(
            F.lit("Address: "), F.col(key).cast("string"), F.lit(" EstimatedFrequency: "), est
        ).alias("line")
    )


def observed(df: DataFrame, hot_fraction: float, name: str = "run") -> tuple[DataFrame, Observation]:
    """``df`` with counters that fill in as it is read: ``rows`` and ``budget``."""
    seen = Observation(name)
    rows = F.count(F.lit(1))
    return (
        df.observe(seen, rows.alias("rows"), F.floor(rows * F.lit(hot_fraction)).alias("budget")),
        seen,
    )
