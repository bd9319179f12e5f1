"""Backward heat: bounds that tighten as older slices are read.

At horizon ``t`` only slices ``t .. end`` have been read. ``est`` sums
``alpha * (1 - alpha) ** (end - s)`` over a key's slices there; the bounds say
what it can still become. Bounds are only ever taken after whole slices, which
is what makes them sound. Keys not seen yet have the upper bound of an estimate
of zero.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from heatlens.functions.decay import block_span, decay, slices_to_reach, weight
from heatlens.functions.slices import int_div
from heatlens.operators.selection import kth_and_next, nth_by_group, top_k
from heatlens.params import DEFAULT_ALPHA
from heatlens.staging import small_table, stage

# A source of ``(key, slice)`` rows from slice t on, and before another slice if one is given; see ``tail_of``.
Tail = Callable[..., DataFrame]

FIRST_SPAN = 16
# Steps of the histogram of sums for each factor of e, and of a step that is counted again.
STEPS = 64
FINER = 1024
# Candidate keys are broadcast up to so many.
BROADCAST_KEYS = 100_000
# Below this doubles lose digits: such bounds settle nothing.
TINY = 1e-290


def tail_of(accesses: DataFrame) -> Tail:
    """Read newest-first from a table: a filter on the slice."""

    def tail(t: int, before: int | None = None) -> DataFrame:
        recent = accesses.filter(F.col("slice") >= F.lit(t))
        return recent if before is None else recent.filter(F.col("slice") < F.lit(before))

    return tail


def heat_backward(tail: DataFrame, end: int, alpha: float = DEFAULT_ALPHA) -> DataFrame:
    """``(key, est)`` over the slices present in ``tail``."""
    counted = tail.select("key", "slice").distinct()
    return counted.groupBy("key").agg(F.sum(weight(alpha, F.lit(end) - F.col("slice"))).alias("est"))


def with_bounds(
    heat: DataFrame, t: int, end: int, start: int = 1, alpha: float = DEFAULT_ALPHA
) -> DataFrame:
    """Add ``lower`` and ``upper`` for horizon ``t``."""
    return heat.withColumn("lower", F.col("est") + decay(alpha, end - start + 1)).withColumn(
        "upper", F.col("est") + decay(alpha, end - t + 1)
    )


def recent_distinct_keys(df: DataFrame, k: int, order: str = "n") -> DataFrame:
    """The ``k + 1`` keys accessed last, with their newest access."""
    newest = df.groupBy("key").agg(F.max(order).alias(order))
    return top_k(newest, k + 1, by=order)


def admission_threshold(kth: float | None, end: int, alpha: float = DEFAULT_ALPHA) -> float:
    """A key first seen at or before this slice cannot reach ``kth``. Without a K-th, or
    with one of 0, every key can: minus infinity."""
    if not kth:
        return float("-inf")
    return end - slices_to_reach(alpha, kth)


def overlap_slice_bound(overlap: float | None, end: int, alpha: float = DEFAULT_ALPHA) -> float:
    """How far back to read until bounds are narrower than ``overlap``. Without an overlap,
    or with one of 0, everything: minus infinity."""
    if not overlap:
        return float("-inf")
    return end + 1 - slices_to_reach(alpha, overlap)


def prune_candidates(bounds: DataFrame, kth: float | None) -> DataFrame:
    """Keys that can still be among the K hottest. Ties with the K-th stay; without a K-th
    all do."""
    if kth is None:
        return bounds
    return bounds.filter(F.col("upper") >= F.lit(kth))


def bucket_status(bounds: DataFrame, budgets: dict[int, int], bucket: str = "bucket") -> DataFrame:
    """``(bucket, kth, low_count, up_count)``; zeros for a bucket that holds
    fewer keys than its budget or has none."""
    found = nth_by_group(bounds, bucket, "lower", budgets, largest=True)
    table = small_table(
        bounds.sparkSession,
        [(b, float(found[b][0]) if b in found else 0.0, b in found) for b in sorted(budgets)],
        f"{bucket} int, kth double, filled boolean",
    )
    above = (
        bounds.join(F.broadcast(table.filter("filled")), bucket)
        .groupBy(bucket)
        .agg(
            F.count_if(F.col("lower") > F.col("kth")).alias("low_count"),
            F.count_if(F.col("upper") > F.col("kth")).alias("up_count"),
        )
    )
    return table.join(above, bucket, "left").select(
        bucket,
        "kth",
        F.coalesce("low_count", F.lit(0)).alias("low_count"),
        F.coalesce("up_count", F.lit(0)).alias("up_count"),
    )


def threshold_counts(bounds: DataFrame, threshold: float) -> DataFrame:
    """``(lower_count, upper_count, overlap)``: keys whose bounds exceed the
    threshold, and the smallest amount by which an upper bound does."""
    theta = F.lit(threshold)
    over = F.col("upper") - theta
    return bounds.agg(
        F.count_if(F.col("lower") > theta).alias("lower_count"),
        F.count_if(F.col("upper") > theta).alias("upper_count"),
        F.min(F.when(over > 0, over)).alias("overlap"),
    )


def finalize_hot_set(bounds: DataFrame, threshold: float | None, k: int | None = None) -> DataFrame:
    """Keys whose upper bound exceeds the threshold, coolest first. The threshold should lie
    between the K-th and the next bound (:func:`threshold_between`): at the K-th itself,
    bounds that have met would leave that key out. With ``k``, keys at the threshold fill up
    the set by key when fewer than ``k`` exceed it."""
    if threshold is None:
        return bounds.orderBy("est", "key")
    kept = bounds.filter(F.col("upper") > F.lit(threshold))
    if k is not None and kept.count() < k:
        kept = top_k(bounds, k, by="upper")
    return kept.orderBy("est", "key")


def threshold_between(bounds: DataFrame, k: int) -> float | None:
    """Half way between the K-th and the next lower bound, so that ``k`` keys clear it
    unless the two tie (:func:`finalize_hot_set` then takes ``k``); ``None``, which all clear,
    with no more keys than ``k``."""
    kth, following = kth_and_next(bounds, k, "lower")
    return None if kth is None or following is None else (kth + following) / 2


@dataclass(frozen=True)
class BackwardResult:
    """A hot set and how it was reached.

    ``settled`` has the members with what was known of them at ``horizon``, the
    slice at which membership was settled: ``est`` there is a lower bound, and
    older slices are not read. ``hot`` completes the estimates of the members,
    coolest first; it is lazy, and only computing it reads the rest of the trace, for the members alone.
    ``counts`` has the members by bucket, if the search was told of buckets. Estimates are not rounded, but keys rank by their rounded logarithms.
    """

    hot: DataFrame
    settled: DataFrame
    horizon: int
    horizons: tuple[int, ...]
    separated: float | None = None
    counts: DataFrame | None = None

    @cached_property
    def threshold(self) -> float:
        """Separates the set, unless a tie at the K-th place was broken by key."""
        if self.separated is not None:
            return self.separated
        return self.hot.agg(F.min("est").alias("est")).first()["est"] or 0.0


def backward_hot_set(
    tail: Tail, end: int, k: int, alpha: float = DEFAULT_ALPHA, digits: int = 12, first_span: int = FIRST_SPAN
) -> BackwardResult:
    """The exact ``k`` hottest keys, reading no further back than needed and nothing twice.

    What was read is carried as one sum per key, to which each further span of slices is added. Keys
    that can no longer reach the K-th lower bound are left out of it, and once no unseen key can
    reach it either, older rows of other keys are not even shuffled.

    Stops at a horizon where exactly ``k`` keys can still reach the K-th lower
    bound and no unseen key can. Otherwise at least doubles the slices read. Keys whose
    estimates agree in about ``digits`` significant digits tie, however small they are.
    """
    return _search(tail, end, k, alpha, digits, first_span)


def threshold_search(
    tail: Tail,
    end: int,
    k: int,
    bucket_of: Callable[[DataFrame], DataFrame],
    alpha: float = DEFAULT_ALPHA,
    digits: int = 12,
    first_span: int = FIRST_SPAN,
) -> BackwardResult:
    """As :func:`backward_hot_set`, by a threshold that ``k`` keys of all buckets clear together.

    At each horizon one job counts the sums of all buckets by step of their logarithm. That histogram
    holds the counts of every candidate threshold at once, for lower and upper bounds alike, as these
    are equally far from the sums. Only where the K-th and the next key share a step that is
    wider than the bounds are apart, that step is counted again in finer ones.
    """
    found = _search(tail, end, k, alpha, digits, first_span)
    return replace(found, counts=bucket_of(found.settled).groupBy("bucket").agg(F.count("*").alias("members")))


def _search(tail: Tail, end: int, k: int, alpha: float, digits: int, first_span: int) -> BackwardResult:
    if k <= 0:
        nothing = heat_backward(tail(1), end, alpha).limit(0)
        return BackwardResult(nothing, nothing, end, (), math.inf)
    near = _near(end, alpha, digits)
    base = (1.0 - alpha) ** end  # lower bounds exceed the sums by this
    state, keys, span, before, seen = None, None, min(first_span, end), None, []
    while span < end:
        t = end - span + 1
        seen.append(t)
        rows = tail(t, before)
        if keys is not None:
            rows = _of_keys(rows, state, keys)
        state, before = stage(_add(state, rows, end, alpha), "carried"), t
        unseen, width = (1.0 - alpha) ** span, _width(span, end, alpha)
        place = _place(state, k, unseen, width)
        sure, gap = None, None
        if place is not None and place.kth + base > TINY:
            kth = place.kth + base
            sure, slack = kth * (1.0 - near), near * kth
            theta = None
            if place.following is None:
                theta = kth - 2 * slack if place.whole else None
            else:
                gap = place.kth - place.following
                theta = kth - (gap - width) / 2 if gap > width + 4 * slack else None
            if theta is not None and unseen < theta * (1.0 - near):
                members = state.filter(F.col("est") + F.lit(unseen) > F.lit(theta))
                hot = _complete(tail, members, k, t, end, alpha, digits)
                return BackwardResult(hot, members.select("key", "est"), t, tuple(seen), theta)
            state = state.filter(F.col("est") + F.lit(unseen) >= F.lit(sure))
            keys = place.reaching if unseen < sure else None
        span = _next_span(span, end, sure, gap, alpha)
    rows = tail(1, before)
    if keys is not None:
        rows = _of_keys(rows, state, keys)
    hot = top_k(_ranked(_add(state, rows, end, alpha), end, alpha, digits), k, by="rank")
    hot = hot.orderBy("rank", "key").select("key", "est")
    return BackwardResult(hot, hot, 1, (*seen, 1))


@dataclass(frozen=True)
class _Place:
    """Where the K-th largest sum is: ``kth`` is at most that sum. With ``whole``, the ``k``
    keys from it on are told apart from the rest, the largest of which is ``following``. At most
    ``reaching`` keys can still reach it."""

    kth: float
    following: float | None
    whole: bool
    reaching: int


def _place(state: DataFrame, k: int, floor: float, width: float) -> _Place | None:
    """``None`` when the K-th sum is below ``floor``, which no stop allows."""
    step = F.when(F.col("est") >= F.lit(floor), F.floor(F.ln("est") * STEPS)).otherwise(F.lit(None))
    steps = _histogram(state, step)
    above, inside = 0, None
    for number in sorted((n for n in steps if n is not None), reverse=True):
        if above + steps[number].rows >= k:
            inside = number
            break
        above += steps[number].rows
    if inside is None:
        return None
    cell, wanted, narrowed = steps[inside], k - above, state
    lower = [s for n, s in steps.items() if n is None or n < inside]
    following = max((s.high for s in lower), default=None)
    reaching = sum(s.rows for s in steps.values() if s.high + width >= cell.low)
    while cell.rows > wanted and cell.high - cell.low > width:
        low, size = cell.low, (cell.high - cell.low) / FINER
        narrowed = narrowed.filter(F.col("est").between(cell.low, cell.high))
        finer = _histogram(narrowed, F.floor((F.col("est") - F.lit(low)) / F.lit(size)))
        order = sorted(finer, reverse=True)
        for i, number in enumerate(order):
            if finer[number].rows >= wanted:
                break
            wanted -= finer[number].rows
        cell = finer[number]
        following = finer[order[i + 1]].high if i + 1 < len(order) else following
    if cell.rows > wanted:
        return _Place(cell.low, cell.low, False, reaching)
    return _Place(cell.low, following, True, reaching)


def _histogram(state: DataFrame, step: Column) -> dict[int | None, Row]:
    """``rows, low, high`` of the sums by step: at most ``STEPS`` rows for each factor of e."""
    counted = state.groupBy(step.alias("step")).agg(
        F.count("*").alias("rows"), F.min("est").alias("low"), F.max("est").alias("high")
    )
    return {r["step"]: r for r in counted.collect()}


def _of_keys(rows: DataFrame, state: DataFrame, keys: int) -> DataFrame:
    """The rows of the keys in ``state``, at most ``keys`` of them."""
    if keys <= BROADCAST_KEYS:
        return rows.join(F.broadcast(state.select("key")), "key", "left_semi")
    # once per (key, slice) first: a hot key is then a row per slice at most
    return rows.select("key", "slice").distinct().join(state.select("key"), "key", "left_semi")


def _add(state: DataFrame | None, rows: DataFrame, end: int, alpha: float) -> DataFrame:
    """``(key, block, mass, est)``: the sums in ``state`` and those of older ``rows`` (``key, slice``).

    Beyond the slices that doubles can span, weights are summed by blocks of slices, and a
    key's ``mass`` is relative to its newest ``block``.
    """
    span = block_span(alpha)
    age = F.lit(end) - F.col("slice")
    counted = rows.select("key", "slice").distinct()
    if end <= span:
        mass = counted.select("key", weight(alpha, age).alias("mass"))
        if state is not None:
            fresh = mass.groupBy("key").agg(F.sum("mass").alias("mass"))
            mass = state.select("key", "mass").unionByName(fresh)
        summed = mass.groupBy("key").agg(F.sum("mass").alias("mass"))
        return summed.select("key", F.lit(0).cast("long").alias("block"), "mass", F.col("mass").alias("est"))
    blocks = counted.groupBy("key", int_div(age, span).cast("long").alias("block")).agg(
        F.sum(weight(alpha, age % F.lit(span))).alias("mass")
    )
    if state is not None:
        blocks = state.select("key", "block", "mass").unionByName(blocks)
    newest = F.min("block").over(Window.partitionBy("key"))
    folded = (
        blocks.withColumn("newest", newest)
        .groupBy("key", F.col("newest"))
        .agg(F.sum(F.col("mass") * decay(alpha, (F.col("block") - F.col("newest")) * F.lit(span))).alias("mass"))
    )
    est = F.col("mass") * decay(alpha, F.col("newest") * F.lit(span))
    return folded.select("key", F.col("newest").alias("block"), "mass", est.alias("est"))


def _ranked(sums: DataFrame, end: int, alpha: float, digits: int) -> DataFrame:
    """``(key, est, rank)``, ``rank`` the rounded logarithm of ``est``: old keys keep their order where ``est`` is 0."""
    older = F.col("block") * F.lit(block_span(alpha) * math.log1p(-alpha))
    return sums.select("key", "est", F.round(F.ln("mass") + older, _rank_digits(end, alpha, digits)).alias("rank"))


def _complete(tail, members, k, t, end, alpha, digits) -> DataFrame:
    """The final estimates of the settled members: what is older than ``t`` is added to their sums."""
    older = _of_keys(tail(1, t), members, k)
    return _ranked(_add(members, older, end, alpha), end, alpha, digits).orderBy("rank", "key").select("key", "est")


def tighten_bounds(
    tail: Tail, candidates: DataFrame, t: int, end: int, alpha: float = DEFAULT_ALPHA
) -> DataFrame:
    """Bounds of the candidate keys at an earlier horizon ``t``."""
    counted = tail(t).select("key", "slice").distinct()
    kept = counted.join(candidates.select("key"), "key", "left_semi")
    return with_bounds(heat_backward(kept, end, alpha), t, end, 1, alpha)


def _width(span: int, end: int, alpha: float) -> float:
    """``upper - lower``, the same for every key."""
    return (1.0 - alpha) ** span - (1.0 - alpha) ** end


def _rank_digits(end: int, alpha: float, digits: int) -> int:
    """Decimals of a logarithm that sums in any order agree on: a double has fewer the
    larger the logarithm can be."""
    largest = 1.0 - end * math.log1p(-alpha)
    return max(1, min(digits, 13 - math.ceil(math.log10(largest))))


def _near(end: int, alpha: float, digits: int) -> float:
    """Estimates that differ by a smaller part of theirs may tie once their logarithms are
    rounded: never separate them."""
    return 2.0 * 10.0 ** -_rank_digits(end, alpha, digits)


def _next_span(span: int, end: int, sure: float | None, gap: float | None, alpha: float) -> int:
    """At least double, and far enough that unseen keys fall below ``sure`` and bounds come closer than ``gap``, which
    is only a guess before the older slices are read."""
    needed = math.floor(slices_to_reach(alpha, sure)) + 1 if sure else span
    if gap:
        needed = max(needed, min(math.floor(slices_to_reach(alpha, gap)) + 1, 4 * span))
    return min(end, max(2 * span, needed))
