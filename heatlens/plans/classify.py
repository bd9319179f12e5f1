"""The classifiers. Each takes an access table and returns ``(key, est)``.

Forward hot sets come hottest first, backward ones coolest first. The driver only
ever holds scalars: row counts, a time span, quantile cuts, a K-th value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from heatlens.functions import slices as sl
from heatlens.functions.buckets import key_bucket
from heatlens.operators import partials as tp
from heatlens.operators.backward import FIRST_SPAN, BackwardResult, Tail, backward_hot_set, tail_of, threshold_search
from heatlens.operators.forward import heat_forward, run_starts, slice_dedup
from heatlens.operators.hotset import hot_set_overlap, merge_ranked
from heatlens.operators.neighbor import MAX_BINS, heat_of_counted
from heatlens.operators.ordinal import ArrivalProfile, arrival_bin, profile_arrival, with_ordinal, with_ordinal_slice
from heatlens.operators.selection import top_k, top_k_by_group
from heatlens.params import FIXED_INTERVAL, TOTAL_SLICES, HeatParams
from heatlens.staging import stage

FIXED_TOP = 100
# Accesses that a search reads first at least.
FIRST_ROWS = 1_000_000


@dataclass(frozen=True)
class TraceSpan:
    """Clock facts of a trace: the first and last by arrival, and the extremes."""

    rows: int
    first: int
    last: int
    low: int
    high: int

    def interval(self, slices: int) -> int:
        return max(1, (self.last - self.first) // slices)


def span_frame(accesses: DataFrame) -> DataFrame:
    """``(rows, first, last, low, high)`` of the accesses that have a time. Without an
    arrival column the clock is the order."""
    by_arrival = "arrival" in accesses.columns
    return accesses.dropna(subset=["ts"]).agg(
        F.count("*").alias("rows"),
        (F.min_by("ts", "arrival") if by_arrival else F.min("ts")).alias("first"),
        (F.max_by("ts", "arrival") if by_arrival else F.max("ts")).alias("last"),
        F.min("ts").alias("low"),
        F.max("ts").alias("high"),
    )


def trace_span(accesses: DataFrame) -> TraceSpan:
    row = span_frame(accesses).first()
    return TraceSpan(row["rows"], *(row[c] or 0 for c in ("first", "last", "low", "high")))


def _ranked(heat: DataFrame, params: HeatParams) -> DataFrame:
    return heat.select("key", F.round("est", params.digits).alias("est"))


def forward_heat(
    accesses: DataFrame, params: HeatParams, profile: ArrivalProfile
) -> DataFrame:
    """Forward heat of every key over slices of equally many accesses."""
    size = params.slice_size(profile.rows)
    sliced = with_ordinal_slice(
        accesses.select("key", "arrival"), profile, lambda n: sl.forward_slice(n, size)
    )
    newest = 1 - (-(profile.rows - 1) // size)
    return heat_forward(slice_dedup(sliced), params.alpha, newest)


def classify_forward(
    accesses: DataFrame, params: HeatParams = HeatParams(), profile: ArrivalProfile | None = None
) -> DataFrame:
    """Slices by access count, forward heat, global budget."""
    profile = profile or profile_arrival(accesses)
    heat = forward_heat(accesses, params, profile)
    return top_k(_ranked(heat, params), params.budget(profile.rows))


def counted_accesses(accesses: DataFrame, params: HeatParams, profile: ArrivalProfile) -> DataFrame:
    """``(key, slice, arrival, bin)``: a key's first access in each slice it occurs in. Arrivals give the order, so
    nothing is numbered; ``bin`` grows along them."""
    size = params.slice_size(profile.rows)
    sliced = with_ordinal_slice(accesses.select("key", "arrival"), profile, lambda n: sl.forward_slice(n, size))
    counted = slice_dedup(sliced, order="arrival").select("key", "slice", "arrival")
    # slices split the bins further, as long as the bins stay few
    groups = min(params.slice_count, MAX_BINS) + 2
    group = sl.int_div(F.col("slice"), -(-(profile.rows // size + 2) // groups))
    binned = arrival_bin(counted, profile)
    return binned.withColumn("bin", F.col("bin").cast("long") * F.lit(groups + 1) + group)


def _neighbor_of(counted: DataFrame, params: HeatParams) -> DataFrame:
    return heat_of_counted(counted, F.col("bin"), params.alpha, order="arrival")


def neighbor_heat(accesses: DataFrame, params: HeatParams, profile: ArrivalProfile) -> DataFrame:
    return _neighbor_of(counted_accesses(accesses, params, profile), params)


def neighbor_overlap(
    accesses: DataFrame, params: HeatParams = HeatParams(), profile: ArrivalProfile | None = None
) -> DataFrame:
    """How far neighbour reuse changes the hot set: ``(n_both, n_a, n_b, recall)`` of the sets with and
    without it. Both estimators read one written table of counted accesses."""
    profile = profile or profile_arrival(accesses)
    counted = stage(counted_accesses(accesses, params, profile), "counted")
    newest = 1 - (-(profile.rows - 1) // params.slice_size(profile.rows))
    k = params.budget(profile.rows)
    plain = heat_forward(counted, params.alpha, newest)
    return hot_set_overlap(top_k(_ranked(_neighbor_of(counted, params), params), k), top_k(_ranked(plain, params), k))


def classify_neighbor(
    accesses: DataFrame, params: HeatParams = HeatParams(), profile: ArrivalProfile | None = None
) -> DataFrame:
    """As :func:`classify_forward`, with the estimate of a close neighbour reused."""
    profile = profile or profile_arrival(accesses)
    heat = neighbor_heat(accesses, params, profile)
    return top_k(_ranked(heat, params), params.budget(profile.rows))


def slices_in_order(sliced: DataFrame) -> bool:
    """Whether ``slice`` never falls along ``arrival``: no slice begins before an earlier one has ended. One
    aggregate with a row per slice, and no sort of the accesses. Rows without an arrival don't matter."""
    ends = sliced.groupBy("slice").agg(F.min("arrival").alias("low"), F.max("arrival").alias("high")).dropna()
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return ends.filter(F.col("low").isNotNull()).withColumn("ended", F.max("high").over(earlier)).filter("ended > low").isEmpty()


def clock_heat(
    accesses: DataFrame, params: HeatParams, span: TraceSpan, in_order: bool | None = None
) -> DataFrame:
    """Forward heat of every key over equally long slices of the clock.

    ``in_order`` says whether the slices never run backwards along ``arrival``, which saves
    a shuffle. Unless told, a table with arrivals is looked at (:func:`slices_in_order`) and folded in their
    order if they do; without arrivals the clock is the order.
    """
    accesses = accesses.dropna(subset=["ts"])
    interval = span.interval(params.slice_count)
    number = sl.timestamp_slice("ts", span.first, interval)
    if in_order is None:
        in_order = "arrival" not in accesses.columns or slices_in_order(accesses.select("arrival", number.alias("slice")))
    # slices before the first one need the general fold
    newest = (span.high - span.first) // interval if span.low >= span.first else None
    if in_order:
        sliced = accesses.select("key", number.alias("slice"))
        return heat_forward(slice_dedup(sliced), params.alpha, newest)
    numbered = with_ordinal(accesses, profile_arrival(accesses))
    counted = run_starts(numbered.select("key", "n", number.alias("slice")))
    return heat_forward(counted, params.alpha, newest, order="n")


def classify_by_block(
    accesses: DataFrame, params: HeatParams = HeatParams(), in_order: bool | None = None
) -> DataFrame:
    """Slices by clock, an equal share of the budget for each key bucket."""
    span = trace_span(accesses)
    budget = params.budget(span.rows)
    heat = _ranked(clock_heat(accesses, params, span, in_order), params)
    bucketed = heat.withColumn("bucket", key_bucket("key", params.buckets))
    lists = top_k_by_group(bucketed, "bucket", budget // params.buckets)
    return merge_ranked([lists.drop("bucket")], budget)


def time_partial_heat(
    accesses: DataFrame, params: HeatParams, span: TraceSpan, in_memory: bool = False, in_order: bool | None = None
) -> DataFrame:
    """``(part, key, partial)`` of either time-partition rule. ``in_order`` says whether slices never
    run backwards along ``arrival``, which saves numbering the accesses; unless told, they are looked at."""
    rule = sl.memory_time_partition if in_memory else sl.file_time_partition
    part, number = rule("ts", span.first, span.interval(params.slice_count), params.slice_count, params.buckets)
    timed = accesses.dropna(subset=["ts"])
    tagged = timed.select("key", "arrival", part.alias("part"), number.alias("slice"))
    if in_memory:
        return tp.partial_by_slice_number(tagged, params.alpha)
    if in_order is None:
        in_order = slices_in_order(tagged.select("arrival", "slice"))
    if in_order:
        return tp.partial_by_slice_rank(tagged, params.slices_per_part, params.slice_count, params.alpha)
    numbered = with_ordinal(tagged, profile_arrival(tagged))
    return tp.partial_by_slice_run(numbered, params.slices_per_part, params.alpha)


def classify_by_time(
    accesses: DataFrame, params: HeatParams = HeatParams(), in_memory: bool = False, k: int = FIXED_TOP,
    in_order: bool | None = None, span: TraceSpan | None = None,
) -> DataFrame:
    """Time partitions scored apart and rolled up; a fixed number of keys."""
    partials = time_partial_heat(accesses, params, span or trace_span(accesses), in_memory, in_order)
    return top_k(_ranked(tp.roll_up(partials, params.slices_per_part, params.alpha), params), k)


def ordinal_tail(
    accesses: DataFrame,
    profile: ArrivalProfile,
    slice_of: Callable[[Column], Column],
    first_ordinal: Callable[[int], int],
) -> Tail:
    """Newest-first reads over ordinal slices.

    ``first_ordinal(t)`` is the ordinal slice ``t`` starts at. The bins that hold the
    slices asked for are a plain comparison on the arrival column, which the scan can use
    to skip files and row groups. A table of a single bin has nothing to skip and
    is sliced once, and written if it is read in parts.
    """
    columns = accesses.select("key", "arrival")
    if profile.bins == 1:
        whole = with_ordinal_slice(columns, profile, slice_of).select("key", "slice")
        held: list[Tail] = []

        def part(t: int, before: int | None = None) -> DataFrame:
            if t <= 1 and before is None and not held:
                return whole
            if not held:
                held.append(tail_of(stage(whole.distinct(), "sliced")))
            return held[0](t, before)

        return part

    def tail(t: int, before: int | None = None) -> DataFrame:
        last = None if before is None else first_ordinal(before) - 1
        bins = profile.bins_of(first_ordinal(t), last)
        low, high = profile.arrivals_of(*bins)
        span = columns if low is None else columns.filter(F.col("arrival") >= F.lit(low))
        span = span if high is None else span.filter(F.col("arrival") <= F.lit(high))
        sliced = with_ordinal_slice(span, profile, slice_of, bins=bins).select("key", "slice")
        return tail_of(sliced)(t, before)

    return tail


def serial_tail(accesses: DataFrame, params: HeatParams, profile: ArrivalProfile) -> tuple[Tail, int]:
    """Slices counted back from the newest access, and their end slice."""
    rows, size = profile.rows, params.slice_size(profile.rows)
    end = sl.tail_end(rows, size, params.slice_count)
    return (
        ordinal_tail(
            accesses,
            profile,
            lambda n: sl.tail_slice(n, rows, size, end),
            lambda t: rows - (end - t + 1) * size,
        ),
        end,
    )


def bucketed_tail(accesses: DataFrame, params: HeatParams, profile: ArrivalProfile) -> tuple[Tail, int]:
    size = params.slice_size(profile.rows)
    tail = ordinal_tail(
        accesses, profile, lambda n: sl.bucketed_slice(n, size), lambda t: (t - 1) * size - 1
    )
    return tail, profile.rows // size + 1


def fixed_tail(
    accesses: DataFrame, profile: ArrivalProfile, interval: int = FIXED_INTERVAL
) -> tuple[Tail, int]:
    tail = ordinal_tail(
        accesses, profile, lambda n: sl.fixed_slice(n, interval), lambda t: (t - 1) * interval - 2
    )
    return tail, sl.fixed_end(profile.rows, interval)


def bucket_budgets(accesses: DataFrame, params: HeatParams) -> dict[int, int]:
    """Each bucket's own budget, from the accesses it holds."""
    per_key = accesses.groupBy("key").agg(F.count("*").alias("rows"))
    per_bucket = per_key.groupBy(key_bucket("key", params.buckets).alias("bucket")).agg(
        F.sum("rows").alias("rows")
    )
    return {r["bucket"]: params.budget(r["rows"]) for r in per_bucket.collect()}


def first_span(size: int, first_rows: int) -> int:
    """Slices of ``size`` accesses read first: a job for fewer than ``first_rows`` accesses costs more than reading them."""
    return max(FIRST_SPAN, -(-first_rows // size))


def search_backward(
    accesses: DataFrame,
    params: HeatParams = HeatParams(),
    profile: ArrivalProfile | None = None,
    first_rows: int = FIRST_ROWS,
) -> BackwardResult:
    """Newest-first with bounds; the budget covers whole slices."""
    profile = profile or profile_arrival(accesses)
    tail, end = serial_tail(accesses, params, profile)
    size = params.slice_size(profile.rows)
    k = params.budget(size * (params.slice_count + 1))
    return backward_hot_set(tail, end, k, params.alpha, params.digits, first_span(size, first_rows))


def search_backward_bucketed(
    accesses: DataFrame,
    params: HeatParams = HeatParams(),
    profile: ArrivalProfile | None = None,
    first_rows: int = FIRST_ROWS,
) -> BackwardResult:
    """Newest-first with a threshold that all key buckets share."""
    profile = profile or profile_arrival(accesses)
    tail, end = bucketed_tail(accesses, params, profile)
    return _search_threshold(tail, end, profile, params, first_span(params.slice_size(profile.rows), first_rows))


def search_backward_fixed(
    accesses: DataFrame,
    params: HeatParams = HeatParams(hot_fraction=0.01),
    profile: ArrivalProfile | None = None,
    interval: int = FIXED_INTERVAL,
    first_rows: int = FIRST_ROWS,
) -> BackwardResult:
    """As :func:`search_backward_bucketed` with slices of ``interval`` accesses."""
    profile = profile or profile_arrival(accesses)
    tail, end = fixed_tail(accesses, profile, interval)
    return _search_threshold(tail, end, profile, params, first_span(interval, first_rows))


def _search_threshold(tail: Tail, end: int, profile: ArrivalProfile, params: HeatParams, span: int) -> BackwardResult:
    return threshold_search(
        tail,
        end,
        params.budget(profile.rows + 1),
        lambda df: df.withColumn("bucket", key_bucket("key", params.buckets)),
        params.alpha,
        params.digits,
        span,
    )


def classify_backward(accesses: DataFrame, params: HeatParams = HeatParams()) -> DataFrame:
    return search_backward(accesses, params).hot


def classify_backward_bucketed(accesses: DataFrame, params: HeatParams = HeatParams()) -> DataFrame:
    return search_backward_bucketed(accesses, params).hot


def classify_backward_fixed(
    accesses: DataFrame, params: HeatParams = HeatParams(hot_fraction=0.01), interval: int = FIXED_INTERVAL
) -> DataFrame:
    return search_backward_fixed(accesses, params, interval=interval).hot


def total_slice_size(rows: int) -> int:
    return max(1, rows // TOTAL_SLICES)


def local_fraction(
    heat: DataFrame, fraction: float, bucket: str = "bucket"
) -> DataFrame:
    """The hottest ``2 * fraction`` of each bucket's keys."""
    if 2 * fraction >= 1.0:
        return heat
    sizes = heat.groupBy(bucket).agg(F.count("*").alias("keys")).collect()
    return top_k_by_group(heat, bucket, {r[bucket]: int(r["keys"] * fraction * 2) for r in sizes})


def classify_total_by_block(
    accesses: DataFrame,
    params: HeatParams = HeatParams(hot_fraction=0.5),
    profile: ArrivalProfile | None = None,
) -> DataFrame:
    """Slices of a thousandth of the trace, a local then a global share of keys."""
    profile = profile or profile_arrival(accesses)
    size = total_slice_size(profile.rows)
    sliced = with_ordinal_slice(
        accesses.select("key", "arrival"), profile, lambda n: sl.total_slice(n, size)
    )
    heat = heat_forward(slice_dedup(sliced), params.alpha, profile.rows // size + 1)
    bucketed = _ranked(heat, params).withColumn("bucket", key_bucket("key", params.buckets))
    local = local_fraction(bucketed, params.hot_fraction)
    return top_k(local.select("key", "est"), params.budget(profile.rows))


def total_partials(
    accesses: DataFrame, params: HeatParams, profile: ArrivalProfile
) -> tuple[DataFrame, int]:
    """Partials over contiguous runs of arrivals, and the slices per run."""
    size, parts = total_slice_size(profile.rows), params.buckets
    per_part = TOTAL_SLICES // parts
    numbered = with_ordinal(accesses.select("key", "arrival"), profile)
    tagged = numbered.select(
        "key",
        "n",
        sl.ordinal_part("n", profile.rows, parts).alias("part"),
        sl.total_slice("n", size).alias("slice"),
    )
    return tp.partial_by_slice_rank(tagged, per_part, 2 * TOTAL_SLICES, params.alpha, order="n"), per_part


def classify_total_by_time(
    accesses: DataFrame,
    params: HeatParams = HeatParams(hot_fraction=0.5),
    profile: ArrivalProfile | None = None,
) -> DataFrame:
    """Runs of arrivals scored apart, rolled up with a growing decay."""
    profile = profile or profile_arrival(accesses)
    partials, per_part = total_partials(accesses, params, profile)
    heat = tp.roll_up_growing(partials, per_part, params.alpha)
    return top_k(_ranked(heat, params), params.budget(profile.rows))
