"""One query per operator: ``(spark, table folder) -> DataFrame``.

``events`` is the main access table (key ``user_id``, arrival ``event_id``, clock
``ts``). ``lineitem`` has a clock but no arrival column; ``orders`` has a clock
that runs backwards along its arrival column. Estimates are rounded to
``DIGITS`` decimals so that any engine cuts a ranking at the same row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from heatlens.functions import slices as sl
from heatlens.functions.buckets import key_bucket, string_hash
from heatlens.operators import backward as bw, forward as fw, hotset, partials as tp, selection as sel
from heatlens.operators.ordinal import ArrivalProfile, profile_arrival, with_ordinal, with_ordinal_slice
from heatlens.params import HeatParams
from heatlens.plans import classify as cl, layout
from heatlens.sources import trace as tr
from heatlens.sources.accesses import accesses_from, as_micros
from heatlens.staging import small_table, staging_path

Query = Callable[[SparkSession, str], DataFrame]

# Even on purpose: sums of 0.05 * 0.95**i end at an even decimal place, so none lies
# exactly half way between two roundings.
DIGITS = 10
SLICES = 100
BUCKETS = 4
FRACTION = 0.002
# Slices read by the queries about one horizon, and by the tightened one.
HORIZON_SPAN = 30
TIGHT_SPAN = 60

EVENTS = HeatParams(slices=SLICES, hot_fraction=FRACTION, buckets=BUCKETS, digits=DIGITS)
WIDE = HeatParams(slices=SLICES, hot_fraction=0.005, buckets=BUCKETS, digits=DIGITS)
LINES = HeatParams(slices=SLICES, hot_fraction=0.005, buckets=BUCKETS, digits=DIGITS)
FIXED = HeatParams(slices=SLICES, hot_fraction=0.01, buckets=BUCKETS, digits=DIGITS)
TOTAL = HeatParams(slices=SLICES, hot_fraction=0.5, buckets=BUCKETS, digits=DIGITS)
# Slices fine enough for a clock to run back by many of them.
FINE = 1000
LOG_DIGITS = 8
LATE = 64
FINE_EVENTS = HeatParams(slices=FINE, hot_fraction=0.005, buckets=BUCKETS, digits=DIGITS)
DEEP = HeatParams(slices=2000, hot_fraction=0.2, buckets=BUCKETS, digits=DIGITS)
# Two keys get most of the accesses, and differ.
BURST = "CASE WHEN arrival % 2 = 0 THEN -1 WHEN arrival % 40 < 10 THEN -2 ELSE key END"
EARLY = HeatParams(slices=FINE, buckets=BUCKETS, digits=DIGITS)
LOCAL_FRACTION = 0.1
SHORT_INTERVAL = 50
# Low enough that the test tables span several bins.
ROWS_PER_BIN = 4096

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return accesses_from(_table(spark, folder, "events"), "user_id", "ts", "event_id")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return accesses_from(_table(spark, folder, "lineitem"), "l_partkey", "l_shipdate")


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return accesses_from(_table(spark, folder, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in cols})


def _profiled(spark: SparkSession, folder: str) -> tuple[DataFrame, ArrivalProfile]:
    events = _events(spark, folder)
    return events, profile_arrival(events, rows_per_bin=ROWS_PER_BIN)


def _numbered(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    events, profile = _profiled(spark, folder)
    return with_ordinal(events, profile), profile.rows


# Scans, sources, sinks


def _trace_text(spark: SparkSession, folder: str, files: int | None = None) -> str:
    """The events written as trace lines; those of errors lack the last field. With
    ``files``, so many follow one another in arrival order."""
    events = _table(spark, folder, "events")
    if files is not None:
        events = events.repartitionByRange(files, "event_id").sortWithinPartitions("event_id")
    path = staging_path(spark, "lines")
    digest = F.when(F.col("event_type") != "error", F.md5(F.col("props").cast("binary")))
    tr.write_lines(
        tr.format_trace(
            events,
            as_micros(events, "ts"),
            "event_id",
            "event_type",
            "user_id",
            F.floor("value").cast("int"),
            F.when(F.col("event_type") == "view", "R").otherwise("W"),
            F.lit(6),
            F.lit(0),
            digest,
        ),
        path,
    )
    return path


@query
def trace_scan(spark, folder):
    parts = tr.fields_of("value")
    return tr.read_lines(spark, _trace_text(spark, folder)).select(
        F.size(parts).alias("fields"), parts[0].alias("first_field"), parts[3].alias("fourth_field")
    )


@query
def trace_valid(spark, folder):
    trace = tr.read_trace(spark, _trace_text(spark, folder))
    return trace.drop("file", "block_start")


@query
def trace_by_bucket(spark, folder):
    numbered, rows = _numbered(spark, folder)
    tagged = numbered.select(
        "key",
        "arrival",
        sl.bucketed_slice("n", EVENTS.slice_size(rows)).alias("slice"),
        key_bucket("key", BUCKETS).alias("bucket"),
    )
    path = staging_path(spark, "by-bucket")
    tr.write_tagged(tagged, path, "bucket")
    return tr.read_tagged(spark, path).select("key", "arrival", "slice", "bucket")


@query
def trace_by_time(spark, folder):
    path = staging_path(spark, "by-time")
    tr.write_tagged(time_partition_file(spark, folder), path, "part")
    return tr.read_tagged(spark, path).withColumn("part", F.col("part").cast("bigint"))


@query
def trace_reverse(spark, folder):
    numbered, rows = _numbered(spark, folder)
    return tr.newest_first(numbered.select("key", "arrival", (F.lit(rows) - F.col("n")).alias("from_end")))


@query
def hot_set_report(spark, folder):
    return hotset.report_lines(classify_forward(spark, folder), digits=DIGITS)


@query
def access_projection(spark, folder):
    return _events(spark, folder).select("ts", "key")


# Ordinals, slices, buckets


@query
def arrival_ordinal(spark, folder):
    return _numbered(spark, folder)[0].select("key", "arrival", "n")


@query
def slice_size_by_count(spark, folder):
    size = F.greatest(F.lit(1).cast("bigint"), sl.int_div(F.count("*"), SLICES))
    return _events(spark, folder).agg(F.count("*").alias("total_rows"), size.alias("slice_size"))


@query
def slice_size_by_total(spark, folder):
    size = F.greatest(F.lit(1).cast("bigint"), sl.int_div(F.count("*"), cl.TOTAL_SLICES))
    return _events(spark, folder).agg(F.count("*").alias("total_rows"), size.alias("slice_size"))


@query
def trace_span(spark, folder):
    interval = F.greatest(F.lit(1).cast("bigint"), sl.int_div(F.col("last_ts") - F.col("first_ts"), SLICES))
    return (
        cl.span_frame(_events(spark, folder))
        .select(F.col("first").alias("first_ts"), F.col("last").alias("last_ts"))
        .withColumn("slice_interval", interval)
    )


def _sliced(spark, folder, rule) -> DataFrame:
    """Rules that never decrease need ranks only where a boundary crosses a bin."""
    events, profile = _profiled(spark, folder)
    sliced = with_ordinal_slice(events.select("key", "arrival"), profile, lambda n: rule(n, profile.rows))
    return sliced.select("key", "arrival", "slice")


@query
def slice_ordinal_forward(spark, folder):
    return _sliced(spark, folder, lambda n, rows: sl.forward_slice(n, EVENTS.slice_size(rows)))


@query
def slice_ordinal_backward(spark, folder):
    numbered, rows = _numbered(spark, folder)
    number = sl.reversed_slice("n", rows, EVENTS.slice_size(rows), SLICES)
    return numbered.select("key", "arrival", number.alias("slice"))


@query
def slice_ordinal_bucketed(spark, folder):
    return _sliced(spark, folder, lambda n, rows: sl.bucketed_slice(n, EVENTS.slice_size(rows)))


@query
def slice_fixed_interval(spark, folder):
    return _sliced(spark, folder, lambda n, rows: sl.fixed_slice(n))


@query
def slice_total_ordinal(spark, folder):
    return _sliced(spark, folder, lambda n, rows: sl.total_slice(n, cl.total_slice_size(rows)))


@query
def slice_timestamp(spark, folder):
    events = _events(spark, folder)
    span = cl.trace_span(events)
    number = sl.timestamp_slice("ts", span.first, span.interval(SLICES))
    return events.select("key", "arrival", number.alias("slice"))


def _time_tagged(spark, folder, rule) -> DataFrame:
    events = _events(spark, folder)
    span = cl.trace_span(events)
    part, number = rule("ts", span.first, span.interval(SLICES), SLICES, BUCKETS)
    return events.select("key", "arrival", number.alias("slice"), part.alias("part"))


@query
def time_partition_file(spark, folder):
    return _time_tagged(spark, folder, sl.file_time_partition)


@query
def time_partition_mem(spark, folder):
    return _time_tagged(spark, folder, sl.memory_time_partition)


@query
def block_bucket(spark, folder):
    keys = _table(spark, folder, "lineitem").select(F.col("l_partkey").alias("key")).distinct()
    return keys.select(
        "key", string_hash("key").alias("hash"), key_bucket("key", BUCKETS).alias("bucket")
    )


# Estimators


def _count_sliced(spark, folder) -> tuple[DataFrame, int]:
    numbered, rows = _numbered(spark, folder)
    return numbered.withColumn("slice", sl.forward_slice("n", EVENTS.slice_size(rows))), rows


@query
def slice_dedup(spark, folder):
    return fw.slice_dedup(_count_sliced(spark, folder)[0], order="n")


def _order_runs(spark, folder, slices=SLICES) -> DataFrame:
    """Order dates are random along the keys: slices are cut over all dates."""
    orders = _orders(spark, folder)
    span = cl.trace_span(orders.select("key", "ts"))
    numbered = with_ordinal(orders, profile_arrival(orders, rows_per_bin=ROWS_PER_BIN))
    number = sl.timestamp_slice("ts", span.first, span.interval(slices))
    return fw.run_starts(numbered.select("key", "n", number.alias("slice")), rows_per_bin=ROWS_PER_BIN)


@query
def slice_dedup_runs(spark, folder):
    return _order_runs(spark, folder).drop("opens")


@query
def heat_forward(spark, folder):
    events, profile = _profiled(spark, folder)
    return _rounded(cl.forward_heat(events, EVENTS, profile), "est")


@query
def heat_forward_runs(spark, folder):
    runs = _order_runs(spark, folder)
    return _rounded(fw.heat_forward(runs, EVENTS.alpha, SLICES, order="n"), "est")


def _logged(df: DataFrame) -> DataFrame:
    """``log_est`` for ``est``, which clocks that jump back make very large; null for 0."""
    found = F.when(F.col("est") > 0, F.round(F.ln("est"), LOG_DIGITS))
    return df.withColumn("log_est", found).drop("est")


@query
def heat_forward_runs_fine(spark, folder):
    """Slices jump back by up to ``FINE``: a later slice may outweigh all others."""
    return _logged(fw.heat_forward(_order_runs(spark, folder, FINE), EVENTS.alpha, FINE, order="n"))


@query
def heat_forward_by_clock(spark, folder):
    lines = _lines(spark, folder)
    return _rounded(cl.clock_heat(lines, LINES, cl.trace_span(lines)), "est")


@query
def heat_as_of(spark, folder):
    events, profile = _profiled(spark, folder)
    rows, size = profile.rows, EVENTS.slice_size(profile.rows)
    end = 1 - (-(rows - 1) // size)
    heat = fw.heat_as_of(cl.forward_heat(events, EVENTS, profile), end, EVENTS.alpha)
    return _rounded(heat, "est").select("key", "est")


@query
def heat_neighbor_reuse(spark, folder):
    events, profile = _profiled(spark, folder)
    return _rounded(cl.neighbor_heat(events, EVENTS, profile), "est")


def _partials(spark, folder, in_memory=False) -> DataFrame:
    events = _events(spark, folder)
    return cl.time_partial_heat(events, EVENTS, cl.trace_span(events), in_memory)


@query
def heat_time_partial(spark, folder):
    return _rounded(_partials(spark, folder), "partial")


@query
def heat_time_partial_runs(spark, folder):
    """On orders, whose clock runs backwards."""
    orders = _orders(spark, folder)
    return _rounded(cl.time_partial_heat(orders, EVENTS, cl.trace_span(orders.select("key", "ts"))), "partial")


@query
def heat_time_partial_mem(spark, folder):
    return _rounded(_partials(spark, folder, in_memory=True), "partial")


@query
def heat_rollup(spark, folder):
    return _rounded(tp.roll_up(_partials(spark, folder), EVENTS.slices_per_part), "est")


@query
def heat_rollup_growing(spark, folder):
    events, profile = _profiled(spark, folder)
    partials, per_part = cl.total_partials(events, TOTAL, profile)
    return _rounded(tp.roll_up_growing(partials, per_part), "est")


# Backward bounds


def _tail(spark, folder) -> tuple[bw.Tail, int, int]:
    events, profile = _profiled(spark, folder)
    tail, end = cl.bucketed_tail(events, EVENTS, profile)
    return tail, end, EVENTS.budget(profile.rows + 1)


def _bounds(tail, end, span=HORIZON_SPAN) -> DataFrame:
    t = max(1, end - span + 1)
    heat = bw.with_bounds(bw.heat_backward(tail(t), end), t, end)
    return _rounded(heat, "est", "lower", "upper")


@query
def heat_backward(spark, folder):
    tail, end, _ = _tail(spark, folder)
    return _bounds(tail, end).select("key", "est")


@query
def heat_bounds(spark, folder):
    tail, end, _ = _tail(spark, folder)
    return _bounds(tail, end)


@query
def run_metrics(spark, folder):
    watched, seen = hotset.observed(_events(spark, folder), FRACTION)
    keys = watched.select("key").distinct().count()
    counted = seen.get
    return small_table(
        spark,
        [(counted["rows"], counted["budget"], keys)],
        "total_rows bigint, budget bigint, distinct_keys bigint",
    )


@query
def recent_distinct_keys(spark, folder):
    numbered, rows = _numbered(spark, folder)
    return bw.recent_distinct_keys(numbered, EVENTS.budget(rows)).select("key", "n")


@query
def kth_lower(spark, folder):
    tail, end, k = _tail(spark, folder)
    kth = sel.kth_value(_bounds(tail, end), k, "lower")
    return small_table(spark, [(k, kth)], "k bigint, kth double")


@query
def admission_threshold(spark, folder):
    tail, end, k = _tail(spark, folder)
    kth = sel.kth_value(_bounds(tail, end), k, "lower")
    found = small_table(spark, [(bw.admission_threshold(kth, end),)], "threshold double")
    return found.withColumn("threshold", F.round("threshold", 6))


@query
def prune_candidates(spark, folder):
    tail, end, k = _tail(spark, folder)
    bounds = _bounds(tail, end)
    return bw.prune_candidates(bounds, sel.kth_value(bounds, k, "lower"))


@query
def backward_hot_set(spark, folder):
    tail, end, k = _tail(spark, folder)
    return _rounded(bw.backward_hot_set(tail, end, k, EVENTS.alpha, DIGITS).hot, "est")


@query
def bucket_status(spark, folder):
    events, profile = _profiled(spark, folder)
    tail, end = cl.bucketed_tail(events, EVENTS, profile)
    bounds = _bounds(tail, end).withColumn("bucket", key_bucket("key", BUCKETS))
    return bw.bucket_status(bounds, cl.bucket_budgets(events, EVENTS))


@query
def threshold_counts(spark, folder):
    tail, end, k = _tail(spark, folder)
    bounds = _bounds(tail, end)
    return _rounded(bw.threshold_counts(bounds, sel.kth_value(bounds, k, "lower")), "overlap")


@query
def overlap_slice_bound(spark, folder):
    tail, end, k = _tail(spark, folder)
    bounds = _bounds(tail, end)
    overlap = bw.threshold_counts(bounds, sel.kth_value(bounds, k, "lower")).first()["overlap"]
    reach = bw.overlap_slice_bound(overlap, end)
    return small_table(spark, [(reach,)], "t_min double").withColumn("t_min", F.round("t_min", 3))


@query
def threshold_search(spark, folder):
    events, profile = _profiled(spark, folder)
    return _rounded(cl.search_backward_bucketed(events, EVENTS, profile, first_rows=1).hot, "est")


@query
def threshold_members(spark, folder):
    """Members of the searched hot set by bucket: what the buckets report above the threshold."""
    events, profile = _profiled(spark, folder)
    return cl.search_backward_bucketed(events, EVENTS, profile, first_rows=1).counts


@query
def tighten_bounds(spark, folder):
    tail, end, k = _tail(spark, folder)
    bounds = _bounds(tail, end)
    candidates = bw.prune_candidates(bounds, sel.kth_value(bounds, k, "lower"))
    tight = bw.tighten_bounds(tail, candidates, max(1, end - TIGHT_SPAN + 1), end)
    return _rounded(tight, "est", "lower", "upper")


@query
def finalize_hot_set(spark, folder):
    tail, end, k = _tail(spark, folder)
    bounds = _bounds(tail, end, span=end)
    return bw.finalize_hot_set(bounds, bw.threshold_between(bounds, k), k).select("key", "est")


# Rankings and comparisons


def _heat(spark, folder) -> tuple[DataFrame, int]:
    events, profile = _profiled(spark, folder)
    return _rounded(cl.forward_heat(events, EVENTS, profile), "est").select("key", "est"), profile.rows


@query
def topk_per_bucket(spark, folder):
    heat, rows = _heat(spark, folder)
    bucketed = heat.withColumn("bucket", key_bucket("key", BUCKETS))
    return sel.top_k_by_group(bucketed, "bucket", EVENTS.budget(rows) // BUCKETS)


@query
def topk_merge(spark, folder):
    heat, rows = _heat(spark, folder)
    k = EVENTS.budget(rows)
    bucketed = heat.withColumn("bucket", key_bucket("key", BUCKETS))
    # one relation holds all lists, so the merge is one ranking over one plan
    ranked = sel.top_k_by_group(bucketed, "bucket", k)
    return hotset.merge_ranked([ranked.select("key", "est")], k)


@query
def hot_budget(spark, folder):
    rows = F.count("*")
    return _events(spark, folder).agg(
        F.floor(rows * F.lit(FRACTION)).alias("by_rows"),
        F.floor((rows + F.lit(1)) * F.lit(FRACTION)).alias("by_rows_plus_one"),
        F.floor(
            F.greatest(F.lit(1).cast("bigint"), sl.int_div(rows, SLICES)) * F.lit(SLICES + 1) * F.lit(FRACTION)
        ).alias("by_slices"),
    )


@query
def topk_hot(spark, folder):
    heat, rows = _heat(spark, folder)
    return sel.top_k(heat, EVENTS.budget(rows))


@query
def topk_fixed(spark, folder):
    return sel.top_k(_heat(spark, folder)[0], cl.FIXED_TOP)


@query
def topk_local_fraction(spark, folder):
    bucketed = _heat(spark, folder)[0].withColumn("bucket", key_bucket("key", BUCKETS))
    return cl.local_fraction(bucketed, LOCAL_FRACTION)


@query
def hot_set_overlap(spark, folder):
    events, profile = _profiled(spark, folder)
    return _rounded(cl.neighbor_overlap(events, WIDE, profile), "recall")


@query
def hot_cold_label(spark, folder):
    heat, rows = _heat(spark, folder)
    return hotset.label_hot(heat, EVENTS.budget(rows))


# End to end


@query
def classify_forward(spark, folder):
    return cl.classify_forward(_events(spark, folder), EVENTS)


@query
def classify_text_trace(spark, folder):
    """From text in several files, by its order in them, to a hot set."""
    trace = tr.with_file_order(tr.read_trace(spark, _trace_text(spark, folder, files=5)))
    return cl.classify_forward(tr.trace_accesses(trace), WIDE)


@query
def classify_neighbor(spark, folder):
    return cl.classify_neighbor(_events(spark, folder), EVENTS)


@query
def classify_by_block(spark, folder):
    return cl.classify_by_block(_lines(spark, folder), LINES)


@query
def classify_by_block_runs(spark, folder):
    """Events that arrive newest first in blocks of ``LATE``."""
    place = F.col("arrival") % LATE
    late = _events(spark, folder).withColumn("arrival", F.col("arrival") - place + (LATE - 1) - place)
    return cl.classify_by_block(late, FINE_EVENTS)


@query
def classify_by_time(spark, folder):
    return cl.classify_by_time(_events(spark, folder), EVENTS)


@query
def classify_by_time_runs(spark, folder):
    """On orders, whose clock runs backwards."""
    orders = _orders(spark, folder)
    return cl.classify_by_time(orders, EVENTS, span=cl.trace_span(orders.select("key", "ts")))


@query
def classify_by_time_mem(spark, folder):
    return cl.classify_by_time(_events(spark, folder), EVENTS, in_memory=True)


@query
def classify_backward(spark, folder):
    return _rounded(cl.classify_backward(_events(spark, folder), EVENTS), "est")


@query
def classify_backward_bucketed(spark, folder):
    return _rounded(cl.classify_backward_bucketed(_events(spark, folder), EVENTS), "est")


@query
def classify_backward_deep(spark, folder):
    """More members than keys in the newest 480 slices, where estimates fall below 1e-12."""
    orders = _table(spark, folder, "orders").select((F.col("o_orderkey") / 3).cast("bigint").alias("key"), "o_orderkey")
    return _logged(cl.classify_backward_bucketed(accesses_from(orders, "key", arrival="o_orderkey"), DEEP))


@query
def classify_backward_early(spark, folder):
    """Two keys far hotter than the rest: membership is settled without the older slices."""
    events = _events(spark, folder).withColumn("key", F.expr(BURST))
    tail, end = cl.serial_tail(events, EARLY, profile_arrival(events, rows_per_bin=ROWS_PER_BIN))
    found = bw.backward_hot_set(tail, end, 2, EARLY.alpha, DIGITS)
    return found.settled.select("key", F.lit(found.horizon > 1).alias("stopped_early"))


@query
def classify_total_by_block(spark, folder):
    return cl.classify_total_by_block(_events(spark, folder), TOTAL)


@query
def classify_total_by_time(spark, folder):
    return cl.classify_total_by_time(_events(spark, folder), TOTAL)


@query
def classify_backward_fixed(spark, folder):
    return _rounded(cl.classify_backward_fixed(_events(spark, folder), FIXED), "est")


@query
def classify_backward_short(spark, folder):
    """Many short slices, read in several horizons."""
    events, profile = _profiled(spark, folder)
    found = cl.search_backward_fixed(events, FIXED, profile, interval=SHORT_INTERVAL, first_rows=1)
    return _rounded(found.hot, "est")


@query
def classify_backward_layout(spark, folder):
    """From the tagged layout: folders of slices, read newest first."""
    events, profile = _profiled(spark, folder)
    path = staging_path(spark, "layout")
    layout.write_layout(events, path, EVENTS, profile)
    return _rounded(layout.search_layout(spark, path, EVENTS, first_rows=1).hot, "est")
