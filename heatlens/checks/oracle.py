"""The queries as plain SQL over whole tables, for an independent engine.

Straightforward on purpose: global ``row_number()``, window functions and, for the
one recursive estimator, a recursive query.
"""

from __future__ import annotations

from heatlens.checks.queries import (
    BUCKETS,
    BURST,
    DEEP,
    DIGITS,
    FINE,
    FINE_EVENTS,
    FIXED,
    FRACTION,
    HORIZON_SPAN,
    LATE,
    LINES,
    LOCAL_FRACTION,
    LOG_DIGITS,
    SHORT_INTERVAL,
    SLICES,
    TIGHT_SPAN,
    TOTAL,
    WIDE,
)
from heatlens.operators.neighbor import REACH
from heatlens.params import DEFAULT_ALPHA, FIXED_INTERVAL, TOTAL_SLICES
from heatlens.plans.classify import FIXED_TOP

A = f"{DEFAULT_ALPHA}::DOUBLE"
L = f"{1.0 - DEFAULT_ALPHA}::DOUBLE"
SPP = SLICES // BUCKETS
TOTAL_SPP = TOTAL_SLICES // BUCKETS

HASH = (
    "((list_reduce(list_prepend(0::BIGINT, list_transform(string_split(key::VARCHAR, ''),"
    " lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296)"
    " + 2147483648) % 4294967296 - 2147483648)"
)
BUCKET = f"abs({HASH} % {BUCKETS})::INTEGER"


def _budget(rows: str, fraction: float) -> str:
    return f"floor(({rows}) * {fraction}::DOUBLE)::BIGINT"


# Common table expressions, chained by name

ACC = f"""acc AS (
  SELECT user_id AS key, event_id AS arrival, epoch_us(ts) AS ts,
         row_number() OVER (ORDER BY event_id) - 1 AS n
  FROM events),
tot AS (SELECT count(*) AS total, greatest(1, count(*) // {SLICES}) AS size FROM acc)"""

SPAN = f"""span AS (
  SELECT arg_min(ts, arrival) AS first, arg_max(ts, arrival) AS last,
         greatest(1, (arg_max(ts, arrival) - arg_min(ts, arrival)) // {SLICES}) AS interval_
  FROM acc)"""

COUNT_SLICED = f"""{ACC},
sliced AS (SELECT key, n, 1 + (n + size - 1) // size AS slice FROM acc, tot),
counted AS (SELECT key, slice, count(*) AS accesses, min(n) AS n FROM sliced GROUP BY ALL)"""

FORWARD = f"""ends AS (SELECT key, min(slice) AS f, max(slice) AS l FROM counted GROUP BY key),
heat AS (
  SELECT key, round(sum(CASE WHEN slice > f THEN {A} * pow({L}, l - slice) ELSE 0 END), {DIGITS}) AS est,
         any_value(f) AS first_slice, any_value(l) AS last_slice, count(*) AS counted
  FROM counted JOIN ends USING (key) GROUP BY key)"""

HEAT = f"{COUNT_SLICED}, {FORWARD}"

LINE_HEAT = f"""acc AS (SELECT l_partkey AS key, epoch_us(l_shipdate) AS ts FROM lineitem),
tot AS (SELECT count(*) AS total FROM acc),
span AS (SELECT min(ts) AS first, greatest(1, (max(ts) - min(ts)) // {SLICES}) AS interval_ FROM acc),
counted AS (SELECT DISTINCT key, (ts - first) // interval_ AS slice FROM acc, span),
{FORWARD}"""

def _runs(acc: str, first: str, last: str, slices: int) -> str:
    place = "(ts - first) // interval_"
    return f"""acc AS ({acc}),
tot AS (SELECT count(*) AS total FROM acc),
span AS (SELECT {first} AS first, greatest(1, ({last} - {first}) // {slices}) AS interval_ FROM acc),
marked AS (
  SELECT key, n, {place} AS slice, lag({place}) OVER (PARTITION BY key ORDER BY n) AS before
  FROM acc, span),
runs AS (SELECT key, slice, n FROM marked WHERE before IS NULL OR before <> slice)"""


ORDERS = """
  SELECT o_custkey AS key, epoch_us(o_orderdate) AS ts, row_number() OVER (ORDER BY o_orderkey) - 1 AS n
  FROM orders"""
ORDER_RUNS = _runs(ORDERS, "min(ts)", "max(ts)", SLICES)
ORDER_RUNS_FINE = _runs(ORDERS, "min(ts)", "max(ts)", FINE)
LATE_RUNS = _runs(
    f"SELECT user_id AS key, epoch_us(ts) AS ts, event_id + {LATE - 1} - 2 * (event_id % {LATE}) AS n FROM events",
    "arg_min(ts, n)",
    "arg_max(ts, n)",
    FINE,
)

# step by step, as the estimate is defined
FOLD = f"""placed AS (SELECT key, slice, row_number() OVER (PARTITION BY key ORDER BY n) AS pos FROM runs),
fold(key, pos, slice, first_slice, est) AS (
  SELECT key, pos, slice, slice, 0::DOUBLE FROM placed WHERE pos = 1
  UNION ALL
  SELECT p.key, p.pos, p.slice, f.first_slice, {A} + f.est * pow({L}, p.slice - f.slice)
  FROM fold f JOIN placed p ON p.key = f.key AND p.pos = f.pos + 1),
folded AS (
  SELECT key, max(pos) AS counted, arg_max(slice, pos) AS last_slice, any_value(first_slice) AS first_slice,
         arg_max(est, pos) AS est
  FROM fold GROUP BY key)"""
LOG_EST = f"CASE WHEN est > 0 THEN round(ln(est), {LOG_DIGITS}) END AS log_est"

NEIGHBOR = f"""placed AS (
  SELECT key, slice, n, slice - lag(slice) OVER w AS gap, row_number() OVER w AS pos,
         lag(n) OVER w AS before_n
  FROM counted WINDOW w AS (PARTITION BY key ORDER BY slice)),
events_ AS (SELECT key, n, gap, CASE WHEN pos > 2 THEN before_n END AS prev_n FROM placed WHERE pos > 1),
headed AS (
  SELECT *, CASE WHEN lag(key) OVER (ORDER BY n) IS NULL OR abs(key - lag(key) OVER (ORDER BY n)) > {REACH}
            THEN n END AS head
  FROM events_),
chained AS (SELECT *, max(head) OVER (ORDER BY n) AS chain FROM headed),
links AS (
  SELECT h.chain, h.gap, p.chain AS parent
  FROM chained h LEFT JOIN chained p ON h.prev_n = p.n WHERE h.n = h.chain),
solved(chain, value) AS (
  SELECT chain, {A} FROM links WHERE parent IS NULL
  UNION ALL
  SELECT k.chain, {A} + pow({L}, k.gap) * s.value FROM links k JOIN solved s ON k.parent = s.chain),
latest AS (SELECT key, arg_max(chain, n) AS chain FROM chained GROUP BY key),
reused AS (
  SELECT key, round(coalesce(value, 0), {DIGITS}) AS est
  FROM (SELECT DISTINCT key FROM counted) LEFT JOIN latest USING (key) LEFT JOIN solved USING (chain))"""

FILE_TIMED = f"""{ACC}, {SPAN},
raw AS (SELECT key, arrival, (ts - first) // interval_ + 1 AS s FROM acc, span),
timed AS (
  SELECT key, arrival, CASE WHEN s // {SPP} >= {BUCKETS} THEN {SLICES} ELSE s END AS slice,
         CASE WHEN s // {SPP} >= {BUCKETS} THEN {BUCKETS - 1} ELSE s // {SPP} END AS part
  FROM raw)"""

MEM_TIMED = f"""{ACC}, {SPAN},
raw AS (SELECT key, arrival, (ts - first) // interval_ AS s FROM acc, span),
timed AS (
  SELECT key, arrival, CASE WHEN s // {SPP} >= {BUCKETS} THEN {SLICES} ELSE s END + 1 AS slice,
         CASE WHEN s // {SPP} >= {BUCKETS} THEN {BUCKETS - 1} ELSE s // {SPP} END AS part
  FROM raw)"""


def _rank_partial(spp: int) -> str:
    return f"""once AS (SELECT part, slice, key, min(arrival) AS seen_at FROM timed GROUP BY ALL),
opened AS (SELECT part, slice, min(seen_at) AS opened_at FROM once GROUP BY ALL),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY part ORDER BY slice) AS j FROM opened),
firsts AS (SELECT part, key, min(slice) AS f FROM once GROUP BY ALL),
partials AS (
  SELECT part, key,
         sum(CASE WHEN slice > f THEN
               pow({L}, greatest(CASE WHEN seen_at = opened_at THEN {spp} + 1 ELSE {spp} END - j, -1))
             ELSE 0::DOUBLE END) AS partial
  FROM once JOIN ranked USING (part, slice) JOIN firsts USING (part, key) GROUP BY ALL)"""


# in arrival order, change by change
RUN_PARTIAL = f"""acc AS ({ORDERS}),
span AS (SELECT min(ts) AS first, greatest(1, (max(ts) - min(ts)) // {SLICES}) AS interval_ FROM acc),
raw AS (SELECT key, n, (ts - first) // interval_ + 1 AS s FROM acc, span),
timed AS (
  SELECT key, n, CASE WHEN s // {SPP} >= {BUCKETS} THEN {SLICES} ELSE s END AS slice,
         CASE WHEN s // {SPP} >= {BUCKETS} THEN {BUCKETS - 1} ELSE s // {SPP} END AS part
  FROM raw),
marked AS (
  SELECT *, coalesce(slice <> lag(slice) OVER (PARTITION BY part ORDER BY n), true)::INT AS opens,
         slice <> lag(slice) OVER (PARTITION BY part, key ORDER BY n) AS counts
  FROM timed),
stepped AS (SELECT *, sum(opens) OVER (PARTITION BY part ORDER BY n) AS j FROM marked),
partials AS (
  SELECT part, key,
         sum(CASE WHEN counts THEN pow({L}, greatest({SPP} - j + opens, -1)) ELSE 0::DOUBLE END) AS partial
  FROM stepped GROUP BY ALL)"""

MEM_PARTIAL = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY part, key ORDER BY arrival) AS r FROM timed),
partials AS (
  SELECT part, key, sum(CASE WHEN r > 1 THEN pow({L}, slice) ELSE 0::DOUBLE END) AS partial
  FROM numbered GROUP BY ALL)"""


def _roll_up(step: str) -> str:
    return f"""rolled AS (
  SELECT key, partial, coalesce(sum({step}) OVER (PARTITION BY key ORDER BY part
         ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS power
  FROM partials),
heat AS (SELECT key, round(sum({A} * partial * pow({L}, power)), {DIGITS}) AS est FROM rolled GROUP BY key)"""


ROLLED = _roll_up(f"{SPP} - 1")
FILE_HEAT = f"{FILE_TIMED}, {_rank_partial(SPP)}, {ROLLED}"
MEM_HEAT = f"{MEM_TIMED}, {MEM_PARTIAL}, {ROLLED}"

TOTAL_TIMED = f"""{ACC},
timed AS (
  SELECT key, n AS arrival, least(n // greatest(1, total // {BUCKETS}), {BUCKETS - 1}) AS part,
         n // greatest(1, total // {TOTAL_SLICES}) + 1 AS slice
  FROM acc, tot)"""
TOTAL_TIME_HEAT = (
    f"{TOTAL_TIMED}, {_rank_partial(TOTAL_SPP)}, {_roll_up(f'(part + 1) * {TOTAL_SPP} - 1')}"
)

TOTAL_HEAT = f"""{ACC},
counted AS (SELECT DISTINCT key, n // greatest(1, total // {TOTAL_SLICES}) + 1 AS slice FROM acc, tot),
{FORWARD}"""

BUCKETED_SLICED = f"""{ACC},
sliced AS (SELECT key, arrival, (n + 1) // size + 1 AS slice FROM acc, tot),
fin AS (SELECT total // size + 1 AS end_, {_budget('total + 1', FRACTION)} AS k FROM tot)"""


def _horizon(span: str, name: str = "bounds") -> str:
    """Bounds when the newest ``span`` slices have been read."""
    t = f"greatest(1, end_ - ({span}) + 1)"
    return f"""{name}_est AS (
  SELECT key, any_value(end_) AS end_, sum({A} * pow({L}, end_ - slice)) AS e
  FROM (SELECT DISTINCT key, slice FROM sliced), fin WHERE slice >= {t} GROUP BY key),
{name} AS (
  SELECT key, round(e, {DIGITS}) AS est, round(e + pow({L}, end_), {DIGITS}) AS lower,
         round(e + pow({L}, end_ - {t} + 1), {DIGITS}) AS upper, round(ln(e), {DIGITS}) AS rank
  FROM {name}_est)"""


BOUNDS = f"{BUCKETED_SLICED}, {_horizon(str(HORIZON_SPAN))}"
KTH = """kth AS (
  SELECT lower AS kth FROM (SELECT lower, row_number() OVER (ORDER BY lower DESC) AS r FROM bounds), fin
  WHERE r = k)"""
EXACT = f"{BUCKETED_SLICED}, {_horizon('end_')}"
COUNTS = """counts AS (
  SELECT count(*) FILTER (lower > kth) AS lower_count, count(*) FILTER (upper > kth) AS upper_count,
         min(upper - kth) FILTER (upper > kth) AS overlap
  FROM bounds, kth)"""

DEEP_SLICED = f"""acc AS (
  SELECT o_orderkey // 3 AS key, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders),
tot AS (SELECT count(*) AS total, greatest(1, count(*) // {DEEP.slices}) AS size FROM acc),
sliced AS (SELECT key, (n + 1) // size + 1 AS slice FROM acc, tot),
fin AS (SELECT total // size + 1 AS end_, {_budget('total + 1', DEEP.hot_fraction)} AS k FROM tot)"""

BURST_SLICED = f"""acc AS (SELECT {BURST} AS key, arrival AS n FROM (SELECT user_id AS key, event_id AS arrival FROM events)),
tot AS (SELECT count(*) AS total, greatest(1, count(*) // {FINE}) AS size FROM acc),
ranked AS (SELECT key, row_number() OVER (ORDER BY n) - 1 AS n FROM acc),
ends AS (SELECT greatest({FINE} + 1, (total + size - 1) // size) AS end_ FROM tot),
sliced AS (SELECT key, end_ - (total - 1 - n) // size AS slice FROM ranked, tot, ends),
fin AS (SELECT end_, 2 AS k FROM ends)"""

TAIL_SLICED = f"""{ACC},
ends AS (SELECT greatest({SLICES} + 1, (total + size - 1) // size) AS end_ FROM tot),
sliced AS (SELECT key, end_ - (total - 1 - n) // size AS slice FROM acc, tot, ends),
fin AS (SELECT end_, {_budget(f'size * {SLICES + 1}', FRACTION)} AS k FROM tot, ends)"""

def _fixed(interval: int) -> str:
    return f"""{ACC},
sliced AS (SELECT key, (n + 2) // {interval} + 1 AS slice FROM acc),
fin AS (SELECT (total + 1) // {interval} + 1 AS end_, {_budget('total + 1', FIXED.hot_fraction)} AS k
        FROM tot)"""


def _top(ctes: str, k: str, cols: str = "key, est", source: str = "heat", by: str = "est") -> str:
    return f"""WITH RECURSIVE {ctes},
top AS (SELECT *, row_number() OVER (ORDER BY {by} DESC, key) AS place FROM {source})
SELECT {cols} FROM top WHERE place <= ({k})"""


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


EVENT_K = f"SELECT {_budget('total', FRACTION)} FROM tot"
PER_BUCKET = f"""bucketed AS (SELECT key, est, {BUCKET} AS bucket FROM heat),
listed AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY est DESC, key) AS r,
         count(*) OVER (PARTITION BY bucket) AS keys
  FROM bucketed)"""
BLOCK_LISTS = f"""{PER_BUCKET},
kept AS (SELECT key, est FROM listed, tot WHERE r <= {_budget('total', LINES.hot_fraction)} // {BUCKETS})"""

ORACLE: dict[str, str] = {
    "trace_scan": """
SELECT CASE WHEN event_type = 'error' THEN 8 ELSE 9 END::INTEGER AS fields,
       epoch_us(ts)::VARCHAR AS first_field, user_id::VARCHAR AS fourth_field
FROM events""",
    "trace_valid": """
SELECT epoch_us(ts) AS ts, event_id::INTEGER AS pid, event_type AS process, user_id AS block,
       floor(value)::INTEGER AS n_sectors, CASE WHEN event_type = 'view' THEN 'R' ELSE 'W' END AS rw,
       6::INTEGER AS major, 0::INTEGER AS minor, md5(props) AS digest
FROM events WHERE event_type <> 'error'""",
    "trace_by_bucket": _with(BUCKETED_SLICED, f"SELECT key, arrival, slice, {BUCKET} AS bucket FROM sliced"),
    "trace_by_time": _with(FILE_TIMED, "SELECT key, arrival, slice, part FROM timed"),
    "trace_reverse": _with(ACC, "SELECT key, arrival, total - n AS from_end FROM acc, tot ORDER BY n DESC"),
    "hot_set_report": _top(
        HEAT,
        EVENT_K,
        f"'Address: ' || key || ' EstimatedFrequency: ' || printf('%.{DIGITS}f', est) AS line",
    ),
    "access_projection": "SELECT epoch_us(ts) AS ts, user_id AS key FROM events",
    "arrival_ordinal": _with(ACC, "SELECT key, arrival, n FROM acc"),
    "slice_size_by_count": _with(ACC, "SELECT total AS total_rows, size AS slice_size FROM tot"),
    "slice_size_by_total": _with(
        ACC, f"SELECT total AS total_rows, greatest(1, total // {TOTAL_SLICES}) AS slice_size FROM tot"
    ),
    "trace_span": _with(
        f"{ACC}, {SPAN}", "SELECT first AS first_ts, last AS last_ts, interval_ AS slice_interval FROM span"
    ),
    "slice_ordinal_forward": _with(
        ACC, "SELECT key, arrival, 1 + (n + size - 1) // size AS slice FROM acc, tot"
    ),
    "slice_ordinal_backward": _with(
        ACC,
        f"SELECT key, arrival, abs(size * {SLICES + 1} - (total - n)) // size + 1 AS slice FROM acc, tot",
    ),
    "slice_ordinal_bucketed": _with(ACC, "SELECT key, arrival, (n + 1) // size + 1 AS slice FROM acc, tot"),
    "slice_fixed_interval": _with(
        ACC, f"SELECT key, arrival, (n + 2) // {FIXED_INTERVAL} + 1 AS slice FROM acc"
    ),
    "slice_total_ordinal": _with(
        ACC, f"SELECT key, arrival, n // greatest(1, total // {TOTAL_SLICES}) + 1 AS slice FROM acc, tot"
    ),
    "slice_timestamp": _with(
        f"{ACC}, {SPAN}", "SELECT key, arrival, (ts - first) // interval_ AS slice FROM acc, span"
    ),
    "time_partition_file": _with(FILE_TIMED, "SELECT key, arrival, slice, part FROM timed"),
    "time_partition_mem": _with(MEM_TIMED, "SELECT key, arrival, slice, part FROM timed"),
    "block_bucket": f"""
SELECT key, {HASH} AS hash, {BUCKET} AS bucket FROM (SELECT DISTINCT l_partkey AS key FROM lineitem)""",
    "slice_dedup": _with(COUNT_SLICED, "SELECT key, slice, accesses, n FROM counted"),
    "slice_dedup_runs": _with(ORDER_RUNS, "SELECT key, slice, n FROM runs"),
    "heat_forward": _with(HEAT, "SELECT key, est, first_slice, last_slice, counted FROM heat"),
    "heat_forward_runs": _with(
        ORDER_RUNS,
        f"""SELECT key, round(sum(CASE WHEN n > fn THEN {A} * pow({L}, l - slice) ELSE 0 END), {DIGITS}) AS est,
       any_value(f) AS first_slice, any_value(l) AS last_slice, count(*) AS counted
FROM runs JOIN (SELECT key, min(n) AS fn, arg_min(slice, n) AS f, arg_max(slice, n) AS l FROM runs GROUP BY key)
USING (key) GROUP BY key""",
    ),
    "heat_forward_runs_fine": _with(
        f"{ORDER_RUNS_FINE}, {FOLD}", f"SELECT key, {LOG_EST}, first_slice, last_slice, counted FROM folded"
    ),
    "heat_forward_by_clock": _with(LINE_HEAT, "SELECT key, est, first_slice, last_slice, counted FROM heat"),
    "heat_as_of": _with(
        f"{COUNT_SLICED}, {FORWARD.replace(f', {DIGITS}) AS est', ', 17) AS est')}",
        f"""SELECT key, round(est * pow({L}, (SELECT max(slice) FROM sliced) - last_slice), {DIGITS}) AS est
FROM heat""",
    ),
    "heat_neighbor_reuse": _with(f"{COUNT_SLICED}, {NEIGHBOR}", "SELECT key, est FROM reused"),
    "heat_time_partial": _with(
        f"{FILE_TIMED}, {_rank_partial(SPP)}",
        f"SELECT part, key, round(partial, {DIGITS}) AS partial FROM partials",
    ),
    "heat_time_partial_runs": _with(
        RUN_PARTIAL, f"SELECT part, key, round(partial, {DIGITS}) AS partial FROM partials"
    ),
    "heat_time_partial_mem": _with(
        f"{MEM_TIMED}, {MEM_PARTIAL}", f"SELECT part, key, round(partial, {DIGITS}) AS partial FROM partials"
    ),
    "heat_rollup": _with(FILE_HEAT, "SELECT key, est FROM heat"),
    "heat_rollup_growing": _with(TOTAL_TIME_HEAT, "SELECT key, est FROM heat"),
    "heat_backward": _with(BOUNDS, "SELECT key, est FROM bounds"),
    "heat_bounds": _with(BOUNDS, "SELECT key, est, lower, upper FROM bounds"),
    "run_metrics": _with(
        ACC,
        f"""SELECT total AS total_rows, {_budget('total', FRACTION)} AS budget,
       (SELECT count(DISTINCT key) FROM acc) AS distinct_keys FROM tot""",
    ),
    "recent_distinct_keys": _with(
        f"""{ACC}, newest AS (SELECT key, max(n) AS n FROM acc GROUP BY key),
placed AS (SELECT *, row_number() OVER (ORDER BY n DESC) AS r FROM newest)""",
        f"SELECT key, n FROM placed, tot WHERE r <= {_budget('total', FRACTION)} + 1",
    ),
    "kth_lower": _with(f"{BOUNDS}, {KTH}", "SELECT k, kth FROM fin, kth"),
    "admission_threshold": _with(
        f"{BOUNDS}, {KTH}", f"SELECT round(end_ - ln(kth) / ln({L}), 6) AS threshold FROM fin, kth"
    ),
    "prune_candidates": _with(
        f"{BOUNDS}, {KTH}", "SELECT key, est, lower, upper FROM bounds, kth WHERE upper >= kth"
    ),
    "backward_hot_set": _top(EXACT, "SELECT k FROM fin", source="bounds", by="rank"),
    "bucket_status": _with(
        f"""{BOUNDS},
bucketed AS (SELECT *, {BUCKET} AS bucket FROM bounds),
shares AS (SELECT bucket, {_budget('count(*)', FRACTION)} AS k
           FROM (SELECT {BUCKET} AS bucket FROM acc) GROUP BY bucket),
listed AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY lower DESC) AS r FROM bucketed),
kths AS (SELECT bucket, lower AS kth FROM listed JOIN shares USING (bucket) WHERE r = k)""",
        """SELECT bucket, coalesce(any_value(kth), 0) AS kth,
       count(*) FILTER (lower > kth) AS low_count, count(*) FILTER (upper > kth) AS up_count
FROM shares LEFT JOIN kths USING (bucket) LEFT JOIN bucketed USING (bucket) GROUP BY bucket""",
    ),
    "threshold_counts": _with(
        f"{BOUNDS}, {KTH}, {COUNTS}",
        f"SELECT lower_count, upper_count, round(overlap, {DIGITS}) AS overlap FROM counts",
    ),
    "overlap_slice_bound": _with(
        f"{BOUNDS}, {KTH}, {COUNTS}", f"SELECT round(end_ + 1 - ln(overlap) / ln({L}), 3) AS t_min FROM counts, fin"
    ),
    "threshold_search": _top(EXACT, "SELECT k FROM fin", source="bounds", by="rank"),
    "threshold_members": _with(
        f"""{EXACT}, top AS (SELECT key, row_number() OVER (ORDER BY rank DESC, key) AS place FROM bounds)""",
        f"SELECT {BUCKET} AS bucket, count(*) AS members FROM top, fin WHERE place <= k GROUP BY 1",
    ),
    "tighten_bounds": _with(
        f"{BOUNDS}, {KTH}, {_horizon(str(TIGHT_SPAN), 'tight')}",
        """SELECT key, est, lower, upper FROM tight
WHERE key IN (SELECT key FROM bounds, kth WHERE upper >= kth)""",
    ),
    "finalize_hot_set": _with(
        f"{EXACT}, placed AS (SELECT *, row_number() OVER (ORDER BY lower DESC) AS r FROM bounds)",
        "SELECT key, est FROM placed, fin WHERE r <= k",
    ),
    "topk_per_bucket": _with(
        f"{HEAT}, {PER_BUCKET}",
        f"SELECT key, est, bucket FROM listed, tot WHERE r <= {_budget('total', FRACTION)} // {BUCKETS}",
    ),
    "topk_merge": _top(HEAT, EVENT_K),
    "hot_budget": _with(
        ACC,
        f"""SELECT {_budget('total', FRACTION)} AS by_rows, {_budget('total + 1', FRACTION)} AS by_rows_plus_one,
       {_budget(f'size * {SLICES + 1}', FRACTION)} AS by_slices FROM tot""",
    ),
    "topk_hot": _top(HEAT, EVENT_K),
    "topk_fixed": _top(HEAT, str(FIXED_TOP)),
    "topk_local_fraction": _with(
        f"{HEAT}, {PER_BUCKET}",
        f"SELECT key, est, bucket FROM listed WHERE r <= floor(keys * {LOCAL_FRACTION}::DOUBLE * 2)",
    ),
    "hot_set_overlap": _with(
        f"""{HEAT}, {NEIGHBOR},
a AS (SELECT key FROM (SELECT key, row_number() OVER (ORDER BY est DESC, key) AS r FROM reused), tot
      WHERE r <= {_budget('total', WIDE.hot_fraction)}),
b AS (SELECT key FROM (SELECT key, row_number() OVER (ORDER BY est DESC, key) AS r FROM heat), tot
      WHERE r <= {_budget('total', WIDE.hot_fraction)}),
sizes AS (SELECT (SELECT count(*) FROM a WHERE key IN (SELECT key FROM b)) AS n_both,
                 (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b)""",
        f"SELECT n_both, n_a, n_b, round(n_both / n_a, {DIGITS}) AS recall FROM sizes",
    ),
    "hot_cold_label": _with(
        f"{HEAT}, placed AS (SELECT *, row_number() OVER (ORDER BY est DESC, key) AS r FROM heat)",
        f"SELECT key, est, r <= {_budget('total', FRACTION)} AS is_hot FROM placed, tot",
    ),
    "classify_forward": _top(HEAT, EVENT_K),
    "classify_text_trace": _top(
        HEAT.replace("FROM events)", "FROM events WHERE event_type <> 'error')"),
        f"SELECT {_budget('total', WIDE.hot_fraction)} FROM tot",
    ),
    "classify_neighbor": _top(f"{COUNT_SLICED}, {NEIGHBOR}", EVENT_K, source="reused"),
    "classify_by_block": _top(
        f"{LINE_HEAT}, {BLOCK_LISTS}",
        f"SELECT {_budget('total', LINES.hot_fraction)} FROM tot",
        source="kept",
    ),
    "classify_by_block_runs": _top(
        f"""{LATE_RUNS}, {FOLD},
heat AS (SELECT key, round(est, {DIGITS}) AS est FROM folded),
{PER_BUCKET},
kept AS (SELECT key, est FROM listed, tot WHERE r <= {_budget('total', FINE_EVENTS.hot_fraction)} // {BUCKETS})""",
        f"SELECT {_budget('total', FINE_EVENTS.hot_fraction)} FROM tot",
        source="kept",
    ),
    "classify_by_time": _top(FILE_HEAT, str(FIXED_TOP)),
    "classify_by_time_runs": _top(f"{RUN_PARTIAL}, {ROLLED}", str(FIXED_TOP)),
    "classify_by_time_mem": _top(MEM_HEAT, str(FIXED_TOP)),
    "classify_backward": _top(f"{TAIL_SLICED}, {_horizon('end_')}", "SELECT k FROM fin", source="bounds", by="rank"),
    "classify_backward_bucketed": _top(EXACT, "SELECT k FROM fin", source="bounds", by="rank"),
    "classify_backward_deep": _top(
        f"""{DEEP_SLICED},
exact AS (SELECT key, sum({A} * pow({L}, end_ - slice)) AS est FROM (SELECT DISTINCT key, slice FROM sliced), fin
          GROUP BY key),
ranked AS (SELECT *, round(ln(est), {DIGITS}) AS rank FROM exact)""",
        "SELECT k FROM fin",
        cols=f"key, {LOG_EST}",
        source="ranked",
        by="rank",
    ),
    "classify_backward_early": _top(
        f"{BURST_SLICED}, {_horizon('end_')}",
        "SELECT k FROM fin",
        cols="key, true AS stopped_early",
        source="bounds",
        by="rank",
    ),
    "classify_total_by_block": _top(
        TOTAL_HEAT, f"SELECT {_budget('total', TOTAL.hot_fraction)} FROM tot"
    ),
    "classify_total_by_time": _top(
        TOTAL_TIME_HEAT, f"SELECT {_budget('total', TOTAL.hot_fraction)} FROM tot"
    ),
    "classify_backward_fixed": _top(
        f"{_fixed(FIXED_INTERVAL)}, {_horizon('end_')}", "SELECT k FROM fin", source="bounds", by="rank"
    ),
    "classify_backward_short": _top(
        f"{_fixed(SHORT_INTERVAL)}, {_horizon('end_')}", "SELECT k FROM fin", source="bounds", by="rank"
    ),
    "classify_backward_layout": _top(EXACT, "SELECT k FROM fin", source="bounds", by="rank"),
}
