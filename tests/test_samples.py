"""Known results on two sample block traces.

Set ``TRACE_SAMPLES`` to a file pattern that matches them; they are told apart by
their number of rows. Values come from an independent sequential derivation.
"""

import glob
import os

import pytest
from pyspark.sql import functions as F

from heatlens import HeatParams, read_trace, trace_accesses, with_file_order
from heatlens.functions.buckets import key_bucket
from heatlens.functions.slices import file_time_partition, slice_size_from_bytes
from heatlens.operators import backward as bw
from heatlens.operators.ordinal import profile_arrival
from heatlens.operators.neighbor import repeat_events
from heatlens.operators.partials import roll_up
from heatlens.operators.selection import top_k
from heatlens.plans import classify as cl

PATTERN = os.environ.get("TRACE_SAMPLES")
pytestmark = pytest.mark.skipif(not PATTERN, reason="TRACE_SAMPLES is not set")
PARAMS = HeatParams(slices=100, hot_fraction=0.01, digits=9)

# Fixed values, by number of rows.
BY_ROWS = {
    1025: {
        "blocks": 507,
        "bytes": 78_896,
        "buckets": [269, 251, 247, 258],
        "positive": 61,
        "forward": [(508500304, 0.12460271), (508516672, 0.12460271), (283193112, 0.122249946)],
        "events": 81,
        "differ": 3,
        "interval": 16_674_907,
        "highest": 115,
        "clock": [(508516680, 0.05), (508516688, 0.05)],
        "parts": [7, 12, 9, 997],
        "rolled": 0,
        "backward": [(283196984, 0.130393422), (283193112, 0.124087443), (283197024, 0.0975)],
    },
    1000: {
        "blocks": 981,
        "bytes": 79_520,
        "buckets": [256, 254, 247, 243],
        "positive": 6,
        "forward": [(278577216, 0.150423521), (261326200, 0.108470005), (261324312, 0.088144371)],
        "events": 19,
        "differ": 2,
        "interval": 6_252_927,
        "highest": 100,
        "clock": [(261326200, 0.182829146), (261324312, 0.14688788), (278577216, 0.0975)],
        "parts": [6, 90, 323, 581],
        "rolled": 5,
        "backward": [(278577216, 0.168347817), (261326200, 0.068700785), (261324312, 0.056188164)],
    },
}


@pytest.fixture(scope="module", params=sorted(glob.glob(PATTERN)) if PATTERN else [])
def sample(request, spark):
    accesses = trace_accesses(with_file_order(read_trace(spark, request.param))).cache()
    rows = accesses.count()
    return accesses, profile_arrival(accesses, rows_per_bin=200), BY_ROWS[rows], os.path.getsize(request.param)


def rows_of(df):
    return [(r["key"], pytest.approx(r["est"], abs=1.5e-9)) for r in df.collect()]


def test_trace(sample):
    accesses, _, known, size = sample
    assert size == known["bytes"] and slice_size_from_bytes(size, 100) == 10
    assert accesses.select("key").distinct().count() == known["blocks"]
    buckets = accesses.groupBy(key_bucket("key", 4).alias("b")).count().orderBy("b")
    assert [r["count"] for r in buckets.collect()] == known["buckets"]


def test_forward(sample):
    accesses, profile, known, _ = sample
    heat = cl.forward_heat(accesses, PARAMS, profile)
    assert heat.filter("est > 0").count() == known["positive"]
    assert rows_of(cl.classify_forward(accesses, PARAMS, profile))[:3] == known["forward"]


def test_neighbor(sample):
    accesses, profile, known, _ = sample
    plain = cl.forward_heat(accesses, PARAMS, profile).select("key", F.col("est").alias("plain"))
    reused = cl.neighbor_heat(accesses, PARAMS, profile).join(plain, "key")
    assert reused.filter(F.abs(F.col("est") - F.col("plain")) > 1e-12).count() == known["differ"]
    size = PARAMS.slice_size(profile.rows)
    counted = accesses.select("key", F.col("arrival").alias("n")).withColumn(
        "slice", F.ceil(F.col("n") / size) + 1
    ).groupBy("key", "slice").agg(F.min("n").alias("n"))
    assert repeat_events(counted).filter("at > 1").count() == known["events"]


def test_clock(sample):
    accesses, _, known, _ = sample
    span = cl.trace_span(accesses)
    assert span.interval(100) == known["interval"]
    top = (span.high - span.first) // known["interval"]
    assert top == known["highest"]
    heat = cl.clock_heat(accesses, PARAMS, span, in_order=False)
    assert rows_of(top_k(heat.select("key", "est"), 3))[: len(known["clock"])] == known["clock"]
    assert heat.filter("est > 1e-12").count() == len(known["clock"]) or len(known["clock"]) == 3


def test_time_partitions(sample):
    accesses, _, known, _ = sample
    span = cl.trace_span(accesses)
    part, _ = file_time_partition("ts", span.first, span.interval(100), 100, 4)
    counts = accesses.groupBy(part.alias("p")).count().orderBy("p")
    assert [r["count"] for r in counts.collect()] == known["parts"]
    heat = roll_up(cl.time_partial_heat(accesses, PARAMS, span), PARAMS.slices_per_part)
    assert heat.filter("est > 0").count() == known["rolled"]


def test_backward(sample):
    accesses, profile, known, _ = sample
    tail, end = cl.serial_tail(accesses, PARAMS, profile)
    assert rows_of(top_k(bw.heat_backward(tail(1), end), 3)) == known["backward"]
    found = cl.search_backward(accesses, PARAMS, profile).hot.collect()
    assert {k for k, _ in known["backward"]} <= {r["key"] for r in found}
