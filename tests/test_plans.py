"""What the plans must look like, whatever the size of the data."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from heatlens import HeatParams, accesses_from
from heatlens.operators import ordinal
from heatlens.operators.ordinal import profile_arrival, with_ordinal_slice
from heatlens.operators.selection import top_k_by_group
from heatlens.plans import classify as cl


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def events(spark, data_dir):
    table = spark.read.parquet(f"{data_dir}/events.parquet")
    return accesses_from(table, "user_id", "ts", "event_id")


@pytest.mark.parametrize(
    "name",
    ["heat_forward", "heat_time_partial", "heat_rollup", "heat_bounds", "classify_by_block", "hot_cold_label", "hot_set_overlap"],
)
def test_no_pairs_no_python(spark, data_dir, name):
    found = plan(contract.queries()[name](spark, data_dir))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert word not in found


def test_only_the_needed_columns_are_read(events):
    found = plan(cl.forward_heat(events, HeatParams(), profile_arrival(events, rows_per_bin=100)))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in found


def test_newest_slices_are_read_with_a_pushed_filter(events):
    profile = profile_arrival(events, rows_per_bin=50)
    tail, end = cl.serial_tail(events, HeatParams(slices=20), profile)
    recent = tail(end - 2)
    assert "GreaterThanOrEqual(event_id" in plan(recent)
    assert recent.count() <= 3 * HeatParams(slices=20).slice_size(profile.rows)


def sliced_plan(events):
    profile = profile_arrival(events, rows_per_bin=20)
    return plan(with_ordinal_slice(events.select("key", "arrival"), profile, lambda n: cl.sl.total_slice(n, 400)))


def test_slices_are_looked_up_in_one_scan_without_a_shuffle(events):
    found = sliced_plan(events)
    assert "Exchange hashpartitioning" not in found and "Window" not in found and found.count("FileScan") == 1
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in found


def test_forward_shuffles_keys_only(events):
    found = plan(cl.forward_heat(events, HeatParams(), profile_arrival(events, rows_per_bin=20)))
    assert found.count("Exchange hashpartitioning") <= 2 and "hashpartitioning(__bin" not in found


def test_settled_bins_are_not_shuffled(events, monkeypatch):
    """With more slices than are looked up, and slices far longer than bins, some rows get
    theirs from the bin table."""
    monkeypatch.setattr(ordinal, "MAX_STARTS", 0)
    found = sliced_plan(events)
    assert "Union" in found and found.count("Exchange hashpartitioning(__bin") == 1


def test_small_rankings_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 4).cast("int").alias("b"), F.col("id").alias("key"), F.rand().alias("est"))
    assert "WindowGroupLimit" in plan(top_k_by_group(df, "b", 10))


def test_estimates_aggregate_before_they_shuffle(events):
    found = plan(cl.clock_heat(events, HeatParams(), cl.trace_span(events), in_order=True))
    assert "partial_sum" in found and "Window" not in found and found.count("Exchange") == 2
