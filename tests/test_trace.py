import random

import pytest
from pyspark.sql import functions as F

from heatlens import HeatParams, classify_by_block, classify_forward
from heatlens.functions.buckets import key_bucket, string_hash
from heatlens.operators.hotset import hot_set_overlap, label_hot, observed, report_lines
from heatlens.sources import trace as tr
from heatlens.sources.accesses import accesses_from


def line(ts, block, extra=""):
    return f"{ts} 42 daemon {block} 8 W 6 0 {'ab' * 16}{extra}"


def test_only_nine_fields_count(spark, tmp_path):
    lines = [
        line(1, 10),
        line(2, 20, " tenth"),
        line(3, 30)[: -33],
        line(4, 40, "  "),
        "",
        line("x", 50),
        line(6, 60) + "\r",
    ]
    path = tmp_path / "trace"
    path.write_text("\n".join(lines))
    trace = tr.read_trace(spark, str(path)).orderBy("ts")
    assert [(r["ts"], r["block"]) for r in trace.collect()] == [(None, 50), (1, 10), (4, 40), (6, 60)]
    ordered = tr.trace_accesses(tr.with_file_order(tr.read_trace(spark, str(path))))
    assert [(r["key"], r["arrival"]) for r in ordered.orderBy("arrival").collect()] == [(10, 0), (40, 1), (60, 3)]


def test_tagged_lines(spark):
    df = spark.createDataFrame([(line(1, 10, " 7"),), (line(1, 10),)], "value string")
    assert [r["slice"] for r in tr.parse_trace(df, tagged=True).collect()] == [7]


def test_order_across_files_and_splits(spark, tmp_path):
    rng = random.Random(0)
    expected = []
    for name in ("part-0", "part-1", "part-2"):
        lines = []
        for _ in range(rng.randint(50, 300)):
            key = rng.randint(0, 10**6)
            good = rng.random() < 0.9
            lines.append(line(len(expected), key, "" if good else " extra"))
            if good:
                expected.append(key)
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        trace = tr.with_file_order(tr.read_trace(spark, str(tmp_path)))
        assert [r["block"] for r in trace.orderBy("n").collect()] == expected
        assert [r["n"] for r in trace.orderBy("n").collect()] == list(range(len(expected)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_tagged_trace_is_pruned_by_folder(spark, tmp_path):
    df = spark.range(1000).select(
        F.col("id").alias("key"), (F.col("id") % 7).alias("slice"), key_bucket("id", 4).alias("bucket")
    )
    path = str(tmp_path / "tagged")
    tr.write_tagged(df, path, "bucket")
    one = tr.read_tagged(spark, path).filter("bucket = 2")
    assert one.count() == df.filter("bucket = 2").count()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tr.write_tagged(df, path, "bucket")


def test_string_hash(spark):
    row = spark.sql("select 508516680L as k").select(string_hash("k").alias("h"), key_bucket("k", 4).alias("b")).first()
    assert row["h"] == 469569937 and row["b"] == 1

    def by_hand(text):
        h = 0
        for c in text:
            h = (h * 31 + ord(c)) % 2**32
        return h - 2**32 if h >= 2**31 else h

    keys = [0, -1, 7, 99999999999, -123456789012, 2**62]
    df = spark.createDataFrame([(k,) for k in keys], "key bigint")
    found = {r["key"]: r["h"] for r in df.select("key", string_hash("key").alias("h")).collect()}
    assert found == {k: by_hand(str(k)) for k in keys}


def test_micros_do_not_depend_on_the_session_zone(spark):
    df = spark.sql("select timestamp_ntz'2024-03-10 02:30:00.123456' as ts, 1 as k")
    want = [1710037800123456]
    assert [r["ts"] for r in accesses_from(df, "k", "ts").collect()] == want
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert [r["ts"] for r in accesses_from(df, "k", "ts").collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_labels_overlap_and_report(spark):
    heat = spark.createDataFrame([(k, k / 10) for k in range(6)], "key bigint, est double")
    labelled = {r["key"]: r["is_hot"] for r in label_hot(heat, 2).collect()}
    assert labelled == {0: False, 1: False, 2: False, 3: False, 4: True, 5: True}
    row = hot_set_overlap(heat.filter("key < 4"), heat.filter("key > 2")).first()
    assert tuple(row) == (1, 4, 3, 0.25)
    assert tuple(hot_set_overlap(heat.limit(0), heat.limit(0)).first()) == (0, 0, 0, None)
    assert report_lines(heat.filter("key = 5")).first()["line"] == "Address: 5 EstimatedFrequency: 0.5"
    watched, seen = observed(heat, 0.5)
    watched.count()
    assert seen.get == {"rows": 6, "budget": 3}


def test_tiny_and_empty_tables(spark):
    empty = spark.createDataFrame([], "key bigint, ts bigint, arrival bigint")
    one = spark.createDataFrame([(5, 100, 1)], "key bigint, ts bigint, arrival bigint")
    params = HeatParams(hot_fraction=1.0, buckets=1)
    for classify in (classify_forward, classify_by_block):
        assert classify(empty, params).collect() == []
        assert [tuple(r) for r in classify(one, params).collect()] == [(5, 0.0)]
