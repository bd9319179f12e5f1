import random

import pytest

import twins
from heatlens import HeatParams
from heatlens.functions.buckets import key_bucket
from heatlens.operators import backward as bw
from heatlens.plans import classify as cl
from heatlens.operators.ordinal import profile_arrival


def trace(spark, seed, rows=1500, keys=60, slices=150, hot=6):
    """A few keys stay hot to the end, so early stops do happen."""
    rng = random.Random(seed)
    s = sorted(rng.randint(1, slices) for _ in range(rows))
    k = [rng.randint(1, hot) if rng.random() < 0.5 else rng.randint(hot + 1, keys) for _ in range(rows)]
    df = spark.createDataFrame(list(zip(k, s)), "key bigint, slice bigint").repartition(3).cache()
    return k, s, df


def pairs(df):
    return {r["key"]: r["est"] for r in df.collect()}


@pytest.mark.parametrize("seed, k_hot", [(0, 1), (0, 6), (1, 6), (2, 13)])
def test_search_finds_the_exact_hot_set(spark, seed, k_hot):
    k, s, df = trace(spark, seed)
    end = 150
    exact = twins.backward(k, s, end)
    found = bw.backward_hot_set(bw.tail_of(df), end, k_hot, first_span=8)
    assert sorted(pairs(found.hot)) == sorted(twins.top(exact, k_hot))
    assert pairs(found.hot) == pytest.approx({x: exact[x] for x in twins.top(exact, k_hot)}, abs=1e-11)
    searched = bw.threshold_search(
        bw.tail_of(df), end, k_hot, lambda d: d.withColumn("bucket", key_bucket("key", 4)), first_span=8
    )
    assert pairs(searched.hot) == pytest.approx(pairs(found.hot), rel=1e-12)


def test_some_searches_stop_early(spark):
    k, s, df = trace(spark, 0)
    found = bw.backward_hot_set(bw.tail_of(df), 150, 6, first_span=8)
    assert found.horizon > 1 and len(found.horizons) < 8


def test_a_tie_at_the_cut_is_broken_by_key(spark):
    df = spark.createDataFrame([(k, s) for k in range(1, 9) for s in (90, 95)], "key bigint, slice bigint")
    found = bw.backward_hot_set(bw.tail_of(df), 100, 3)
    assert sorted(pairs(found.hot)) == [1, 2, 3]


def test_more_wanted_than_there_are(spark):
    df = spark.createDataFrame([(1, 1), (2, 50)], "key bigint, slice bigint")
    assert len(pairs(bw.backward_hot_set(bw.tail_of(df), 50, 9).hot)) == 2
    assert pairs(bw.backward_hot_set(bw.tail_of(df), 50, 0).hot) == {}


def test_large_budgets_take_the_counting_path(spark, monkeypatch):
    from heatlens.operators import selection as sel

    k, s, df = trace(spark, 2)
    want = pairs(bw.backward_hot_set(bw.tail_of(df), 150, 13).hot)
    monkeypatch.setattr(sel, "SMALL_K", 0)
    monkeypatch.setattr(bw, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(sel, "SETTLE_ROWS", 10)
    assert pairs(bw.backward_hot_set(bw.tail_of(df), 150, 13).hot) == pytest.approx(want, rel=1e-12)


def test_bounds_close_in(spark):
    k, s, df = trace(spark, 1)
    end, last = 150, None
    exact = twins.backward(k, s, end)
    tail = bw.tail_of(df)
    for t in (140, 100, 30, 1):
        rows = {r["key"]: r for r in bw.with_bounds(bw.heat_backward(tail(t), end), t, end).collect()}
        for key, r in rows.items():
            assert r["est"] <= exact[key] + 1e-12
            assert r["lower"] <= exact[key] + 0.95**end + 1e-12 and exact[key] <= r["upper"] + 1e-12
            if last and key in last:
                assert last[key]["lower"] <= r["lower"] + 1e-12 and r["upper"] <= last[key]["upper"] + 1e-12
        last = rows
    assert {x: r["est"] for x, r in rows.items()} == pytest.approx(exact, abs=1e-12)


@pytest.mark.parametrize("rows_per_bin", [50, 10_000])
def test_classifiers_on_ordinal_slices(spark, rows_per_bin):
    rng = random.Random(9)
    keys = [rng.randint(1, 5) if rng.random() < 0.4 else rng.randint(6, 80) for _ in range(2000)]
    df = spark.createDataFrame([(k, 10 * n + 3) for n, k in enumerate(keys)], "key bigint, arrival bigint")
    params = HeatParams(slices=40, hot_fraction=0.003)
    profile = profile_arrival(df, rows_per_bin=rows_per_bin)
    size = 50
    serial = twins.backward(keys, [42 - -(-(2000 - n) // size) for n in range(2000)], 41)
    assert set(pairs(cl.search_backward(df, params, profile).hot)) == set(twins.top(serial, 6))
    bucketed = twins.backward(keys, [(n + 1) // size + 1 for n in range(2000)], 41)
    assert set(pairs(cl.search_backward_bucketed(df, params, profile).hot)) == set(twins.top(bucketed, 6))
    fixed = twins.backward(keys, [(n + 2) // 30 + 1 for n in range(2000)], 2001 // 30 + 1)
    found = cl.search_backward_fixed(df, params, profile, interval=30)
    assert set(pairs(found.hot)) == set(twins.top(fixed, 6))


@pytest.mark.parametrize("seed, k_hot", [(0, 6), (1, 6), (2, 13)])
def test_no_slice_is_read_twice(spark, seed, k_hot):
    k, s, df = trace(spark, seed)
    spans, whole = [], bw.tail_of(df)

    def tail(t, before=None):
        spans.append((t, before))
        return whole(t, before)

    found = bw.backward_hot_set(tail, 150, k_hot, first_span=8)
    assert len(found.horizons) > 1 and spans[0][1] is None
    # each read ends where the one before it began; the last one completes the members
    assert all(before == later for (_, before), (later, _) in zip(spans[1:], spans)) and spans[-1][0] == 1


@pytest.mark.parametrize("k", [1, 3, 40, 59, 60])
def test_place_by_histogram(spark, k):
    """Sums that share a step of the histogram are told apart by counting it again."""
    rng = random.Random(k)
    sums = [0.5 + i * 1e-7 for i in range(40)] + [0.5 - 1e-13 * i for i in range(1, 11)] + [rng.random() * 1e-3 for _ in range(10)]
    state = spark.createDataFrame([(i, e) for i, e in enumerate(sums)], "key long, est double")
    place, order = bw._place(state, k, 1e-9, 1e-11), sorted(sums, reverse=True)
    if place.whole:
        assert place.kth == order[k - 1] and place.following == (order[k] if k < 60 else None)
    else:
        assert place.kth <= order[k - 1] and order[k - 1] - order[k] <= 1e-11
    assert place.whole == (k < 40 or k >= 50)
    assert place.reaching >= sum(e >= place.kth for e in sums)
    assert bw._place(state, 61, 1e-9, 1e-11) is None


def test_layout_is_searched_by_folder(spark, tmp_path):
    from heatlens.plans import layout

    rng = random.Random(3)
    keys = [rng.randint(1, 4) if rng.random() < 0.6 else rng.randint(6, 300) for _ in range(6000)]
    df = spark.createDataFrame([(k, 10 * n + 3) for n, k in enumerate(keys)], "key bigint, arrival bigint")
    params = HeatParams(slices=600, hot_fraction=0.0007)
    layout.write_layout(df, str(tmp_path / "log"), params, profile_arrival(df, rows_per_bin=500))
    found = layout.search_layout(spark, str(tmp_path / "log"), params, first_rows=1)
    exact = twins.backward(keys, [(n + 1) // 10 + 1 for n in range(6000)], 601)
    assert found.horizon > 1 and set(pairs(found.hot)) == set(twins.top(exact, 4))
    assert pairs(found.hot) == pytest.approx({x: exact[x] for x in twins.top(exact, 4)}, abs=1e-11)
    rows = layout.layout_tail(spark, str(tmp_path / "log"), 601)(500, 560)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(span" in plan and "Sort" not in plan and "Exchange" not in plan


def test_missing_kth_excludes_nothing(spark):
    from heatlens.operators.backward import admission_threshold, overlap_slice_bound, prune_candidates

    bounds = spark.createDataFrame([(1, 0.1, 0.2), (2, 0.0, 0.0)], "key long, lower double, upper double")
    assert prune_candidates(bounds, None).count() == 2 and prune_candidates(bounds, 0.1).count() == 1
    assert admission_threshold(None, 9) == admission_threshold(0.0, 9) == overlap_slice_bound(None, 9) == float("-inf")
    assert 0 < admission_threshold(0.05, 100) < 100


@pytest.mark.parametrize("slices", [2_000, 30_000])
def test_old_keys_keep_their_order(spark, slices):
    """Estimates far below 1e-12, and below what a double can hold, still rank."""
    step = slices // 500
    rows = [(7 * s % 1_009, s) for s in range(step, slices + 1, step)]
    df = spark.createDataFrame(rows, "key bigint, slice bigint")
    newest = {key for key, _ in rows[-250:]}
    assert set(pairs(bw.backward_hot_set(bw.tail_of(df), slices, 250).hot)) == newest
    searched = bw.threshold_search(
        bw.tail_of(df), slices, 250, lambda d: d.withColumn("bucket", key_bucket("key", 1))
    )
    assert set(pairs(searched.hot)) == newest


def test_finalized_at_a_threshold_between(spark):
    bounds = spark.createDataFrame(
        [(k, 0.1 * k, 0.1 * k, 0.1 * k) for k in range(1, 6)], "key long, est double, lower double, upper double"
    )
    for k in (1, 3):
        found = bw.finalize_hot_set(bounds, bw.threshold_between(bounds, k))
        assert [r["key"] for r in found.collect()] == [*range(6 - k, 6)]
    assert bw.finalize_hot_set(bounds, bw.threshold_between(bounds, 9)).count() == 5


@pytest.mark.parametrize("k", [1, 2, 4, 6])
def test_finalized_with_ties_at_the_threshold(spark, k):
    """One key on top, four tied, one below; and all tied at the maximum."""
    schema = "key long, est double, lower double, upper double"
    bounds = spark.createDataFrame([(x, e, e, e) for x, e in [(9, 0.5), (4, 0.2), (2, 0.2), (3, 0.2), (1, 0.2), (7, 0.1)]], schema)
    found = bw.finalize_hot_set(bounds, bw.threshold_between(bounds, k), k)
    assert {r["key"] for r in found.collect()} == set([9, 1, 2, 3, 4, 7][:k])
    level = spark.createDataFrame([(x, 0.2, 0.2, 0.2) for x in range(8, 0, -1)], schema)
    found = bw.finalize_hot_set(level, bw.threshold_between(level, k), k)
    assert [r["key"] for r in found.collect()] == list(range(1, k + 1))
