import random

import pytest
from pyspark.sql import functions as F

import twins
from heatlens.operators.forward import heat_as_of, heat_forward, run_starts, slice_dedup
from heatlens.operators.neighbor import heat_neighbor_reuse
from heatlens.params import HeatParams


def heat_of(df):
    return {r["key"]: r["est"] for r in df.collect()}


def accesses(spark, keys, slices):
    rows = [(k, s, n) for n, (k, s) in enumerate(zip(keys, slices))]
    return spark.createDataFrame(rows, "key bigint, slice bigint, n bigint")


def random_trace(seed, rows=400, keys=25, step=0.3, back=0.0):
    rng = random.Random(seed)
    s, slices = 1, []
    for _ in range(rows):
        if rng.random() < step:
            s += rng.randint(1, 3)
        slices.append(max(1, s - rng.randint(1, 4)) if rng.random() < back else s)
    return [rng.randint(0, keys - 1) * rng.choice([1, 1, 7]) for _ in range(rows)], slices


@pytest.mark.parametrize(
    "slices, expected",
    [([1], 0.0), ([1, 1], 0.0), ([1, 3], 0.05), ([1, 2, 3], 0.05 + 0.05 * 0.95)],
)
def test_one_key(spark, slices, expected):
    df = accesses(spark, [7] * len(slices), slices)
    assert heat_of(heat_forward(slice_dedup(df), max_slices=10)) == {7: pytest.approx(expected, abs=1e-15)}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("max_slices", [1000, None])
def test_fold(spark, seed, max_slices):
    keys, slices = random_trace(seed)
    found = heat_of(heat_forward(slice_dedup(accesses(spark, keys, slices)), max_slices=max_slices))
    assert found == pytest.approx(twins.forward(keys, slices), abs=1e-14)


def test_more_slices_than_a_double_can_span(spark):
    slices = [1, 2, 5_900, 5_901, 40_000, 40_001, 40_010]
    keys = [1] * len(slices)
    df = slice_dedup(accesses(spark, keys, slices))
    assert heat_of(heat_forward(df)) == pytest.approx(twins.forward(keys, slices), rel=1e-12)


@pytest.mark.parametrize("rows_per_bin", [7, 100, 10_000])
@pytest.mark.parametrize("max_slices", [1000, None])
def test_slices_that_go_back(spark, rows_per_bin, max_slices):
    keys, slices = random_trace(5, back=0.3)
    runs = run_starts(accesses(spark, keys, slices), rows_per_bin=rows_per_bin)
    found = heat_of(heat_forward(runs, max_slices=max_slices, order="n"))
    assert found == pytest.approx(twins.forward(keys, slices), abs=1e-13)


@pytest.mark.parametrize(
    "slices", [[900, 1, 3], [990, 10, 20, 30], [4999, 1, 2, 3], [12_000, 3, 5], [30_000, 2, 4], [5, 3, 5, 5, 2, 900, 3]]
)
@pytest.mark.parametrize("rows_per_bin", [2, 10_000])
def test_clocks_that_jump_far_back(spark, slices, rows_per_bin):
    runs = run_starts(accesses(spark, [1] * len(slices), slices), rows_per_bin=rows_per_bin)
    try:
        want = twins.forward([1] * len(slices), slices)
    except OverflowError:  # the step from 0 may not be weighed: 0.05 + 0 * 0.95**-29998
        want = twins.forward([1] * (len(slices) - 1), slices[1:])
        want = {1: want[1] + 0.05 * twins.LAMBDA ** (slices[-1] - slices[1])}
    for max_slices in (None, 5_000 if max(slices) <= 5_000 else None):
        found = heat_of(heat_forward(runs, max_slices=max_slices, order="n"))
        assert found == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("top", [1_000, 5_000, 9_000])
def test_random_slices(spark, top):
    rng = random.Random(top)
    keys = [rng.randint(0, 9) for _ in range(120)]
    slices = [rng.randint(1, top) for _ in keys]
    runs = run_starts(accesses(spark, keys, slices), rows_per_bin=30)
    found = heat_of(heat_forward(runs, max_slices=top if top < 5_848 else None, order="n"))
    assert found == pytest.approx(twins.forward(keys, slices), rel=1e-8)


def test_decay_without_access(spark):
    df = heat_forward(slice_dedup(accesses(spark, [1, 1], [1, 3])), max_slices=10)
    assert heat_of(heat_as_of(df, 5)) == {1: pytest.approx(0.05 * 0.95**2)}


@pytest.mark.parametrize("seed, rows_per_bin", [(0, 5), (1, 64), (2, 10_000)])
def test_neighbor_reuse(spark, seed, rows_per_bin):
    rng = random.Random(seed)
    keys = [rng.randint(0, 12) * 11 for _ in range(400)]
    slices = [1 + n // 9 for n in range(400)]
    found = heat_of(
        heat_neighbor_reuse(accesses(spark, keys, slices), len(keys), rows_per_bin=rows_per_bin)
    )
    assert found == pytest.approx(twins.neighbor(keys, slices), abs=1e-14)


@pytest.mark.parametrize("local, seed", [(0, 1), (40, 2), (40, 3)])
def test_chains_are_contracted(spark, monkeypatch, local, seed):
    """Long paths and bushy trees, solved by splicing; all tables written hold under three rows a chain."""
    from heatlens.operators import neighbor

    rng, written = random.Random(seed), []
    parents = [None if i < 3 else i - 1 if i < 500 else rng.choice([499, rng.randrange(i), i - 1]) for i in range(1500)]
    rows = [(i, p, rng.random() if p is not None else 0.0, rng.random()) for i, p in enumerate(parents)]
    want = {}
    for i, p, a, b in rows:
        want[i] = b + (a * want[p] if p is not None else 0.0)
    stage = neighbor.stage

    def counted(df, name):
        held = stage(df, name)
        written.append(held.count())
        return held

    monkeypatch.setattr(neighbor, "stage", counted)
    links = spark.createDataFrame(rows, "chain long, parent long, a double, b double").repartition(3)
    found = neighbor.solve_chains(links, len(rows), local)
    assert {r["chain"]: r["value"] for r in found.collect()} == pytest.approx(want, rel=1e-12)
    # the first table is the links themselves
    assert sum(written[1:]) < 3 * len(rows) and len(written) > 4


def test_neighbor_takes_the_estimate_of_the_one_before(spark):
    keys, slices = [100, 116, 117, 100, 116, 133], [1, 1, 1, 3, 3, 3]
    found = heat_of(heat_neighbor_reuse(accesses(spark, keys, slices), len(keys)))
    assert found[116] == found[100] == pytest.approx(0.05)
    assert found[117] == found[133] == 0.0


@pytest.mark.parametrize(
    "bad",
    [{"slices": 1}, {"buckets": 0}, {"alpha": 0.0}, {"alpha": 1.0}, {"hot_fraction": 1.5}, {"digits": 0}],
)
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        HeatParams(**bad)


def test_few_slices_are_raised():
    assert HeatParams(slices=3).slice_count == 5
    with pytest.raises(ValueError):
        HeatParams(slices=5, buckets=9).slices_per_part


def test_forward_and_backward_agree_up_to_the_first_access(spark):
    keys, slices = random_trace(8)
    end = max(slices)
    folded = heat_forward(slice_dedup(accesses(spark, keys, slices)), max_slices=end).withColumn(
        "back",
        F.pow(F.lit(0.95), end - F.col("last_slice"))
        * (F.col("est") + 0.05 * F.pow(F.lit(0.95), F.col("last_slice") - F.col("first_slice"))),
    )
    found = {r["key"]: r["back"] for r in folded.collect()}
    assert found == pytest.approx(twins.backward(keys, slices, end), abs=1e-14)
