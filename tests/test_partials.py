import random

import pytest

import twins
from heatlens.operators.partials import partial_by_slice_number, partial_by_slice_rank, partial_by_slice_run, roll_up, roll_up_growing


def tagged(spark, seed, rows=500, keys=20, slices=40, parts=4):
    rng = random.Random(seed)
    s = sorted(rng.randint(1, slices) for _ in range(rows))
    p = [min(x // (slices // parts), parts - 1) for x in s]
    k = [rng.randint(1, keys) for _ in range(rows)]
    df = spark.createDataFrame(
        [(k[i], s[i], p[i], i) for i in range(rows)], "key bigint, slice bigint, part bigint, arrival bigint"
    )
    return k, s, p, df


def tables_of(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["part"], {})[r["key"]] = r["partial"]
    return found


def assert_tables(found, expected):
    assert set(found) == set(expected)
    for part in expected:
        assert found[part] == pytest.approx(expected[part], abs=1e-13)


@pytest.mark.parametrize("per_part", [10, 3])
def test_rank_partials_and_roll_up(spark, per_part):
    k, s, p, df = tagged(spark, 1)
    expected = twins.rank_partials(k, s, p, per_part)
    partials = partial_by_slice_rank(df, per_part, 40)
    assert_tables(tables_of(partials), expected)
    plain = {r["key"]: r["est"] for r in roll_up(partials, per_part).collect()}
    assert plain == pytest.approx(twins.rolled(expected, lambda _: per_part - 1), abs=1e-13)
    growing = {r["key"]: r["est"] for r in roll_up_growing(partials, per_part).collect()}
    assert growing == pytest.approx(twins.rolled(expected, lambda q: (q + 1) * per_part - 1), abs=1e-13)


@pytest.mark.parametrize("rows_per_bin", [7, 60, 1_000_000])
@pytest.mark.parametrize("per_part", [400, 10])
def test_run_partials_on_a_clock_that_goes_back(spark, per_part, rows_per_bin):
    rng = random.Random(4)
    s = [max(1, min(40, i // 12 + rng.randint(-6, 6))) for i in range(500)]
    p, k = [min(x // 10, 3) for x in s], [rng.randint(1, 20) for _ in s]
    df = spark.createDataFrame(list(zip(k, s, p, range(500))), "key bigint, slice bigint, part bigint, n bigint")
    found = partial_by_slice_run(df.repartition(3), per_part, rows_per_bin=rows_per_bin)
    assert_tables(tables_of(found), twins.rank_partials(k, s, p, per_part))


def test_number_partials(spark):
    k, s, p, df = tagged(spark, 2)
    assert_tables(tables_of(partial_by_slice_number(df)), twins.number_partials(k, s, p))


def test_many_slices_are_joined_by_shuffle(spark, monkeypatch):
    from heatlens.operators import partials as module

    k, s, p, df = tagged(spark, 3)
    monkeypatch.setattr(module, "BROADCAST_SLICES", 1)
    assert_tables(tables_of(partial_by_slice_rank(df, 10, 40)), twins.rank_partials(k, s, p, 10))
