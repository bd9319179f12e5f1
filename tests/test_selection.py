import random

import pytest

from heatlens.operators import selection as sel


@pytest.fixture(scope="module")
def ranked(spark):
    """A third of the rows share one estimate, another third one bucket."""
    rng = random.Random(3)
    rows = []
    for key in rng.sample(range(100_000), 6000):
        est = 0.05 if rng.random() < 0.35 else round(rng.random(), 4)
        rows.append((0 if rng.random() < 0.4 else rng.randint(1, 5), key, f"k{key:06d}", est))
    df = spark.createDataFrame(rows, "bucket int, key bigint, name string, est double").cache()
    df.count()
    return rows, df


def order(rows):
    return sorted(rows, key=lambda r: (-r[3], r[1]))


@pytest.mark.parametrize("k", [0, 1, 17, 2500, 3500, 5999, 6000, 9000])
@pytest.mark.parametrize("small_k", [100_000, 0])
def test_top_k(ranked, k, small_k):
    rows, df = ranked
    found = [r["key"] for r in sel.top_k(df, k, small_k=small_k).collect()]
    assert found == [r[1] for r in order(rows)[:k]]


def test_top_k_breaks_ties_by_text(ranked, monkeypatch):
    rows, df = ranked
    monkeypatch.setattr(sel, "SETTLE_ROWS", 50)
    found = [r["key"] for r in sel.top_k(df, 3000, tie="name", small_k=0).collect()]
    assert found == [r[1] for r in order(rows)[:3000]]


@pytest.mark.parametrize("k", [5, 400, {0: 700, 1: 3, 2: 0, 5: 10_000}])
@pytest.mark.parametrize("small_k", [100_000, 0])
def test_top_k_by_group(ranked, k, small_k):
    rows, df = ranked
    found = sel.top_k_by_group(df, "bucket", k, small_k=small_k).collect()
    expected = set()
    for b in range(6):
        limit = k if isinstance(k, int) else k.get(b, 0)
        expected |= {r[1] for r in order([r for r in rows if r[0] == b])[:limit]}
    assert {r["key"] for r in found} == expected and len(found) == len(expected)


@pytest.mark.parametrize("col", ["est", "key", "name"])
@pytest.mark.parametrize("largest", [True, False])
def test_nth_by_group_narrows_to_the_exact_row(ranked, col, largest):
    rows, df = ranked
    at = {"key": 1, "name": 2, "est": 3}[col]
    want = {0: 900, 1: 1, 3: 250, 4: 100_000}
    found = sel.nth_by_group(df, "bucket", col, want, largest, settle=20)
    assert set(found) == {0, 1, 3}
    for b, (value, before) in found.items():
        values = sorted((r[at] for r in rows if r[0] == b), reverse=largest)
        assert value == values[want[b] - 1]
        assert before == values.index(value)


@pytest.mark.parametrize("k", [1, 500, 5999, 6000, 6001])
@pytest.mark.parametrize("small_k", [100_000, 0])
def test_kth_and_next(ranked, k, small_k):
    rows, df = ranked
    values = sorted((r[3] for r in rows), reverse=True) + [None, None]
    expected = (values[k - 1], values[k]) if k <= 6000 else (None, None)
    assert sel.kth_and_next(df, k, "est", small_k) == expected


@pytest.mark.parametrize("k", [1, 3000, 6000, 6001])
@pytest.mark.parametrize("small_k", [100_000, 0])
def test_kth_row(ranked, k, small_k):
    rows, df = ranked
    expected = (order(rows)[k - 1][3], order(rows)[k - 1][1]) if k <= 6000 else None
    assert sel.kth_row(df, k, small_k=small_k) == expected


@pytest.mark.parametrize("small_k", [100_000, 0])
def test_nulls_have_no_rank(spark, small_k):
    rows = [(None, 1, 0.9), (0, None, 0.8), (0, 3, None), (0, 4, 0.5), (0, 5, 0.5), (1, 6, 0.1)]
    df = spark.createDataFrame(rows, "bucket int, key bigint, est double")
    assert [r["key"] for r in sel.top_k(df, 2, small_k=small_k).collect()] == [1, 4]
    assert {r["key"] for r in sel.top_k_by_group(df, "bucket", 2, small_k=small_k).collect()} == {4, 5, 6}
    assert sel.kth_row(df, 3, small_k=small_k) == (0.5, 5)
    assert sel.kth_and_next(df, 5, "est", small_k=small_k) == (0.1, None)


def test_labels_without_a_rank_are_cold(spark):
    from heatlens.operators.hotset import label_hot

    df = spark.createDataFrame([(1, 0.5), (None, 0.5), (3, None), (4, 0.1)], "key bigint, est double")
    for k in (0, 1, 9):
        hot = [r["key"] for r in label_hot(df, k).filter("is_hot").collect()]
        assert sorted(hot) == {0: [], 1: [1], 9: [1, 4]}[k]
        assert label_hot(df, k).filter("is_hot is null").count() == 0
