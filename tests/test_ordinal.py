import random

import pytest
from pyspark.sql import functions as F

from heatlens.functions import slices as sl
from heatlens.operators import ordinal
from heatlens.operators.ordinal import profile_arrival, with_ordinal, with_ordinal_slice


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the arrivals crowd into a sliver of the range."""
    rng = random.Random(1)
    values = set(rng.sample(range(10**12), 1000)) | set(range(5 * 10**11, 5 * 10**11 + 2000))
    shuffled = list(values)
    rng.shuffle(shuffled)
    df = spark.createDataFrame([(v % 37, v) for v in shuffled], "key bigint, arrival bigint").repartition(6)
    return sorted(values), df.cache()


@pytest.mark.parametrize("rows_per_bin", [10, 250, 10_000])
def test_ordinal(skewed, rows_per_bin):
    values, df = skewed
    profile = profile_arrival(df, rows_per_bin=rows_per_bin)
    assert profile.rows == len(values)
    if profile.bins > 1:
        assert sum(profile.counts) == len(values)
        assert max(profile.counts) <= 3 * rows_per_bin
    found = {r["arrival"]: r["n"] for r in with_ordinal(df, profile).collect()}
    assert found == {v: i for i, v in enumerate(values)}


@pytest.mark.parametrize("starts", [0, 16_384])
@pytest.mark.parametrize("rows_per_bin", [10, 250, 10_000])
@pytest.mark.parametrize("size", [1, 33, 700])
def test_ordinal_slice(skewed, monkeypatch, rows_per_bin, size, starts):
    values, df = skewed
    monkeypatch.setattr(ordinal, "MAX_STARTS", starts)
    profile = profile_arrival(df, rows_per_bin=rows_per_bin)
    sliced = with_ordinal_slice(df, profile, lambda n: sl.forward_slice(n, size))
    found = {r["arrival"]: r["slice"] for r in sliced.collect()}
    assert found == {v: 1 + -(-i // size) for i, v in enumerate(values)}


@pytest.mark.parametrize("low", [-(2**63), 2**62, 2**63 - 9001])
def test_slices_of_arrivals_beyond_exact_doubles(spark, low):
    """Neighbouring arrivals that are equal as doubles, and a range too wide for doubles."""
    for values in ([low + 3 * i for i in range(3000)], sorted({-(2**63), *range(low, low + 2000), 2**63 - 1})):
        df = spark.createDataFrame([(v % 7, v) for v in values], "key bigint, arrival bigint").repartition(3)
        profile = profile_arrival(df, rows_per_bin=400)
        found = {r["arrival"]: r["slice"] for r in with_ordinal_slice(df, profile, lambda n: sl.total_slice(n, 7)).collect()}
        assert found == {v: i // 7 + 1 for i, v in enumerate(values)}


def test_slices_of_a_suffix(skewed):
    values, df = skewed
    profile = profile_arrival(df, rows_per_bin=100)
    for ordinal in (0, 1, 999, 1500, 2999):
        cut = profile.first_cut_before(ordinal)
        recent = df if cut is None else df.filter(F.col("arrival") >= cut)
        assert recent.filter(F.col("arrival") >= values[ordinal]).count() == len(values) - ordinal
        sliced = with_ordinal_slice(recent, profile, lambda n: sl.total_slice(n, 40))
        wanted = ordinal // 40 + 1
        found = {r["arrival"]: r["slice"] for r in sliced.collect() if r["slice"] > wanted}
        assert found == {v: i // 40 + 1 for i, v in enumerate(values) if i // 40 + 1 > wanted}


@pytest.mark.parametrize("size", [3, 33, 299])
def test_slice_starts_by_counting(skewed, monkeypatch, size):
    """Narrowed to single cells: crowded and lonely arrivals, more starts than cells."""
    values, df = skewed
    monkeypatch.setattr(ordinal, "RANKED_ROWS", 0)
    monkeypatch.setattr(ordinal, "MAX_CELLS", 512)
    profile = profile_arrival(df, rows_per_bin=100)
    found = {r["arrival"]: r["slice"] for r in with_ordinal_slice(df, profile, lambda n: sl.forward_slice(n, size)).collect()}
    assert found == {v: 1 + -(-i // size) for i, v in enumerate(values)}


def test_few_arrivals_are_ranked(spark, monkeypatch):
    """1,000 slices over 100 bins: less than a tenth of the arrivals reaches the shuffle."""
    rows, reached, ranked = 50_000, [], ordinal._in_cells
    monkeypatch.setattr(ordinal, "RANKED_ROWS", 0)
    df = spark.range(rows).select((F.col("id") % 11).alias("key"), (F.col("id") * F.col("id")).alias("arrival")).cache()
    profile = profile_arrival(df, rows_per_bin=rows // 100)

    def ranked_starts(arrivals, slice_of, arrival, cells, real=ordinal._ranked_starts):
        reached.append(ranked(arrivals, arrival, [(c.low, c.high) for c in cells]).count())
        return real(arrivals, slice_of, arrival, cells)

    monkeypatch.setattr(ordinal, "_ranked_starts", ranked_starts)
    sliced = with_ordinal_slice(df, profile, lambda n: sl.forward_slice(n, rows // 1000))
    wrong = sliced.filter(F.col("slice") != 1 + F.ceil(F.sqrt("arrival").cast("bigint") / (rows // 1000)))
    assert profile.bins > 80 and wrong.count() == 0 and sum(reached) < rows / 10


@pytest.mark.parametrize("bins", [(0, 0), (3, 9), (12, 29)])
def test_slices_of_some_bins(skewed, bins):
    values, df = skewed
    profile = profile_arrival(df, rows_per_bin=100)
    low, high = profile.arrivals_of(*bins)
    first, last = profile.offsets[bins[0]], (*profile.offsets, len(values))[min(bins[1], profile.bins - 1) + 1]
    near = df.filter(F.col("arrival").between(low if low is not None else -1, high if high is not None else 2**60))
    for size in (40, 5000):
        sliced = with_ordinal_slice(near, profile, lambda n: sl.total_slice(n, size), bins=(bins[0], min(bins[1], profile.bins - 1)))
        assert {r["arrival"]: r["slice"] for r in sliced.collect()} == {values[i]: i // size + 1 for i in range(first, last)}


def test_slice_formulas(spark):
    rows, size, slices = 1038, 10, 100
    df = spark.range(rows).select(
        F.col("id").alias("n"),
        sl.forward_slice("id", size).alias("forward"),
        sl.reversed_slice("id", rows, size, slices).alias("reversed"),
        sl.tail_slice("id", rows, size, sl.tail_end(rows, size, slices)).alias("tail"),
        sl.bucketed_slice("id", size).alias("bucketed"),
        sl.fixed_slice("id", 26).alias("fixed"),
    )
    counter, boundary, fixed = 1, 1, 1
    for r in df.orderBy("n").collect():
        n = r["n"]
        assert r["forward"] == counter
        if n % size == 0:
            counter += 1
        assert r["bucketed"] == (n + 1) // size + 1
        boundary += 1
        if boundary % 26 == 0:
            fixed += 1
        assert r["fixed"] == fixed
        assert r["reversed"] == abs(size * (slices + 1) - (rows - n)) // size + 1
        assert r["tail"] == sl.tail_end(rows, size, slices) - (rows - 1 - n) // size >= 1
    assert sl.fixed_end(rows, 26) == (rows + 1) // 26 + 1
    assert sl.slice_size_from_bytes(78_896, 100) == 10


@pytest.mark.parametrize("rows_per_bin", [10, 250, 10_000])
def test_rows_without_an_arrival_are_left_out(spark, skewed, rows_per_bin):
    values, df = skewed
    holes = df.unionByName(spark.range(300).select("id", F.lit(None).cast("bigint").alias("arrival")).toDF(*df.columns))
    profile = profile_arrival(holes, rows_per_bin=rows_per_bin)
    assert profile.rows == len(values)
    assert {r["arrival"]: r["n"] for r in with_ordinal(holes, profile).collect()} == {v: i for i, v in enumerate(values)}
    sliced = with_ordinal_slice(holes, profile, lambda n: sl.forward_slice(n, 33))
    assert sliced.count() == len(values)


def test_times_before_the_first_access_fall_into_the_first_part(spark):
    df = spark.createDataFrame([(-900,), (0,), (35,), (999,)], "ts bigint")
    for rule, first in ((sl.file_time_partition, 1), (sl.memory_time_partition, 1)):
        part, number = rule("ts", 0, 10, 8, 2)
        found = [(r[0], r[1]) for r in df.orderBy("ts").select(part, number).collect()]
        assert found[0] == found[1] == (0, first) and all(0 <= p <= 1 for p, _ in found)
