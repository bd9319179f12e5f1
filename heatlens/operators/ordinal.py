"""Exact arrival ordinals and ordinal slices without a global sort.

The arrival column is profiled once: its row count, quantile cut points and the
exact number of rows between neighbouring cuts. Cuts and counts are at most
``MAX_BINS`` numbers whatever the data, and arrivals are unique, so no bin can
hold much more than its share, however the arrivals crowd together.
A row's ordinal is then its bin's offset plus its rank inside the bin.

Slices need less than that: only the first arrival of each slice. All of them are found together, by counting
bare arrivals in ever finer cells around them and ranking the few that are left; a row's slice is then
looked up among at most ``MAX_STARTS`` starts, and no row is shuffled. With more slices,
a bin that lies wholly inside one slice gives all its rows that slice straight from
the bin table, and only the rows of bins which a slice boundary crosses are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from heatlens.operators.selection import quantiles
from heatlens.staging import small_table

ROWS_PER_BIN = 1_000_000
MAX_BINS = 16_384
# Slices are looked up among at most so many starts.
MAX_STARTS = 16_384
# Slice starts are searched in at most so many cells, each cut into at most so many parts a round, until a
# sixteenth of the rows, or so few that one more round costs more, are left to rank.
MAX_CELLS = 65_536
MOST_PARTS = 32
RANKED_SHARE = 16
RANKED_ROWS = 1_000_000
# Integers up to here are exact as doubles.
EXACT_DOUBLE = 2**53
# Rows sampled per bin to place the cuts.
SAMPLE_PER_BIN = 200
_BIN = "__bin"
_POS = "__pos"


@dataclass(frozen=True)
class ArrivalProfile:
    """Row count, inner cut points, and rows and first and last arrival per bin of an arrival column."""

    rows: int
    cuts: tuple[int, ...] = ()
    counts: tuple[int, ...] = field(default=())
    extents: tuple[tuple[int, int] | None, ...] = field(default=(), repr=False)

    @property
    def bins(self) -> int:
        return len(self.cuts) + 1

    @cached_property
    def offsets(self) -> tuple[int, ...]:
        totals, running = [], 0
        for count in self.counts or (self.rows,):
            totals.append(running)
            running += count
        return tuple(totals)

    def first_cut_before(self, ordinal: int) -> int | None:
        """A lower bound, usable as a pushed filter, on the arrivals of all
        rows from ``ordinal`` on. ``None`` when the first bin holds it."""
        index = max(i for i, offset in enumerate(self.offsets) if offset <= max(0, ordinal))
        if index == 0:
            return None
        cut = self.cuts[index - 1]
        # bins compare doubles: leave room for the rounding of the cut
        return cut - math.ceil(math.ulp(float(cut)))

    def bins_of(self, first: int, last: int | None = None) -> tuple[int, int]:
        """The first and the last bin with an ordinal from ``first`` to ``last`` (to the end by default)."""
        low = max(i for i, offset in enumerate(self.offsets) if offset <= max(0, first))
        if last is None:
            return low, self.bins - 1
        return low, max(low, *(i for i, offset in enumerate(self.offsets) if offset <= max(0, last)))

    def arrivals_of(self, first_bin: int, last_bin: int) -> tuple[int | None, int | None]:
        """Bounds on the arrivals of these bins, usable as pushed filters; ``None`` where there is none."""
        slack = lambda cut: math.ceil(math.ulp(float(cut)))
        low = self.cuts[first_bin - 1] if first_bin else None
        high = self.cuts[last_bin] if last_bin < len(self.cuts) else None
        return None if low is None else low - slack(low), None if high is None else high + slack(high)


def profile_arrival(
    df: DataFrame,
    arrival: str = "arrival",
    rows_per_bin: int = ROWS_PER_BIN,
    max_bins: int = MAX_BINS,
) -> ArrivalProfile:
    """Profile ``arrival``. Up to ``rows_per_bin`` rows cost one count only. Rows
    without an arrival have no place in the order: they count nowhere."""
    df = df.filter(F.col(arrival).isNotNull())
    rows = df.count()
    wanted = min(max_bins, -(-rows // rows_per_bin))
    if wanted <= 1:
        return ArrivalProfile(rows)
    # which cuts is no matter, as long as the counts below belong to them
    sampled = df.select(arrival).filter(F.rand() < F.lit(SAMPLE_PER_BIN * wanted / rows))
    drawn = sampled.agg(quantiles(arrival, wanted).alias("cuts")).first()["cuts"] or []
    # bins compare doubles, so cuts that round alike count once
    cuts = tuple(sorted({float(cut): cut for cut in drawn}.values()))
    binned = _with_bin(df.select(arrival), arrival, cuts)
    found = binned.groupBy(_BIN).agg(
        F.count("*").alias("rows"), F.min(arrival).alias("low"), F.max(arrival).alias("high")
    ).collect()
    counted = {int(r[_BIN]): (r["rows"], (r["low"], r["high"])) for r in found}
    per_bin = [counted.get(i, (0, None)) for i in range(len(cuts) + 1)]
    return ArrivalProfile(rows, cuts, tuple(c for c, _ in per_bin), tuple(e for _, e in per_bin))


def _with_bin(df: DataFrame, arrival: str, cuts: tuple[int, ...]) -> DataFrame:
    """Add the bin number: a binary search over the cuts inside the JVM."""
    if not cuts:
        return df.withColumn(_BIN, F.lit(0))
    search = Bucketizer(
        splits=[-math.inf, *map(float, cuts), math.inf], inputCol=_POS, outputCol=_BIN, handleInvalid="keep"
    )
    placed = search.transform(df.withColumn(_POS, F.col(arrival).cast("double")))
    # never null, so that joins on it need not evaluate it once more to filter
    return placed.withColumn(_BIN, F.coalesce(F.col(_BIN).cast("int"), F.lit(-1))).drop(_POS)


def _in_bins(df: DataFrame, profile: ArrivalProfile, arrival: str, first_bin: int, last_bin: int) -> DataFrame:
    """The rows of these bins. A cut and its arrival are compared as doubles, as :func:`_with_bin` does."""
    at = F.col(arrival).cast("double")
    if first_bin:
        df = df.filter(at >= F.lit(float(profile.cuts[first_bin - 1])))
    if last_bin < len(profile.cuts):
        df = df.filter(at < F.lit(float(profile.cuts[last_bin])))
    return df


def arrival_bin(df: DataFrame, profile: ArrivalProfile, arrival: str = "arrival", name: str = "bin") -> DataFrame:
    """Add the number of the profile's bin that an arrival is in; bins follow one another."""
    return _with_bin(df, arrival, profile.cuts).withColumnRenamed(_BIN, name)


def _rank_in_bin(arrival: str) -> Column:
    return F.row_number().over(Window.partitionBy(_BIN).orderBy(arrival)).cast("bigint") - F.lit(1)


def with_ordinal(
    df: DataFrame, profile: ArrivalProfile, arrival: str = "arrival", n: str = "n"
) -> DataFrame:
    """Add the exact 0-based arrival ordinal ``n``. Rows without an arrival are left out."""
    df = df.filter(F.col(arrival).isNotNull())
    binned = _with_bin(df, arrival, profile.cuts)
    if profile.bins == 1:
        return binned.withColumn(n, _rank_in_bin(arrival)).drop(_BIN)
    table = small_table(df.sparkSession, list(enumerate(profile.offsets)), f"{_BIN} int, __offset bigint")
    return (
        binned.withColumn(n, _rank_in_bin(arrival))
        .join(F.broadcast(table), _BIN)
        .withColumn(n, F.col("__offset") + F.col(n))
        .drop(_BIN, "__offset")
    )


def with_ordinal_slice(
    df: DataFrame,
    profile: ArrivalProfile,
    slice_of: Callable[[Column], Column],
    arrival: str = "arrival",
    slice_col: str = "slice",
    bins: tuple[int, int] | None = None,
) -> DataFrame:
    """Add ``slice_of(ordinal)`` for a slice rule that never decreases.

    A part of the table may be passed with the profile of the whole, and the first and last of the
    ``bins`` that it holds; rows of other bins are left out. Rows without an arrival are too.
    """
    df = df.filter(F.col(arrival).isNotNull())
    if profile.bins == 1:
        ranked = with_ordinal(df, profile, arrival, "__n")
        return ranked.withColumn(slice_col, slice_of(F.col("__n"))).drop("__n")
    first_bin, last_bin = bins or (0, profile.bins - 1)
    if bins is not None:
        df = _in_bins(df, profile, arrival, first_bin, last_bin)
    held = [
        (i, o, o + c - 1) for i, (o, c) in enumerate(zip(profile.offsets, profile.counts)) if c and first_bin <= i <= last_bin
    ]
    if not held:
        return df.withColumn(slice_col, slice_of(F.lit(0).cast("bigint")))
    number = slice_of(F.lit(0).cast("bigint"))
    kind = df.sparkSession.range(1).select(number.alias("s")).schema["s"].dataType
    at = _slices_at(df.sparkSession, slice_of, [n for _, o, last in held for n in (o - 1, o, last)])
    lowest, highest = at[held[0][1]], at[held[-1][2]]
    if highest - lowest <= MAX_STARTS:
        cells = [
            _Cell(*profile.extents[i], o, last - o + 1) for i, o, last in held if at[max(0, o - 1)] < at[last]
        ] if profile.extents else []
        if not cells and profile.extents:
            # all in one slice
            return df.withColumn(slice_col, F.lit(highest).cast(kind))
        if cells and cells[-1].high - cells[0].low <= EXACT_DOUBLE:
            starts = _slice_starts(df, profile.rows, slice_of, arrival, cells)
            if not starts:
                return df.withColumn(slice_col, F.lit(highest).cast(kind))
            return _look_up(df, starts, highest, kind.simpleString(), arrival, slice_col)
    offsets = {i: o for i, o, last in held if at[o] < at[last]}
    inside = small_table(
        df.sparkSession, [(i, at[o]) for i, o, last in held if i not in offsets], f"{_BIN} int, {slice_col} {kind.simpleString()}"
    )
    crossed = small_table(df.sparkSession, list(offsets.items()), f"{_BIN} int, __offset bigint")
    binned = _with_bin(df, arrival, profile.cuts)
    settled = binned.join(F.broadcast(inside), _BIN).drop(_BIN)
    ranked = (
        binned.join(F.broadcast(crossed), _BIN)
        .withColumn(slice_col, slice_of(F.col("__offset") + _rank_in_bin(arrival)))
        .drop(_BIN, "__offset")
    )
    return settled.unionByName(ranked)


def _slices_at(spark: SparkSession, slice_of: Callable[[Column], Column], ordinals: list[int]) -> dict[int, int]:
    """The slices of these ordinals; of one before the first row, that of the first row."""
    table = small_table(spark, [(n,) for n in sorted({max(0, n) for n in ordinals})], "n bigint")
    found = dict(map(tuple, table.select("n", slice_of(F.col("n"))).collect()))
    return found | {n: found[0] for n in ordinals if n < 0}


@dataclass(frozen=True)
class _Cell:
    """Arrivals from ``low`` to ``high``, both of which occur: ``rows`` of them, the first with ordinal ``offset``."""

    low: int
    high: int
    offset: int
    rows: int


def _slice_starts(
    df: DataFrame, rows: int, slice_of: Callable[[Column], Column], arrival: str, cells: list[_Cell]
) -> list[tuple[int, int, int]]:
    """``(arrival, slice, slice before)`` of the first row of each slice but the first one, in order.

    All starts are searched together. Each round cuts the cells that hold a start into
    equal parts and counts these, which shuffles counts only; parts without a start are dropped, and one whose
    first row is its only start is settled by its smallest arrival. When few rows are left in the cells, these are ranked.
    """
    spark = df.sparkSession
    arrivals, starts = df.select(arrival), set()
    while True:
        at = _slices_at(spark, slice_of, [n for c in cells for n in (c.offset - 1, c.offset, c.offset + c.rows - 1)])
        left = []
        for c in cells:
            before, first, last = at[c.offset - 1], at[c.offset], at[c.offset + c.rows - 1]
            if before < first:
                starts.add((c.low, first, before))
            if first < last:
                left.append(c)
        cells = left
        if not cells or sum(c.rows for c in cells) <= max(RANKED_ROWS, rows // RANKED_SHARE):
            break
        cells = _narrowed(arrivals, arrival, cells)
    if cells:
        starts.update(_ranked_starts(arrivals, slice_of, arrival, cells))
    return sorted(starts)


def _in_cells(arrivals: DataFrame, arrival: str, cells: list[tuple[int, int]]) -> DataFrame:
    """Add ``_BIN``, the number of the cell ``(low, high)`` that an arrival is in; arrivals in none are left out."""
    first, last = cells[0][0], cells[-1][1]
    near = arrivals.filter(F.col(arrival).between(F.lit(first), F.lit(last)))
    edges: dict[int, int] = {}
    for i, (low, high) in enumerate(cells):
        edges[low] = i
        edges.setdefault(high + 1, -1)
    order = sorted(edges)
    splits = [-math.inf, *(float(e - first) for e in order), math.inf]
    placed = Bucketizer(splits=splits, inputCol=_POS, outputCol="__edge").transform(
        near.withColumn(_POS, (F.col(arrival) - F.lit(first)).cast("double"))
    )
    named = small_table(
        arrivals.sparkSession, [(i + 1, edges[e]) for i, e in enumerate(order) if edges[e] >= 0], f"__edge int, {_BIN} int"
    )
    edge = F.coalesce(F.col("__edge").cast("int"), F.lit(-1))
    return placed.select(arrival, edge.alias("__edge")).join(F.broadcast(named), "__edge").select(arrival, _BIN)


def _narrowed(arrivals: DataFrame, arrival: str, cells: list[_Cell]) -> list[_Cell]:
    """The parts of the cells that hold rows, with their counts."""
    parts = max(2, min(MOST_PARTS, MAX_CELLS // len(cells)))
    cut = []
    for i, c in enumerate(cells):
        width = -(-(c.high - c.low + 1) // parts)
        cut += [(low, min(low + width - 1, c.high), i) for low in range(c.low, c.high + 1, width)]
    counted = (
        _in_cells(arrivals, arrival, [(low, high) for low, high, _ in cut])
        .groupBy(_BIN)
        .agg(F.count("*").alias("rows"), F.min(arrival).alias("low"), F.max(arrival).alias("high"))
        .collect()
    )
    found, offset, parent = [], 0, None
    for r in sorted(counted, key=lambda r: r[_BIN]):
        if cut[r[_BIN]][2] != parent:
            parent = cut[r[_BIN]][2]
            offset = cells[parent].offset
        found.append(_Cell(r["low"], r["high"], offset, r["rows"]))
        offset += r["rows"]
    return found


def _ranked_starts(
    arrivals: DataFrame, slice_of: Callable[[Column], Column], arrival: str, cells: list[_Cell]
) -> list[tuple[int, int, int]]:
    """The starts inside the cells, but at their first rows, by ranking their rows."""
    offsets = small_table(arrivals.sparkSession, [(i, c.offset) for i, c in enumerate(cells)], f"{_BIN} int, __offset bigint")
    n = F.col("__n")
    ranked = (
        _in_cells(arrivals, arrival, [(c.low, c.high) for c in cells])
        .withColumn("__rank", _rank_in_bin(arrival))
        .join(F.broadcast(offsets), _BIN)
        .filter("__rank > 0")
        .withColumn("__n", F.col("__offset") + F.col("__rank"))
        .select(arrival, slice_of(n).alias("slice"), slice_of(n - 1).alias("before"))
    )
    return [tuple(r) for r in ranked.filter("slice <> before").collect()]


def _look_up(
    df: DataFrame, starts: list[tuple[int, int, int]], highest: int, number: str, arrival: str, slice_col: str
) -> DataFrame:
    """Add the slice by a binary search of the arrival among the starts: no shuffle. An arrival is in the slice before the
    next start, so starts before the first row of ``df`` may be missing; ``highest`` is the last slice."""
    first, last = starts[0][0], starts[-1][0]
    # distances from the first start: exact as doubles where they are compared
    near = F.least(F.greatest(F.col(arrival), F.lit(first - 1)), F.lit(last)) - F.lit(first)
    search = Bucketizer(
        splits=[-math.inf, *(float(at - first) for at, _, _ in starts), math.inf], inputCol=_POS, outputCol=_BIN
    )
    slices = [*(before for _, _, before in starts), highest]
    named = small_table(df.sparkSession, list(enumerate(slices)), f"{_BIN} int, {slice_col} {number}")
    placed = search.transform(df.withColumn(_POS, near.cast("double")))
    placed = placed.withColumn(_BIN, F.coalesce(F.col(_BIN).cast("int"), F.lit(-1))).drop(_POS)
    return placed.join(F.broadcast(named), _BIN).drop(_BIN)
