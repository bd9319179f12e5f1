"""Top-K and order statistics for budgets that grow with the data.

A small K is an ordinary ``orderBy().limit()`` or ``row_number() <= k``. A hot
budget is a fraction of all accesses, though, and K rows of a large table must
not meet in one task. Beyond ``SMALL_K`` the K-th row is located first, by
narrowing between pivots with counting jobs that shuffle a handful of rows, and
the selection becomes a plain filter. Both ways return exactly the same rows. A row
whose group, value or tie-breaker is null has no rank, and neither way returns it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from heatlens.staging import small_table, stage

SMALL_K = 10_000
# Above this (spark.sql.optimizer.windowGroupLimitThreshold) a ranking by group is
# no longer cut down before the shuffle.
SMALL_GROUP_K = 1_000
SETTLE_ROWS = 1_000_000
# Rows sampled for the pivots of a group, and quantiles taken of them.
_SAMPLE = 200_000
_GRID = 500
_DRAWN_PIVOTS = 15


def top_k(df: DataFrame, k: int, by: str = "est", tie: str = "key", small_k: int | None = None) -> DataFrame:
    """The first ``k`` rows by ``by`` descending, ``tie`` ascending (unique)."""
    if k <= 0:
        return df.limit(0)
    df = df.dropna(subset=[by, tie])
    order = [F.desc(by), F.asc(tie)]
    if k <= (SMALL_K if small_k is None else small_k):
        return df.orderBy(*order).limit(k)
    held = stage(df.withColumn("__all", F.lit(0)), "ranked")
    return _keep_cut(held, "__all", {0: k}, by, tie).drop("__all").orderBy(*order)


def top_k_by_group(
    df: DataFrame,
    group: str,
    k: int | Mapping[int, int],
    by: str = "est",
    tie: str = "key",
    small_k: int | None = None,
) -> DataFrame:
    """The first ``k`` rows of each group; ``k`` may differ by group."""
    largest = k if isinstance(k, int) else max(k.values(), default=0)
    if largest <= 0:
        return df.limit(0)
    df = df.dropna(subset=[group, by, tie])
    if largest <= (SMALL_GROUP_K if small_k is None else small_k):
        place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(by), F.asc(tie)))
        ranked = df.withColumn("__place", place).filter(F.col("__place") <= F.lit(largest))
        if not isinstance(k, int):
            limits = _group_table(df, group, [(g, n) for g, n in k.items()], "__limit bigint")
            ranked = ranked.join(F.broadcast(limits), group).filter("__place <= __limit").drop("__limit")
        return ranked.drop("__place").select(*df.columns)
    held = stage(df, "ranked")
    if isinstance(k, int):
        k = {r[0]: largest for r in held.select(group).distinct().collect()}
    return _keep_cut(held, group, k, by, tie).select(*df.columns)


def kth_value(df: DataFrame, k: int, by: str, small_k: int | None = None) -> float | None:
    """The ``k``-th largest ``by``; ``None`` when there are fewer rows."""
    return kth_and_next(df, k, by, small_k)[0]


def kth_and_next(
    df: DataFrame, k: int, by: str, small_k: int | None = None
) -> tuple[float | None, float | None]:
    """The ``k``-th and the ``k + 1``-th largest ``by``, where they exist."""
    if k <= 0:
        return None, None
    df = df.dropna(subset=[by])
    if k <= (SMALL_K if small_k is None else small_k):
        row = (
            df.select(by).orderBy(F.desc(by)).limit(k + 1)
            .agg(F.count("*").alias("rows"), F.slice(F.sort_array(F.collect_list(by)), 1, 2).alias("tail"))
            .first()
        )
        if row["rows"] == k + 1:
            return row["tail"][1], row["tail"][0]
        return (row["tail"][0] if row["rows"] == k else None), None
    grouped = df.select(F.lit(0).alias("__all"), by)
    found = nth_by_group(grouped, "__all", by, {0: k}, largest=True)
    if 0 not in found:
        return None, None
    kth = found[0][0]
    row = df.agg(
        F.count_if(F.col(by) >= F.lit(kth)).alias("upto"),
        F.max(F.when(F.col(by) < F.lit(kth), F.col(by))).alias("following"),
    ).first()
    return kth, kth if row["upto"] > k else row["following"]


def nth_by_group(
    df: DataFrame,
    group: str,
    col: str,
    want: Mapping[int, int],
    largest: bool,
    settle: int | None = None,
) -> dict[int, tuple[object, int]]:
    """Per group the ``want``-th largest (or smallest) ``col``.

    Returns ``{group: (value, rows strictly before it)}`` without the groups that
    have fewer than ``want`` rows. Each round throws away every row that lies
    outside the pivots around the wanted rank; a group with at most ``settle``
    rows left is finished with a window. The driver holds a few numbers per group.
    """
    settle = SETTLE_ROWS if settle is None else settle
    df = df.dropna(subset=[group, col])
    sizes = {r[group]: r["rows"] for r in df.groupBy(group).agg(F.count("*").alias("rows")).collect()}
    open_groups = {}
    for g, w in want.items():
        rows = sizes.get(g, 0)
        if 1 <= w <= rows:
            open_groups[g] = _Bracket(rows - w + 1 if largest else w, rows)
    found: dict[int, tuple[object, int]] = {}
    while open_groups:
        small = {g: b for g, b in open_groups.items() if b.rows <= settle}
        if small:
            _finish_small(df, group, col, small, found, largest)
            open_groups = {g: b for g, b in open_groups.items() if g not in small}
        if open_groups:
            _narrow(df, group, col, open_groups, found, largest)
            open_groups = {g: b for g, b in open_groups.items() if g not in found}
    return found


class _Bracket:
    """Where a group's wanted row may still be: strictly between two pivots.

    ``rank`` counts from the smallest of the ``rows`` left; ``below`` rows of the
    group's ``total`` lie under them.
    """

    def __init__(self, rank: int, rows: int) -> None:
        self.rank = rank
        self.rows = self.total = rows
        self.below = 0
        self.low: object = None
        self.high: object = None

    def before(self, below: int, upto: int, largest: bool) -> int:
        """Rows ranked strictly before a value, by its counts in the bracket."""
        return self.total - self.below - upto if largest else self.below + below


def _finish_small(df, group, col, brackets, found, largest) -> None:
    ranks = _group_table(df, group, [(g, b.rank) for g, b in brackets.items()], "__rank bigint")
    upto = F.sum("same").over(Window.partitionBy(group).orderBy(F.asc(col)))
    hits = (
        _within(df, group, col, brackets)
        .groupBy(group, col).agg(F.count("*").alias("same"))
        .withColumn("upto", upto)
        .join(F.broadcast(ranks), group)
        .filter("upto >= __rank and upto - same < __rank")
        .collect()
    )
    for r in hits:
        b = brackets[r[group]]
        found[r[group]] = (r[col], b.before(r["upto"] - r["same"], r["upto"], largest))


def _pivots(df: DataFrame, group: str, col: str, brackets: Mapping[int, _Bracket]) -> DataFrame:
    """``(group, pivots)``. Pivots only steer the search, so quantiles of about
    ``_SAMPLE`` rows per group or, for types that have none, values drawn by hash
    will do."""
    within = _within(df, group, col, brackets)
    if not isinstance(df.schema[col].dataType, T.NumericType):
        drawn = [F.min_by(col, F.xxhash64(col, F.lit(seed))) for seed in range(_DRAWN_PIVOTS)]
        return within.groupBy(group).agg(F.array(*drawn).alias("pivots"))
    shares = _group_table(
        df, group, [(g, min(1.0, _SAMPLE / b.rows)) for g, b in brackets.items()], "__share double"
    )
    sampled = within.join(F.broadcast(shares), group).filter(F.rand() < F.col("__share"))
    return sampled.groupBy(group).agg(quantiles(col, _GRID).alias("pivots"))


def quantiles(col: str, parts: int) -> Column:
    """The inner cut points of about ``parts`` equal parts. For samples only: a
    sketch this fine of every task's rows would be too much for one reducer."""
    grid = ",".join(f"{i / parts!r}D" for i in range(1, parts))
    return F.expr(f"percentile_approx(`{col}`, array({grid}), {10 * parts})")


def _narrow(df, group, col, brackets, found, largest) -> None:
    """One round: draw pivots, count around them, keep the part with the rank."""
    rows = []
    for r in _pivots(df, group, col, brackets).collect():
        b, pivots = brackets[r[group]], r["pivots"]
        if len(pivots) > _DRAWN_PIVOTS:  # quantiles: only those around the rank
            centre = min(b.rank * _GRID // b.rows, len(pivots) - 1)
            pivots = pivots[max(0, centre - 3) : centre + 3]
        rows.append((r[group], sorted(set(pivots))))
    item = df.schema[col].dataType.simpleString()
    table = _group_table(df, group, rows, f"__pivots array<{item}>")
    counts = []
    for i in range(max(len(p) for _, p in rows)):
        pivot = F.try_element_at("__pivots", F.lit(i + 1))
        counts += [
            F.count_if(F.col(col) < pivot).alias(f"below{i}"),
            F.count_if(F.col(col) <= pivot).alias(f"upto{i}"),
        ]
    within = _within(df, group, col, brackets).join(F.broadcast(table), group)
    tallies = {r[group]: r for r in within.groupBy(group).agg(*counts).collect()}
    for g, pivots in rows:
        b, tally = brackets[g], tallies[g]
        skipped, left = 0, b.rows
        for i, pivot in enumerate(pivots):
            below, upto = tally[f"below{i}"], tally[f"upto{i}"]
            if below < b.rank <= upto:
                found[g] = (pivot, b.before(below, upto, largest))
                break
            if b.rank > upto:
                b.low, skipped = pivot, upto
            else:
                b.high, left = pivot, below
                break
        b.rank -= skipped
        b.below += skipped
        b.rows = left - skipped


def _group_table(df: DataFrame, group: str, rows: list[tuple], column: str) -> DataFrame:
    kind = df.schema[group].dataType.simpleString()
    return small_table(df.sparkSession, rows, f"{group} {kind}, {column}")


def _within(df: DataFrame, group: str, col: str, brackets: Mapping[int, _Bracket]) -> DataFrame:
    """Rows still strictly between their group's pivots."""
    item = df.schema[col].dataType.simpleString()
    rows = [(g, b.low, b.high) for g, b in brackets.items()]
    table = _group_table(df, group, rows, f"__low {item}, __high {item}")
    keep = (F.col("__low").isNull() | (F.col(col) > F.col("__low"))) & (
        F.col("__high").isNull() | (F.col(col) < F.col("__high"))
    )
    return df.select(group, col).join(F.broadcast(table), group).filter(keep).drop("__low", "__high")


def kth_row(
    df: DataFrame, k: int, by: str = "est", tie: str = "key", small_k: int | None = None
) -> tuple[object, object] | None:
    """``(by, tie)`` of the ``k``-th row; ``None`` when there are fewer rows."""
    pairs = df.select(by, tie).dropna()
    if k <= (SMALL_K if small_k is None else small_k):
        ranked = pairs.orderBy(F.desc(by), F.asc(tie)).limit(k)
        row = (
            ranked.withColumn("__place", F.row_number().over(Window.orderBy(F.desc(by), F.asc(tie))))
            .filter(F.col("__place") == F.lit(k)).first()
        )
        return (row[by], row[tie]) if row else None
    value, last = _cuts(stage(pairs.withColumn("__all", F.lit(0)), "ranked"), "__all", {0: k}, by, tie)[0]
    return None if value is None else (value, last)


def _cuts(
    df: DataFrame, group: str, want: Mapping[int, int], by: str, tie: str
) -> dict[int, tuple[object, object]]:
    """``(by, tie)`` of each group's last wanted row; nulls when all are wanted."""
    by_type = df.schema[by].dataType.simpleString()
    values = nth_by_group(df, group, by, want, largest=True)
    shared = _group_table(df, group, [(g, v) for g, (v, _) in values.items()], f"__value {by_type}")
    tied = df.join(F.broadcast(shared), group).filter(F.col(by) == F.col("__value")).select(group, tie)
    room = {g: want[g] - before for g, (_, before) in values.items()}
    last = nth_by_group(tied, group, tie, room, largest=False)
    return {
        g: (values[g][0], last[g][0]) if g in values else (None, None) for g, w in want.items() if w > 0
    }


def _keep_cut(df: DataFrame, group: str, want: Mapping[int, int], by: str, tie: str) -> DataFrame:
    """Filter each group down to its first ``want`` rows by (by desc, tie)."""
    limits = _group_table(
        df,
        group,
        [(g, *cut) for g, cut in _cuts(df, group, want, by, tie).items()],
        f"__value {df.schema[by].dataType.simpleString()}, __last {df.schema[tie].dataType.simpleString()}",
    )
    inside = at_or_before(F.col("__value"), F.col("__last"), by, tie)
    keep = F.col("__value").isNull() | inside
    return df.join(F.broadcast(limits), group).filter(keep).drop("__value", "__last")


def at_or_before(value: Column, last: Column, by: str = "est", tie: str = "key") -> Column:
    """Whether a row ranks no later than the row ``(value, last)``; false without a rank."""
    inside = (F.col(by) > value) | ((F.col(by) == value) & (F.col(tie) <= last))
    return F.col(by).isNotNull() & F.col(tie).isNotNull() & inside
