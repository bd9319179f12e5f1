"""Neighbour reuse: a repeat access next to the previous one copies its estimate.

Counted repeat accesses, in arrival order, are events. An event within ``reach``
of the event before it takes that event's estimate; any other smooths its own
key's previous estimate. Events that copy from one another form a chain with a
single value, the value of its head, so only heads are solved:

    value(chain) = alpha + (1 - alpha) ** gap * value(parent chain)

where the parent chain holds the previous event of the head's key. These links form a forest, which is
contracted: a chain that a coin picks out, and whose parent's coin does not, is spliced out, and those
below it point past it. Each round of ``CONTRACTIONS`` writes a table of less than half as many open links. What is
left when they fit one task is solved there, and the chains spliced out then get their values, last ones first. All
tables together hold less than three rows for each chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from heatlens.functions.decay import decay
from heatlens.functions.slices import int_div
from heatlens.operators.forward import slice_dedup
from heatlens.params import DEFAULT_ALPHA
from heatlens.staging import stage

# Fixed value: addresses at most this far apart are neighbours.
REACH = 16
ROWS_PER_BIN = 100_000
MAX_BINS = 65_536
# So many open links are solved by one task, in a few arrays of this length.
LOCAL_LINKS = 200_000
CONTRACTIONS = 3


def repeat_events(counted: DataFrame, order: str = "n") -> DataFrame:
    """Every counted access with ``at``, its place among its key's, ``gap``, the slices since the key was last
    counted, and ``prev_n``, the order of the key's previous event. Events are those with ``at > 1``.

    ``counted`` has one row per key and slice with its first ``order``.
    """
    of_key = Window.partitionBy("key").orderBy("slice")
    return (
        counted.withColumn("gap", F.col("slice") - F.lag("slice").over(of_key))
        .withColumn("at", F.row_number().over(of_key))
        .withColumn("prev_n", F.when(F.col("at") > 2, F.lag(order).over(of_key)))
    )


def chain_events(placed: DataFrame, bin_of: Column, reach: int = REACH, order: str = "n") -> DataFrame:
    """Add ``chain``, the ``order`` of the event that heads the event's chain; null for accesses that are no events.

    The comparison runs along the whole trace, so it is cut into bins that follow one another along ``order``.
    Inside a bin it is a window; across bins it needs each bin's last
    key and last head, a row per bin.
    """
    event = F.col("at") > 1
    own, at = F.when(event, F.col("key")), F.when(event, F.col(order))
    inside = Window.partitionBy("__bin").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(own, ignorenulls=True).over(earlier)
    far = F.abs(F.col("key") - F.col("__before")) > F.lit(reach)
    local = placed.withColumn("__bin", bin_of).withColumn("__before", before).withColumn("__head", F.when(event & far, F.col(order)))
    # bin edges: the first event of a bin is judged against the bin before it
    edges = local.groupBy("__bin").agg(
        F.min_by(own, at).alias("first_key"),
        F.min(at).alias("first_n"),
        F.max_by(own, at).alias("last_key"),
        F.max("__head").alias("last_head"),
    ).filter("first_n is not null")
    along = Window.orderBy("__bin")
    ended = F.lag("last_key").over(along)
    opens = ended.isNull() | (F.abs(F.col("first_key") - ended) > F.lit(reach))
    edges = (
        edges.withColumn("__opens", F.when(opens, F.col("first_n")))
        .withColumn("__seen", F.coalesce("last_head", "__opens"))
        .withColumn(
            "__carried",
            F.coalesce(
                "__opens",
                F.last("__seen", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)),
            ),
        )
        .select("__bin", "__carried")
    )
    return (
        local.withColumn("__head", F.last("__head", ignorenulls=True).over(upto))
        .join(F.broadcast(edges), "__bin", "left")
        .withColumn("chain", F.when(event, F.coalesce("__head", "__carried")))
        .select(*placed.columns, "chain")
    )


def chain_links(events: DataFrame, alpha: float = DEFAULT_ALPHA, order: str = "n") -> DataFrame:
    """``(chain, parent, a, b)`` with ``value = a * value(parent) + b``; a chain without a parent has the value ``b``."""
    heads = events.filter(F.col("chain") == F.col(order)).select("chain", "gap", "prev_n")
    owners = events.select(F.col(order).alias("prev_n"), F.col("chain").alias("parent"))
    a = F.when(F.col("parent").isNull(), F.lit(0.0)).otherwise(decay(alpha, F.col("gap")))
    return heads.join(owners, "prev_n", "left").select("chain", "parent", a.alias("a"), F.lit(alpha).alias("b"))


def solve_chains(links: DataFrame, most: int, local_links: int | None = None) -> DataFrame:
    """``(chain, value)`` of at most ``most`` links."""
    local_links = LOCAL_LINKS if local_links is None else local_links
    if most <= local_links:
        return _solved_in_one_task(links)
    links = stage(links, "chains")
    values = links.filter("parent is null").select("chain", F.col("b").alias("value"))
    open_links, spliced, coin = links.filter("parent is not null"), [], 0
    while open_links.count() > local_links:
        for _ in range(CONTRACTIONS):
            gone, open_links = _contracted(open_links, coin)
            spliced.append(gone)
            coin += 1
        open_links = stage(open_links, "chains")
    known = values.select(F.col("chain").alias("parent"), "value")
    rest = open_links.join(known, "parent", "left").select(
        "chain",
        F.when(F.col("value").isNull(), F.col("parent")).alias("parent"),
        "a",
        (F.coalesce(F.col("a") * F.col("value"), F.lit(0.0)) + F.col("b")).alias("b"),
    )
    values = values.unionByName(stage(_solved_in_one_task(rest), "values"))
    for gone in reversed(spliced):
        known = values.select(F.col("chain").alias("parent"), "value")
        found = gone.join(known, "parent").select("chain", (F.col("a") * F.col("value") + F.col("b")).alias("value"))
        values = values.unionByName(stage(found, "values"))
    return values


def _contracted(links: DataFrame, coin: int) -> tuple[DataFrame, DataFrame]:
    """The links spliced out, no two of which are parent and child, and the others, pointing past them.

    Many chains may share one parent; the parent side has one row per chain, so
    AQE can split the crowded side of this join.
    """
    heads = lambda c: F.pmod(F.xxhash64(c, F.lit(coin)), F.lit(2)) == 1
    out = heads("chain") & ~heads("parent")
    gone = links.filter(out)
    above = gone.select(
        F.col("chain").alias("parent"),
        F.col("parent").alias("grand"),
        F.col("a").alias("up_a"),
        F.col("b").alias("up_b"),
    )
    kept = links.filter(~out).join(above, "parent", "left").select(
        "chain",
        F.coalesce("grand", "parent").alias("parent"),
        (F.col("a") * F.coalesce("up_a", F.lit(1.0))).alias("a"),
        (F.col("a") * F.coalesce("up_b", F.lit(0.0)) + F.col("b")).alias("b"),
    )
    return gone, kept


def _solved_in_one_task(links: DataFrame) -> DataFrame:
    """``(chain, value)`` by pointer doubling in arrays. Every parent is among the links."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by("chain")
        chain, parent, a, b = (table[c].combine_chunks() for c in ("chain", "parent", "a", "b"))
        a, b = a.to_numpy(zero_copy_only=False).copy(), b.to_numpy(zero_copy_only=False).copy()
        ids = chain.to_numpy()
        up = np.where(parent.is_valid(), np.searchsorted(ids, parent.fill_null(0).to_numpy()), -1)
        while (at := np.flatnonzero(up >= 0)).size:
            over = up[at]
            b[at] += a[at] * b[over]
            a[at], up[at] = a[at] * a[over], up[over]
        yield pa.record_batch({"chain": chain, "value": pa.array(b)})

    return links.coalesce(1).mapInArrow(solve, "chain long, value double")


def heat_of_counted(
    counted: DataFrame, bin_of: Column, alpha: float = DEFAULT_ALPHA, reach: int = REACH, order: str = "n"
) -> DataFrame:
    """``(key, est)`` from one row per key and slice with its first ``order``. Bins by ``bin_of`` follow
    one another along ``order``."""
    events = chain_events(repeat_events(counted, order), bin_of, reach, order)
    events = stage(events.select("key", F.col(order).cast("long").alias("n"), "gap", "prev_n", "chain"), "events")
    links = chain_links(events.filter("chain is not null"), alpha)
    latest = events.groupBy("key").agg(F.max_by("chain", "n").alias("chain"))
    valued = latest.join(solve_chains(links, events.count()), "chain", "left")
    return valued.select("key", F.coalesce("value", F.lit(0.0)).alias("est"))


def heat_neighbor_reuse(
    df: DataFrame, rows: int, alpha: float = DEFAULT_ALPHA, reach: int = REACH, rows_per_bin: int = ROWS_PER_BIN
) -> DataFrame:
    """``(key, est)`` for accesses with ``key``, ``slice`` and ordinal ``n``."""
    counted = slice_dedup(df, order="n").select("key", "slice", "n")
    width = max(rows_per_bin, -(-rows // MAX_BINS))
    return heat_of_counted(counted, int_div("n", width), alpha, reach)
