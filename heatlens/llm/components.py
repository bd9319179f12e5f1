"""Connected components of a table of links, by alternating stars.

At most ``LOCAL_LINKS`` links are joined by one task, in a few arrays of that length. With more, each round points every larger neighbour of a node at the smallest one it knows, then
every node and its smaller neighbours at the smallest of these. The links of a component
end as a star around its smallest node, after about log(size) rounds. Every round is a
written table; the driver sees two numbers of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from heatlens.llm.common import join_groups, staged

LOCAL_LINKS = 200_000


def _smallest(edges: DataFrame) -> DataFrame:
    """For each ``u``: the smallest of itself and its neighbours, and the number of these."""
    return staged(
        edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("degree")), "star"
    )


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    pointed = join_groups(both, _smallest(both), "u", "degree").filter("v > u")
    return pointed.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    pointed = join_groups(down, _smallest(down), "u", "degree")
    to_m = pointed.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = pointed.select("u", F.col("m").alias("v"))
    return to_m.unionByName(own).filter("u <> v").distinct()


def _mark(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1] or 0


def tops_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links from ``u`` to ``v``, ascending, and the place of the smallest node of each one's component,
    by hooking the larger of two linked tops under the smaller, and following these to their ends."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, top = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while (top[u] != top[v]).any():
        a, b = top[u], top[v]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := top[top], top):
            top = up
    return ids, top


def _joined_in_one_task(links: DataFrame) -> DataFrame:
    """``id, component`` of the nodes that are not the smallest of their component."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        ids, top = tops_of(table["u"].to_numpy(), table["v"].to_numpy())
        found = np.flatnonzero(top != np.arange(len(ids)))
        yield pa.record_batch({"id": pa.array(ids[found]), "component": pa.array(ids[top[found]])})

    return links.coalesce(1).mapInArrow(join, "id long, component long")


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (smallest id) of every node of ``links`` (``u, v`` long) that is not itself the
    smallest of its component. Repeated links and links to oneself don't matter."""
    links = staged(links.select("u", "v").filter("u <> v").distinct(), "links")
    mark = _mark(links)
    if mark[0] <= LOCAL_LINKS:
        return staged(_joined_in_one_task(links), "joined")
    while True:
        links = staged(_small_star(staged(_large_star(links), "large-star")), "small-star")
        before, mark = mark, _mark(links)
        if before == mark:
            return links.select(F.col("u").alias("id"), F.col("v").alias("component"))
