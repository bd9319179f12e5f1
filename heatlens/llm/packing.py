"""Packing documents into sequences by cutting-stock column generation.

A document's ids are cut into full sequences and a rest; the rest is cut once more into
a head, a multiple of ``GRAIN`` ids, and a tail shorter than ``GRAIN``. So there are fewer
than capacity / GRAIN + GRAIN piece sizes, and the histogram over them is exact and as
small for any corpus. A linear program chooses how often to use which pattern (a
multiset of sizes that fits a sequence); a knapsack over the dual values finds the next pattern
worth adding. Pattern counts are rounded down, the few pieces left over are placed largest
first, and pieces, ranked within their size, take the slots in order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from heatlens.llm.common import BROADCAST_ROWS, chunks, staged, text_of
from heatlens.llm.tokens import byte_bpe

GRAIN = 64
# Column generation may stop after so many patterns; any stop leaves a valid plan.
MAX_COLUMNS = 3000

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, part long, local_rank long"


def cut(n: int, capacity: int, grain: int = GRAIN) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids, in order."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [x for x in (rest - rest % grain, rest % grain) if x]


def _best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes (ascending) that fits, by dynamic programming."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    usable = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c], last[c] = best[c - 1], -1
        if k := usable[c]:
            gains = best[c - sizes[:k]] + values[:k]
            i = int(gains.argmax())
            if gains[i] > best[c] + 1e-12:
                best[c], last[c] = gains[i], i
    pattern, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[capacity]), pattern


def solve(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ``{size: slots}`` and how many sequences use each; together they have
    exactly as many slots of each size as the histogram has pieces."""
    sizes = np.array(sorted(s for s, n in histogram.items() if n and s < capacity), dtype=np.int64)
    chosen = [({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    if not len(sizes):
        return chosen
    need = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    basis = np.diag((capacity // sizes).astype(float))
    use = need / basis.diagonal()
    for _ in range(MAX_COLUMNS):
        duals = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, pattern = _best_pattern(sizes, np.maximum(duals, 0), capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, pattern.astype(float))
        ratios = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        basis[:, out] = pattern
        use = np.maximum(np.linalg.solve(basis, need.astype(float)), 0)
    left = need.copy()
    for i in np.argsort(-use, kind="stable"):
        pattern = np.rint(basis[:, i]).astype(np.int64)
        has = pattern > 0
        times = int(min(np.floor(use[i] + 1e-6), (left[has] // pattern[has]).min()))
        if times > 0:
            chosen.append(({int(s): int(n) for s, n in zip(sizes[has], pattern[has])}, times))
            left -= pattern * times
    while left.any():  # a bounded number of pieces: less than one pattern for each size
        room, pattern = capacity, np.zeros(len(sizes), dtype=np.int64)
        for i in range(len(sizes) - 1, -1, -1):
            pattern[i] = min(left[i], room // sizes[i])
            room -= pattern[i] * sizes[i]
        has = pattern > 0
        times = int((left[has] // pattern[has]).min())
        chosen.append(({int(s): int(n) for s, n in zip(sizes[has], pattern[has])}, times))
        left -= pattern * times
    return chosen


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each size: first rank, slots in a sequence, first sequence and offset of each pattern."""
    table: dict[int, list[tuple[int, ...]]] = {}
    taken: Counter[int] = Counter()
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for size in sorted(pattern, reverse=True):
            table.setdefault(size, []).append((taken[size], pattern[size], sequence, offset))
            taken[size] += pattern[size] * times
            offset += pattern[size] * size
        sequence += times
    return {s: tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) for s, rows in table.items()}


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """One row per piece: ``doc_id, start`` (ids of its document before it), ``length, ids``
    (uint32, little endian), ``doc_tokens``, ``sequence_id, offset`` (its place there).

    Every document has at least the end id. Rows that repeat a ``doc_id`` and those
    without one are documents of their own. Encoding runs once, into a written table; the
    histogram and ranks come from that table, so a lost task can't change them.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks = TaskContext.get().partitionId(), Counter()
        for batch in chunks(batches, 128):
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = np.append(byte_bpe(vocabulary).ids(text or ""), end_id).astype("<u4")
                start = 0
                for length in cut(len(ids), capacity):
                    rows.append((doc, start, length, ids[start : start + length].tobytes(), len(ids), part, ranks[length]))
                    ranks[length] += 1
                    start += length
            columns = list(zip(*rows))
            yield pa.record_batch(
                [pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns)], names=names
            )

    names = ["doc_id", "start", "length", "ids", "doc_tokens", "part", "local_rank"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    pieces = staged(rows.mapInArrow(encode, PIECES), "pieces")

    # One row for each task and size.
    counts = staged(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(solve(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first_rank"))
    if counts.count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sizes, ranks = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        for size in np.unique(sizes):
            at = sizes == size
            lows, each, base, begin = table[int(size)]
            k = np.searchsorted(lows, ranks[at], side="right") - 1
            nth = ranks[at] - lows[k]
            sequence[at] = base[k] + nth // each[k]
            offset[at] = begin[k] + nth % each[k] * size
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return (
        pieces.join(firsts, ["part", "length"])
        .withColumn("place", place("length", F.col("first_rank") + F.col("local_rank")))
        .select("doc_id", "start", "length", "ids", "doc_tokens", "place.sequence_id", "place.offset")
    )
