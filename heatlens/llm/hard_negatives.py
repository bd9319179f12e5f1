"""Hard negatives: for an anchor and each of its nearest rows of its own label, the highest
scoring rows of other labels below them.

Components become integers (floor of ``SCALE`` times the component), and a score is the inner product of two rows' integers,
so it has to be exact. It is computed in residues: both matrices are reduced modulo several primes, each pair of residue
matrices is multiplied in single precision, where sums of ``CHUNK`` products of residues of at most ten bits are exact, and
the Chinese remainder theorem gives back the signed score. The number of primes follows from the largest component.

The anchors are a stated set of queries against all rows. Both are dealt over a grid: a cell gets about
``ROWS_PER_CELL`` rows and ``ANCHORS_PER_CELL`` anchors, whatever their labels, and returns only each anchor's best rows.
The grid is read twice, for the positives (products within a label only) and then for their
negatives; window functions select among the best of the cells.

Rows take no part with a null id or label, a null or empty vector, or a null or non-finite component; nor do rows whose scaled
components are so large that a score might leave 64 bits (:func:`largest_component`). Vectors of
different lengths have no score. Rows that repeat an id are rows of their own; an anchor is never its own positive.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from heatlens.llm.common import chunks, partitions_for, staged

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
# A negative scores from so much to so much of the positive's score, in hundredths.
LOW_PERCENT, HIGH_PERCENT = 50, 95
# 64 products of residues up to 510 stay below 2 ** 24, where single precision is exact.
CHUNK, LARGEST_PRIME = 64, 1021
ROWS_PER_CELL, ANCHORS_PER_CELL = 16_384, 2_048
# Rows scored at once in a cell.
ROWS_PER_PRODUCT = 2_048


def largest_component(width: int) -> int:
    """The largest scaled component for which no score of this many components leaves 62 bits."""
    return math.isqrt(2**62 // width)


def primes_for(bound: int) -> list[int]:
    """Primes from ``LARGEST_PRIME`` down whose product tells scores from ``-bound`` to ``bound`` apart."""
    found, product, p = [], 1, LARGEST_PRIME
    while product <= 2 * bound:
        if all(p % d for d in range(2, math.isqrt(p) + 1)):
            found.append(p)
            product *= p
        p -= 1
    return found


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """``x`` modulo ``p`` from ``-p // 2`` to ``p // 2``, in single precision."""
    r = np.mod(x, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def residue_products(a: np.ndarray, b: np.ndarray, primes: list[int]) -> np.ndarray:
    """The exact ``a @ b.T`` of integer matrices, if the primes are enough for it."""
    value, product = np.zeros((len(a), len(b)), np.int64), 1
    for p in primes:
        left, right = residues(a, p), residues(b, p)
        total = np.zeros(value.shape, np.int64)
        for start in range(0, a.shape[1], CHUNK):
            total += (left[:, start : start + CHUNK] @ right[:, start : start + CHUNK].T).astype(np.int64)
        # mixed radix: value is right modulo the primes so far, the next digit makes it right modulo p
        digit = np.mod((total - np.mod(value, p)) * pow(product, -1, p), p)
        digit[digit > p // 2] -= p
        value += digit * product
        product *= p
    return value


def _read(vectors: DataFrame, anchor: Column) -> DataFrame:
    """``row, id, label, anchor, width, peak, raw``: rows that take part, with their integers and the largest of these."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 4096):
            keep, widths, peaks, raws = [], [], [], []
            for i, values in enumerate(batch["embedding"].to_pylist()):
                if values and None not in values:
                    x = np.array(values, dtype=np.float64)
                    if np.isfinite(x).all():
                        with np.errstate(over="ignore"):
                            scaled = np.floor(SCALE * x)
                        peak = np.abs(scaled).max()
                        if peak <= largest_component(len(x)):
                            keep.append(i)
                            widths.append(len(x))
                            peaks.append(int(peak))
                            raws.append(scaled.astype(_kind(peak)).tobytes())
            kept = batch.select(["id", "label", "anchor"]).take(pa.array(keep, pa.int64()))
            yield pa.record_batch(
                [*kept.columns, pa.array(widths, pa.int64()), pa.array(peaks, pa.int64()), pa.array(raws, pa.binary())],
                names=["id", "label", "anchor", "width", "peak", "raw"],
            )

    rows = vectors.select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), "embedding",
    ).filter("id is not null and label is not null")
    read_rows = rows.mapInArrow(read, "id long, label string, anchor boolean, width long, peak long, raw binary")
    return staged(read_rows.withColumn("row", F.monotonically_increasing_id()), "negative-rows")


def _kind(peak: float) -> str:
    """The shortest integers that hold a row."""
    return "<i2" if peak < 2**15 else "<i4" if peak < 2**31 else "<i8"


def _integers(raws: Iterable[bytes], peaks: Iterable[int], width: int) -> np.ndarray:
    return np.array([np.frombuffer(r, _kind(p)) for r, p in zip(raws, peaks)], np.int64).reshape(-1, width)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by score descending, id ascending."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _table(found: list[np.ndarray], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(np.concatenate(found) if found else np.empty((0, len(columns)), np.int64), columns=columns)


def _near_in_cell(primes: list[int], k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Each anchor's best ``k`` other rows of its label."""

    def pick(cell: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (width, _), group in cell.groupby(["width", "label"], sort=False):
            asked, rows = group[group["asks"]], group[~group["asks"]]
            if not len(asked):
                continue
            a = _integers(asked["raw"], asked["peak"], width)
            own, own_ids = asked["row"].to_numpy(), asked["id"].to_numpy()
            for start in range(0, len(rows), ROWS_PER_PRODUCT):
                part = rows.iloc[start : start + ROWS_PER_PRODUCT]
                scores = residue_products(a, _integers(part["raw"], part["peak"], width), primes)
                numbers, ids = part["row"].to_numpy(), part["id"].to_numpy()
                for i, mine in enumerate(scores):
                    other = np.flatnonzero(numbers != own[i])
                    at = other[_first(mine[other], ids[other], k)]
                    same = np.ones(len(at), np.int64)
                    found.append(np.column_stack([same * own[i], same * own_ids[i], numbers[at], ids[at], mine[at]]))
        return _table(found, ["a_row", "anchor_id", "row", "positive_id", "score"])

    return pick


def _hard_in_cell(primes: list[int], k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For each positive of each anchor the best ``k`` rows of other labels in the wanted range."""

    def pick(cell: pd.DataFrame) -> pd.DataFrame:
        found = []
        for width, group in cell.groupby("width", sort=False):
            asked, rows = group[group["asks"]], group[~group["asks"]]
            a = _integers(asked["raw"], asked["peak"], width)
            own, labels, wanted = asked["row"].to_numpy(), asked["label"].to_numpy(), asked["wanted"].tolist()
            for start in range(0, len(rows) if len(asked) else 0, ROWS_PER_PRODUCT):
                part = rows.iloc[start : start + ROWS_PER_PRODUCT]
                scores = residue_products(a, _integers(part["raw"], part["peak"], width), primes)
                ids, part_labels = part["id"].to_numpy(), part["label"].to_numpy()
                for i, mine in enumerate(scores):
                    least, most = min(w["least"] for w in wanted[i]), max(w["most"] for w in wanted[i])
                    near = np.flatnonzero((mine >= least) & (mine <= most))
                    near = near[part_labels[near] != labels[i]]
                    for want in wanted[i]:
                        fit = near[(mine[near] >= want["least"]) & (mine[near] <= want["most"])]
                        at = fit[_first(mine[fit], ids[fit], k)]
                        same = np.ones(len(at), np.int64)
                        found.append(np.column_stack([same * own[i], same * want["place"], ids[at], mine[at]]))
        return _table(found, ["a_row", "place", "negative_id", "negative_score"])

    return pick


def _grid(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """Rows and anchors (``asks``) in every cell ``(i, j)`` they meet in."""
    across, down = max(1, -(-n_rows // ROWS_PER_CELL)), max(1, -(-n_anchors // ANCHORS_PER_CELL))
    place = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asking = anchors.select("*", F.lit(True).alias("asks"), place(down, 1).alias("i"), every(across).alias("j"))
    asked = rows.select("*", F.lit(False).alias("asks"), every(down).alias("i"), place(across, 2).alias("j"))
    parts = partitions_for(rows.sparkSession, across * down, 1)
    return asking.unionByName(asked, allowMissingColumns=True).repartition(parts, "i", "j")


def _hundredths(percent: int, rounded: Callable[[Column], Column]) -> Column:
    """``score * percent / 100``, rounded, without a product that could overflow."""
    rest = F.pmod(F.col("score"), F.lit(100).cast("long"))
    whole = F.call_function("div", F.col("score") - rest, F.lit(100).cast("long"))
    return whole * percent + rounded(rest * percent / F.lit(100.0)).cast("long")


def mine(
    vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low_percent: int = LOW_PERCENT, high_percent: int = HIGH_PERCENT,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors``: ``vec_id, label, embedding``; ``anchor`` is a condition on them. An anchor's positives are the first ``positives``
    other rows of its label, higher scores first, ties by smaller id. Returned for each are the first ``negatives`` rows of other
    labels with a score from ``low_percent`` to ``high_percent`` hundredths of the positive's. A pair without any has no row.
    """
    rows = _read(vectors, anchor)
    facts = rows.agg(
        F.max("peak").alias("peak"), F.max("width").alias("width"), F.count("*").alias("rows"), F.count_if("anchor").alias("anchors")
    ).first()
    bound = (facts["width"] or 1) * (facts["peak"] or 0) ** 2
    primes = primes_for(min(bound, 2**62))
    sizes = facts["rows"], facts["anchors"]
    columns = ("row", "id", "label", "width", "peak", "raw")
    anchors = rows.filter("anchor").select(*columns)
    rows = rows.select(*columns)

    near = _grid(rows, anchors, *sizes).groupBy("i", "j").applyInPandas(
        _near_in_cell(primes, positives), "a_row long, anchor_id long, row long, positive_id long, score long"
    )
    order = Window.partitionBy("a_row").orderBy(F.desc("score"), "positive_id", "row")
    kept = staged(near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives), "positives")

    wanted = kept.select(
        F.col("a_row").alias("row"), F.col("place").cast("long").alias("place"),
        _hundredths(low_percent, F.ceil).alias("least"), _hundredths(high_percent, F.floor).alias("most"),
    ).filter("least <= most")
    ranges = wanted.groupBy("row").agg(F.collect_list(F.struct("place", "least", "most")).alias("wanted"))
    far = _grid(rows, anchors.join(ranges, "row"), *sizes).groupBy("i", "j").applyInPandas(
        _hard_in_cell(primes, negatives), "a_row long, place long, negative_id long, negative_score long"
    )
    order = Window.partitionBy("a_row", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.join(kept, ["a_row", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score"
    )
