"""Near-duplicate vectors: an epsilon grid order join.

Vectors of cosine >= c, scaled to length 1, are at most eps = sqrt(2 - 2c) apart. They are
rotated to their principal axes (covariance over all rows) and sorted by the grid cells, eps
wide, of the leading axes. The sorted sequence is cut into blocks, each of them one row of a
written table. Two blocks are joined only if the boxes around them are at most eps apart; a task
reads two runs of blocks from that table (a cartesian product of its files), so no vector is
shuffled or written for a pair of blocks. Within a pair the two intervals are halved again and again,
and halves whose boxes are too far apart are skipped. What is left is compared by a bound of the cosine
from the leading axes and the length of the rest, and beyond that in double precision.

Equal vectors are one class that is compared once. A task returns about one row per vector (the
vectors linked to it, and one vector of its group in the task), never the links
themselves, so a dense group costs no more rows than a sparse one.

Vectors that are null, zero, or hold null or non-finite components link with nothing; so do
vectors of different lengths. A null ``vec_id`` can't be named: that row is reported by
itself with no links, a null component, and kept. Rows that repeat a ``vec_id`` are counted
as vectors of their own.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from heatlens.llm.common import chunks, join_groups, staged
from heatlens.llm.components import components, tops_of

BLOCK = 2048
# A block holds fewer vectors if their doubles are more than this, but at least a leaf.
BLOCK_BYTES = 1 << 20
LEAF = 256
# Axes that grid cells and boxes of blocks use.
AXES = 8
# A file of the sequence has a 256th of its rows, but at least so many, and at most so many bytes of singles.
ROWS_PER_PART = 8192
PART_BYTES = 1 << 25
# Vectors are first compared on so many leading axes that vectors of a normal distribution are near on them by this chance.
CHANCE = 1e-6
# Single-precision products within this margin of the bound are looked at in double precision.
MARGIN = 1e-4
# Bytes of leading axes that a task remembers, and rows of its result that it keeps before it adds them up.
HEADS_BYTES = 96 << 20
FOUND_ROWS = 1 << 17

SEQUENCE = (
    "block long, odd boolean, low array<double>, high array<double>, firsts binary, sizes binary, keys binary, raw binary"
)


def _doubles(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each width: the rows of a batch whose vectors can link, and their doubles."""
    column = batch["embedding"]
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)  # null becomes NaN
    starts = np.cumsum(lengths) - lengths
    for width in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == width)
        x = values[starts[at][:, None] + np.arange(width)] + 0.0
        good = np.isfinite(x).all(axis=1) & x.any(axis=1)
        yield at[good], x[good]


def _keys_of(x: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in x.astype("<f8")]


def _keys(vectors: DataFrame) -> DataFrame:
    """``id, key`` of every row: the class key of its vector, null where that links with nothing."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 4096):
            keys = np.full(batch.num_rows, None, object)
            for at, x in _doubles(batch):
                keys[at] = _keys_of(x)
            yield pa.record_batch({"id": batch["vec_id"], "key": pa.array(keys, pa.binary())})

    return vectors.mapInArrow(read, "id long, key binary")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that no square overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The principal axes of all unit vectors, largest variance first, as columns, the variances, and the vectors' number."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in chunks(batches, 4096):
            for _, x in _doubles(batch):
                x = np.column_stack([_unit(x), np.ones(len(x))])
                total += x.T @ x
        i, j = np.divmod(np.arange(total.size), width + 1)
        yield pa.record_batch({"i": pa.array(i), "j": pa.array(j), "s": pa.array(total.ravel())})

    sums = np.zeros((width + 1, width + 1))
    for row in vectors.select("embedding").mapInArrow(moments, "i long, j long, s double").groupBy("i", "j").sum("s").collect():
        sums[row[0], row[1]] = row[2]
    n = max(1.0, sums[-1, -1])
    covariance = sums[:-1, :-1] / n - np.outer(sums[-1, :-1], sums[-1, :-1]) / n**2
    variances, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    return axes[:, ::-1].copy(), np.maximum(variances[::-1], 0), int(sums[-1, -1])


def _on_axes(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors of ``x`` on ``axes``, to the last bit the same in any batch, as equal vectors have to meet."""
    x = np.ascontiguousarray((x / np.abs(x).max(axis=1, keepdims=True)).T)
    at, squares = np.zeros((x.shape[1], axes.shape[1])), np.zeros(x.shape[1])
    for component, axis in zip(x, axes):
        squares += component * component
        at += component[:, None] * axis
    return at / np.sqrt(squares)[:, None]


def _grid_order(at: np.ndarray, cell: float) -> list[bytes]:
    """Bytes that sort by grid cell, and within a cell along the first axis."""
    cells = (np.floor(at / cell).astype(np.int64) + (1 << 31)).astype(">u4")
    bits = (at[:, 0] + 0.0).view(np.uint64)
    first = np.where(bits >> 63, ~bits, bits | np.uint64(1 << 63)).astype(">u8")
    together = np.hstack([cells.view(np.uint8).reshape(len(at), -1), first.view(np.uint8).reshape(len(at), -1)])
    return [row.tobytes() for row in together]


def _components_of(raw: bytes, rows: int, width: int) -> np.ndarray:
    """The components of packed vectors, which are singles where these lose nothing."""
    return np.frombuffer(raw, "<f4" if len(raw) == rows * width * 4 else "<f8").reshape(rows, width).astype("<f8")


def _sequence(vectors: DataFrame, rows: int, axes: np.ndarray, eps: float, base: int) -> DataFrame:
    """Classes in epsilon grid order, a row per block: the box on the leading axes, and the members' smallest ids,
    numbers of rows, keys and components, packed. A class's number is that of its block and its place in there."""
    width = len(axes)
    leading, cell = axes[:, :AXES].copy(), max(eps, 1e-6)
    block = max(LEAF, min(BLOCK, BLOCK_BYTES // (8 * width)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 4096):
            ids = batch["vec_id"].to_numpy(zero_copy_only=False)
            for at, x in _doubles(batch):
                # equal vectors of a batch are put together here, so that a very common one is few rows
                if not len(at):
                    continue
                numbers: dict[bytes, int] = {}
                group = np.array([numbers.setdefault(k, len(numbers)) for k in _keys_of(x)], np.int64)
                one = np.unique(group, return_index=True)[1]
                first = np.full(len(one), np.iinfo(np.int64).max)
                np.minimum.at(first, group, ids[at])
                x = x[one].astype("<f8")
                with np.errstate(over="ignore"):
                    single = x.astype("<f4")
                exact = (single == x).all(axis=1)
                yield pa.record_batch(
                    {
                        "place": pa.array(_grid_order(_on_axes(x, leading), cell), pa.binary()),
                        "key": pa.array(list(numbers), pa.binary()),
                        "first": pa.array(first),
                        "size": pa.array(np.bincount(group, minlength=len(one)).astype(np.int64)),
                        "raw": pa.array([(single if e else x)[i].tobytes() for i, e in enumerate(exact)], pa.binary()),
                    }
                )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        start = base + (TaskContext.get().partitionId() << 30)
        cuts, keys, firsts, sizes, raws = 0, [], [], [], []

        def packed() -> pa.RecordBatch:
            same = len({len(r) for r in raws}) == 1
            raw = b"".join(raws if same else [_components_of(r, 1, width).tobytes() for r in raws])
            at = _on_axes(_components_of(raw, len(raws), width), leading)
            row = {
                "block": start + cuts * block, "odd": cuts % 2 == 1, "low": at.min(axis=0).tolist(), "high": at.max(axis=0).tolist(),
                "firsts": np.array(firsts, "<i8").tobytes(), "sizes": np.array(sizes, "<i8").tobytes(), "keys": b"".join(keys), "raw": raw,
            }
            return pa.RecordBatch.from_pylist([row])

        for batch in chunks(batches, 4096):
            for key, first, size, raw in zip(*(batch[n].to_pylist() for n in ("key", "first", "size", "raw"))):
                if keys and key == keys[-1]:
                    firsts[-1], sizes[-1] = min(firsts[-1], first), sizes[-1] + size
                    continue
                if len(keys) == block:
                    yield packed()
                    cuts += 1
                    for held in (keys, firsts, sizes, raws):
                        held.clear()
                keys.append(key)
                firsts.append(first)
                sizes.append(size)
                raws.append(raw)
        if keys:
            yield packed()

    most = max(block, PART_BYTES // (4 * width))
    parts = max(1, -(-rows // min(most, max(ROWS_PER_PART, rows // 256))))
    placed = vectors.mapInArrow(place, "place binary, key binary, first long, size long, raw binary")
    ordered = placed.repartitionByRange(parts, "place", "key").sortWithinPartitions("place", "key")
    return staged(ordered.mapInArrow(cut, SEQUENCE), "sequence")


def _classes(sequence: DataFrame) -> DataFrame:
    """``id, key, first, size`` of the classes: number, key, smallest id, number of rows."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                firsts = np.frombuffer(row["firsts"], "<i8")
                keys = [row["keys"][at : at + 16] for at in range(0, len(row["keys"]), 16)]
                yield pa.record_batch(
                    {
                        "id": pa.array(row["block"] + np.arange(len(firsts))),
                        "key": pa.array(keys, pa.binary()),
                        "first": pa.array(firsts),
                        "size": pa.array(np.frombuffer(row["sizes"], "<i8")),
                    }
                )

    return sequence.select("block", "firsts", "sizes", "keys").mapInArrow(unpack, "id long, key binary, first long, size long")


def _near_blocks(sequence: DataFrame, k: int, eps2: float) -> DataFrame:
    """Pairs of blocks, each once, whose boxes are at most eps apart. The product's tasks read the files of the sequence themselves;
    a pair has its lesser block left if both have even or both odd places, right if not, so all tasks get pairs."""

    def side(letter: str) -> DataFrame:
        return sequence.select(*[F.col(n).alias(f"{n}_{letter}") for n in ("block", "odd", "low", "high", "sizes", "raw")])

    def gap(d: int) -> Column:
        return F.greatest(F.lit(0.0), F.col("low_b")[d] - F.col("high_a")[d], F.col("low_a")[d] - F.col("high_b")[d])

    apart = F.lit(0.0)
    for d in range(k):
        apart = apart + gap(d) * gap(d)
    alike = F.col("odd_a") == F.col("odd_b")
    more = F.col("block_a") > F.col("block_b")
    once = (alike & ~more) | (~alike & more)
    product = side("a").hint("shuffle_replicate_nl").join(side("b"), once & (apart <= eps2))
    return product.select("block_a", "sizes_a", "raw_a", "block_b", "sizes_b", "raw_b")


class _Block:
    """The leading axes of a block's unit vectors with the length of the rest, and boxes around them:
    around all, around its halves, and so on down to leaves."""

    def __init__(self, x: np.ndarray, axes: np.ndarray):
        head = _unit(x) @ axes
        rest = np.sqrt(np.maximum(0, 1 - (head * head).sum(axis=1)))
        head = np.column_stack([head, rest])
        self.depth = max(0, math.ceil(math.log2(len(x) / LEAF)))
        self.cuts = np.arange((1 << self.depth) + 1) * len(x) >> self.depth
        boxes = np.minimum.reduceat(head, self.cuts[:-1]), np.maximum.reduceat(head, self.cuts[:-1])
        self.boxes = [boxes]
        while len(boxes[0]) > 1:
            boxes = np.minimum(boxes[0][::2], boxes[0][1::2]), np.maximum(boxes[1][::2], boxes[1][1::2])
            self.boxes.insert(0, boxes)
        self.single = head.astype(np.float32)

    def near_leaves(self, other: _Block, eps2: float) -> Iterator[tuple[slice, slice]]:
        """Pairs of leaves left when halves whose boxes are too far apart are skipped; each once within one block."""
        p = q = np.zeros(1, np.int64)
        for level in range(max(self.depth, other.depth) + 1):
            if level:
                for side in (0, 1):
                    if level <= (self.depth, other.depth)[side]:
                        twice = [np.repeat(p, 2), np.repeat(q, 2)]
                        twice[side] = np.stack([2 * (p, q)[side], 2 * (p, q)[side] + 1], axis=1).ravel()
                        p, q = twice
                if self is other:
                    p, q = p[p <= q], q[p <= q]
            (low_a, high_a), (low_b, high_b) = self.boxes[min(level, self.depth)], other.boxes[min(level, other.depth)]
            gap = np.maximum(np.maximum(low_b[q] - high_a[p], low_a[p] - high_b[q]), 0)
            near = np.einsum("ij,ij->i", gap, gap) <= eps2
            p, q = p[near], q[near]
        for a, b in zip(p, q):
            yield slice(self.cuts[a], self.cuts[a + 1]), slice(other.cuts[b], other.cuts[b + 1])


def _linked(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray, cosine: float) -> np.ndarray:
    """Which of the pairs of rows ``r`` of ``x`` and ``c`` of ``y`` are linked, in double precision."""
    rows, r = np.unique(r, return_inverse=True)
    columns, c = np.unique(c, return_inverse=True)
    x, y = _unit(x[rows]), _unit(y[columns])
    if len(r) * 16 < len(rows) * len(columns):
        linked, open_ = np.zeros(len(r), bool), np.arange(len(r))
    else:
        products = (x @ y.T)[r, c]
        linked, open_ = products >= cosine, np.flatnonzero(np.abs(products - cosine) < 1e-9)
    for lo in range(0, len(open_), 16384):
        at = open_[lo : lo + 16384]
        linked[at] = np.einsum("ij,ij->i", x[r[at]], y[c[at]]) >= cosine
    return linked


class _Found:
    """Rows ``id, links, low`` of a task, added up whenever they have become many."""

    def __init__(self) -> None:
        self.parts, self.rows, self.limit = [], 0, FOUND_ROWS

    def add(self, ids: np.ndarray, links: np.ndarray, low: np.ndarray) -> None:
        self.parts.append((ids, links, low))
        self.rows += len(ids)
        if self.rows > self.limit:
            self.add_up()

    def add_up(self) -> None:
        if self.parts:
            ids, links, low = map(np.concatenate, zip(*self.parts))
            nodes, top = tops_of(ids, low)
            at = np.searchsorted(nodes, ids)
            sums = np.zeros(len(nodes), np.int64)
            np.add.at(sums, at, links)
            self.parts, self.rows = [(nodes, sums, nodes[top])], len(nodes)
            self.limit = max(FOUND_ROWS, 2 * self.rows)


def _head(variances: np.ndarray, eps2: float) -> int:
    """How many axes to compare first; all if nearly all are needed. The chance is the volume of a ball times the density of
    differences at its centre."""
    width = len(variances)
    logs = np.cumsum(np.log(eps2 / np.maximum(4 * variances, 1e-30)) / 2)
    few = [h for h in range(1, width + 1) if logs[h - 1] - math.lgamma(h / 2 + 1) <= math.log(CHANCE)]
    return few[0] if few and few[0] <= 0.75 * width else width


def _comparison(axes: np.ndarray, variances: np.ndarray, cosine: float, eps2: float):
    """For pairs of blocks: ``id, links, low`` of the linked classes, ``low`` one class of each group of them."""
    width = len(axes)
    leading = axes[:, : _head(variances, eps2)].copy()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, _Block] = OrderedDict()
        known_bytes, found = 0, _Found()

        def components_at(batch: pa.RecordBatch, r: int, side: str) -> tuple[int, np.ndarray, np.ndarray]:
            sizes = np.frombuffer(batch[f"sizes_{side}"][r].as_buffer(), "<i8")
            raw = batch[f"raw_{side}"][r].as_buffer()
            single = raw.size == len(sizes) * width * 4
            return batch[f"block_{side}"][r].as_py(), sizes, np.frombuffer(raw, "<f4" if single else "<f8").reshape(-1, width)

        def block_of(number: int, x: np.ndarray) -> _Block:
            nonlocal known_bytes
            if number in known:
                known.move_to_end(number)
                return known[number]
            known[number] = made = _Block(x.astype("<f8"), leading)
            known_bytes += made.single.nbytes
            while known_bytes > HEADS_BYTES and len(known) > 2:
                known_bytes -= known.popitem(last=False)[1].single.nbytes
            return made

        for batch in batches:
            for r in range(batch.num_rows):
                (i, sizes_a, x), (j, sizes_b, y) = components_at(batch, r, "a"), components_at(batch, r, "b")
                a, b = block_of(i, x), block_of(j, y)
                for rows, columns in a.near_leaves(b, eps2):
                    products = a.single[rows] @ b.single[columns].T
                    at = np.flatnonzero((products >= cosine - MARGIN).ravel())
                    if not len(at):
                        continue
                    u, v = np.divmod(at, products.shape[1])
                    u, v = u + rows.start, v + columns.start
                    if i == j:
                        u, v = u[u < v], v[u < v]
                    yes = _linked(x[rows].astype("<f8"), y[columns].astype("<f8"), u - rows.start, v - columns.start, cosine)
                    u, v = u[yes], v[yes]
                    if len(u):
                        ids = np.concatenate([i + u, j + v])
                        nodes, top = tops_of(i + u, j + v)
                        links = np.bincount(np.searchsorted(nodes, ids), weights=np.concatenate([sizes_b[v], sizes_a[u]]))
                        found.add(nodes, links.astype(np.int64), nodes[top])
        found.add_up()
        for ids, links, low in found.parts:
            yield pa.record_batch({"id": pa.array(ids), "links": pa.array(links), "low": pa.array(low)})

    return compare


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (``vec_id, embedding``)."""
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    eps2 = eps * eps * (1 + 1e-9) + 1e-12
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    read = staged(_keys(vectors), "vector-keys")
    named = vectors.filter("vec_id is not null and size(embedding) > 0")
    spark = vectors.sparkSession
    found = classes = None
    for n, row in enumerate(named.select(F.size("embedding").alias("width")).distinct().sort("width").collect()):  # one in any sound table
        own = named.filter(F.size("embedding") == row.width)
        axes, variances, rows = principal_axes(own, row.width)
        if not rows:
            continue
        sequence = _sequence(own, rows, axes, eps, n << 50)
        pairs = _near_blocks(sequence, min(AXES, row.width), eps2)
        part = pairs.mapInArrow(_comparison(axes, variances, cosine, eps2), "id long, links long, low long")
        found = part if found is None else found.unionByName(part)
        classes = _classes(sequence) if classes is None else classes.unionByName(_classes(sequence))
    if found is None:
        found = spark.createDataFrame([], "id long, links long, low long")
        classes = spark.createDataFrame([], "id long, key binary, first long, size long")
    found = staged(found, "vector-links")
    known = components(found.select(F.col("id").alias("u"), F.col("low").alias("v")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    # a class of one row without links is its own component, and needs no row here
    placed = staged(
        classes.join(links, "id", "left")
        .filter("size > 1 or links is not null")
        .join(known, "id", "left")
        .select(
            "key", "size", "first",
            (F.coalesce("links", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("top"),
        ),
        "placed-classes",
    )
    tops = staged(placed.groupBy("top").agg(F.min("first").alias("component"), F.count("*").alias("classes")), "components")
    judged = staged(join_groups(placed, tops, "top", "classes").select("key", "size", "n_links", "component"), "judged")
    usable = read.filter("id is not null and key is not null")
    joined = join_groups(usable, judged, "key", "size", how="left").select(
        "id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "id").alias("component")
    )
    alone = read.filter("id is null or key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return joined.unionByName(alone).select(
        F.col("id").alias("vec_id"),
        "n_links",
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )
