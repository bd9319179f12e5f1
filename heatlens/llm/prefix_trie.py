"""Which conversations share their first turns: a prefix trie of the conversations.

1. Turns are dictionary-encoded: each distinct (role, text) has a number, and from then on no text moves.
2. Conversations are rebuilt (see :func:`rebuild`). Equal ones become one sequence with the
   number of its conversations and the hash of their ids.
3. The sequences are range-partitioned in the order of their turn numbers. Each shard inserts its own into a ternary
   search tree, the median first and then the medians of both halves, which balances the
   search among siblings. An iterative traversal sums up members, leaves and savings.
4. A node is complete in its shard unless it lies on the path of the shard's first or last
   sequence. Those boundary nodes are merged over shards, and their subtrees summed by
   doubling the distance to an ancestor: about log2(depth) small written tables.

A node's row: ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``,
``n_children``, ``n_leaves`` and ``saved_tokens`` of its subtree (each node's (n_convs - 1) times the code points of its last
text), ``ends_sha256`` of the ids that end there.

A null role or text counts as empty; rows without a ``conv_id`` belong to no conversation and are left out. Turns of
one number are ordered by their SHA-256. An empty table has no nodes. Other columns don't matter. The numbers of one
conversation's turns (8 bytes a turn) are one row, as a document's text is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from heatlens.llm.common import BROADCAST_ROWS, join_groups, partitions_for, staged

# Fixed values of the rebuilt table: conversations share the first turns of every hundredth.
FAMILY, LONGEST_HEAD = 100, 6
SEQUENCES_PER_SHARD = 20_000
# Ids of so many equal conversations are joined in one row; of more, in pieces.
SMALL_GROUP = 1_000
IDS_PER_PIECE = 50_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
ROOT = b"\x00" * 16
_NODE = (
    "boundary boolean, node binary, up binary, depth long, low long, parent_low long, n_convs long, "
    "n_children long, n_leaves long, saved long, chars long, ends string"
)


def encode_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, ids, chars``: the turns of each conversation in order, as numbers of distinct
    (role, text) and their lengths in code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = staged(
        conversations.filter("conv_id is not null").select(
            F.col("conv_id").cast("long").alias("conv_id"),
            "turn",
            F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("print"),
            F.length(text).alias("chars"),
        ),
        "turns",
    )
    distinct = turns.groupBy("print").agg(F.count("*").alias("uses"))
    dictionary = staged(distinct.withColumn("id", F.monotonically_increasing_id()), "turn-dictionary")
    encoded = join_groups(turns, dictionary, "print", "uses")
    in_order = F.array_sort(F.collect_list(F.struct("turn", "print", "id", "chars")))
    return encoded.groupBy("conv_id").agg(in_order.alias("turns")).select(
        "conv_id",
        F.transform("turns", lambda t: t["id"]).alias("ids"),
        F.transform("turns", lambda t: t["chars"]).alias("chars"),
    )


def rebuild(encoded: DataFrame) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % 100 (none if there is
    none, all if it has fewer), where h = crc32(c) % 6; its own turns after the first h follow."""
    own = staged(encoded, "encoded")
    heads = own.filter(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("family"), *[F.slice(c, 1, LONGEST_HEAD).alias(f"head_{c}") for c in ("ids", "chars")]
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % LONGEST_HEAD).cast("int")
    joined = own.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", h).join(heads, "family", "left")

    def whole(name: str, kind: str):
        none = F.array().cast(f"array<{kind}>")
        head = F.slice(F.coalesce(f"head_{name}", none), F.lit(1), F.col("h"))
        rest = F.slice(name, F.col("h") + 1, F.greatest(F.size(name), F.lit(1)))
        return F.concat(head, rest).alias(name)

    return joined.select("conv_id", whole("ids", "bigint"), whole("chars", "int"))


def _piece_hashes(members: DataFrame) -> DataFrame:
    """``path_key, ends`` of large groups. Ids are sorted over many tasks and joined to pieces there; a group's
    pieces then pass through the hash in order, one at a time."""

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, IDS_PER_PIECE):
                piece = batch.slice(start, IDS_PER_PIECE)
                keys, ids = np.array(piece["path_key"].to_pylist(), object), piece["conv_id"].to_pylist()
                cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(ids)]
                runs = list(zip(cuts, cuts[1:]))
                yield pa.record_batch(
                    {
                        "path_key": pa.array([keys[a] for a, _ in runs], pa.string()),
                        "first": pa.array([ids[a] for a, _ in runs], pa.int64()),
                        "piece": pa.array([",".join(map(str, ids[a:b])) for a, b in runs], pa.string()),
                    }
                )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for batch in batches:
            for row_key, piece in zip(batch["path_key"].to_pylist(), batch["piece"].to_pylist()):
                if row_key != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = row_key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece.encode())
        if key is not None:
            done.append((key, state.hexdigest()))
        yield pa.record_batch({"path_key": pa.array([k for k, _ in done], pa.string()), "ends": pa.array([e for _, e in done], pa.string())})

    ordered = members.repartitionByRange("path_key", "conv_id").sortWithinPartitions("path_key", "conv_id")
    pieces = ordered.mapInArrow(join_ids, "path_key string, first long, piece string")
    return pieces.repartition("path_key").sortWithinPartitions("path_key", "first").mapInArrow(digest, "path_key string, ends string")


def sequences(rebuilt: DataFrame) -> DataFrame:
    """``ids, chars, members, low, ends`` of the distinct turn sequences."""
    keyed = staged(rebuilt.withColumn("path_key", F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), 256)), "rebuilt")
    groups = staged(
        keyed.groupBy("path_key", "ids", "chars").agg(F.count("*").alias("members"), F.min("conv_id").alias("low")), "sequences"
    )
    columns = ("ids", "chars", "members", "low", "ends")
    alone = groups.filter("members = 1").withColumn("ends", F.sha2(F.col("low").cast("string").cast("binary"), 256))
    found = alone.select(*columns)
    shared = groups.filter("members > 1").select("path_key", "members")
    for picked, hashed in (
        (f"members <= {SMALL_GROUP}", _short_hashes),
        (f"members > {SMALL_GROUP}", _piece_hashes),
    ):
        some = shared.filter(picked)
        if not some.isEmpty():
            ends = hashed(join_groups(keyed.select("path_key", "conv_id"), some, "path_key", "members"))
            found = found.unionByName(groups.join(ends, "path_key").select(*columns))
    return found


def _short_hashes(members: DataFrame) -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string"))
    return members.groupBy("path_key").agg(F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("ends"))


class TernaryTree:
    """A ternary search tree of sequences of turn numbers. Entry 0 is the root of the trie; every other entry
    holds one turn, its smaller and larger siblings, and the first entry below it."""

    def __init__(self) -> None:
        self.turn, self.less, self.more, self.below, self.up = [-1], [0], [0], [0], [-1]
        self.length, self.depth = [0], [0]

    def _entry(self, turn: int, length: int, up: int) -> int:
        for column, value in (
            (self.turn, turn), (self.less, 0), (self.more, 0), (self.below, 0), (self.up, up),
            (self.length, length), (self.depth, self.depth[up] + 1),
        ):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, turns: list[int], lengths: list[int]) -> int:
        """The entry at the end of the sequence."""
        node = 0
        for turn, length in zip(turns, lengths):
            at = self.below[node]
            if not at:
                at = self.below[node] = self._entry(turn, length, node)
            while self.turn[at] != turn:
                side = self.less if turn < self.turn[at] else self.more
                if not side[at]:
                    side[at] = self._entry(turn, length, node)
                at = side[at]
            node = at
        return node

    @classmethod
    def of_sorted(cls, paths: list[list[int]], lengths: list[list[int]]) -> tuple[TernaryTree, list[int]]:
        """The tree of distinct sorted sequences, and the entry at the end of each."""
        tree, ends, open_parts = cls(), [0] * len(paths), [(0, len(paths))]
        while open_parts:
            low, high = open_parts.pop()
            if low < high:
                middle = (low + high) // 2
                ends[middle] = tree.insert(paths[middle], lengths[middle])
                open_parts += [(middle + 1, high), (low, middle)]
        return tree, ends

    def children_first(self) -> list[int]:
        """All entries, each after those below it: the reverse of an iterative walk from the root."""
        order, open_entries = [], [0]
        while open_entries:
            at = open_entries.pop()
            order.append(at)
            # the siblings of an entry belong to the walk of its parent
            siblings = [self.below[at]] if self.below[at] else []
            while siblings:
                child = siblings.pop()
                open_entries.append(child)
                siblings += [s for s in (self.less[child], self.more[child]) if s]
        order.reverse()
        return order


def _step(key: bytes, turn: int) -> bytes:
    return hashlib.blake2b(key + int(turn).to_bytes(8, "little"), digest_size=16).digest()


def shard_nodes(paths: list[list[int]], lengths: list[list[int]], members: list[int], lows: list[int], hashes: list[str]) -> list[tuple]:
    """Rows ``_NODE`` of a shard's sorted sequences. Counts of a boundary node leave out its boundary children."""
    tree, ends = TernaryTree.of_sorted(paths, lengths)
    n = len(tree.turn)
    convs, low, sha = [0] * n, [None] * n, [None] * n
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    for end, count, first, digest in zip(ends, members, lows, hashes):
        convs[end], low[end], sha[end] = count, first, digest
    edge: dict[int, bytes] = {0: ROOT}
    for end in {ends[0], ends[-1]}:
        path = []
        while end not in edge:
            path.append(end)
            end = tree.up[end]
        for at in reversed(path):
            edge[at] = _step(edge[tree.up[at]], tree.turn[at])
    order = tree.children_first()
    for at in order:
        up = tree.up[at]
        if at not in edge:
            leaves[at] = leaves[at] or 1
            saved[at] += (convs[at] - 1) * tree.length[at]
            children[up] += 1
            leaves[up] += leaves[at]
            saved[up] += saved[at]
        if up >= 0:
            convs[up] += convs[at]
            low[up] = low[at] if low[up] is None else min(low[up], low[at])
    rows = []
    for at in order:
        up = tree.up[at]
        inner = up >= 0 and up not in edge
        rows.append(
            (
                at in edge, edge.get(at), None if up < 0 or inner else edge[up], tree.depth[at], low[at], low[up] if inner else None,
                convs[at], children[at], leaves[at], saved[at], tree.length[at], sha[at],
            )
        )
    return rows


def _shards(found: DataFrame) -> DataFrame:
    schema = pa.schema(
        [("boundary", pa.bool_()), ("node", pa.binary()), ("up", pa.binary())]
        + [(c, pa.int64()) for c in ("depth", "low", "parent_low", "n_convs", "n_children", "n_leaves", "saved", "chars")]
        + [("ends", pa.string())]
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: dict[str, list] = {c: [] for c in ("ids", "chars", "members", "low", "ends")}
        for batch in batches:
            for name, values in columns.items():
                values += batch[name].to_pylist()
        if columns["ids"]:
            rows = shard_nodes(*columns.values())
            for start in range(0, len(rows), 8192):
                parts = zip(*rows[start : start + 8192])
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(parts, schema)], schema=schema)

    held = staged(found, "trie-sequences")
    shards = partitions_for(held.sparkSession, held.count(), SEQUENCES_PER_SHARD)
    ordered = held.repartitionByRange(shards, "ids").sortWithinPartitions("ids")
    return staged(ordered.mapInArrow(build, _NODE), "trie-shards")


def _merged_boundary(partials: DataFrame) -> DataFrame:
    """One row per boundary node, with the totals of its whole subtree."""
    own = staged(
        partials.groupBy("node").agg(
            F.max("up").alias("up"), F.max("depth").alias("depth"), F.min("low").alias("low"), F.sum("n_convs").alias("n_convs"),
            F.sum("n_children").alias("inner"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"),
            F.max("chars").alias("chars"), F.max("ends").alias("ends"),
        ),
        "trie-boundary",
    )
    below = own.filter("up is not null").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("outer"))
    own = own.join(below, "node", "left").withColumn("n_children", F.col("inner") + F.coalesce("outer", F.lit(0)))
    sums = staged(
        own.select(
            "node",
            "up",
            F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"),
            (F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        ),
        "trie-sums",
    )
    # each round adds the sums of the nodes twice as far below
    while not sums.filter("up is not null").isEmpty():
        gained = sums.filter("up is not null").groupBy(F.col("up").alias("node")).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        above = sums.select(F.col("node").alias("up"), F.col("up").alias("next"))
        sums = staged(
            sums.join(gained, "node", "left").join(above, "up", "left").select(
                "node",
                F.col("next").alias("up"),
                (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            ),
            "trie-sums",
        )
    totals = sums.select("node", "n_leaves", "saved")
    return staged(own.select("node", "up", "depth", "low", "n_convs", "n_children", "ends").join(totals, "node"), "trie-merged")


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """A row per node of the trie of the rebuilt conversations (``conv_id, turn, role, text``)."""
    nodes = _shards(sequences(rebuild(encode_turns(conversations))))
    merged = _merged_boundary(nodes.filter("boundary"))
    columns = ("depth", "low", "n_convs", "n_children", "n_leaves", "saved", "ends")
    inner = nodes.filter("not boundary and up is null").select(*columns, F.col("parent_low").alias("parent"))
    waiting = nodes.filter("not boundary and up is not null").select(*columns, "up")
    waiting = waiting.unionByName(merged.filter("up is not null").select(*columns, "up"))
    # a parent may have a large part of all nodes as its children
    parents = merged.filter("n_children > 0").select(F.col("node").alias("up"), F.col("low").alias("parent"), F.col("n_children").alias("__size"))
    if merged.count() <= BROADCAST_ROWS:
        known = waiting.join(F.broadcast(parents), "up")
    else:
        known = join_groups(waiting, parents, "up", "__size")
    root = merged.filter("up is null").select(*columns, F.lit(None).cast("long").alias("parent"))
    return inner.unionByName(known.select(*columns, "parent")).unionByName(root).select(
        F.col("low").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
