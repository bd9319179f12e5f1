"""Near-duplicate texts: MinHash bands find candidates, odd sketches sift them, full sets decide.

A text's set holds its distinct five-word shingles (words: ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased;
with fewer words the whole sequence is one shingle; without words the set is empty and
linked with nothing). Texts are linked when 100 * |A and B| >= 75 * |A or B|. Shingles are
compared by a 64-bit hash.

1. 128 MinHash values give 32 bands of 4, and are folded into an odd sketch: a bitmap of 512
   bits in which each (position, value) flips one bit. Two bitmaps differ in about
   256 * (1 - exp(-d / 256)) bits when d of 256 entries differ, so the population count of their XOR
   estimates high similarities closely. Pairs that differ in more bits than texts of
   similarity 0.5 are sifted out; at 0.75 that is five standard deviations away. A pair of 0.75
   shares no band with a probability of 5e-6.
2. Equal sets form a class with a number of its own, represented by one document; only these go on.
3. In each band's bucket, members are checked against the smallest one. Where some fail,
   they are compared with the rest of the bucket inside blocks of bounded size, which hold the full sets. Odd
   sketches of these (4,096 bits, a few hundredths of similarity wide) leave the likely pairs; those between
   components that are still apart are decided on the sets, first the four likeliest for each member, then
   all others. Only links that join two components come out, fewer than a block has members.
   Two texts are compared in the first bucket that they share.
4. Links give the components.

A null ``doc_id`` can't be named: such a row is reported by itself with a null
``component_id`` and kept. Rows that repeat a ``doc_id`` are each judged by their own text: nothing but the
report goes by ids.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from heatlens.llm.common import BROADCAST_ROWS, chunks, join_groups, staged, text_of
from heatlens.llm.components import components

SHINGLE_WORDS = 5
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
SKETCH_BITS = 512
SKETCH_WORDS = SKETCH_BITS // 64
SIFT_SIMILARITY = 0.5
PARITY_BITS = 4096
PERCENT = 75
# Blocks of a bucket in which sets are compared: their members, and the shingles of each side.
BLOCK_FAILED, BLOCK_MEMBERS = 512, 2048
BLOCK_SHINGLES = 1 << 20
FIRST_BEST = 4

_RANDOM = np.random.default_rng(20240607)
_BYTE_WEIGHTS = _RANDOM.integers(0, 2**64, size=256, dtype=np.uint64) | np.uint64(1)
_WORD_WEIGHTS = _RANDOM.integers(0, 2**64, size=SHINGLE_WORDS, dtype=np.uint64) | np.uint64(1)
_FLIPS = _RANDOM.integers(0, 2**64, size=HASHES, dtype=np.uint64)
_FACTORS = _RANDOM.integers(0, 2**64, size=HASHES, dtype=np.uint64) | np.uint64(1)
_SALTS = _RANDOM.integers(0, 2**64, size=HASHES, dtype=np.uint64)


def most_differing_bits() -> int:
    """Differing bits expected of two sketches of texts of ``SIFT_SIMILARITY``."""
    differing = 2 * HASHES * (1 - SIFT_SIMILARITY)
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-2 * differing / SKETCH_BITS)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash per word, in order. A word is summed over its bytes, each weighed
    by its place; places beyond the table are weighed by the table turned on."""
    raw = np.frombuffer(text.encode("utf-8", "replace").lower(), dtype=np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    inside = np.flatnonzero(~space)
    if not len(inside):
        return np.empty(0, np.uint64)
    first = np.empty(len(inside), bool)
    first[0] = True
    np.not_equal(np.diff(inside), 1, out=first[1:])
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(inside)))
    place = np.arange(len(inside)) - np.repeat(starts, lengths)
    weights = _BYTE_WEIGHTS[place & 255]
    if lengths.max() > 256:
        weights = _mix(weights + (place >> 8).astype(np.uint64)) | np.uint64(1)
    return _mix(np.add.reduceat((raw[inside].astype(np.uint64) + np.uint64(1)) * weights, starts) + lengths.astype(np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    width = min(SHINGLE_WORDS, len(words))
    n = len(words) - width + 1
    total = np.full(n, np.uint64(width))
    for j in range(width):
        total += words[j : j + n] * _WORD_WEIGHTS[j]
    return np.unique(_mix(total))


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    lowest = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), 512):
        part = shingles[start : start + 512]
        np.minimum(lowest, ((part[None, :] ^ _FLIPS[:, None]) * _FACTORS[:, None]).min(axis=1), out=lowest)
    return lowest


def band_keys(lowest: np.ndarray) -> np.ndarray:
    return _mix((lowest.reshape(BANDS, ROWS) * _WORD_WEIGHTS[:ROWS]).sum(axis=1, dtype=np.uint64) ^ _SALTS[:BANDS])


def odd_sketch(lowest: np.ndarray) -> np.ndarray:
    flipped = np.bincount((_mix(lowest ^ _SALTS) % np.uint64(SKETCH_BITS)).astype(int), minlength=SKETCH_BITS)
    return np.packbits((flipped & 1).astype(np.uint8)).view(np.uint64)


def _marked(docs: DataFrame) -> DataFrame:
    """``id, text, mark``: a document is found again by its id and the hash of its text, as ids may repeat."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text"), F.xxhash64(text_of()).alias("mark"))


def _signatures(docs: DataFrame) -> DataFrame:
    schema = "id long, mark long, n long, digest binary, bands array<long>, sketch array<long>"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = []
            for text in batch["text"].to_pylist():
                shingles = shingle_set(text)
                lowest = min_hashes(shingles)
                rows.append((len(shingles), digest(shingles), band_keys(lowest).view(np.int64), odd_sketch(lowest).view(np.int64)))
            yield pa.record_batch(
                {
                    "id": batch["id"],
                    "mark": batch["mark"],
                    "n": pa.array([r[0] for r in rows], pa.int64()),
                    "digest": pa.array([r[1] for r in rows], pa.binary()),
                    "bands": pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                    "sketch": pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                }
            )

    return staged(_marked(docs).mapInArrow(sign, schema), "signatures")


def _from_texts(docs: DataFrame, wanted: DataFrame, column: str, make: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``id, n`` and ``column`` (made of the full set) of the classes in ``wanted`` (``id, doc, mark, digest``)."""
    small = wanted.count() <= BROADCAST_ROWS
    rows = _marked(docs).withColumnRenamed("id", "doc")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 256):
            keep, sizes, found = [], [], []
            for i, (text, want) in enumerate(zip(batch["text"].to_pylist(), batch["digest"].to_pylist())):
                shingles = shingle_set(text)
                if digest(shingles) == want:
                    keep.append(i)
                    sizes.append(len(shingles))
                    found.append(make(shingles).view(np.int64))
            yield pa.record_batch(
                {
                    "id": batch["id"].take(pa.array(keep, pa.int64())),
                    "n": pa.array(sizes, pa.int64()),
                    column: pa.array(found, pa.list_(pa.int64())),
                }
            )

    named = rows.join(F.broadcast(wanted) if small else wanted, ["doc", "mark"])
    return staged(named.mapInArrow(read, f"id long, n long, {column} array<long>").dropDuplicates(["id"]), column)


def parities(shingles: np.ndarray) -> np.ndarray:
    """The odd sketch of the full set itself: each shingle flips one of ``PARITY_BITS`` bits."""
    flipped = np.bincount((shingles % np.uint64(PARITY_BITS)).astype(int), minlength=PARITY_BITS)
    return np.packbits((flipped & 1).astype(np.uint8)).view(np.uint64)


def most_odd_bits(sizes: np.ndarray) -> np.ndarray:
    """Bits that the parities of linked sets with these summed sizes differ in at most: the
    mean at the largest difference that makes a link, and six standard deviations."""
    m, d = PARITY_BITS, sizes * (100 - PERCENT) / (100 + PERCENT)
    once, twice = (1 - 2 / m) ** d, (1 - 4 / m) ** d
    variance = m / 4 * (1 - twice) + m * m / 4 * (twice - once**2)
    return m / 2 * (1 - once) + 6 * np.sqrt(np.maximum(variance, 0)) + 1


def _confirm(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The ``pairs`` (``u, v``) that are links, from the full sets. ``u`` may be in many pairs: its set
    goes to one place for each share of them."""
    ids = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
    wanted = staged(reps.select("id", "doc", "mark", "digest").join(ids, "id", "left_semi"), "wanted")
    sets = _from_texts(docs, wanted, "shingles", lambda s: s)
    shares = max(16, pairs.count() // 1024)
    dealt = pairs.withColumn("share", F.pmod(F.xxhash64("v"), F.lit(shares)))
    hubs = dealt.select("u", "share").distinct().join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u")
    members = dealt.join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return members.join(hubs, ["u", "share"]).filter(100 * common >= PERCENT * (F.size("a") + F.size("b") - common)).select("u", "v")


def _differing_bits(a: Column, b: Column) -> Column:
    bits = F.lit(0)
    for i in range(SKETCH_WORDS):
        bits = bits + F.bit_count(a[i].bitwiseXOR(b[i]))
    return bits


def _sift(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose sizes and sketches allow a link. ``u`` may be in many pairs."""
    light = reps.select("id", "n", "sketch")
    degree = pairs.groupBy("u").agg(F.count("*").alias("degree"))
    hubs = staged(degree.join(light.withColumnRenamed("id", "u"), "u").withColumnsRenamed({"n": "nu", "sketch": "su"}), "hubs")
    members = pairs.join(light.withColumnsRenamed({"id": "v", "n": "nv", "sketch": "sv"}), "v")
    fits = 100 * F.least("nu", "nv") >= PERCENT * F.greatest("nu", "nv")
    close = _differing_bits(F.col("su"), F.col("sv")) <= most_differing_bits()
    return join_groups(members, hubs, "u", "degree").filter(fits & close).select("u", "v")


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two ascending arrays without repeats."""
    if len(a) < len(b):
        a, b = b, a
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())


def _linked_in_block(block: pd.DataFrame) -> pd.DataFrame:
    """Links (``u, v``) of failed members (``query``) and the others of a block, on full sets, that join components which are
    apart: as many as it takes to join them, so fewer than there are members."""
    asked, others = block[block["query"]], block[~block["query"]]
    links: list[tuple[int, int]] = []
    if not len(asked) or not len(others):
        return pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64")})
    bucket = block["bucket"].iloc[0]
    _, roots = np.unique(np.concatenate([asked["component"], others["component"]]), return_inverse=True)
    top_q, top = roots[: len(asked)].copy(), roots[len(asked) :].copy()
    ids, n = others["id"].to_numpy(), others["n"].to_numpy()
    failed, bands = others["failed"].to_numpy(), np.array(others["bands"].tolist(), dtype=np.int64)
    sets, sets_q = ([s.view(np.uint64) for s in side["shingles"]] for side in (others, asked))
    bits = np.array([parities(s) for s in sets])
    ids_q, n_q = asked["id"].to_numpy(), asked["n"].to_numpy()
    bands_q, bits_q = list(asked["bands"]), [parities(s) for s in sets_q]

    def likely(q: int) -> tuple[np.ndarray, np.ndarray]:
        """Partners of ``q`` in other components, likeliest first, and a number that falls with the likeliness."""
        # of two failed members one asks
        ok = (top != top_q[q]) & (~failed | (ids > ids_q[q])) & (100 * np.minimum(n, n_q[q]) >= PERCENT * np.maximum(n, n_q[q]))
        at = np.flatnonzero(ok)
        same = bands[at] == bands_q[q]
        first = bands_q[q][same.argmax(axis=1)]
        at = at[~same.any(axis=1) | (first == bucket)]
        differ, sizes = np.bitwise_count(bits[at] ^ bits_q[q]).sum(axis=1), n[at] + n_q[q]
        fits = differ <= most_odd_bits(sizes)
        at, differ, sizes = at[fits], differ[fits].astype(float), sizes[fits]
        far = -np.log1p(-np.minimum(2 * differ / PARITY_BITS, 0.999)) / sizes
        order = np.lexsort((ids[at], far))
        return at[order], far[order]

    def joined(q: int, i: int) -> bool:
        nonlocal top_q, top
        a, b = sets_q[q], sets[i]
        common = _overlap(a, b)
        if 100 * common < PERCENT * (len(a) + len(b) - common):
            return False
        links.append((min(ids_q[q], ids[i]), max(ids_q[q], ids[i])))
        low, high = sorted((top_q[q], top[i]))
        top_q[top_q == high] = low
        top[top == high] = low
        return True

    tried = set()
    best = []
    for q in range(len(asked)):
        at, far = likely(q)
        best.extend(zip(far[:FIRST_BEST].tolist(), [q] * len(at[:FIRST_BEST]), at[:FIRST_BEST].tolist()))
    for _, q, i in sorted(best):
        if top_q[q] != top[i]:
            tried.add((q, i))
            joined(q, i)
    for q in range(len(asked)):
        for i in likely(q)[0].tolist():
            if top_q[q] != top[i] and (q, i) not in tried:
                joined(q, i)
    return pd.DataFrame(links, columns=["u", "v"], dtype="int64")


def _linked_in_buckets(members: DataFrame, sets: DataFrame, known: DataFrame) -> DataFrame:
    """Links (``u, v``) of failed members and any other of their bucket that join different components, at most as many
    as rows are compared. ``members``: ``bucket, id, failed``. ``sets``: ``id, n, bands, shingles``. ``known``: ``id, component``."""
    of_id = sets.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    light = members.join(of_id.select("id", "n", "component"), "id")
    bad = F.col("failed").cast("long")
    sizes = light.groupBy("bucket").agg(
        F.count("*").alias("all"),
        F.sum(bad).alias("bad"),
        F.sum("n").alias("weight"),
        F.sum(bad * F.col("n")).alias("bad_weight"),
        F.min("component").alias("low"),
        F.max("component").alias("high"),
    ).filter("low < high").select(
        "bucket",
        F.greatest(F.ceil(F.col("all") / BLOCK_MEMBERS), F.ceil(F.col("weight") / BLOCK_SHINGLES)).alias("columns"),
        F.greatest(F.ceil(F.col("bad") / BLOCK_FAILED), F.ceil(F.col("bad_weight") / BLOCK_SHINGLES)).alias("rows"),
        "all",
    )
    placed = join_groups(members, staged(sizes, "bucket-sizes"), "bucket", "all")
    place = lambda n: F.pmod(F.xxhash64("id", "bucket"), F.col(n))
    across = placed.filter("failed").select(
        "*", F.lit(True).alias("query"), place("rows").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1)).alias("j")
    )
    down = placed.select(
        "*", F.lit(False).alias("query"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("i"), place("columns").alias("j")
    )
    sent = across.unionByName(down).select("bucket", "i", "j", "query", "id", "failed").join(of_id, "id")
    return sent.groupBy("bucket", "i", "j").applyInPandas(_linked_in_block, "u long, v long")


def _judged(docs: DataFrame) -> DataFrame:
    """``id, mark, n, component, stays`` of every row: ``stays`` marks one document of each component."""
    signed = _signatures(docs)
    named = signed.filter("id is not null and n > 0")
    grouped = named.groupBy("digest").agg(F.min(F.struct("id", "mark")).alias("rep"), F.count("*").alias("size"))
    classes = staged(
        grouped.select(F.monotonically_increasing_id().alias("class"), "digest", "rep", "size"), "classes"
    )
    reps = staged(
        named.join(classes.select("digest", "class", "rep.id", "rep.mark"), ["digest", "id", "mark"])
        .dropDuplicates(["digest"])
        .withColumnRenamed("id", "doc").withColumnRenamed("class", "id"),
        "reps",
    )
    banded = reps.select("id", F.explode("bands").alias("bucket"))
    buckets = staged(
        banded.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count("*").alias("members")).filter("members > 1"), "buckets"
    )
    members = staged(join_groups(banded, buckets, "bucket", "members"), "members")
    pairs = staged(members.filter("id <> pivot").select(F.col("pivot").alias("u"), F.col("id").alias("v")).distinct(), "pairs")
    links = staged(_confirm(staged(_sift(pairs, reps), "sifted"), docs, reps), "links")

    # Members that are not linked to the smallest one of a bucket of three or more.
    missed = staged(pairs.join(links, ["u", "v"], "left_anti"), "missed")
    open_rows = members.filter("members > 2 and id <> pivot").join(
        missed.select(F.col("u").alias("pivot"), F.col("v").alias("id")), ["pivot", "id"], "left_semi"
    )
    failed = staged(open_rows.select("bucket", "id").withColumn("failed", F.lit(True)), "failed")
    known = components(links)
    if not failed.isEmpty():
        open_buckets = staged(failed.groupBy("bucket").agg(F.count("*").alias("bad")), "open-buckets")
        rows = (
            join_groups(members.select("bucket", "id"), open_buckets, "bucket", "bad")
            .join(failed, ["bucket", "id"], "left")
            .select("bucket", "id", F.coalesce("failed", F.lit(False)).alias("failed"))
        )
        rows = staged(rows, "open-members")
        open_ids = rows.select("id").distinct()
        wanted = staged(reps.select("id", "doc", "mark", "digest").join(open_ids, "id", "left_semi"), "open")
        sets = _from_texts(docs, wanted, "shingles", lambda s: s).join(reps.select("id", "bands"), "id")
        more = staged(_linked_in_buckets(rows, sets, known), "bucket-links")
        if not more.isEmpty():
            known = components(known.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more))

    placed = staged(
        classes.join(known.withColumnRenamed("id", "class"), "class", "left").select(
            "digest", "rep", "size", F.coalesce("component", "class").alias("top")
        ),
        "placed-classes",
    )
    tops = staged(placed.groupBy("top").agg(F.min("rep").alias("first"), F.count("*").alias("classes")), "components")
    of_class = staged(join_groups(placed, tops, "top", "classes").select("digest", "first", "size"), "class-components")
    grouped = join_groups(named.select("id", "mark", "n", "digest"), of_class, "digest", "size").select(
        "id", "mark", "n", F.col("first.id").alias("component"), (F.struct("id", "mark") == F.col("first")).alias("stays")
    )
    alone = signed.filter("id is null or n = 0").select(
        "id", "mark", "n", F.col("id").alias("component"), F.lit(True).alias("stays")
    )
    return grouped.unionByName(alone)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``."""
    return _judged(docs).select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that another one of their component stands for: one document of each stays,
    that with the smallest ``doc_id``. Rows that repeat both id and text are that document, and stay together."""
    gone = staged(
        _judged(docs).filter("not stays").select(F.col("id").alias("__id"), F.col("mark").alias("__mark")).distinct(), "gone"
    )
    small = gone.count() <= BROADCAST_ROWS
    same = (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64(text_of()) == F.col("__mark"))
    return docs.join(F.broadcast(gone) if small else gone, same, "left_anti").select(*docs.columns)
