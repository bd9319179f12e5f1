"""Token ids on disk, with access to single short documents.

Every document is one zstandard frame of its serialized id array. All frames share a
dictionary trained on serialized id arrays of a bounded sample, so that even documents of a
few ids compress.

A folder of the format holds two tables. ``dictionary``: one row with the dictionary's
bytes, its SHA-256 and the width of an id. ``blocks``: one row per run of documents in
ascending order of ``doc_id`` (nulls first; rows that repeat a ``doc_id`` by their ids):

``part, block``      place of the block; (part, block) ascends with doc_id
``first_doc, last_doc``  ids of its first and last document
``doc_ids``          int64 each, -1 where ``has_id`` is 0
``has_id``           uint8 each
``n_ids``            uint64 each, number of token ids
``offsets``          uint64 each, start of the frame in ``frames``, and one more for the end
``frames``           the frames
``before``           token ids of all documents of the part before the block
``tokens``           token ids in the block
``dictionary_sha256``  hash of the dictionary that the frames need

Tables are written by Spark's own writer, so that a retried task leaves nothing twice and
the folder can be in any store Spark reaches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from heatlens.llm.common import BROADCAST_ROWS, chunks, partitions_for, text_of
from heatlens.llm.tokens import byte_bpe

# The dictionary is trained on this many documents at most, and on this many bytes of each.
SAMPLE_DOCS = 1024
SAMPLE_BYTES = 1 << 16
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
BLOCK_DOCS = 1024
BLOCK_BYTES = 4 << 20
ROWS_PER_PART = 100_000

BLOCKS = (
    "part long, block long, first_doc long, last_doc long, doc_ids binary, has_id binary, n_ids binary, "
    "offsets binary, frames binary, before long, tokens long, dictionary_sha256 string"
)
DOCUMENTS = "part long, position long, doc_id long, before long, ids binary"


def _encoded(vocabulary: str, end_id: int, width: str, text: str | None) -> bytes:
    ids = byte_bpe(vocabulary).ids(text or "")
    return np.append(ids, end_id).astype(width).tobytes()


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int, width: str) -> bytes:
    """A dictionary from the ``SAMPLE_DOCS`` documents with the smallest hashed ids.

    Empty if the sample is too small to train on; frames then use none. The dictionary
    changes the size of the files only, never what is read back.
    """
    # A share of all rows first, so that few rows are sorted.
    share = min(1.0, 2 * SAMPLE_DOCS / max(1, docs.count()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    chosen = (
        docs.select("doc_id", text_of().alias("text"))
        .filter(place <= int(share * (1 << 40)))
        .orderBy(place, "doc_id")
        .limit(SAMPLE_DOCS)
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [_encoded(vocabulary, end_id, width, t)[:SAMPLE_BYTES] for t in batch["text"].to_pylist()]
            yield pa.record_batch({"ids": pa.array(ids, pa.binary())})

    samples = [bytes(r.ids) for r in chosen.mapInArrow(encode, "ids binary").collect()]
    if sum(map(len, samples)) < 2 * DICTIONARY_BYTES:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class _Block:
    """Documents gathered for one row of ``blocks``."""

    def __init__(self, part: int, block: int, before: int):
        self.part, self.block, self.before = part, block, before
        self.docs, self.counts, self.frames, self.bytes = [], [], [], 0

    def add(self, doc: int | None, count: int, frame: bytes) -> None:
        self.docs.append(doc)
        self.counts.append(count)
        self.frames.append(frame)
        self.bytes += len(frame)

    def full(self) -> bool:
        return len(self.docs) >= BLOCK_DOCS or self.bytes >= BLOCK_BYTES

    def row(self, sha: str) -> dict:
        sizes = np.cumsum([0, *map(len, self.frames)]).astype("<u8")
        return {
            "part": self.part,
            "block": self.block,
            "first_doc": self.docs[0],
            "last_doc": self.docs[-1],
            "doc_ids": np.array([-1 if d is None else d for d in self.docs], "<i8").tobytes(),
            "has_id": np.array([d is not None for d in self.docs], "u1").tobytes(),
            "n_ids": np.array(self.counts, "<u8").tobytes(),
            "offsets": sizes.tobytes(),
            "frames": b"".join(self.frames),
            "before": self.before,
            "tokens": int(sum(self.counts)),
            "dictionary_sha256": sha,
        }


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, width: str = "<u2") -> None:
    """Encode every whole text, append ``end_id``, and write the format above to ``path``.

    ``width``: numpy type of a stored id, wide enough for the vocabulary. Documents are dealt
    by ranges of ``doc_id`` before they are encoded, so texts are encoded once. An
    empty table writes an empty ``blocks``.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, vocabulary, end_id, width)
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(bytearray(dictionary), sha, width)], "dictionary binary, sha256 string, width string").coalesce(
        1
    ).write.parquet(f"{path}/dictionary")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared).compress
        part, before = TaskContext.get().partitionId(), 0
        block = _Block(part, 0, 0)
        for batch in chunks(batches, 256):
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = _encoded(vocabulary, end_id, width, text)
                count = len(ids) // np.dtype(width).itemsize
                block.add(doc, count, compress(ids))
                before += count
                if block.full():
                    yield pa.RecordBatch.from_pylist([block.row(sha)], schema=schema)
                    block = _Block(part, block.block + 1, before)
        if block.docs:
            yield pa.RecordBatch.from_pylist([block.row(sha)], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(BLOCKS))
    parts = partitions_for(spark, docs.count(), ROWS_PER_PART)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    (
        rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(encode, BLOCKS)
        .write.parquet(f"{path}/blocks")
    )


def _decoder(spark: SparkSession, path: str):
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary, width = bytes(row.dictionary), row.width
    sha = hashlib.sha256(dictionary).hexdigest()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        decompress = zstandard.ZstdDecompressor(dict_data=shared).decompress
        for batch in chunks(batches, 1):
            block = batch.to_pylist()[0]
            if block["dictionary_sha256"] != sha:
                raise ValueError("the frames were written with another dictionary")
            docs = np.frombuffer(block["doc_ids"], "<i8")
            has = np.frombuffer(block["has_id"], "u1")
            counts = np.frombuffer(block["n_ids"], "<u8").astype("i8")
            offsets = np.frombuffer(block["offsets"], "<u8")
            befores = block["before"] + np.cumsum(counts) - counts
            frames = memoryview(block["frames"])
            wanted = block.get("wanted")
            at = range(len(docs)) if wanted is None else np.flatnonzero(has.astype(bool) & np.isin(docs, wanted))
            for lo in range(0, len(at), 256):
                some = list(at[lo : lo + 256])
                ids = [
                    np.frombuffer(decompress(frames[offsets[i] : offsets[i + 1]]), width).astype("<u4").tobytes() for i in some
                ]
                yield pa.record_batch(
                    {
                        "part": pa.array([block["part"]] * len(some), pa.int64()),
                        "position": pa.array([(block["block"] << 20) + int(i) for i in some], pa.int64()),
                        "doc_id": pa.array([int(docs[i]) if has[i] else None for i in some], pa.int64()),
                        "before": pa.array(befores[some], pa.int64()),
                        "ids": pa.array(ids, pa.binary()),
                    }
                )

    return decode


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (token ids of all documents before it) and ``ids`` (uint32, little
    endian) of every document."""
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per written partition.
    starts = totals.select("part", F.coalesce(F.sum("tokens").over(running), F.lit(0)).alias("part_start"))
    small = blocks.select("part").distinct().count() <= BROADCAST_ROWS
    docs = blocks.mapInArrow(_decoder(spark, path), DOCUMENTS)
    return docs.join(F.broadcast(starts) if small else starts, "part").select(
        "doc_id", (F.col("part_start") + F.col("before")).alias("start"), "ids"
    )


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id`` and ``ids`` of a few documents: only blocks whose range holds one of them
    are read, and of these only the wanted frames are decompressed."""
    blocks = spark.read.parquet(f"{path}/blocks")
    hit = F.lit(False)
    for doc in doc_ids:
        hit = hit | ((F.coalesce("first_doc", F.lit(-(2**63))) <= doc) & (F.col("last_doc") >= doc))
    wanted = blocks.filter(hit).withColumn("wanted", F.array(*map(F.lit, doc_ids)).cast("array<long>"))
    return wanted.mapInArrow(_decoder(spark, path), DOCUMENTS).select("doc_id", "ids")
