"""Exact duplicates: two Bloom passes, then only possibly repeated rows shuffle.

The first pass builds a blocked Bloom filter of the fingerprints: per block, the bits that were
set at all, the bits set an odd number of times, and how many were set in sum. Each of them
is merged map-side, so a task sends one row for each block that it touched, however many rows and copies it
read. From the three follow the bits set twice or more often (see ``repeated_filter``), the filter of the
repeated fingerprints, without false negatives. Its number of blocks is bounded, so it is broadcast. The second
pass probes every row with it. Rows that miss pass straight through; rows that hit are grouped by
their full SHA-256.

Texts are equal when identical after replacing each run of ``[\\x20\\x09-\\x0D]`` by one
space. Null counts as empty. The row with the smallest ``doc_id`` stays; a null ``doc_id`` is
larger than any. Rows that repeat both ``doc_id`` and text are one document: the report marks
all of them as kept, ``drop_duplicates`` returns one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from heatlens.llm.bloom import bits_of, block_count, block_of
from heatlens.llm.common import join_groups, staged, text_of

WIDTH = 64
# Of distinct texts, about one in a thousand passes a filter with so many bits a row.
BITS_PER_ROW = 64
# Two longs for each block: about 32 MB on each executor at most.
MAX_BLOCKS = 1 << 20


def normalised(text: Column) -> Column:
    """Each run of white space as one space; single spaces need no replacement."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def fingerprint(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def repeated_filter(prints: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The blocks ``(block, twice)`` of the filter of repeated fingerprints, and their number.

    Bits set an even number of times are set, but not an odd number of times. If the settings beyond the
    first of each bit are as many as those bits, no bit was set three times, and those bits are the
    repeated ones. Otherwise all bits of the block count as repeated: its other rows pass for nothing,
    no repeated one is missed.
    """
    blocks = block_count(prints.count(), WIDTH, MAX_BLOCKS, BITS_PER_ROW)
    planes = (
        prints.select(block_of(F.col(column), blocks).alias("__block"), bits_of(F.col(column), WIDTH).alias("__bits"))
        .groupBy("__block")
        .agg(
            F.bit_or("__bits").alias("__any"),
            F.bit_xor("__bits").alias("__odd"),
            F.sum(F.bit_count("__bits")).alias("__set"),
        )
    )
    even = F.col("__any").bitwiseAND(F.bitwise_not("__odd"))
    at_most_two = F.col("__set") - F.bit_count("__any") == F.bit_count(even)
    twice = F.when(at_most_two, even).otherwise(F.col("__any"))
    return staged(planes.select("__block", twice.alias("__twice")).filter("__twice != 0"), "bloom"), blocks


def probe(rows: DataFrame, column: str, twice: DataFrame, blocks: int) -> DataFrame:
    """``rows`` and ``__maybe``: whether the fingerprint may occur more than once."""
    bits = bits_of(F.col(column), WIDTH)
    hit = F.coalesce(F.col("__twice").bitwiseAND(bits) == bits, F.lit(False))
    return (
        rows.withColumn("__block", block_of(F.col(column), blocks))
        .join(F.broadcast(twice), "__block", "left")
        .withColumn("__maybe", hit)
        .drop("__block", "__twice")
    )


def _groups(maybe: DataFrame) -> DataFrame:
    """One row per text that may be repeated."""
    return staged(
        maybe.groupBy("__print").agg(F.min("__id").alias("__keep"), F.count("*").alias("__size")), "dedup-groups"
    )


def _prints(docs: DataFrame) -> DataFrame:
    return staged(docs.select(F.col("doc_id").alias("__id"), fingerprint(text_of()).alias("__print")), "fingerprints")


def duplicate_report(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    prints = _prints(docs)
    twice, blocks = repeated_filter(prints, "__print")
    probed = probe(prints, "__print", twice, blocks)
    maybe = probed.filter("__maybe").drop("__maybe")
    alone = probed.filter("not __maybe").drop("__maybe")
    known = join_groups(maybe, _groups(maybe), "__print", "__size")
    straight = alone.select(
        "__print", "__id", F.col("__id").alias("__keep"), F.lit(1).cast("long").alias("__size")
    )
    return known.unionByName(straight).select(
        F.col("__id").alias("doc_id"),
        F.col("__keep").alias("keep_id"),
        F.col("__size").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"),
        F.col("__print").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that do not stay, all columns kept."""
    twice, blocks = repeated_filter(_prints(docs), "__print")
    rows = docs.withColumn("__print", fingerprint(text_of()))
    probed = probe(rows, "__print", twice, blocks)
    maybe = probed.filter("__maybe").drop("__maybe")
    alone = probed.filter("not __maybe")
    groups = _groups(maybe.select("__print", F.col("doc_id").alias("__id")))
    stays = (
        join_groups(maybe, groups, "__print", "__size")
        .filter(F.col("doc_id").eqNullSafe(F.col("__keep")))
        .dropDuplicates(["__print"])
    )
    return alone.select(*docs.columns).unionByName(stays.select(*docs.columns))
