"""URL lists: a blocked Bloom filter of the listed URLs, then an exact hash join.

A rule names a host and a path and fits that host, its subdomains, and all paths
that start with its path. So a URL has to be looked up once for each suffix of its host
and each length that listed paths have. The Bloom filter of the rules answers almost all
of these look-ups; only URLs with a possible hit go on to the join, which removes false
positives. The longest rule wins (of equally long ones that with the longer host).

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then
up to ``?``, ``#`` or the end. A null url, or one without ``://``, has an empty host and path and
fits no rule. A URL that no rule fits is allowed: the list blocks only what it names.
Rows that repeat a page stay as many as they are.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from heatlens.llm.bloom import bits_of, block_count, block_of
from heatlens.llm.common import BROADCAST_ROWS

WIDTH = 32
# A literal of 4 bytes for each block: 512 KB at most.
MAX_BLOCKS = 1 << 17
DEFAULT = "allow"


def url_parts(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(whole, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(whole, pattern, 2)


def _bloom(rules: DataFrame) -> tuple[bytes, int]:
    blocks = block_count(rules.count(), WIDTH, MAX_BLOCKS)
    key = F.col("rule")
    rows = rules.groupBy(block_of(key, blocks).alias("block")).agg(F.bit_or(bits_of(key, WIDTH)).alias("bits")).collect()
    words = np.zeros(blocks, dtype=">u4")
    for row in rows:
        words[row.block] = row.bits
    return words.tobytes(), blocks


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages`` (``page_id, url``).

    ``rules``: ``host`` (lower case), ``path`` (empty or starting with a slash) and ``verdict``. Rules
    with a null are left out; a rule listed twice counts once, ``block`` before ``allow``.
    """
    listed = (
        rules.select("host", "path", "verdict")
        .dropna()
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("rule", F.concat("host", "path"))
    )
    shape = listed.agg(
        F.max(F.size(F.split("host", r"\."))).alias("labels"),
        F.sort_array(F.collect_set(F.length("path"))).alias("lengths"),
        F.count("*").alias("n"),
    ).first()
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    bare = (F.lit(None).cast("string").alias("rule"), F.lit(DEFAULT).alias("verdict"))
    if not shape.n:
        return rows.select("*", *bare)

    filter_bytes, blocks = _bloom(listed)
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size(labels) - shape.labels + 1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    lengths = F.filter(F.array(*map(F.lit, shape.lengths)), lambda n: n <= F.length("path"))
    keys = F.flatten(
        F.transform(suffixes, lambda s: F.transform(lengths, lambda n: F.concat(s, F.substring(F.col("path"), F.lit(1), n))))
    )

    def listed_maybe(key: Column) -> Column:
        word = F.substring(F.lit(filter_bytes), (block_of(key, blocks) * 4 + 1).cast("int"), F.lit(4))
        bits = bits_of(key, WIDTH)
        return F.conv(F.hex(word), 16, 10).cast("long").bitwiseAND(bits) == bits

    probed = rows.withColumn("__keys", F.filter(keys, listed_maybe))
    misses = probed.filter(F.size("__keys") == 0).select("page_id", "host", "path", *bare)
    maybe = probed.filter(F.size("__keys") > 0).groupBy("page_id", "host", "path").agg(
        F.count("*").alias("__n"), F.first("__keys").alias("__keys")
    )
    exact = listed.select(F.col("rule").alias("__key"), F.struct(F.length("rule"), F.length("host"), "rule", "verdict").alias("__fit"))
    candidates = maybe.select("page_id", "host", "path", "__n", F.explode("__keys").alias("__key"))
    found = (
        candidates.join(F.broadcast(exact) if shape.n <= BROADCAST_ROWS else exact, "__key", "left")
        .groupBy("page_id", "host", "path", "__n")
        .agg(F.max("__fit").alias("__fit"))
    )
    hits = found.select(
        "page_id",
        "host",
        "path",
        F.col("__fit.rule").alias("rule"),
        F.coalesce("__fit.verdict", F.lit(DEFAULT)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), "__n")).alias("__copy"),
    ).drop("__copy")
    return misses.unionByName(hits)
