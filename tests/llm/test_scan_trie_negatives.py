"""License scans, the prefix trie and hard negatives against plain restatements."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from heatlens.llm import hard_negatives, license_scan, prefix_trie
from heatlens.llm.common import read_table
from heatlens.llm.queries import QUERIES

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def base_places(text):
    words = WORD.findall((text or "").translate(A_TO_Z))
    found = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


LICENSES = [
    (1, None), (2, ""), (3, " .,;\x00 "), (4, "MIT License mit  LICENSE, mit/license"), (5, "a mit licenses b"), (6, "MİT License"),
    (7, "under the Apache License and the GNU General\nPublic: License v3"), (8, "word " * 30_000 + "MIT license"), (8, "an id again"),
    (8, "an id again"), (None, "general public license"), (None, "general public license"), (9, "license"), (10, "éa mit license é"),
    (11, "mit " * 500 + "license"), (12, "mit license " * 400), (13, "Licensed under CC BY-NC 4.0."),
    (14, "Permission is hereby granted, free of all charge, to any person obtaining one copy of this software and associated "
         "documentation files (the Software), to deal in this Software without restriction"),
    (15, "permission is hereby granted"), (16, "released under the terms of a license"),
    (17, "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    (18, "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]


def scanned(df):
    rows = []
    for r in license_scan.scan(df).collect():
        base = [s.start for s in r.spans if s.base]
        labels = ",".join(sorted({s.label for s in r.spans}))
        rows.append((r.doc_id, r.n_words, len(base), min(base, default=None), max(base, default=None), ",".join(sorted({s.label for s in r.spans if s.base})), labels, r.score))
    return sorted(rows, key=repr)


def test_license_places(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in LICENSES], "doc_id long, text string, label string, words int")
    got = scanned(docs)
    assert [r[:6] for r in got] == sorted(((i, *base_places(t)) for i, t in LICENSES), key=repr)
    labels = {(r[0], r[1]): (r[6], r[7]) for r in got}
    assert labels[(13, 7)] == ("cc-by-nc", 1.0) and labels[(9, 1)] == ("", 0.0)
    # words lost, gained and changed: a passage over several diagonals
    [passage] = [v for k, v in labels.items() if k[0] == 14]
    assert passage[0] == "mit" and license_scan.COVERAGE <= passage[1] < 1
    assert labels[(15, 4)] == ("", 0.0)
    # most of one passage stands in the other: the better covered one is it
    assert labels[(17, 14)] == ("cc-by-nc", 1.0) and labels[(18, 13)] == ("cc-by", 1.0)
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_license_spans_hold_their_words(spark):
    docs = spark.createDataFrame([(1, "so: released under the MIT License, and licensed under CC BY 4.0")], "doc_id long, text string")
    [row] = license_scan.scan(docs).collect()
    assert [(s.start, s.end, s.label, s.base) for s in row.spans] == [(1, 6, "mit", False), (4, 6, "mit", True), (7, 13, "cc-by", False)]


def test_license_query_on_documents(spark, data_dir):
    want = {r.doc_id: base_places(r.text) for r in read_table(spark, data_dir, "documents").collect()}
    got = {r.doc_id: r for r in QUERIES["op11_diagonal_licenses"](spark, data_dir).collect()}
    assert len(got) == len(want)
    for i, base in want.items():
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(r.labels)


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, sha, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in nodes:
        if path:
            children[path[:-1]] += 1
    for path, members in nodes.items():
        gain = (len(members) - 1) * len(path[-1][1]) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += gain
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == p).encode()).hexdigest())
        for p, m in nodes.items()
    )


def trie_rows(seed, n):
    rng, rows = random.Random(seed), []
    for _ in range(n):
        conv = rng.choice([rng.randrange(0, 400), rng.randrange(0, 5) * 100, -rng.randrange(0, 250)])
        rows.append((conv, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", None]), rng.choice(["", None, "a", "bb", "ccc é", "日本"])))
    return rows + [(None, 1, "user", "no conversation")]


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", range(3))
def test_trie_against_brute_force(spark, seed, monkeypatch):
    # small groups and pieces: every way of hashing ids is used
    monkeypatch.setattr(prefix_trie, "SMALL_GROUP", 2)
    monkeypatch.setattr(prefix_trie, "SEQUENCES_PER_SHARD", 7)
    rows = trie_rows(seed, 700)
    rows += [(1000 + c, t, "user", f"copied {t}") for c in range(60) for t in range(9)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS + ", depth string, n_convs int")
    got = sorted(tuple(r) for r in prefix_trie.prefix_nodes(table).collect())
    assert sorted(got, key=repr) == sorted(brute_trie(rows), key=repr)


def test_trie_of_long_conversation_and_of_none(spark):
    rows = [(0, t, "user", f"{t % 7}") for t in range(300)] + [(1, t, "user", f"{t % 7}") for t in range(280)] + [(250, 0, "user", "x")]
    got = [tuple(r) for r in prefix_trie.prefix_nodes(spark.createDataFrame(rows, TURNS)).collect()]
    assert sorted(got, key=repr) == sorted(brute_trie(rows), key=repr)
    assert prefix_trie.prefix_nodes(spark.createDataFrame([], TURNS)).count() == 0


def test_tree_is_balanced_among_siblings():
    n = 4096
    tree, ends = prefix_trie.TernaryTree.of_sorted([[i] for i in range(n)], [[1]] * n)
    depth = {tree.below[0]: 1}
    for at in [tree.below[0]]:
        pending = [at]
        while pending:
            x = pending.pop()
            for s in (tree.less[x], tree.more[x]):
                if s:
                    depth[s] = depth[x] + 1
                    pending.append(s)
    assert len(depth) == n and max(depth.values()) <= 13 and len(set(ends)) == n


def brute_negatives(rows, positives=5, negatives=3):
    usable = []
    for place, (i, label, x) in enumerate(rows):
        if i is not None and label is not None and x and None not in x and all(map(math.isfinite, x)):
            usable.append((place, i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * v) for v in x]))
    out = []
    for place, i, label, x in usable:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), j, other) for p, j, other, y in usable if p != place and len(x) == len(y))
            scored_same = [s for s in scored if s[2] == label][:positives]
            for s, j, _ in scored_same:
                fit = [(-t, k) for t, k, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s]
                out += [(i, j, n + 1, k, -s, t) for n, (t, k) in enumerate(fit[:negatives])]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<double>"


def vector_rows(seed, n, scale, width=9):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(0, n)), int(rng.integers(0, 4)), (rng.normal(size=width) * scale).tolist()) for _ in range(n)]
    rows += [rows[0], rows[1], (50, 1, [0.0] * width), (100, 1, rows[3][2]), (101, 2, rows[3][2]), (150, None, rows[3][2]), (None, 1, rows[3][2])]
    rows += [(200, 1, None), (200, 1, []), (201, 1, [None] * width), (202, 1, [math.nan] * width), (203, 1, [math.inf] * width), (250, 1, [1.0, 2.0])]
    return rows


@pytest.mark.parametrize("scale", [0.3, 1.0, 5000.0])
def test_negatives_against_brute_force(spark, scale, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(hard_negatives, "ROWS_PER_CELL", 60)
    monkeypatch.setattr(hard_negatives, "ANCHORS_PER_CELL", 4)
    monkeypatch.setattr(hard_negatives, "ROWS_PER_PRODUCT", 16)
    rows = vector_rows(int(scale), 400, scale)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS + ", score int, rank string")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mine(table.withColumn("label", moved), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows)
    assert hard_negatives.mine(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("bits", [3, 8, 15, 22, 27])
def test_residue_products_are_exact(bits):
    rng = np.random.default_rng(bits)
    top = 2**bits
    a, b = (rng.integers(-top, top, size=(5, 130), endpoint=True) for _ in range(2))
    a[0], b[0], b[1] = top, top, -top
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert hard_negatives.residue_products(a, b, hard_negatives.primes_for(130 * top * top)).tolist() == want


def test_vectors_beyond_64_bits_take_no_part(spark):
    from pyspark.sql import functions as F

    rows = [(50, 1, [1e300, 0.0]), (51, 1, [1.0, 1.0]), (100, 1, [1.0, 1.0]), (52, 2, [0.9, 0.9]), (53, 2, [1e12, 1.0])]
    found = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0).collect()
    assert [(r.anchor_id, r.positive_id, r.negative_id) for r in found] == [(100, 51, 52)]
