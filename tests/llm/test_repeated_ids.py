"""Ids that repeat with different content, and near duplicates of whole tables against all pairs."""

import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_llm import brute_near

from heatlens.llm import ego_join, near_dedup
from heatlens.llm.common import read_table
from heatlens.llm.queries import QUERIES


def smallest_of_components(ids, linked):
    top = list(range(len(ids)))
    for _ in ids:
        top = [min((top[j] for j in range(len(ids)) if j == i or linked(i, j)), default=top[i]) for i in range(len(ids))]
    return [min(ids[j] for j in range(len(ids)) if top[j] == top[i]) for i in range(len(ids))]


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.02]), (7, [1.0, 0.03]), (7, [0.0, 1.0]), (9, [0.0, 2.0]), (7, [0.0, 1.0])]
    got = Counter(map(tuple, ego_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    near = [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (7, 3, 1, False)]
    assert got == Counter(near + [(7, 2, 7, True)] * 2 + [(9, 2, 7, False)])


def test_vectors_that_share_ids_against_all_pairs(spark):
    random = np.random.default_rng(8)
    x = np.repeat(random.normal(size=(12, 6)), 10, axis=0) + random.normal(size=(120, 6)) * 0.12
    ids = [int(i) for i in random.integers(0, 40, len(x))]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    tops = smallest_of_components(ids, lambda i, j: linked[i, j])
    rows = list(zip(ids, x.tolist()))
    got = ego_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter(map(tuple, got)) == Counter(
        (i, int(linked[n].sum()) - 1, top, i == top) for n, (i, top) in enumerate(zip(ids, tops))
    )


def test_documents_that_share_an_id(spark):
    one, other = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight"
    rows = [(1, one), (2, one), (5, one), (5, other), (6, other), (9, other), (5, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, mark string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert got == Counter([(1, 1, True), (2, 1, False), (5, 1, False), (5, 5, True), (6, 5, False), (9, 5, False), (5, 5, True)])
    left = near_dedup.keep_one_of_each(docs)
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(1, one), (5, other), (5, None)])


def test_a_later_pass_goes_on_where_an_earlier_finds_nothing(spark, monkeypatch):
    """With no best partners in the first pass, the complete one still finds all links."""
    monkeypatch.setattr(near_dedup, "FIRST_BEST", 0)
    random = np.random.default_rng(3)
    base = [f"w{x}" for x in random.integers(0, 500, 120)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in random.integers(0, 120, i % 12):
            words[at] = f"x{i}"
        rows.append((i, " ".join(words)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(rows)


def linked_pairs(rows):
    """All pairs of linked texts, through the words' own shingles."""
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, holders = {}, defaultdict(list)
    for i, text in rows:
        w = [x for x in (text or "").translate(up).replace("\n", " ").replace("\t", " ").split(" ") if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for s in sets[i]:
            holders[s].append(i)
    common = Counter()
    for ids in holders.values():
        common.update((a, b) for n, a in enumerate(ids) for b in ids[n + 1 :])
    return {(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)}


def test_recall_on_documents(spark):
    folder = os.environ.get("RECALL_SF_DIR", "/root/testdata/sf0.01")
    if not os.path.isdir(folder):
        pytest.skip(f"no test tables at {folder}")
    rows = [(r.doc_id, r.text) for r in read_table(spark, folder, "documents").select("doc_id", "text").collect()]
    component = {r.doc_id: r.component_id for r in QUERIES["op6_odd_sketch"](spark, folder).collect()}
    links = linked_pairs(rows)
    found = sum(component[a] == component[b] for a, b in links)
    assert links and found >= 0.99 * len(links)
    # and nothing else is put together
    tops = {i: i for i, _ in rows}
    for _ in range(len(rows)):
        before = dict(tops)
        for a, b in links:
            tops[a] = tops[b] = min(tops[a], tops[b])
        if before == tops:
            break
    assert all(tops[i] <= component[i] for i in tops)
