"""Blocks of a bucket give no more links than they have members, whatever their size."""

import numpy as np
import pandas as pd
from test_llm import brute_near

from heatlens.llm import components, near_dedup


def side(sets, query, bucket, bands):
    return pd.DataFrame(
        {
            "bucket": bucket, "i": 0, "j": 0, "query": query, "id": np.arange(len(sets)), "failed": True, "n": [len(s) for s in sets],
            "bands": bands, "shingles": [np.sort(s).view(np.int64) for s in sets], "component": np.arange(len(sets)),
        }
    )


def block_of(sets, bucket, bands):
    return pd.concat([side(sets, True, bucket, bands), side(sets, False, bucket, bands)], ignore_index=True)


def near_copies(n, changed):
    random = np.random.default_rng(11)
    base = random.integers(0, 2**63, size=200, dtype=np.uint64)
    return [np.unique(np.concatenate([base[changed:], random.integers(0, 2**63, size=changed, dtype=np.uint64)])) for _ in range(n)]


def test_a_block_of_copies_gives_a_link_a_member():
    bands = [np.full(32, 5)] * 60
    assert len(near_dedup._linked_in_block(block_of(near_copies(60, 10), 5, bands))) == 59
    # 170 common of 230: likely by the sketches, yet no links
    assert len(near_dedup._linked_in_block(block_of(near_copies(60, 30), 5, bands))) == 0


def test_texts_are_compared_in_their_first_common_bucket():
    sets, bands = near_copies(6, 10), [np.array([4, 5] + [100 * i + j for j in range(30)]) for i in range(6)]
    assert len(near_dedup._linked_in_block(block_of(sets, 4, bands))) == 5
    assert len(near_dedup._linked_in_block(block_of(sets, 5, bands))) == 0


def test_small_blocks_find_all_links(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_FAILED", 3)
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 7)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 400)
    sizes = {}

    def counted(df, name):
        table = staged(df, name)
        sizes.setdefault(name, []).append(table.count())
        return table

    staged = near_dedup.staged
    monkeypatch.setattr(near_dedup, "staged", counted)
    random = np.random.default_rng(3)
    base = [f"w{x}" for x in random.integers(0, 500, 120)]
    rows = []
    for i in range(90):
        words = list(base)
        for at in random.integers(0, 120, i % 9):
            words[at] = f"x{i}"
        rows.append((i, " ".join(words)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(rows)
    assert max(n for name, many in sizes.items() for n in many) <= near_dedup.BANDS * len(rows)
    assert sizes["bucket-links"][0] <= sizes["open-members"][0]


def test_links_of_one_task_and_of_many_give_the_same(spark, monkeypatch):
    random = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in random.integers(0, 300, (260, 2))] + [(1000 - i, 999 - i) for i in range(200)]
    links = spark.createDataFrame(pairs, "u long, v long")
    one = {tuple(r) for r in components.components(links).collect()}
    monkeypatch.setattr(components, "LOCAL_LINKS", 0)
    assert one == {tuple(r) for r in components.components(links).collect()}
    assert components.components(links.limit(0)).count() == 0
