"""The vector join over many blocks: what it writes, and all pairs."""

import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from heatlens.llm import ego_join
from heatlens.staging import staging_dir


def files(spark):
    """Bytes of the files that shuffles and written tables have on disk, by path."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    tops = [d.toString() for d in manager.localDirs()] + [staging_dir(spark).removeprefix("file:")]
    return {p: os.path.getsize(p) for top in tops for d, _, names in os.walk(top) for n in names if os.path.exists(p := os.path.join(d, n))}


def all_pairs(ids, x):
    """``vec_id, n_links, component_id, kept`` of every row, by all pairs."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    at, links = [], np.zeros(len(x), int)
    for lo in range(0, len(x), 1000):
        r, c = np.nonzero(unit[lo : lo + 1000] @ unit.T >= 0.95)
        links[lo : lo + 1000] = np.bincount(r, minlength=len(unit[lo : lo + 1000])) - 1
        at.append((r + lo, c))
    r, c = map(np.concatenate, zip(*at))
    low = np.array(ids)
    while True:
        new = low.copy()
        np.minimum.at(new, r, low[c])
        if (new == low).all():
            return Counter((int(i), int(n), int(t), bool(i == t)) for i, n, t in zip(ids, links, low))
        low = new


def table(spark, folder, ids, x, kind):
    path = str(folder / "embeddings.parquet")
    pq.write_table(pa.table({"vec_id": pa.array(ids), "embedding": pa.array(list(x.astype(kind)))}), path)
    return spark.read.parquet(path), os.path.getsize(path)


def test_many_blocks_are_written_once(spark, tmp_path, monkeypatch):
    """Every block is near every other one here; no vector is written again for a pair of blocks."""
    random = np.random.default_rng(12)
    x = random.normal(size=(16000, 64))
    x[-1500:] = x[:1500] + random.normal(size=(1500, 64)) * 0.1
    x[8000:8400] = x[7999] + random.normal(size=(400, 64)) * 0.12
    x = x.astype("f4").astype("f8")
    ids = [int(i) for i in random.permutation(len(x))]
    monkeypatch.setattr(ego_join, "BLOCK", 512)
    vectors, size = table(spark, tmp_path, ids, x, "f4")
    before = files(spark)
    got = Counter(map(tuple, ego_join.near_vectors(vectors).collect()))
    written = sum(n for p, n in files(spark).items() if p not in before)
    assert got == all_pairs(ids, x)
    assert written <= 4 * size


@pytest.mark.parametrize("kind", ["f4", "f8"])
def test_classes_that_many_batches_hold(spark, tmp_path, monkeypatch, kind):
    """Equal vectors of several batches, tasks and ids are one class, in files of a few rows too."""
    random = np.random.default_rng(4)
    own = random.normal(size=(700, 12)).astype(kind).astype("f8")
    x = np.concatenate([own, np.repeat(own[:1], 5000, axis=0), np.repeat(own[1:40], 20, axis=0), own[40:80] * 2, own[:80] * (1 + 1e-3)])
    x = x.astype(kind).astype("f8")
    order = random.permutation(len(x))
    ids = [int(i) for i in random.integers(0, 5500, len(x))]
    monkeypatch.setattr(ego_join, "ROWS_PER_PART", 300)
    vectors, _ = table(spark, tmp_path, ids, x[order], kind)
    got = Counter(map(tuple, ego_join.near_vectors(vectors.repartition(3)).collect()))
    assert got == all_pairs(ids, x[order])


def test_leaves_that_are_left_hold_all_links():
    random = np.random.default_rng(6)
    x = np.sort(random.normal(size=(1500, 3)), axis=0) + random.normal(size=(1500, 3)) * 0.05
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = ego_join._Block(x[:1100], np.eye(3)[:, :2]), ego_join._Block(x[1100:], np.eye(3)[:, :2])
    eps2 = 0.1 + 1e-9
    for p, q, at, to in ((a, b, 0, 1100), (a, a, 0, 0), (b, a, 1100, 0)):
        left = np.zeros((len(p.single), len(q.single)), int)
        for rows, columns in p.near_leaves(q, eps2):
            left[rows, columns] += 1
        linked = unit[at : at + len(left)] @ unit[to : to + left.shape[1]].T >= 0.95
        if p is q:
            linked = np.triu(linked)
        assert left.max() == 1 and left[linked].all() and not left.all()
