"""The two Bloom passes of exact dedup: what they let pass, and that they miss no repeated text."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from heatlens.llm import exact_dedup


def numbered(spark, sizes):
    """Text ``t<i>``, ``sizes[i]`` times, spread over all partitions."""
    rows = [(f"t{i}",) for i, size in enumerate(sizes) for _ in range(size)]
    return spark.createDataFrame(rows, "text string").repartition(7).withColumn(
        "doc_id", F.monotonically_increasing_id()
    )


def passing(docs):
    prints = docs.select("text", exact_dedup.fingerprint(F.col("text")).alias("print"))
    twice, blocks = exact_dedup.repeated_filter(prints, "print")
    rows = exact_dedup.probe(prints, "print", twice, blocks).filter("__maybe").collect()
    return Counter(r.text for r in rows), twice.count(), blocks


def test_distinct_texts_pass_straight_through(spark):
    passed, _, _ = passing(numbered(spark, [1] * 50_000))
    assert passed.total() < 500


@pytest.mark.parametrize("blocks", [1, 64, 1 << 20])
def test_no_repeated_text_is_missed(spark, monkeypatch, blocks):
    monkeypatch.setattr(exact_dedup, "MAX_BLOCKS", blocks)
    monkeypatch.setattr(exact_dedup, "block_count", lambda rows, width, most, bits: min(most, 1 << 13))
    sizes = [1] * 4000 + [2, 3, 4, 5, 6, 7] * 100 + [3000]
    passed, cells, used = passing(numbered(spark, sizes))
    assert cells <= used <= blocks
    assert all(passed[f"t{i}"] == size for i, size in enumerate(sizes) if size > 1)
    docs = numbered(spark, sizes)
    groups = {r.text_sha256: (r.group_size, r.n, r.kept) for r in exact_dedup.duplicate_report(docs).groupBy(
        "text_sha256", "group_size").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()}
    assert Counter(groups.values()) == Counter((size, size, 1) for size in sizes)
    assert exact_dedup.drop_duplicates(docs).count() == len(sizes)


def test_first_pass_sends_a_row_per_block_and_task(spark, monkeypatch):
    """The exchange of the first pass is keyed by the block alone, after a partial aggregate."""
    plans = []
    monkeypatch.setattr(exact_dedup, "staged", lambda df, name: plans.append(df) or df)
    prints = numbered(spark, [1, 2, 3]).select(exact_dedup.fingerprint(F.col("text")).alias("print"))
    exact_dedup.repeated_filter(prints, "print")
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    first = plan[plan.index("hashpartitioning(") :]
    assert first.startswith("hashpartitioning(__block#") and "__bits" not in first.split(")")[0]
    assert "partial_bit_or" in plan and "partial_bit_xor" in plan
