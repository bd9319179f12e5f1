"""Helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from heatlens.staging import stage

# A table of keys and a few numbers is broadcast up to so many rows, tens of megabytes
# at most; beyond that it is joined by a shuffle.
BROADCAST_ROWS = 200_000


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def partitions_for(spark: SparkSession, rows: int, rows_per_partition: int) -> int:
    """The session's shuffle partitions, or more if these would get too many rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_partition))


def chunks(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``rows`` rows, so that Python objects made of one stay few."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut there."""
    return stage(df, f"llm-{name}")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, hot_share: int = 1024, how: str = "inner") -> DataFrame:
    """Inner (or left) join of ``rows`` with ``groups`` (one row per ``key``, with the number of rows
    it has in ``size``). Groups that hold over 1/``hot_share`` of all rows, of which
    there are fewer than ``hot_share``, are broadcast, so no task gets a hot group.
    ``groups`` should be cheap to read twice (a written table).
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.filter(F.col(size) > total / hot_share)
    cold = groups.filter(F.col(size) <= total / hot_share)
    keys = hot.select(key)
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(F.broadcast(keys), key, "left_anti").join(cold, key, how)
    )
