"""A trace written for backward searches: slices in folders, rows in arrival order.

The accesses are numbered and cut into slices once. A search then reads the newest folders, and
further back only the folders of the slices it asks for: partition pruning instead of a filter on the
arrivals of each horizon, and neither a sort nor a numbering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from heatlens.functions import slices as sl
from heatlens.functions.buckets import key_bucket
from heatlens.operators.backward import BackwardResult, Tail, threshold_search
from heatlens.operators.ordinal import ArrivalProfile, profile_arrival, with_ordinal_slice
from heatlens.params import HeatParams
from heatlens.plans.classify import FIRST_ROWS, first_span
from heatlens.sources.trace import read_tagged, write_tagged

# Folders are few and long enough to be read by many tasks each.
FOLDERS = 256


def _folder_span(end: int) -> int:
    return -(-end // FOLDERS)


def write_layout(accesses: DataFrame, path: str, params: HeatParams = HeatParams(), profile: ArrivalProfile | None = None) -> None:
    """Write ``(key, arrival, slice)``, a folder ``span`` for each run of slices, sorted by arrival."""
    profile = profile or profile_arrival(accesses)
    size = params.slice_size(profile.rows)
    sliced = with_ordinal_slice(accesses.select("key", "arrival"), profile, lambda n: sl.bucketed_slice(n, size))
    span = _folder_span(profile.rows // size + 1)
    write_tagged(sliced.withColumn("span", sl.int_div("slice", span).cast("int")), path, "span", order="arrival")


def layout_tail(spark: SparkSession, path: str, end: int) -> Tail:
    """Newest-first reads of a written layout whose last slice is ``end``."""
    table, span = read_tagged(spark, path), _folder_span(end)

    def tail(t: int, before: int | None = None) -> DataFrame:
        rows = table.filter((F.col("span") >= F.lit(t // span)) & (F.col("slice") >= F.lit(t)))
        if before is not None:
            rows = rows.filter((F.col("span") <= F.lit((before - 1) // span)) & (F.col("slice") < F.lit(before)))
        return rows.select("key", "slice")

    return tail


def search_layout(
    spark: SparkSession, path: str, params: HeatParams = HeatParams(), first_rows: int = FIRST_ROWS
) -> BackwardResult:
    """The backward search over a layout written with the same ``params``."""
    rows = read_tagged(spark, path).count()
    size = params.slice_size(rows)
    return threshold_search(
        layout_tail(spark, path, rows // size + 1),
        rows // size + 1,
        params.budget(rows + 1),
        lambda df: df.withColumn("bucket", key_bucket("key", params.buckets)),
        params.alpha,
        params.digits,
        first_span(size, first_rows),
    )


def classify_layout(spark: SparkSession, path: str, params: HeatParams = HeatParams()) -> DataFrame:
    return search_layout(spark, path, params).hot
