"""Block-access traces: one access per line, nine fields split by single spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from heatlens.staging import small_table, stage

# The positional layout of a trace line. Only ``ts`` and ``block``
# matter to the estimators.
TRACE_FIELDS = (
    ("ts", "bigint"),
    ("pid", "int"),
    ("process", "string"),
    ("block", "bigint"),
    ("n_sectors", "int"),
    ("rw", "string"),
    ("major", "int"),
    ("minor", "int"),
    ("digest", "string"),
)

BROADCAST_BLOCKS = 1_000_000
# Rows of a file of a tagged trace.
ROWS_PER_FILE = 5_000_000


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(value, file, block_start, line)``: raw lines and where they stand.

    ``line`` grows along a file block but means nothing across blocks;
    :func:`with_file_order` turns the three into an ordinal.
    """
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def fields_of(value: Column | str) -> Column:
    """A line's fields. Empty fields at the end of a line do not count."""
    text = F.col(value) if isinstance(value, str) else value
    return F.split(F.rtrim(text), " ")


def valid_lines(lines: DataFrame, fields: int = len(TRACE_FIELDS), value: str = "value") -> DataFrame:
    """Lines with exactly ``fields`` fields; all others are skipped."""
    return lines.filter(F.size(fields_of(value)) == F.lit(fields))


def parse_trace(lines: DataFrame, tagged: bool = False, value: str = "value") -> DataFrame:
    """Typed columns of the valid lines, other columns kept.

    ``tagged`` lines carry a tenth field, the slice. A number that does not parse
    becomes null; :func:`trace_accesses` leaves such rows out.
    """
    layout = (*TRACE_FIELDS, ("slice", "int")) if tagged else TRACE_FIELDS
    kept = [c for c in lines.columns if c != value]
    parts = valid_lines(lines, len(layout), value).withColumn("__parts", fields_of(value))
    return parts.select(
        *[F.col("__parts")[i].try_cast(kind).alias(name) for i, (name, kind) in enumerate(layout)],
        *kept,
    )


def read_trace(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The valid accesses of text traces, typed, in no particular order."""
    return parse_trace(read_lines(spark, path))


def with_file_order(rows: DataFrame, n: str = "n") -> DataFrame:
    """Add the 0-based ordinal of each row in (file, position) order.

    Rows of a file block are read by one task in file order, so a running id
    numbers them without a shuffle. The numbered rows are written once: a second
    scan of the text could be split differently. Each block's offset then
    comes from a table with one row per block, summed up in ranges of blocks.
    """
    numbered = stage(rows.withColumn("__line", F.monotonically_increasing_id()), "trace")
    blocks = numbered.groupBy("file", "block_start").agg(
        F.min("__line").alias("__first"), F.count("*").alias("__rows")
    )
    blocks = stage(_with_offset(blocks), "blocks")
    if blocks.count() <= BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    return (
        numbered.join(blocks, ["file", "block_start"])
        .withColumn(n, F.col("__offset") + F.col("__line") - F.col("__first"))
        .drop("__line", "__first", "__offset", "file", "block_start")
    )


def _with_offset(blocks: DataFrame) -> DataFrame:
    """``__offset``, the rows of all earlier file blocks, in place of ``__rows``.

    Blocks are sorted into ranges, written with their range, and summed within it; the
    driver holds one total per range, of which there are as many as shuffle partitions.
    """
    spark = blocks.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(
        blocks.repartitionByRange(ranges, "file", "block_start").withColumn("__range", F.spark_partition_id()),
        "ranges",
    )
    totals = placed.groupBy("__range").agg(F.sum("__rows").alias("rows")).orderBy("__range").collect()
    starts, running = [], 0
    for r in totals:
        starts.append((r["__range"], running))
        running += r["rows"]
    table = small_table(spark, starts, "__range int, __start bigint")
    earlier = (
        Window.partitionBy("__range").orderBy("file", "block_start").rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = F.coalesce(F.sum("__rows").over(earlier), F.lit(0))
    return (
        placed.withColumn("__offset", inside)
        .join(F.broadcast(table), "__range")
        .withColumn("__offset", F.col("__start") + F.col("__offset"))
        .drop("__rows", "__range", "__start")
    )


def trace_accesses(trace: DataFrame, key: str = "block", ts: str = "ts", arrival: str = "n") -> DataFrame:
    """``(key, ts, arrival)``: the two fields that count, and the order."""
    return trace.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(arrival).alias("arrival")
    )


def newest_first(accesses: DataFrame, order: str = "arrival") -> DataFrame:
    """Rows from the newest to the oldest (a range sort)."""
    return accesses.orderBy(F.desc(order))


def write_tagged(
    tagged: DataFrame, path: str, by: str, rows_per_file: int = ROWS_PER_FILE, order: str | None = None
) -> None:
    """Write a tagged trace as Parquet, one folder per ``by`` (a block bucket, a time partition or a range of
    slices). A folder's rows are first counted and then spread over shares of about ``rows_per_file``, so
    a hot one is written by as many tasks as its size asks for. With ``order``, shares are ranges of it and files are
    sorted by it, so that a filter on it skips files and row groups."""
    counts = tagged.groupBy(by).agg(F.count("*").alias("__rows"))
    shares = counts.select(F.col(by).alias("__by"), F.ceil(F.col("__rows") / rows_per_file).cast("int").alias("__shares")).collect()
    kind = tagged.schema[by].dataType.simpleString()
    table = small_table(tagged.sparkSession, [tuple(r) for r in shares], f"__by {kind}, __shares int")
    tasks = max(1, sum(r["__shares"] for r in shares))
    if order is None:
        split = tagged.join(F.broadcast(table), F.col(by).eqNullSafe(F.col("__by")), "left")
        share = F.pmod(F.xxhash64(*tagged.columns), F.col("__shares"))
        dealt = split.withColumn("__share", share).repartition(tasks, by, "__share").select(*tagged.columns)
    else:
        dealt = tagged.repartitionByRange(tasks, by, order).sortWithinPartitions(by, order)
    dealt.write.mode("error").partitionBy(by).parquet(path)


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """Scan a tagged trace; a filter on the folder column prunes folders."""
    return spark.read.parquet(path)


def format_trace(df: DataFrame, *fields: Column | str) -> DataFrame:
    """Lines of text from columns, in the given order."""
    cols = [F.col(f) if isinstance(f, str) else f for f in fields]
    return df.select(F.concat_ws(" ", *[c.cast("string") for c in cols]).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("error").text(path)
