"""Session set-up and written intermediate tables.

Iterative operators cut their lineage with a table written to the shared
checkpoint folder. Such a table outlives any executor, and unlike a checkpointed
RDD it stays columnar, so later reads still prune columns.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_session(app: str = "heatlens", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster use your own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def staging_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's checkpoint folder.

    Only a local session without one gets a temporary folder of its own.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="heatlens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file:{folder}")
    return f"file:{folder}"


def _own_dir(spark: SparkSession) -> str:
    return f"{staging_dir(spark)}/heatlens-{spark.sparkContext.applicationId}"


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_staged(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. Results that still
    read from them can no longer be computed."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A table of driver-side scalars. It becomes part of the plan, so joining it
    costs no job. Only for rows whose number does not grow with the data."""
    schema = StructType.fromDDL(ddl)
    columns = zip(*rows) if rows else [[] for _ in schema]
    arrow = to_arrow_schema(schema)
    table = pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, schema)
