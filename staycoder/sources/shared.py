"""Tables written once to the cluster's shared folder and read back.

Used to cut lineage where rows must not be computed twice (sampled model output, training features)
and for small derived tables: once written, their size is known to Spark, which then broadcasts
them if they are below spark.sql.autoBroadcastJoinThreshold and otherwise shuffles both sides.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir (or the context's checkpoint folder); a temporary one in local mode only."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="staycoder-")
    context.setCheckpointDir(folder)
    return folder


def write_once(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write `df` under the shared folder and return the stored table.

    The folder is the application's scratch space: nothing is deleted here, later reads may need it. With `free`
    the shuffle files of this write go when it ends, not when the driver happens to collect garbage (Spark 4.1;
    older versions ignore the setting), and the table is compressed harder.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not free:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    before = spark.conf.get(FREES_SHUFFLES, None)
    spark.conf.set(FREES_SHUFFLES, "true")
    try:
        # only a frame planned under the setting frees its shuffles
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FREES_SHUFFLES)
        else:
            spark.conf.set(FREES_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def file_row_key() -> Column:
    """Key of a row of a parquet table: its file (as a 64-bit hash of the path) and its place in it. Nothing is copied."""
    return F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def with_row_key(df: DataFrame, key: str = "doc_key") -> DataFrame:
    """Give every row a unique key that stays the same however often the table is read.

    The generated ids depend on how the rows are split, so the table is stored with them.
    """
    return write_once(df.withColumn(key, F.monotonically_increasing_id()), "rows")


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Repartition a scan if it has fewer partitions than the cluster has cores.

    Text work is heavy per byte, and a small or unsplittable file would otherwise be one task.
    On large inputs the scan already has enough partitions and nothing is shuffled. With the row
    key given, its hash layout also serves a later grouping by that key.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key) if key else df.repartition(cores)
