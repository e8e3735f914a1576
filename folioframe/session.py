"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}

UNEVEN = 3  # times a fair share of rows that one partition may hold before rows are dealt anew


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for durable intermediate data.

    ``spark.checkpoint.dir`` of the session; a local folder only where it is unset
    and Spark itself runs locally.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="spark-shared-")
    return _local[app]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def reuse(df: DataFrame) -> DataFrame:
    """Write a frame that several branches read, and read it back.

    The copy survives lost executors, is computed once, and its true size lets the
    optimizer pick the join strategy.
    """
    spark = df.sparkSession
    path = new_folder(spark, "reuse")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores for a frame whose rows come in fewer partitions than there are.

    A large file of one row group is cut into many partitions, of which one holds all rows; so
    rows are counted, from the footers alone where nothing is filtered.  A frame that already
    fills its partitions is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    there = df.rdd.getNumPartitions()
    if there >= cores:
        rows = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"))
        most, total = rows.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if most * cores <= UNEVEN * total:
            return df
    return df.repartition(max(cores, there), *keys)
