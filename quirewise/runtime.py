"""Session helpers shared by all operators: table reading, shared folder, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the one the cluster names in spark.checkpoint.dir.

    Where that is unset a temporary folder serves, but only in a single JVM: on a cluster the executors share none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "quirewise-shared")
        os.makedirs(base, exist_ok=True)
        base = f"file://{base}"
    return f"{base.rstrip('/')}/quirewise-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: one evaluation, a short lineage, safe when executors go."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    _delete_at_the_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete_at_the_end(spark: SparkSession, path: str) -> None:
    """Have the file system delete the folder when the driver ends: results may be read as long as it lives."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer partitions than there are; larger inputs stay as they are, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
