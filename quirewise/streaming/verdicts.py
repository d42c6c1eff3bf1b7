"""Checks over arriving sentences: a watermarked stream, counts of flags in windows, and verdicts brought up to date per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirewise.functions import patterns as P
from quirewise.functions import text as T


def arriving(spark: SparkSession, path: str, schema, delay: str = "90 days", files_per_batch: int = 1) -> DataFrame:
    """Sentences as they are loaded, each once: rows that come again within the delay are dropped."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    raw = raw.withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    return raw.withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(["paper_id", "text_id"])


def windowed_flags(stream: DataFrame, flags: list[str], width: str = "30 days") -> DataFrame:
    """Counts of flagged sentences in tumbling windows of the time they were loaded."""
    w = F.window("loaded_at", width)
    return stream.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(T.flag("text", P.FLAGS[f])).alias(f"n_{f}") for f in flags]).select("w.start", "w.end", "n", *[f"n_{f}" for f in flags])


def keep_counts(stream: DataFrame, flags: list[str], folder: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's counts per paper and flag; a repeated batch overwrites its own folder, so nothing counts twice."""

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("paper_id").agg(*[F.count_if(T.flag("text", P.FLAGS[f])).alias(f"n_{f}") for f in flags])
        counts.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str, flags: list[str]) -> DataFrame:
    """Counts of all batches so far, per paper."""
    return spark.read.parquet(folder).groupBy("paper_id").agg(*[F.sum(f"n_{f}").alias(f"n_{f}") for f in flags])
