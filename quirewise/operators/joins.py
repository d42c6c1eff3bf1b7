"""Joins that Spark has no operator for: as-of, and points in intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str]) -> DataFrame:
    """Each left row with the columns ``take`` of the right row of its key that has the greatest ``on`` not above its own; null if none.

    One shuffle by key: both sides are put into one column order and the last right row is carried on. Of right rows with equal
    ``on`` the greatest values win; rows with a null ``on`` find nothing and are never found.
    """
    best = right.filter(F.col(on).isNotNull()).groupBy(*by, on).agg(F.max(F.struct(*take)).alias("_r"))
    a = left.select(*[F.col(c) for c in left.columns], F.lit(1).alias("_side"), F.lit(None).cast(best.schema["_r"].dataType).alias("_r"))
    b = best.select(*[(F.col(c) if c in [*by, on] else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in left.columns], F.lit(0).alias("_side"), "_r")
    w = Window.partitionBy(*by).orderBy(F.col(on).asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    return b.unionByName(a).withColumn("_r", F.last("_r", True).over(w)).filter("_side = 1").select(*left.columns, *[F.col(f"_r.{c}").alias(c if c not in left.columns else f"{c}_right") for c in take])


def within(points: DataFrame, intervals: DataFrame, by: list[str], at: Column | str, low: str, high: str, width: int) -> DataFrame:
    """Points with all intervals of their key that hold them, low <= at < high, as an equi-join on bins of ``width``.

    An interval stands in every bin it touches, so ``width`` should be about the length of most intervals; empty or null intervals
    hold nothing.
    """
    at = F.col(at) if isinstance(at, str) else at
    p = points.withColumn("_at", at).withColumn("_bin", F.floor(F.col("_at") / width))
    i = intervals.filter(F.col(low) < F.col(high)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    return p.join(i, [*by, "_bin"]).filter((F.col("_at") >= F.col(low)) & (F.col("_at") < F.col(high))).drop("_at", "_bin")
