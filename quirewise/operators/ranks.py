"""Numbering of rows within groups that no single task could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirewise.runtime import materialise


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """(by, order, name): the distinct order values of each group, numbered from 1.

    The values are range-partitioned over all groups together, numbered in each partition, and moved on by what a group has in the
    partitions before; a group with most of the rows thus lies in many partitions. Rows of a null group aren't numbered.
    """
    keys = rows.select(*by, *order).distinct()
    for c in by:
        keys = keys.filter(F.col(c).isNotNull())
    ranged = materialise(keys.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    out = ranged.withColumn("_k", local).join(sizes.withColumn("_before", before), [*by, "_part"])
    return out.select(*by, *order, (F.col("_k") + F.col("_before")).cast("int").alias(name))
