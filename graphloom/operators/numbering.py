"""Exact places in a total order, without one task sorting everything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds `name`, the place of each row from 0 in the order of the columns `order` (nulls first); equal rows in any order.

    Rows are range-partitioned and sorted; the sizes of the partitions, one number each, are prefix-summed.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("o_part", F.spark_partition_id()).withColumn("o_row", F.monotonically_increasing_id())
    ranged = written(ranged)
    sizes = ranged.groupBy("o_part").agg(F.count("*").alias("n"), F.min("o_row").alias("o_first"))
    starts = sizes.select("o_part", "o_first", F.coalesce(F.sum("n").over(W.orderBy("o_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("o_start"))  # a row per partition
    return ranged.join(F.broadcast(starts), "o_part").withColumn(name, F.col("o_start") + F.col("o_row") - F.col("o_first")).drop("o_part", "o_row", "o_first", "o_start")
