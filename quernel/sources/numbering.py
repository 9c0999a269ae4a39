"""Consecutive numbers for rows without gathering them in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def consecutive(df: DataFrame, column: str, first: int) -> DataFrame:
    """df with ``column`` holding first, first + 1, ... in the order of partitions and of rows in them.

    Both passes, the one that counts and the one that numbers, are over one RDD, so partitions are the same in both;
    rows stay in the JVM. The counts, one a partition, go through the driver.
    """
    rows = df._jdf.queryExecution().toRdd()
    fixed = DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), df.sparkSession)
    parts = rows.getNumPartitions()
    held = dict(map(tuple, fixed.groupBy(F.spark_partition_id()).count().collect())) if parts > 1 else {}
    starts = accumulate((held.get(k, 0) for k in range(parts - 1)), initial=first)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # in the row's partition
    start = F.expr(f"array({', '.join(f'{n}L' for n in starts)})")[F.spark_partition_id()]
    return fixed.withColumn(column, start + place)
