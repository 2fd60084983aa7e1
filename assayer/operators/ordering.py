"""Gapless numbers over sorted data without a window that sees a whole key, or the whole table.

Rows are sorted by range partitions. A row's number is its place in its partition plus what the partitions before
hold of its key; only these counts, one per key and partition, are summed in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.session import materialize


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], out: str) -> DataFrame:
    """``df`` with ``out``: the row's number from 0 within ``keys`` (or overall) in the given order.

    Null keys are keys. Rows that ``order`` does not tell apart are numbered in any order.
    """
    by = [*keys, *order]
    at = F.col("_at")
    rows = materialize(
        df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "numbered"
    ).withColumn("_part", F.shiftright(at, 33))
    counts = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    one = keys or [F.lit(0)]  # overall: one count per partition
    before = Window.partitionBy(*one).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), "_first", "_before"
    )
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    found = rows.join(offsets, same)
    return found.select(*df.columns, (F.col("_before") + at - F.col("_first")).alias(out))


def neighbours(df: DataFrame, keys: list[str], order: str, previous: str) -> DataFrame:
    """``df`` with ``previous``: the value of ``order`` in the row before, within ``keys``; null for the first.

    Within a range partition it is a lag; across partitions it is the greatest value of the key in those before.
    """
    by = [*keys, order]
    rows = materialize(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "neighbours")
    ends = rows.groupBy(*keys, "_part").agg(F.max(order).alias("_last"))
    one = keys or [F.lit(0)]
    before = Window.partitionBy(*one).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.max("_last").over(before)).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), "_carried"
    )
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy("_part", *keys).orderBy(order)
    return rows.withColumn("_lag", F.lag(order).over(inside)).join(carried, same).select(
        *df.columns, F.coalesce("_lag", "_carried").alias(previous)
    )
