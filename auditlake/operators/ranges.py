"""Numbers and running sums in a total order without a task that sees all rows: inside ranges, and offset by the ranges before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.sources.scratch import stored


def ranged(rows: DataFrame, *order: str | Column) -> DataFrame:
    """The rows in order, written, with `__part`, their range, and `__nth`, their place in it."""
    cut = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(cut.withColumn("__part", F.spark_partition_id()).withColumn("__nth", F.monotonically_increasing_id() % (1 << 33)), "ranges")


def _offset(cut: DataFrame, value: Column) -> DataFrame:
    """The sum over the ranges before each; one row per range is broadcast."""
    sums = cut.groupBy("__part").agg(F.sum(value).alias("__s"))
    before = sums.select(F.col("__part").alias("__p"), (F.sum("__s").over(Window.orderBy("__part")) - F.col("__s")).alias("__before"))
    return cut.join(F.broadcast(before), F.col("__part") == F.col("__p")).drop("__p")


def positions(rows: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """The rows with dense numbers from 0."""
    return _offset(ranged(rows, *order), F.lit(1).cast("long")).withColumn(name, F.col("__before") + F.col("__nth")).drop("__part", "__nth", "__before")


def running_sum(rows: DataFrame, value: str, name: str, *order: str | Column) -> DataFrame:
    """The rows with the sum of `value` up to each, itself included."""
    cut = _offset(ranged(rows, *order), F.col(value))
    inside = F.sum(value).over(Window.partitionBy("__part").orderBy("__nth"))
    return cut.withColumn(name, F.col("__before") + inside).drop("__part", "__nth", "__before")
