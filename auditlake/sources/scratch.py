"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, as in tests, below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Writes the rows, partitioned if asked, and reads them back: one evaluation, whatever comes after."""
    path = shared_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, most: int, *by: str) -> DataFrame:
    """`rows` rows dealt to partitions of about `most`, so that a task's work and memory do not grow with the table; Spark keeps such a number."""
    return df.repartition(max(1, -(-rows // most)), *by)
