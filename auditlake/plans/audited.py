"""Reads that leave a record: who asked what, with how many results, but never what was searched for."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.plans.catalog import Policy
from auditlake.plans.query import Dataset, LogQuery

ACCESS = "id string, ts_us long, actor string, operation string, params string, result_count long"


class AuditedReader:
    """A dataset behind a policy and an access log, a Parquet table of its own with its own retention."""

    def __init__(self, spark: SparkSession, data: Dataset, path: str, policy: Policy):
        self.spark, self.data, self.path, self.policy = spark, data, path, policy

    def _record(self, actor: str, operation: str, params: str, count: int) -> None:
        row = (uuid.uuid4().hex, time.time_ns() // 1000, actor, operation, params, count)
        self.spark.createDataFrame([row], ACCESS).coalesce(1).write.mode("append").parquet(self.path)

    def page(self, actor: str, role: str, q: LogQuery) -> tuple[DataFrame, str | None]:
        """A page and its cursor; the record is written before anything is returned."""
        self.policy.require(role, "query")
        rows, cursor = self.data.page(q)
        self._record(actor, "query_page", q.summary(), rows.count())
        return rows, cursor

    def count(self, actor: str, role: str, q: LogQuery) -> int:
        self.policy.require(role, "query")
        n = self.data.count(q).first().n
        self._record(actor, "count", q.summary(), n)
        return n

    def run(self, actor: str, role: str, operation: str, work: Callable[[], Any], right: str = "administer") -> Any:
        """An administrative act or another read: its record is written before its result is returned, and refusals and failures leave none."""
        self.policy.require(role, right)
        out = work()
        self._record(actor, operation, "{}", out.count() if isinstance(out, DataFrame) else len(out) if isinstance(out, (list, dict)) else 1)
        return out

    def records(self, actor: str | None = None, operation: str | None = None, from_micros: int | None = None, to_micros: int | None = None, limit: int | None = None) -> DataFrame:
        """Access records, oldest first; reading them leaves no record."""
        rows = self.spark.read.schema(ACCESS).parquet(self.path)
        if actor is not None:
            rows = rows.where(F.col("actor") == actor)
        if operation is not None:
            rows = rows.where(F.col("operation") == operation)
        if from_micros is not None:
            rows = rows.where(F.col("ts_us") >= from_micros)
        if to_micros is not None:
            rows = rows.where(F.col("ts_us") <= to_micros)
        rows = rows.orderBy("ts_us", "id")
        return rows if limit is None else rows.limit(limit)
