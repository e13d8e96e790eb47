"""Consistent hashing of tenants to shards, and reads over several shards."""

from __future__ import annotations

import bisect
import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = 64


def text_hash(text: str) -> int:
    """60 bits of SHA-256, as `column_hash` gives."""
    return int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)


def column_hash(c: Column) -> Column:
    return F.conv(F.substring(F.sha2(c.cast("binary"), 256), 1, 15), 16, 10).cast("long")


@dataclass(frozen=True)
class Ring:
    """Active shards own points of a ring; frozen ones take no writes but are still read."""

    active: tuple[int, ...]
    frozen: tuple[int, ...] = ()
    seed: int = 0

    def points(self) -> list[tuple[int, int]]:
        return sorted((text_hash(f"{self.seed}/{s}/{i}"), s) for s in self.active for i in range(POINTS))

    def owner(self, tenant: str) -> int:
        p = self.points()
        return p[bisect.bisect_left(p, (text_hash(f"{self.seed}:{tenant}"), -1)) % len(p)][1]

    def read_targets(self, tenant: str | None) -> list[int]:
        """Shards a read of the tenant must see; all of them without one."""
        return sorted({self.owner(tenant), *self.frozen}) if tenant is not None else sorted({*self.active, *self.frozen})

    def freeze(self, shard: int) -> Ring:
        if shard in self.frozen:
            return self
        if self.active == (shard,):
            raise ValueError("the last active shard cannot be frozen")
        return Ring(tuple(s for s in self.active if s != shard), (*self.frozen, shard), self.seed)

    def add(self, shard: int) -> Ring:
        return self if shard in self.active else Ring((*self.active, shard), tuple(s for s in self.frozen if s != shard), self.seed)

    def manifest_hash(self) -> str:
        return hashlib.sha256(repr((sorted(self.active), sorted(self.frozen), self.seed)).encode()).hexdigest()

    def route(self, tenant: Column) -> Column:
        """The owner as a column: the first point at or after the tenant's hash, else the first point.

        Points are kept by the top 8 bits of their hash, so a row looks at one or two of them.
        """
        points = self.points()
        h = column_hash(F.concat(F.lit(f"{self.seed}:"), tenant.cast("string")))
        lots = [[p for p, _ in points if p >> 52 == k] for k in range(256)]
        base = [sum(p >> 52 < k for p, _ in points) for k in range(256)]
        lot = (F.shiftright(h, 52) + 1).cast("int")
        here = F.element_at(F.array(*[F.array(*map(F.lit, x)).cast("array<long>") for x in lots]), lot)
        before = F.element_at(F.array(*map(F.lit, base)), lot) + F.size(F.filter(here, lambda x: x < h))
        return F.element_at(F.array(*[F.lit(s) for _, s in points]), F.pmod(before, F.lit(len(points))).cast("int") + 1)

    def route_sql(self, tenant: str) -> str:
        """The same in DuckDB SQL."""
        points = self.points()
        h = f"('0x' || substr(sha256('{self.seed}:' || {tenant}::VARCHAR), 1, 15))::BIGINT"
        before = f"len(list_filter([{', '.join(str(p) for p, _ in points)}]::BIGINT[], lambda x: x < {h}))"
        return f"[{', '.join(str(s) for _, s in points)}][({before} % {len(points)}) + 1]"


def merged_page(rows: DataFrame, limit: int, after: tuple[int, int] | None = None) -> DataFrame:
    """The newest rows of all shards by (ts_us, pos), behind a key if given; one more row than the limit."""
    if after:
        rows = rows.where((F.col("ts_us") < after[0]) | ((F.col("ts_us") == after[0]) & (F.col("pos") < after[1])))
    return rows.orderBy(F.desc("ts_us"), F.desc("pos")).limit(limit + 1)
