"""Several stores as one: writes go to a tenant's shard, reads merge all that must be seen, administration visits every one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.keys import RsaRing
from auditlake.operators.checkpoints import global_checkpoint, global_problems
from auditlake.operators.sharding import Ring
from auditlake.plans.query import LogQuery, decode_cursor, encode_cursor
from auditlake.streaming import admin
from auditlake.streaming.ingest import Store


@dataclass
class Fleet:
    """A ring and the stores of its shards."""

    ring: Ring
    stores: dict[int, Store]

    def apply(self, events: DataFrame, batch: int, tenant: Column, source: str = "stream") -> None:
        """One micro-batch, each event to the owner of its tenant. A shard that has the batch already skips it, so a batch may run again."""
        routed = events.withColumn("__shard", self.ring.route(tenant))
        for shard in self.ring.active:
            self.stores[shard].apply(routed.where(F.col("__shard") == shard).drop("__shard"), batch, source)

    def each(self, work: Callable[[Store], Any], shards: list[int] | None = None) -> tuple[dict[int, Any], dict[int, str]]:
        """What `work` gives for each shard, and the errors of those that failed."""
        done, failed = {}, {}
        for s in shards if shards is not None else self.ring.read_targets(None):
            try:
                done[s] = work(self.stores[s])
            except Exception as e:  # noqa: BLE001  one shard's failure must not hide the others
                failed[s] = str(e).splitlines()[0]
        return done, failed

    def page(self, q: LogQuery, tenant: str | None = None) -> tuple[DataFrame | None, str | None, dict[int, str]]:
        """The newest or oldest matches of all shards by time, shard and position, the next page's cursor, and the shards left out.

        Every shard gives its own first rows; the merged page is their best. The cursor is the last row's key, so it holds while logs
        come and go, and a shard that fails now is seen again by the next page.
        """
        if q.limit is None or q.limit < 1:
            raise ValueError("a merged page needs a limit")
        desc = q.order == "desc"
        key = decode_cursor(q.cursor, q.order, 3) if q.cursor else None
        order = [F.desc(c) if desc else F.asc(c) for c in ("ts_us", "shard", "pos")]

        def rows(s: int):
            def work(store: Store) -> DataFrame:
                data = store.snapshot().dataset()
                found = data.matching(replace(q, cursor=None)).withColumn("shard", F.lit(s))
                if key:
                    mine, at = F.struct("ts_us", "shard", "pos"), F.struct(F.lit(key[0]).cast("long").alias("ts_us"), F.lit(key[1]).alias("shard"), F.lit(key[2]).cast("long").alias("pos"))
                    # the bound on time alone reaches the scan
                    found = found.where(F.col("ts_us") <= key[0] if desc else F.col("ts_us") >= key[0]).where(mine < at if desc else mine > at)
                made = found.orderBy(*order).limit(q.limit + 1).toArrow()  # a page's rows
                return store.spark.createDataFrame(made, found.schema)

            return work

        parts, failed = {}, {}
        for s in self.ring.read_targets(tenant):
            done, bad = self.each(rows(s), [s])
            parts |= done
            failed |= bad
        if not parts:
            return None, None, failed
        every = None
        for part in parts.values():
            every = part if every is None else every.unionByName(part)
        best = every.orderBy(*order).limit(q.limit + 1).collect()
        cursor = encode_cursor(q.order, *(best[q.limit - 1][c] for c in ("ts_us", "shard", "pos"))) if len(best) > q.limit else None
        best, shown = best[: q.limit], None
        for s, part in parts.items():
            mine = [r.pos for r in best if r.shard == s]
            if mine:
                one = self.stores[s].snapshot().dataset().render(part.where(F.col("pos").isin(mine)))
                shown = one if shown is None else shown.unionByName(one)
        shown = every.limit(0) if shown is None else shown
        return shown.orderBy(*order), cursor, failed

    def count(self, q: LogQuery, tenant: str | None = None) -> tuple[int, dict[int, str]]:
        """Matches of all shards that a read must see, and the shards left out."""
        done, failed = self.each(lambda store: store.snapshot().dataset().count(q).first().n, self.ring.read_targets(tenant))
        return sum(done.values()), failed

    def verify(self) -> dict:
        """One report of all shards; a shard that cannot be read is a problem."""
        done, failed = self.each(admin.verify)
        report = admin.merged_reports(done)
        return report | {"ok": report["ok"] and not failed, "problems": report["problems"] + [f"shard {s}: {e}" for s, e in sorted(failed.items())]}

    def redrive(self) -> dict[int, str]:
        return self.each(Store.redrive)[1]

    def purge(self, cutoff: int | None = None, budget: int | None = None) -> tuple[dict[int, list[int]], dict[int, str]]:
        """Retention of every shard, each by its own budget."""
        return self.each(lambda store: admin.purge(store, cutoff, budget))

    def _roots(self) -> dict[int, tuple[int, bytes]]:
        return self.each(lambda store: (store.last["logs_size"], store.snapshot().tree().root()))[0]

    def checkpoint(self, keys: RsaRing, at: int) -> dict:
        """A signed record of all shards' sizes and roots and of the ring."""
        return global_checkpoint(self._roots(), self.ring.manifest_hash(), keys, at)

    def problems(self, made: dict, keys: RsaRing) -> list[str]:
        """What a signed record shows against the shards now."""
        return global_problems(made, self._roots(), self.ring.manifest_hash(), keys)
