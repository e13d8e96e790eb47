"""Counters and health of a store, from its commits and from Spark's streaming listener."""

from __future__ import annotations

import time

from pyspark.sql.streaming import StreamingQueryListener

from auditlake.operators.lifecycle import LATENCY_BOUNDS
from auditlake.streaming import admin
from auditlake.streaming.ingest import Store


class Metrics(StreamingQueryListener):
    """Counts batches, rows and their seconds as Spark reports them; add it with `spark.streams.addListener`."""

    def __init__(self):
        self.counters = {"batches": 0, "rows": 0, "failed_queries": 0}
        self.buckets, self.seconds, self.last_batch = [0] * (len(LATENCY_BOUNDS) + 1), 0.0, None

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.observe(event.progress.numInputRows, event.progress.batchDuration / 1000)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.counters["failed_queries"] += event.exception is not None

    def observe(self, rows: int, seconds: float) -> None:
        """One batch. Buckets hold seconds per row, as single writes would."""
        self.counters["batches"] += 1
        self.counters["rows"] += rows
        self.seconds += seconds
        self.last_batch = time.time()
        each = seconds / max(rows, 1)
        for i, bound in enumerate((*LATENCY_BOUNDS, float("inf"))):
            self.buckets[i] += each <= bound

    def merged(self, other: Metrics) -> Metrics:
        """The sum of two shards' metrics."""
        out = Metrics()
        out.counters = {k: v + other.counters[k] for k, v in self.counters.items()}
        out.buckets, out.seconds = [a + b for a, b in zip(self.buckets, other.buckets, strict=True)], self.seconds + other.seconds
        out.last_batch = max((t for t in (self.last_batch, other.last_batch) if t is not None), default=None)
        return out

    def text(self, store: Store) -> str:
        """Counters, gauges and the histogram in the text format of metric collectors."""
        lines = [f"# TYPE audit_{k}_total counter\naudit_{k}_total {v}" for k, v in self.counters.items()]
        now = store.snapshot()
        for k, v in {"tree_size": now.record["logs_size"], "versions": now.record["versions_size"], "dead_letters": now.dead.count(), "retained_bytes": admin.retained_bytes(store)}.items():
            lines.append(f"# TYPE audit_{k} gauge\naudit_{k} {v}")
        lines.append("# TYPE audit_write_seconds histogram")
        lines += [f'audit_write_seconds_bucket{{le="{"+Inf" if b == float("inf") else b}"}} {n}' for b, n in zip((*LATENCY_BOUNDS, float("inf")), self.buckets, strict=True)]
        lines += [f"audit_write_seconds_sum {self.seconds}", f"audit_write_seconds_count {self.counters['batches']}"]
        return "\n".join(lines) + "\n"


def health(store: Store, metrics: Metrics | None = None, most_dead: int = 0) -> dict:
    """ok, degraded (dead letters wait, or a sink failed) or unhealthy (the store cannot be read, or a stream failed), with the reasons."""
    reasons, bad = [], False
    try:
        now = store.refresh()
        waiting = now.dead.count()
        if waiting > most_dead:
            reasons.append(f"{waiting} dead letters wait")
    except Exception as e:  # noqa: BLE001  whatever is wrong is the answer
        reasons, bad = [f"the store cannot be read: {str(e).splitlines()[0]}"], True
    if getattr(store, "sink_error", None):
        reasons.append(f"a sink failed: {store.sink_error}")
    if metrics and metrics.counters["failed_queries"]:
        reasons, bad = [*reasons, "a stream failed"], True
    return {"status": "unhealthy" if bad else "degraded" if reasons else "ok", "reasons": reasons}


class Housekeeping:
    """After every batch, at most each `every` seconds: a checkpoint, retention, and a verification now and then. Use it as a store's sink."""

    def __init__(self, store: Store, every: float = 30.0, cutoff_age_us: int | None = None, budget: int | None = None, verify_every: float | None = None):
        self.store, self.every, self.age, self.budget, self.verify_every = store, every, cutoff_age_us, budget, verify_every
        self.done, self.verified, self.report, self.running = 0.0, time.time(), None, False

    def __call__(self, _) -> None:
        now = time.time()
        if self.running or now - self.done < self.every:
            return
        self.running = True
        try:
            admin.write_checkpoint(self.store, int(now * 1_000_000))
            if self.age is not None or self.budget is not None:
                admin.purge(self.store, None if self.age is None else int(now * 1_000_000) - self.age, self.budget, int(now * 1_000_000))
            if self.verify_every is not None and now - self.verified >= self.verify_every:
                self.report, self.verified = admin.verify(self.store), now
        finally:
            self.running, self.done = False, now
