"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from auditlake.queries import QUERIES  # noqa: E402

NAMES = [
    "flagship", "log_scan_desc", "filter_time_range", "filter_conjunction", "count_logs", "query_page_next", "segment_stats", "entity_versions", "latest_versions", "filter_actor", "filter_targets_and",
    "page_with_targets", "render_as_recorded", "pin_versions_asof", "match_contains_ngram_plain", "token_candidates_posting", "protect_hmac", "merkle_root", "inclusion_proof", "retention_bytes", "fanout_page", "latency_histogram",
    "idempotent_dedup", "dlq_split", "export_ndjson", "consistency_proof", "query_rsa_contains", "ingest_events",
]


def events(spark: SparkSession, sf_dir: str, lots: int):
    """Events of one actor and one target each, as durable write benchmarks have them; `lots` times the table."""
    from pyspark.sql import functions as F

    from auditlake.sources.views import micros

    entity = lambda kind, i, field: F.struct(F.lit(kind).alias("entity_type"), F.lit(i).alias("entity_id"), F.create_map(F.lit(field), F.lit("same")).alias("fields"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("lot", F.explode(F.sequence(F.lit(1), F.lit(lots))))
    return e.select(
        F.lit(None).cast("string").alias("event_id"), micros(F.col("ts")).alias("occurred_at"), entity("user", "u1", "state").alias("actor"), F.lit("POST").alias("method"), F.concat(F.lit("/api/"), "event_id").alias("url"),
        F.lit("small text").alias("content"), F.array(entity("item", "i1", "kind")).alias("targets"), F.lit(None).cast("map<string,string>").alias("custom"),
    )


def ingest_rates(spark: SparkSession, sf_dir: str, folder: str) -> dict:
    """Durable commits through the write path: of the plain events, and of events that make versions; and what pruning opens."""
    from auditlake.plans.query import LogQuery
    from auditlake.queries import INGEST, ingested
    from auditlake.streaming.ingest import Store

    store = Store(spark, f"{folder}/plain", INGEST)
    store.apply(events(spark, sf_dir, 1).limit(2000), 0)
    out = {}
    for lots in (1, 5):
        began, before = time.time(), store.last["logs_size"]
        store.apply(events(spark, sf_dir, lots), lots)
        took = time.time() - began
        out[f"ingest_x{lots}"], out[f"ingest_x{lots}_events_per_sec"] = round(took, 3), round((store.last["logs_size"] - before) / took)
    began = time.time()
    rich = ingested(spark, sf_dir, f"{folder}/rich")
    out["ingest"] = round(time.time() - began, 3)
    out["ingest_events_per_sec"] = round(rich.last["logs_size"] / out["ingest"])
    # six commits in order of time: a window of a thousandth, and the newest hundred
    cut, span = Store(spark, f"{folder}/cut", INGEST), 6
    rows = events(spark, sf_dir, 1).limit(20_000).orderBy("occurred_at").cache()
    low, high = rows.selectExpr("min(occurred_at)", "max(occurred_at)").first()
    for i in range(span):
        a, b = (low + (high + 1 - low) * k // span for k in (i, i + 1))
        cut.apply(rows.where(f"occurred_at >= {a} and occurred_at < {b}"), i)
    out["commits"] = span
    out["narrow_window_opens"] = cut.snapshot().page(LogQuery(from_micros=low, to_micros=low + (high - low) // 1000, limit=1_000_000))[2]
    out["newest_100_opens"] = cut.snapshot().page(LogQuery(limit=100))[2]
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .config("spark.checkpoint.dir", f"file://{folder}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["log_scan"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in NAMES:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    write = ingest_rates(spark, sf_dir, f"{folder}/tables")
    seconds |= {k: v for k, v in write.items() if k in ("ingest", "ingest_x1", "ingest_x5")}
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))} | {k: v for k, v in write.items() if k not in seconds}))


if __name__ == "__main__":
    main()
