import json
import time

import pytest
from pyspark.sql import functions as F
from test_ingest import CATALOG, event, frame

from auditlake.functions.keys import Envelope, RsaRing
from auditlake.operators.sharding import Ring
from auditlake.plans.query import InvalidCursor, LogQuery, TargetFilter
from auditlake.streaming.fleet import Fleet
from auditlake.streaming.health import Housekeeping, Metrics, health
from auditlake.streaming.ingest import EVENT, Store


@pytest.fixture(scope="module")
def fleet(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("fleet")
    ring = Ring((0, 1, 2), seed=4)
    stores = {s: Store(spark, str(path / f"shard-{s}"), CATALOG, rsa=RsaRing({1: Envelope(spark, 1024)})) for s in ring.active}
    made = Fleet(ring, stores)
    events = [event(i, actor=f"tenant-{i % 10}", occurred_at=1000 + i // 2) for i in range(60)]
    made.apply(frame(spark, events, 2), 0, F.col("actor.entity_id"))
    return made


def test_writes_go_to_owners_once(fleet, spark):
    where = {r.url: s for s, store in fleet.stores.items() for r in store.snapshot().logs.collect()}
    assert where == {f"/x/{i}": fleet.ring.owner(f"tenant-{i % 10}") for i in range(60)} and len(set(where.values())) > 1
    fleet.apply(frame(spark, [event(999)]), 0, F.col("actor.entity_id"))  # the batch is committed already
    assert fleet.count(LogQuery()) == (60, {}) and fleet.count(LogQuery(url_prefix="/x/1"), "tenant-3")[0] < 11


def test_merged_pages_cover_everything_once(fleet):
    for order in ("desc", "asc"):
        seen, cursor = [], None
        while True:
            rows, cursor, failed = fleet.page(LogQuery(limit=23, order=order, cursor=cursor, targets=(TargetFilter("doc", "name", "first"),)))
            got = rows.collect()
            assert not failed and all(len(r.targets) == 1 and not r.targets[0].missing for r in got)
            seen += [(r.ts_us, r.shard, r.pos) for r in got]
            if cursor is None:
                break
        assert len(seen) == 60 and seen == sorted(set(seen), reverse=order == "desc")
    with pytest.raises(InvalidCursor):
        fleet.page(LogQuery(limit=7, cursor="desc.1"))


def test_a_broken_shard_is_named_and_the_others_answer(fleet, spark):
    broken = Fleet(fleet.ring, fleet.stores | {1: None})
    rows, _, failed = broken.page(LogQuery(limit=100))
    assert set(failed) == {1} and {r.shard for r in rows.collect()} == {0, 2}
    assert broken.count(LogQuery())[1].keys() == {1} and not broken.verify()["ok"]


def test_administration_visits_every_shard(fleet, spark):
    report = fleet.verify()
    assert report["ok"] and report["log_records"] == 60
    keys = RsaRing({1: Envelope(spark, 1024)})
    made = fleet.checkpoint(keys, 1)
    assert fleet.problems(made, keys) == [] and fleet.redrive() == {} and fleet.purge(cutoff=0) == ({0: [], 1: [], 2: []}, {})
    other = Fleet(fleet.ring.freeze(2), fleet.stores)
    assert other.problems(made, keys) == ["the ring changed"] and other.count(LogQuery())[0] == 60
    shrunk = Fleet(fleet.ring, {s: fleet.stores[0] for s in fleet.stores})
    assert any("shard" in p for p in shrunk.problems(made, keys))


def test_health_metrics_and_housekeeping(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), CATALOG, rsa=RsaRing({1: Envelope(spark, 1024)}))
    keeper = store.sink = Housekeeping(store, every=0, verify_every=0)
    metrics = Metrics()
    spark.streams.addListener(metrics)
    try:
        (tmp_path / "in").mkdir()
        import json

        from auditlake.streaming.ingest import EVENT

        (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(event(i)) for i in range(5)))
        store.start(spark.readStream.schema(EVENT).json(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
        for _ in range(50):
            if metrics.counters["rows"]:
                break
            import time

            time.sleep(0.2)
    finally:
        spark.streams.removeListener(metrics)
    assert keeper.report["ok"] and metrics.counters["rows"] == 5 and health(store, metrics) == {"status": "ok", "reasons": []}
    store.sink = None
    store.apply(frame(spark, [event(9, targets=(("ghost", "g", "g"),))]), 7)
    assert health(store) == {"status": "degraded", "reasons": ["1 dead letters wait"]}
    text = metrics.merged(metrics).text(store)
    assert "audit_rows_total 10" in text and "audit_tree_size 5" in text and "audit_dead_letters 1" in text and 'le="+Inf"' in text
    metrics.counters["failed_queries"] = 1
    assert health(store, metrics)["status"] == "unhealthy"
