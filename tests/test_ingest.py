import json
import random

import pytest
from pyspark.sql import functions as F

from auditlake.functions.keys import Envelope, KeyRing, RsaRing
from auditlake.operators.integrity import verify_consistency, verify_inclusion
from auditlake.plans.catalog import Catalog, CustomColumn, Field, SchemaError
from auditlake.plans.query import LogQuery, TargetFilter
from auditlake.sources.tagged import tagged_events
from auditlake.streaming import admin
from auditlake.streaming.ingest import EVENT, RESOLVED, Store

NAMED = (Field("name", indexed=True), Field("role", indexed=True))
CATALOG = Catalog().define_type("user", NAMED).define_type("doc", NAMED).define_column(CustomColumn("k"), now=0)


def event(i, actor="ann", name="Ann", targets=(("doc", "d1", "first"),), **more):
    return {"event_id": f"e{i}", "occurred_at": 1000 + i, "actor": {"entity_type": "user", "entity_id": actor, "fields": {"name": name}}, "method": "PUT", "url": f"/x/{i}", "content": "c",
            "targets": [{"entity_type": t, "entity_id": e, "fields": {"name": n}} for t, e, n in targets], "custom": {"k": str(i)}} | more


def land(path, number, events):
    path.mkdir(exist_ok=True)
    (path / f"{number}.json").write_text("\n".join(map(json.dumps, events)))


def frame(spark, events, parts=1):
    return spark.read.schema(EVENT).json(spark.sparkContext.parallelize(list(map(json.dumps, events)), parts))


def test_stream_versions_dead_letters_and_redrive(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), CATALOG)
    landing = tmp_path / "in"
    land(landing, 1, [event(1), event(2, targets=(("doc", "d1", "first"), ("doc", "d2", "x"))), event(3, targets=(("ghost", "g", "g"),)), event(4, actor=None), event(8, event_id="two words"), event(9, custom={"z": "1"})])
    stream = lambda: store.start(spark.readStream.schema(EVENT).json(str(landing)), str(tmp_path / "cp"))
    stream().awaitTermination()
    now = store.snapshot()
    assert [(r.pos, r.event_id) for r in now.logs.orderBy("pos").collect()] == [(0, "e1"), (1, "e2")]
    assert {(r.event_id, r.error) for r in now.dead.collect()} == {("e3", "unknown target type"), ("e4", "missing actor"), ("two words", "malformed key"), ("e9", "unknown column")}
    # a rename makes a version, a repeat and a resent event make nothing; a late event keeps its time and goes last
    land(landing, 2, [event(5, targets=(("doc", "d1", "second"),)), event(2), event(6, targets=(("doc", "d1", "second"),)), event(7, occurred_at=5)])
    stream().awaitTermination()
    later = store.snapshot()
    versions = {(r.entity_type, r.entity_id, r.version): r.fields["name"] for r in later.versions.collect()}
    assert versions == {("user", "ann", 0): "Ann", ("doc", "d1", 0): "first", ("doc", "d2", 0): "x", ("doc", "d1", 1): "second", ("doc", "d1", 2): "first"}
    logs = {r.event_id: r for r in later.logs.collect()}
    assert [logs[f"e{i}"].pos for i in (1, 2, 5, 6, 7)] == list(range(5)) and logs["e7"].ts_us == 5
    # a snapshot does not see what came after it
    assert now.logs.count() == 2 and now.versions.count() == 3 and store.snapshot(0).logs.count() == 2
    # every relation's version exists, and positions pin what was current
    assert later.relations.join(later.versions, "uid", "left_anti").count() == 0
    named = {r.log: r.fields["name"] for r in later.relations.join(later.versions.select("uid", "fields", "entity_id"), "uid").where("entity_id = 'd1'").collect()}
    assert named[logs["e1"].pos] == "first" and named[logs["e5"].pos] == "second" and named[logs["e7"].pos] == "first"
    # after the type exists, its event is replayed with its own time; the others are parked again
    wider = Store(spark, str(tmp_path / "t"), CATALOG.define_type("ghost", NAMED))
    wider.redrive()
    assert {r.event_id: r.ts_us for r in wider.snapshot().logs.collect()}["e3"] == 1003
    assert {r.event_id for r in wider.snapshot().dead.collect()} == {"e4", "two words", "e9"}
    before = wider.snapshot().logs.count()
    wider.redrive()
    assert wider.snapshot().logs.count() == before and wider.snapshot().dead.count() == 3
    # a corrupt dead-letter file is passed over and listed
    (tmp_path / "t" / "dead" / f"batch={wider.last['n']}" / "part-bad.parquet").write_bytes(b"not parquet at all")
    assert [r.path.endswith("part-bad.parquet") for r in wider.quarantined().collect()] == [True]
    wider.redrive()
    assert wider.snapshot().logs.count() == before


def test_events_without_a_key_all_count_and_the_earliest_of_a_key_wins(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), CATALOG)
    events = [event(i, event_id=None) for i in range(5)] + [event(10, event_id="k", url="/first"), event(11, event_id="k", url="/second"), event(9, event_id="k", url="/third")]
    store.apply(frame(spark, events, 3), 0)
    rows = store.snapshot().logs.orderBy("pos").collect()
    assert [r.url for r in rows] == [f"/x/{i}" for i in range(5)] + ["/first"] and [r.pos for r in rows] == list(range(6))


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), CATALOG)
    rows = frame(spark, [event(i) for i in range(50)])
    store.apply(rows, 0)
    seen = lambda s: sorted((r.idx, bytes(r.hash)) for r in s.tree().leaves.collect())
    first = seen(store.snapshot())
    store.apply(rows, 0)
    assert seen(store.snapshot()) == first and len(first) == 50
    # a try that broke off before its record leaves nothing to see, and the next writes the same
    other = Store(spark, str(tmp_path / "t"), CATALOG)
    other.commit, kept = lambda record: 1 / 0, other.commit
    with pytest.raises(ZeroDivisionError):
        other.apply(frame(spark, [event(100), event(101)]), 1)
    assert Store(spark, str(tmp_path / "t"), CATALOG).snapshot().logs.count() == 50
    other.commit = kept
    other.apply(frame(spark, [event(100), event(101)]), 1)
    assert Store(spark, str(tmp_path / "t"), CATALOG).snapshot().logs.count() == 52
    assert admin.verify(other)["ok"]


def test_versions_equal_a_plain_loop_over_many_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("auditlake.streaming.ingest.HEADS_EVERY", 1)
    rng = random.Random(3)
    events = [event(i, targets=tuple(("doc", rng.choice(["hot", "hot", "a", "b"]), rng.choice("xyz")) for _ in range(rng.randint(0, 3)))) for i in range(300)]
    store = Store(spark, str(tmp_path / "t"), CATALOG)
    want, latest = [], {}
    for lot in range(3):
        store.apply(frame(spark, events[lot * 100 : lot * 100 + 100], 7), lot)
    assert store.last["heads"] >= 1
    for e in events:
        for t in [e["actor"], *e["targets"]]:
            key, name = (t["entity_type"], t["entity_id"]), t["fields"]["name"]
            version, old = latest.get(key, (-1, None))
            if old != name:
                want.append((*key, version + 1, name))
                latest[key] = (version + 1, name)
    now = store.snapshot()
    assert sorted((r.entity_type, r.entity_id, r.version, r.fields["name"]) for r in now.versions.collect()) == sorted(want)
    assert sorted(r.pos for r in now.logs.collect()) == list(range(300)) and sorted(r.idx for r in now.versions.collect()) == list(range(len(want)))
    assert now.relations.join(now.versions, "uid", "left_anti").count() == 0


SECRET = (Field("name", indexed=True, search="ngram", size=2), Field("mail", protection="hmac", indexed=True, search="exact"), Field("ssn", protection="rsa", search="ngram", size=3), Field("tag", protection="sha256", indexed=True, search="prefix", size=4), Field("age", kind="number", indexed=True))


@pytest.fixture(scope="module")
def protected(spark, tmp_path_factory):
    """People whose fields are plain, hashed, keyed and encrypted; two commits under two key versions."""
    path = str(tmp_path_factory.mktemp("p") / "t")
    catalog = Catalog().define_type("user", NAMED).define_type("person", SECRET)
    rsa = RsaRing({1: Envelope(spark, 1024)})
    people = [("p1", {"name": "Orla Finch", "mail": "Orla@x.io", "ssn": "912-44", "tag": "Alpha", "age": "41"}), ("p2", {"name": "orlando", "mail": "lo@x.io", "ssn": "555-10", "tag": "alps", "age": "41.5"})]
    store = Store(spark, path, catalog, KeyRing({1: b"one"}), rsa)
    make = lambda i, p, f: event(i, targets=()) | {"custom": None, "targets": [{"entity_type": "person", "entity_id": p, "fields": f}]}
    store.apply(frame(spark, [make(1, *people[0]), make(2, *people[1])]), 0)
    store = Store(spark, path, catalog, KeyRing({1: b"one", 2: b"two"}), rsa)
    store.apply(frame(spark, [make(3, "p3", {"name": "Orla", "mail": "orla@x.io", "ssn": "912-99", "tag": "beta", "age": "41.0"}), make(4, *people[0])]), 1)
    return store


@pytest.mark.parametrize("field, value, mode, want", [
    ("name", "Orla", "exact", [2]), ("name", "ORLA", "exact_ci", [2]), ("name", "orl", "prefix", [0, 1, 2, 3]), ("name", "FINCH", "contains", [0, 3]),
    ("mail", "Orla@x.io", "exact", [0, 3]), ("mail", "orla@X.IO", "exact_ci", [0, 2, 3]), ("ssn", "912", "contains", [0, 2, 3]), ("ssn", "2-4", "contains", [0, 3]),
    ("tag", "Alpha", "exact", [0, 3]), ("tag", "ALP", "prefix", [0, 1, 3]), ("age", 41, "exact", [0, 2, 3]), ("age", 41.5, "exact", [1]),
])
def test_every_mode_on_every_protection(protected, field, value, mode, want):
    rows, cursor = protected.snapshot().dataset().page(LogQuery(targets=(TargetFilter("person", field, value, mode),), order="asc", limit=10))
    assert [r.pos for r in rows.collect()] == want and cursor is None


def test_what_is_stored_tells_nothing_and_errors_are_loud(protected):
    now = protected.snapshot()
    stored = " ".join(f"{r.fields} {r.tokens} {r.fingerprint}" for r in now.registry("person").collect())
    assert "912" not in stored and "Orla@" not in stored and "Alpha" not in stored and "Orla Finch" in stored
    assert now.registry("person").count() == 3  # the repeat of p1 under a new key is no change
    data = now.dataset()
    for field, mode in (("ssn", "exact"), ("mail", "contains"), ("tag", "contains"), ("tag", "exact_ci"), ("none", "exact")):
        with pytest.raises(SchemaError):
            data.uids(TargetFilter("person", field, "abc", mode))
    with pytest.raises(ValueError, match="shorter"):
        data.uids(TargetFilter("person", "ssn", "91", "contains"))
    plan = data.uids(TargetFilter("person", "ssn", "912", "contains"))._jdf.queryExecution().toString()
    assert all(k.hex() not in plan.lower() for k in protected.data_keys().values())
    assert admin.verify(protected)["ok"]


def test_rekey(spark, protected):
    ring, rsa = KeyRing({2: b"two", 3: b"three"}), RsaRing({1: protected.rsa.pairs[1], 2: Envelope(spark, 1024)})
    admin.rekey(protected, ring, rsa, at=7)
    # the old private key is no longer needed; tokens of the encrypted field are under the new key
    moved = Store(spark, protected.path, protected.catalog, ring, RsaRing({1: Envelope(spark, public=rsa.pairs[1].exported()[0]), 2: rsa.pairs[2]}))
    find = lambda f, v, m: [r.pos for r in moved.snapshot().dataset().page_rows(LogQuery(targets=(TargetFilter("person", f, v, m),), order="asc")).collect()]
    assert find("ssn", "912", "contains") == [0, 2, 3] and find("name", "FINCH", "contains") == [0, 3]
    assert moved.snapshot().versions.count() == 4 and admin.verify(moved) == {"ok": True, "segments_checked": 2, "log_records": 4, "problems": []}
    forged = Store(spark, protected.path, protected.catalog, ring, RsaRing({1: rsa.pairs[1], 2: Envelope(spark, 1024)}))
    assert any("re-key" in p for p in admin.verify(forged)["problems"])


def test_deletion_and_return(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), CATALOG)
    store.apply(frame(spark, [event(1), event(2, targets=(("doc", "d2", "x"),))]), 0)
    assert store.delete("doc", spark.createDataFrame([("d1",), ("nobody",)], "entity_id string"), at=9) == 1
    assert store.delete("doc", spark.createDataFrame([("d1",)], "entity_id string"), at=9) == 0
    query = lambda past: [r.pos for r in store.snapshot().dataset().page_rows(LogQuery(targets=(TargetFilter("doc", "name", "first", include_past=past),))).collect()]
    assert query(True) == [0] and query(False) == []
    store.apply(frame(spark, [event(3)]), 1)  # the same fields after a deletion are a new version
    rows = sorted((r.version, r.deleted) for r in store.snapshot().registry("doc").where("entity_id = 'd1'").collect())
    assert rows == [(0, False), (1, True), (2, False)] and query(False) == [2, 0]
    assert admin.verify(store)["ok"]


def test_proofs_grow_with_the_store_and_tampering_shows(spark, tmp_path):
    rsa, sent = RsaRing({1: Envelope(spark, 1024)}), []
    store = Store(spark, str(tmp_path / "t"), CATALOG, rsa=rsa)
    sizes, roots = [], []
    for lot, n in enumerate((700, 500, 1100, 1)):
        store.apply(frame(spark, [event(10_000 * lot + i, targets=()) for i in range(n)], 3), lot)
        admin.write_checkpoint(store, lot, sent.append)
        sizes.append(store.last["logs_size"])
        roots.append(store.snapshot().tree().root())
    tree = store.snapshot().tree()
    assert len(sent) == 4 and tree.nodes.count() == 2 and sizes[-1] == 2301
    leaves = {r.idx: bytes(r.hash) for r in tree.leaves.collect()}
    for i in (0, 1023, 1024, 2047, 2048, 2300):
        assert verify_inclusion(leaves[i], i, tree.size, tree.inclusion(i), roots[-1])
    for size, root in zip(sizes, roots, strict=True):
        assert verify_consistency(size, tree.size, tree.consistency(size), root, roots[-1])
    assert tree.rows([(10, 0), (11, 0), (12, 0)]).count() < 300  # two stored nodes and the last leaves, not the log
    assert admin.verify(store) == {"ok": True, "segments_checked": 4, "log_records": 2301, "problems": []}
    # one changed row, and the counts stay
    path = f"{store.path}/logs/batch=1"
    rows = spark.read.parquet(path).withColumn("url", F.when(F.col("pos") == 800, F.lit("/forged")).otherwise(F.col("url"))).toPandas()
    spark.createDataFrame(rows, spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)
    report = admin.verify(Store(spark, store.path, CATALOG, rsa=rsa))
    assert not report["ok"] and report["problems"] == ["1 log records differ from the tree, first 800"]


def test_retention_drops_whole_commits(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), CATALOG, rsa=RsaRing({1: Envelope(spark, 1024)}))
    for lot in range(4):
        store.apply(frame(spark, [event(100 * lot + i) for i in range(50)]), lot)
    assert admin.purge(store, cutoff=0) == [] and admin.purge(store, cutoff=1100) == [0]
    before = admin.retained_bytes(store)
    assert admin.purge(store, budget=before - 1) == [1] and admin.retained_bytes(store) < before
    now = store.snapshot()
    assert sorted(r.pos for r in now.logs.collect()) == list(range(100, 200)) and now.relations.count() == 100
    assert admin.purge(store, budget=0) == [2] and admin.purge(store, budget=0) == []  # the newest stays
    report = admin.verify(store)
    assert report["ok"] and report["log_records"] == 50
    store.apply(frame(spark, [event(900)]), 9)
    assert store.snapshot().logs.agg(F.max("pos")).first()[0] == 200 and admin.verify(store)["ok"]


def test_sinks_see_commits_and_break_nothing(spark, tmp_path):
    seen = []
    store = Store(spark, str(tmp_path / "t"), CATALOG, sink=lambda logs: seen.append(logs.count()))
    store.apply(frame(spark, [event(1), event(2)]), 0)
    store.sink = lambda logs: 1 / 0
    store.apply(frame(spark, [event(3)]), 1)
    assert seen == [2] and store.snapshot().logs.count() == 3 and "division" in store.sink_error


def test_pages_open_the_commits_they_need(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), CATALOG)
    for lot in range(6):
        store.apply(frame(spark, [event(100 * lot + i) for i in range(20)]), lot)
    now, seen, cursor = store.snapshot(), [], None
    while True:
        rows, cursor, opened = now.page(LogQuery(limit=45, cursor=cursor))
        seen += [r.pos for r in rows.collect()]
        assert opened <= 5
        if cursor is None:
            break
    assert seen == list(range(120))[::-1]
    rows, _, opened = now.page(LogQuery(from_micros=1305, to_micros=1309, limit=100))
    assert sorted(r.ts_us for r in rows.collect()) == [1305, 1306, 1307, 1308, 1309] and opened == 1
    assert now.page(LogQuery(limit=10))[2] == 1 and now.page(LogQuery(method="none", limit=5))[2] == 6
    assert [r.pos for r in now.page(LogQuery(limit=3, order="asc"))[0].collect()] == [0, 1, 2]


def test_tagged_lines_go_through_the_store(spark, tmp_path):
    entity = lambda kind, i, **f: {"entity_type": kind, "entity_id": i, "fields": f}
    line = {"event_id": "t1", "occurred_at": 5, "actor": entity("user", "ann", name={"Text": "Ann"}), "method": "PUT", "url": "/x", "content": {"Json": {"b": 1, "a": [ ]}}, "targets": [entity("doc", "d", name={"Number": 7.0})], "custom": {"k": {"Number": 0.5}}}
    lines = [line, line | {"event_id": "t2", "extra": 1}, line | {"event_id": "t3", "content": {"Text": "a", "Number": 1}}, line | {"event_id": "t4", "custom": {"k": {"Bool": True}}}, line | {"event_id": "t5", "targets": None, "content": None, "custom": None}]
    rows = tagged_events(spark.createDataFrame([(json.dumps(x),) for x in lines] + [("no json",), ("[1]",), (None,)], "value string"))
    got = rows.collect()
    assert [r.error for r in got] == [None, "unknown key", "untagged value", "untagged value", None, "no JSON object", "no JSON object", "no JSON object"]
    assert got[0].content == '{"a":[],"b":1}' and got[0].targets[0].fields == {"name": "7"} and got[0].custom == {"k": "0.5"} and got[4].targets is None
    store = Store(spark, str(tmp_path / "t"), CATALOG)
    store.apply(rows.where("error is null").drop("error"), 0)
    assert sorted(r.event_id for r in store.snapshot().logs.collect()) == ["t1", "t5"]


def test_entities_history_and_resolved_logs(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), CATALOG)
    store.apply(frame(spark, [event(1), event(2, targets=(("doc", "d1", "second"), ("doc", "d2", "x")))]), 0)
    now = store.snapshot()
    assert [(r.entity_id, r.version) for r in now.entities("doc").collect()] == [("d1", 1), ("d2", 0)]
    assert [r.fields["name"] for r in now.history("doc", "d1").collect()] == ["first", "second"]
    with pytest.raises(KeyError):
        now.history("doc", "nobody")
    store.delete("doc", spark.createDataFrame([("d2",)], "entity_id string"), at=3)
    assert store.snapshot().entities("doc").count() == 1 and store.snapshot().entities("doc", deleted=True).count() == 2
    who, what = now.history("user", "ann").first().uid, now.history("doc", "d1").first().uid
    pins = lambda u: spark.createDataFrame([("r1", 9, ("user", who), "GET", "/r", None, [("doc", u)], None)], RESOLVED)
    with pytest.raises(KeyError):
        store.append_resolved(pins("lost"), 0)
    store.append_resolved(pins(what), 0)
    store.append_resolved(pins(what), 0)
    found = store.snapshot().dataset().page(LogQuery(method="get", limit=5))[0].collect()
    assert [(r.pos, r.actor_uid, r.targets[0].fields) for r in found] == [(2, who, '{"name":"first"}')] and admin.verify(store)["ok"]
