"""Queries that do the whole job, on tables of more rows than their samples had."""

import hashlib

import pyarrow.parquet as pq
import pytest

from auditlake import queries
from auditlake.operators.integrity import fold, shard_roots, verify_consistency

SF = "/root/testdata/sf0.01"


def leaves():
    rows = pq.read_table(f"{SF}/events.parquet").to_pylist()
    epoch = lambda t: round((t - t.__class__(1970, 1, 1)).total_seconds() * 1_000_000)
    rows.sort(key=lambda r: r["event_id"])
    return [hashlib.sha256(b"\0" + "|".join(map(str, (r["event_id"], epoch(r["ts"]), r["user_id"], r["event_type"], r["props"]))).encode()).digest() for r in rows]


def test_every_order_is_rendered(spark):
    names = {r["p_partkey"]: r["p_name"] for r in pq.read_table(f"{SF}/part.parquet").to_pylist() if r["p_partkey"] % 7}
    pairs = {(r["l_orderkey"], r["l_partkey"]) for r in pq.read_table(f"{SF}/lineitem.parquet", columns=["l_orderkey", "l_partkey"]).to_pylist()}
    got = sorted(map(tuple, queries.QUERIES["render_as_recorded_all"](spark, SF).collect()))
    assert got == sorted((o, "part", p, names.get(p), p not in names) for o, p in pairs) and got[-1][0] > 2000


def test_consistency_with_the_whole_log(spark):
    every = leaves()
    assert len(every) > 4096
    proof = {r.step: bytes.fromhex(r.hash) for r in queries.QUERIES["consistency_proof_all"](spark, SF).collect()}
    proof = [proof[i] for i in range(len(proof))]
    assert verify_consistency(600, len(every), proof, fold(every[:600]), fold(every))
    assert not verify_consistency(600, 1000, proof, fold(every[:600]), fold(every[:1000]))


def test_checkpoint_sees_one_ordinary_row(spark, monkeypatch):
    seen = {}
    whole = queries.integrity.verify_global

    def kept(now, then):
        seen.update(now={r.shard: (r.size, r.root) for r in now.collect()}, then={r.shard: (r.size, r.root) for r in then.collect()})
        return whole(now, then)

    monkeypatch.setattr(queries.integrity, "verify_global", kept)
    assert sorted(map(tuple, queries.QUERIES["verify_global"](spark, SF).collect())) == [(1, "rollback"), (2, "rewrite"), (3, "missing")]
    every = leaves()
    assert seen["then"] == {s: (len(every[s::4]), fold(every[s::4]).hex()) for s in range(4)}
    assert seen["now"][0] == seen["then"][0] and seen["now"][1] == (len(every[1::4]) - 1, fold(every[1::4][:-1]).hex())
    assert seen["now"][2][0] == seen["then"][2][0] and sorted(seen["now"]) == [0, 1, 2]


@pytest.mark.parametrize("sizes", [(1, 9, 64, 65), (3, 0, 8, 7)])
def test_roots_by_shard(spark, sizes):
    made = {s: [hashlib.sha256(f"{s}/{i}".encode()).digest() for i in range(n)] for s, n in enumerate(sizes)}
    rows = spark.createDataFrame([(s, i, bytearray(h)) for s, x in made.items() for i, h in enumerate(x)], "shard int, idx long, hash binary")
    got = {r.shard: (r.size, r.root) for r in shard_roots(rows, max(sizes), height=3).collect()}
    assert got == {s: (len(x), fold(x).hex()) for s, x in made.items() if x}


def test_entities_are_protected_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(queries, "ENTITIES", 100)
    people = queries._people(spark, SF).registries["person"]
    assert people.count() == 1500 and len(people.inputFiles()) == 15
    assert queries._indexed(spark, SF, queries.X.exact_tokens(queries.F.col("name"))).rdd.getNumPartitions() == 20


def test_token_digests_are_dealt_too(spark, monkeypatch):
    monkeypatch.setattr(queries, "ENTITIES", 100)
    assert queries.QUERIES["tok_digests"](spark, SF).rdd.getNumPartitions() == 20


def test_tokens_are_sorted_without_a_comparator(spark):
    F, pads = queries.F, queries.with_pads
    rows = pads(spark.createDataFrame([("person", {"name": "Customer#1", "mail": "Customer#1", "note": "Customer#1", "segment": "MACHINERY"}), ("person", {"segment": ""}), ("other", {})], "kind string, plain map<string,string>"), {"k": b"key"})
    made = rows.select("kind", queries.PROTECTED.tokens(F.col("kind"), F.col("plain"), F.col("k")).alias("t"))
    assert "array_sort(" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = [r.t for r in made.collect()]
    assert [len(t) for t in got] == [8 + 1 + 8 + 4, 0, 0] and got[0] == sorted(set(got[0]))


def test_export_renders_once_in_lots(spark, monkeypatch):
    from auditlake.sources import views

    monkeypatch.setattr(views, "LINES", 1000)
    assert views.relations(spark, SF).where("entity_type = 'part'").rdd.getNumPartitions() == 60
    lines = queries.QUERIES["export_ndjson"](spark, SF)
    assert "Join" not in lines._jdf.queryExecution().optimizedPlan().toString()  # what is ordered is read twice
    assert lines.count() == 4933


def test_ranges_of_touches_need_no_sorting_aggregate(spark):
    from auditlake.sources import views

    plan = views.user_touches(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan and "Aggregate" not in plan
