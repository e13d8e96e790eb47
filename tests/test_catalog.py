import pytest
from pyspark.sql import functions as F

from auditlake.functions.keys import Envelope, RsaRing
from auditlake.operators.checkpoints import checkpoint, global_checkpoint, global_problems, problems
from auditlake.operators.integrity import Tree
from auditlake.operators.lifecycle import split_valid
from auditlake.plans.audited import AuditedReader
from auditlake.plans.catalog import Catalog, CustomColumn, Field, PermissionDenied, Policy, SchemaError
from auditlake.plans.query import Dataset, LogQuery, TargetFilter


def test_types_only_grow():
    c = Catalog().define_type("doc", (Field("name", indexed=True, required=True),))
    wider = c.define_type("doc", (Field("name", indexed=True), Field("note", protection="rsa", search="ngram", size=3)))
    assert wider.type_names() == ["doc"] and len(wider.types["doc"]) == 2
    for bad in ((Field("note"),), (Field("name", kind="number", indexed=True),), (Field("name", protection="hmac", indexed=True),), (Field("name"),), (Field("name", indexed=True, search="prefix", size=2),)):
        with pytest.raises(SchemaError):
            c.define_type("doc", bad)
    for name, fields in (("__x", ()), ("t", (Field("a", protection="rsa", indexed=True),)), ("t", (Field("a", search="ngram"),)), ("t", (Field("a", kind="number", search="exact"),)), ("t", (Field("a"), Field("a")))):
        with pytest.raises(SchemaError):
            Catalog().define_type(name, fields)


def test_rules(spark):
    c = Catalog().define_type("doc", (Field("name", required=True), Field("n", kind="number"), Field("j", kind="json")))
    c = c.define_column(CustomColumn("reason", required=True), now=100).define_column(CustomColumn("n", "number"), now=100)
    rows = spark.createDataFrame(
        [(1, {"name": "a", "n": "1.5", "j": "{}"}, {"reason": "r"}, 100), (2, {"n": "1"}, {"reason": "r"}, 100), (3, {"name": "a", "n": "x"}, {"reason": "r"}, 100), (4, {"name": "a", "z": "1"}, {"reason": "r"}, 100), (5, {"name": "a", "j": "{"}, {"reason": "r"}, 100),
         (6, {"name": "a"}, {"reason": None}, 99), (7, {"name": "a"}, {"x": "1"}, 99), (8, {"name": "a"}, {"n": "1"}, 100), (9, {"name": "a"}, {"n": "one"}, 1), (10, {"name": "a"}, None, 1)],
        "i int, f map<string,string>, c map<string,string>, at long",
    )
    good, bad = split_valid(rows, c.field_rules("doc", F.col("f")) | c.custom_rules(F.col("c"), F.col("at")))
    assert sorted(r.i for r in good.collect()) == [1, 6, 10]
    assert {r.i: r.error for r in bad.collect()} == {2: "missing name", 3: "n is no number", 4: "unknown field", 5: "j is no JSON", 7: "unknown column", 8: "missing column reason", 9: "column n is no number"}
    with pytest.raises(SchemaError):
        c.field_rules("ghost", F.col("f"))


def test_reads_leave_records_without_probes(spark, tmp_path):
    logs = spark.createDataFrame([(1, 5, "GET", "/x", "u0")], "pos long, ts_us long, method string, url string, actor_uid string")
    people = spark.createDataFrame([("u0", "u", 0, False, {"ssn": "301-22-7"})], "uid string, entity_id string, version long, deleted boolean, fields map<string,string>")
    data = Dataset(logs, spark.createDataFrame([], "log long, uid string, entity_type string"), {"person": people})
    reader = AuditedReader(spark, data, str(tmp_path / "access"), Policy({"auditor": frozenset({"query"})}))
    q = LogQuery(actor=TargetFilter("person", "ssn", "301-22-7"), limit=5)
    assert reader.page("ann", "auditor", q)[0].count() == 1 and reader.count("ann", "auditor", q) == 1
    with pytest.raises(PermissionDenied):
        reader.count("bob", "guest", q)
    records = reader.records(actor="ann").collect()
    assert [(r.operation, r.result_count) for r in records] == [("query_page", 1), ("count", 1)]
    assert all("301-22" not in r.params and "ssn" in r.params for r in records)
    with pytest.raises(PermissionDenied):
        reader.run("ann", "auditor", "verify", dict)
    assert reader.run("ann", "auditor", "history", lambda: people, right="query").count() == 1
    assert AuditedReader(spark, data, str(tmp_path / "access"), Policy({"chief": frozenset({"administer"})})).run("zoe", "chief", "purge", lambda: [3, 4]) == [3, 4]
    assert [(r.operation, r.result_count) for r in reader.records(actor="zoe").collect()] == [("purge", 2)] and reader.records(operation="history").count() == 1
    assert reader.records(operation="count", limit=5).count() == 1 and reader.records(to_micros=0).count() == 0


def test_checkpoints(spark):
    def tree(n, salt=0):
        leaves = spark.range(n).select(F.col("id").alias("idx"), F.unhex(F.sha2((F.col("id") + salt).cast("string"), 256)).alias("hash"))
        return Tree(leaves, spark.createDataFrame([], "height int, idx long, hash binary"), n)

    keys, sent = RsaRing({1: Envelope(spark, 1024)}), []
    made = [checkpoint(tree(20), keys, 1, sent.append), checkpoint(tree(45), keys, 2, lambda c: 1 / 0)]
    assert len(sent) == 1 and "anchor_error" in made[1]
    assert problems(tree(60), made, keys) == [] and problems(tree(45), made, keys) == [] and problems(tree(5), [], keys) == []
    assert "shrank" in problems(tree(44), made, keys)[0]
    assert "prefix" in problems(tree(60, salt=1), made, keys)[0]
    assert "signature" in problems(tree(60), [made[0] | {"size": 21}, made[1]], keys)[0]


def test_global_checkpoints(spark):
    keys = RsaRing({1: Envelope(spark, 1024)})
    then = {0: (5, b"a"), 1: (5, b"b"), 2: (5, b"c"), 3: (5, b"d")}
    made = global_checkpoint(then, "m1", keys, 1)
    assert global_problems(made, then, "m1", keys) == []
    assert global_problems(made, {0: (6, b"x"), 1: (5, b"x"), 2: (4, b"c")}, "m2", keys) == ["the ring changed", "shard 1: rewrite", "shard 2: rollback", "shard 3: missing"]
    assert global_problems(made | {"shards": {}}, then, "m1", keys) == ["bad signature"]


def test_keys_can_be_carried(spark):
    pair = Envelope(spark, 1024)
    public, private = pair.exported()
    key = Envelope.new_data_key()
    assert Envelope(spark, public=public, private=private).unwrap(pair.wrap(key)) == key
    half = Envelope(spark, public=public)
    assert half.verify(b"m", pair.sign(b"m")) and not half.verify(b"n", pair.sign(b"m")) and not half.verify(b"m", b"short")
    with pytest.raises(ValueError, match="private"):
        half.unwrap(half.wrap(key))
    assert RsaRing({1: half}).unwrap(1, half.wrap(key)) is None and RsaRing({1: pair}).unwrap(9, b"") is None


@pytest.mark.parametrize("value", [1.0, 0.5, -2.25, 1e15, 1.5e20, 123456789.125, 1e-4, 0.001, -7.5e-9, 1e300, 12345678.0, 9999999.5])
def test_numbers_are_probed_as_they_are_stored(spark, value):
    f = Field("n", kind="number")
    assert spark.createDataFrame([(repr(value),)], "t string").select(f.canonical(F.col("t"))).first()[0] == f.probe(value)
