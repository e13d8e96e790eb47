import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from auditlake.functions import scalars as X
from auditlake.functions.keys import Envelope, KeyRing, decrypted, encrypted, with_data_keys, with_pads
from auditlake.operators import search
from auditlake.operators.lifecycle import deduplicated, rendered_body, split_valid
from auditlake.operators.sharding import Ring


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first().r


def test_tokens(spark):
    v = F.col("v")
    for text, column, want in [
        ("MoSs", X.ngram_tokens(v, 3), ["mos", "oss"]), ("水曜日", X.ngram_tokens(v, 2), ["曜日", "水曜"]), ("ox", X.ngram_tokens(v, 3), ["ox"]), ("", X.ngram_tokens(v, 3), []),
        ("Petra", X.prefix_tokens(v, 3), ["p", "pe", "pet"]), ("ox", X.prefix_tokens(v, 5), ["o", "ox"]), ("", X.prefix_tokens(v, 5), []), ("oooo", X.ngram_tokens(v, 2), ["oo"]),
    ]:
        assert one(spark, column, text) == want
    assert X.probe_ngrams("89", 3) is None and X.probe_ngrams("8901", 3) == ["890", "901"]


def test_digests(spark):
    for key in (b"k", b"long" * 40):
        row = with_pads(spark.createDataFrame([("héllo",)], "v string"), {"k": key})
        assert row.select(X.hmac_hex(F.col("v"), F.col("k"))).first()[0] == hmac.new(key, "héllo".encode(), hashlib.sha256).hexdigest()
        assert row.select(X.token_digests("f", F.array("v"), F.col("k"))[0]).first()[0] == X.probe_digest("f", "héllo", key)
        assert all(p.hex() not in row._jdf.queryExecution().toString().lower() for p in X.pads(key))
    assert one(spark, X.token_digests("f", F.array("v"))[0], "t") == X.probe_digest("f", "t")
    assert one(spark, X.rfc3339(F.lit(1_700_000_000_123_456))) == "2023-11-14T22:13:20.123456Z"
    assert one(spark, X.canonical_number(F.lit(7.0))) == "7" and one(spark, X.canonical_number(F.lit(0.5))) == "0.5" and one(spark, X.canonical_json(F.col("v")), '{"b": 1, "a": [ ]}') == '{"a":[],"b":1}'


def test_false_positives_of_hashed_ngrams_stay_and_plain_ones_go(spark):
    rows = spark.createDataFrame([("n-1", "mirror-roro"), ("n-2", "mirroro")], "entity_id string, note string")
    for key in (None, b"key"):
        d = with_pads(rows, {"k": key or b"none"}).withColumn("t", X.token_digests("note", X.ngram_tokens(F.col("note"), 3), F.col("k") if key else None))
        find = lambda plain: sorted(r.entity_id for r in d.where(search.match_ngrams(F.col("t"), "note", "mirroro", 3, [key], plain)).collect())  # noqa: B023, E731
        assert find(None) == ["n-1", "n-2"] and find(F.col("note")) == ["n-2"]
    with pytest.raises(ValueError, match="shorter"):
        search.match_ngrams(F.col("t"), "note", "ab", 3, [None])


def test_keys(spark):
    old, new = Envelope(spark, 1024), Envelope(spark, 1024)
    key = Envelope.new_data_key()
    wrapped = old.wrap(key)
    assert old.unwrap(wrapped) == key and new.unwrap(old.rewrap(wrapped, new)) == key
    rows = with_data_keys(spark.createDataFrame([("secret é", 1), ("other", 2)], "v string, n long"), {1: key}, "n").select("n", decrypted(encrypted(F.col("v"), F.coalesce("__key", F.lit(b"0" * 16))), F.col("__key")).alias("d"))
    assert {r.n: r.d for r in rows.collect()} == {1: "secret é", 2: None}
    signature = old.sign(b"root")
    assert old.verify(b"root", signature) and not old.verify(b"roots", signature) and not new.verify(b"root", signature)
    assert KeyRing({1: b"a", 3: b"b"}).active == 3 and KeyRing({3: b"b", 1: b"a"}).held() == [b"a", b"b"]
    with pytest.raises(ValueError):
        KeyRing({0: b"x"})


def test_ring(spark):
    ring = Ring((0, 1, 2, 3), seed=5)
    tenants = [f"tenant-{i}" for i in range(400)]
    got = {r.v: r.s for r in spark.createDataFrame([(t,) for t in tenants], "v string").select("v", ring.route(F.col("v")).alias("s")).collect()}
    assert got == {t: ring.owner(t) for t in tenants} and set(got.values()) == {0, 1, 2, 3}
    wider = ring.add(4)
    moved = [t for t in tenants if wider.owner(t) != ring.owner(t)]
    assert 0 < len(moved) < 160 and all(wider.owner(t) == 4 for t in moved)
    frozen = ring.freeze(2)
    assert 2 in frozen.read_targets("tenant-1") and all(frozen.owner(t) != 2 for t in tenants) and frozen.freeze(2) == frozen
    assert frozen.read_targets(None) == [0, 1, 2, 3] and frozen.manifest_hash() != ring.manifest_hash()
    with pytest.raises(ValueError):
        Ring((1,)).freeze(1)


def test_batches(spark):
    e = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b b"), (4, None), (5, "")], "n int, k string")
    keyed = spark.createDataFrame([(2, "a"), (1, "a"), (3, "b b"), (4, None), (5, None)], "n int, k string")
    assert sorted(r.n for r in deduplicated(keyed, "k", "n").collect()) == [1, 4, 5]  # of a key the earliest, all without one, none malformed
    good, bad = split_valid(e, {"no key": "k is not null", "small": F.col("n") < 3})
    assert [r.n for r in good.orderBy("n").collect()] == [1, 2] and [(r.n, r.error) for r in bad.orderBy("n").collect()] == [(3, "small"), (4, "no key"), (5, "small")]
    for text, want in [('{"a": 1}', '{"a":1}'), ("plain \"q\"", '"plain \\"q\\""'), ("", None), ("x" * 30, '"<body of 30 bytes exceeds the capture limit>"')]:
        assert one(spark, rendered_body(F.col("v"), 20), text) == want
    for raw, want in [(b"\xff\xfe\x00", '"<3 bytes, no text>"'), (b"{}", "{}"), (b"x" * 21, '"<body of 21 bytes exceeds the capture limit>"'), (b"", None)]:
        row = spark.createDataFrame([(bytearray(raw),)], "b binary").select(rendered_body(F.lit(""), 20, F.col("b"))).first()
        assert row[0] == want
