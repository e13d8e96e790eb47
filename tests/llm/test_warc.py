import base64
import gzip
import hashlib
import os
import random
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import compare  # noqa: E402

from auditlake.llm import warc  # noqa: E402
from auditlake.llm.queries import op3_warc  # noqa: E402

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def pages():
    r = random.Random(1)
    out = [(i, f"http://x/{i}\r\nEvil: 1", r.choice(["<p>é</p>", "", None, "b" * i, FAKE, FAKE * 2 + "tail", "\r\n\r\n", f"x{FAKE}{i}"]), "c") for i in range(120)]
    return out + [(5, "u", "same", "c"), (5, "u", "same", "c"), (4, "v", "same", "c"), (4, "v", "same", "c"), (4, "v", "same", "c"), (300, None, "y" * 300_000, "c")]


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def expected(rows, least=0):
    first = {}
    for i, (p, _, h, _) in enumerate(rows):
        h = h or ""
        if len(h.encode()) >= least and (h not in first or (p, i) < first[h]):
            first[h] = (p, i)
    out = []
    for i, (p, _, h, _) in enumerate(rows):
        h = h or ""
        again = h in first and first[h] != (p, i)
        out.append((p, len(h.encode()), digest(h), "revisit" if again else "response", first[h][0] if again else None, True, True))
    return sorted(out, key=repr)


SCHEMA = "page_id long, url string, html string, digest string"


def test_round_trip_of_hostile_pages(spark):
    df = spark.createDataFrame(pages(), SCHEMA).coalesce(2)
    assert sorted(map(tuple, warc.warc_round_trip(df).collect()), key=repr) == expected(pages())


def test_small_payloads_are_all_responses(spark, tmp_path):
    warc.write_warc(spark.createDataFrame(pages(), SCHEMA), str(tmp_path / "w"), least_bytes=10)
    kinds = sorted(r.record_type for r in warc.read_warc(spark, str(tmp_path / "w")).collect())
    assert kinds == sorted(r[3] for r in expected(pages(), 10))


def test_equals_sql(spark, sf_dir):
    assert compare(spark, sf_dir, op3_warc, warc.ORACLE_SQL)


def test_empty_table(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_reads_members_and_marks_broken_files(spark, tmp_path):
    record = FAKE.encode()
    (tmp_path / "part-a.gz").write_bytes(b"".join(gzip.compress(record) for _ in range(3)))
    (tmp_path / "part-b").write_bytes(record * 2 + record[:-7])
    (tmp_path / "part-c").write_bytes(b"junk" + record)
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    by = {n: [r for r in rows if f"part-{n}" in r.file] for n in "abc"}
    assert [len(by[n]) for n in "abc"] == [3, 2, 0]
    assert all(r.complete for r in by["a"]) and not any(r.complete for r in by["b"])


def test_ranges_of_one_file(spark, tmp_path):
    """A file that many tasks read range by range, with magics inside payloads across ranges."""
    path = str(tmp_path / "w")
    many = [(i, "u", f"{FAKE * (i % 3)}{i} " * (1 + i % 40), "c") for i in range(150)]
    warc.write_warc(spark.createDataFrame(many, SCHEMA).coalesce(1), path, compression="none")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert warc.pieces(spark, path).rdd.getNumPartitions() > 20
        rows = warc.read_warc(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 150 and all(r.complete and r.intact for r in rows)
    assert sorted((r.payload_bytes, r.payload_digest) for r in rows) == sorted((len(h), digest(h)) for _, _, h, _ in many)


def test_pointer_jumping_equals_walking():
    r = np.random.default_rng(1)
    for _ in range(200):
        offset = np.sort(r.choice(200, r.integers(1, 60), replace=False))
        offset[0] = 0 if r.random() < 0.9 else offset[0]
        after = np.array([r.choice(offset[offset > o]) if (offset > o).any() and r.random() < 0.9 else o + 1 for o in offset])
        seen, at, by = set(), 0, dict(zip(offset.tolist(), after.tolist(), strict=True))
        while at in by:
            seen.add(at)
            at = by[at]
        assert set(offset[warc.reachable(offset, after)].tolist()) == seen
    n = 100_000
    assert warc.reachable(np.arange(n), np.arange(n) + 1).all()
