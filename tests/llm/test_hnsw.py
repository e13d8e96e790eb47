import math

import numpy as np
import pyarrow as pa

from auditlake.llm.hnsw import Graph, _unit, build, nearest_neighbours
from auditlake.llm.queries import op9_hnsw


def brute(rows, every, k):
    """All cosines; vectors that take no part are left out."""
    good = {}
    for i, v in sorted(rows, key=lambda r: (r[0], r[1] or [])):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v) and i not in good:
            good[i] = np.array(v, float)
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for j, i in enumerate(ids):
        if i % every == 0:
            s = x @ x[j]
            out[i] = [(ids[m], s[m]) for m in sorted((m for m in range(len(ids)) if m != j), key=lambda m: (-round(s[m], 12), ids[m]))[:k]]
    return out


def test_recall_and_ranks_on_the_table(spark, sf_dir):
    table = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute(table, 50, 5)
    got = {}
    for r in op9_hnsw(spark, sf_dir).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert got.keys() == want.keys() and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    right = sum(got[q][i + 1][0] == v and abs(got[q][i + 1][1] - s) < 1e-12 for q, w in want.items() for i, (v, s) in enumerate(w))
    assert right / sum(map(len, want.values())) >= 0.9


def test_recall_over_shards_with_a_common_vector(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[1000:2000] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = brute(rows, 20, 5)
    got = {}
    for r in nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=20, shard_rows=800).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    hits = sum(len({v for v, _ in w} & {v for _, v in got[q]}) for q, w in want.items())
    assert hits / (5 * len(want)) >= 0.9
    assert sorted(got[100]) == [(i + 1, 1000 + i) for i in range(5)] and sorted(got[1000])[0] == (1, 100)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 0.0]), (10, [1.0, 2.0, 3.0]), (100, None), (11, [1e300, 1e300])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in nearest_neighbours(df).collect())
    assert got == [(0, 1, 3), (0, 2, 11), (0, 3, 50), (50, 1, 3), (50, 2, 11), (50, 3, 0)]
    assert nearest_neighbours(df.limit(0)).count() == 0 and nearest_neighbours(df.where("vec_id = 0")).count() == 0


def test_graph_survives_storage():
    unit = _unit(np.random.default_rng(2).normal(size=(500, 8))).astype(np.float32)
    g = build(unit)
    h = Graph.load(g.save())
    assert (g.nearest(unit[:50])[0] == h.nearest(unit[:50])[0]).all()
    assert (h.nearest(unit[:50])[0][:, 0] == np.arange(50)).all()


def test_near_members_of_one_float32_direction_are_scored(spark):
    rows = [(0, [1.0, 0.0])] + [(i, [1.0, 0.5 - i * 1e-10]) for i in range(1, 21)] + [(i, [-1.0, 0.1 * i]) for i in range(30, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id) for r in nearest_neighbours(df, every=1000).collect())
    assert got == [(1, 20), (2, 19), (3, 18), (4, 17), (5, 16)]


def test_recall_of_a_full_shard(spark):
    """More vectors than any other test, in shards of the usual size, in clusters."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(200, 32))
    x = (centres[rng.integers(0, 200, 24_000)] + 0.6 * rng.normal(size=(24_000, 32))).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(24_000), "embedding": list(x)}))
    got = {}
    for r in nearest_neighbours(df, every=200).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 24_000, 200):
        s = u @ u[q]
        s[q] = -2
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert len(got) == 120 and hits / 600 >= 0.9, hits
