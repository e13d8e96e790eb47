import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from auditlake.llm.mixing import mix, mixed, pivot_round, targets


def brute_targets(sizes):
    """Shares by weight; sources above their cap stop there, and the excess goes on to the others."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def rows(n=6000, seed=1):
    rng = random.Random(seed)
    out = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice(["a", "a", "a", "b", "c", "d", None]), i) for i in range(n)]
    out += [(n, None, "a", 0), (n + 1, "x", "tiny", 0), (n + 2, "  ", "empty", 0), (None, "null id", "b", 0), (5, "again again", "b", 0), (5, "again again", "b", 0), (n + 3, "w " * 60_000, "b", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, source string, size int")


def test_targets_and_taken(spark, docs):
    out = mix(docs).collect()
    assert len(out) == len(rows())
    sizes, got, target = Counter(), Counter(), {}
    largest = defaultdict(int)
    for r in out:
        sizes[r.source] += r.size
        got[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(got[s] - target[s]) <= largest[s] + 1e-6
    assert all(r.source_size == sizes[r.source] for r in out)
    again = mix(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_mixed_rows(docs):
    want = Counter()
    for r in mix(docs).collect():
        want[(r.doc_id, r.source)] += r.copies
    got = Counter((r.doc_id, r.source) for r in mixed(docs).collect())
    assert +want == got and mixed(docs).columns == docs.columns


def test_many_rows_without_an_id_or_with_one_id(spark, monkeypatch):
    """Buckets stay small, whatever the ids are, and targets are met."""
    from auditlake.llm import mixing

    monkeypatch.setattr(mixing, "BUCKET", 64)
    inner = mixing._round_bucket

    def spied(level, seed):
        run = inner(level, seed)

        def measured(key, rows):
            return run(key, rows).assign(copies=len(rows)) if level == 0 else run(key, rows)

        return measured

    rows = [(None, f"a{i % 50} " * (i % 7 + 1), "s", 0) for i in range(2000)] + [(7, "b b", "s", 0)] * 2000 + [(i, "c " * 40, "t", 0) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, place int").repartition(5)
    out = mix(docs).collect()
    assert len(out) == len(rows)
    for s in ("s", "t"):
        mine = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 40
    words = Counter()
    for r in mixed(docs).collect():
        words[r.source] += len(r.text.split())
    assert all(abs(words[r.source] - r.target) <= 40 for r in out)
    monkeypatch.setattr(mixing, "_round_bucket", spied)
    most = max(r.copies for r in mix(docs).collect())
    assert most < 64 * 3


def test_targets_of_very_many_sources(spark):
    sizes = {f"host{i}": (i * 7919) % 1000 + 1 for i in range(3000)} | {None: 5}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(6)
    got = {r.source: r.target for r in targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_empty(spark, docs):
    assert mix(docs.limit(0)).count() == 0 and mixed(docs.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, None, 0)], docs.schema)
    assert [tuple(r) for r in mix(blank).select("size", "source_size", "target", "taken").collect()] == [(0, 0, 0.0, 0)]


def test_pivot_keeps_words_and_is_fair():
    size = np.array([3.0, 5, 8, 1, 9, 4, 4])
    chance = np.array([0.2, 0.7, 0.5, 0.9, 0.35, 0.5, 0.1])
    total = np.zeros(7)
    for k in range(4000):
        p, left = pivot_round(size, chance, np.random.default_rng(k))
        assert (p * size).sum() == pytest.approx((chance * size).sum())
        assert sum(0 < x < 1 for x in p) <= 1 and (left < 0 or 0 < p[left] < 1)
        total += p
    assert np.allclose(total / 4000, chance, atol=0.03)
