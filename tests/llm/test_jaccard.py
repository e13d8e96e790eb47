import os
import random
import sys

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import compare  # noqa: E402

from auditlake.llm import jaccard  # noqa: E402
from auditlake.llm.components import components  # noqa: E402
from auditlake.llm.queries import op7_jaccard  # noqa: E402


def brute(rows):
    """All pairs of rows."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = (t or "").translate(lower).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            up[root(i)] = root(first.setdefault(d, i))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if None not in (rows[i][0], rows[j][0]) and a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                k = len(a & b)
                if 100 * k >= 75 * (len(a) + len(b) - k):
                    up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)) if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def near(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        rng.choice([lambda: words.__setitem__(at, f"e{rng.random()}"), lambda: words.pop(at), lambda: words.insert(at, "Extra")])()
    return " ".join(words)


def test_near_copies_passages_and_odd_rows(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    texts = [" ".join(word() for _ in range(rng.randint(5, 150))) for _ in range(120)]
    for base in range(12):
        words = [word() for _ in range(rng.randint(30, 200))]
        texts += [near(rng, words, rng.randint(0, 9)) for _ in range(rng.choice([2, 5, 60]))]
    texts += [" ".join(passage + [word() for _ in range(rng.randint(0, 40))]) for _ in range(80)]
    texts += ["a b c d", "A B c D", "a b c", "one", "one", "", "", "  ", None, "x y z w v", "x y z w v u", "same same " * 40, "same " * 90, "é B", "É b"]
    texts += [" ".join(f"l{i}" for i in range(30_000)), " ".join(f"l{i}" for i in range(29_000))]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows += [(3, texts[3]), (4, texts[200]), (4, texts[5]), (None, texts[6]), (None, None), (10_000, texts[6]), (-5, texts[7])]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n int, id string").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()), key=repr)
    assert got == brute(rows)


def test_hot_grams_many_fragments_and_relays(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FRAGMENT", 2000)  # about 20 fragments
    monkeypatch.setattr(jaccard, "FAN", 3)  # so three exchanges: 3, 9, 20
    monkeypatch.setattr(jaccard, "BLOCK", 4000)
    rng = random.Random(9)
    base = [f"w{rng.randrange(200)}" for _ in range(60)]
    rows = [(i, near(rng, base[: rng.choice([30, 60])], rng.randint(0, 6))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()), key=repr)
    assert got == brute(rows)


def test_equals_sql(spark, sf_dir):
    rows = compare(spark, sf_dir, op7_jaccard, jaccard.ORACLE_SQL)
    assert len({r[0] for r in rows}) < len(rows)


def test_equal_rows_in_different_tasks_all_come_back(spark):
    df = spark.createDataFrame([(1, "w w w")] * 8 + [(2, "W w w")] * 4, "doc_id long, text string").repartition(12)
    got = sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(df).collect())
    assert got == [(1, 1)] * 8 + [(2, 1)] * 4


def test_empty_table(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_long_chains(spark):
    rng = random.Random(1)
    ids = rng.sample(range(10_000), 300)
    edges = [(ids[i], ids[i + 1]) for i in range(199)] + [(ids[i + 1], ids[i]) for i in range(200, 299)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == min(ids[:200]) for i in ids[:200]) and all(got[i] == min(ids[200:]) for i in ids[200:])


def _sent_rows(spark, n, fan):
    """Message rows and their bytes over n documents of 30 own words and 30 that all share."""
    common = " ".join(f"c{i}" for i in range(30))
    rows = [(i, common + " " + " ".join(f"d{i}x{j}" for j in range(30))) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    text = df.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
    size = sum(len(t) for _, t in rows)
    fragments = -(-size // 2000)
    steps, width = [min(fragments, fan)], fan
    while width < fragments:
        width *= fan
        steps.append(min(width, fragments))
    sent = text.mapInArrow(jaccard._send(steps[0], 20_000), jaccard._SENT)
    counts = [sent.count()]
    for finer in steps[1:]:
        sent = sent.repartition("fragment").sortWithinPartitions("fragment", "source").mapInArrow(jaccard._relay(finer, 80_000), jaccard._SENT)
        counts.append(sent.count())
    return counts


def test_rows_sent_grow_with_the_input_alone(spark):
    sizes = [400, 800, 1600]
    most = [max(_sent_rows(spark, n, 8)) for n in sizes]
    assert most[1] < 2.6 * most[0] and most[2] < 2.6 * most[1], most


def test_equal_low_bits_do_not_merge_ngrams(spark):
    """N-grams that agree in 40 bits and their fragment are still two."""
    grams = np.sort(np.array([(1 << 63) + 5, (1 << 63) + 5 + (1 << 40), (1 << 63) + 5 + (2 << 40)], np.uint64))
    rows = pd.DataFrame([(0, f"b{i}", jaccard._packed(g), b"\x01" * len(g), None, None) for i, g in enumerate([grams[:2], grams[1:]])], columns=jaccard._NAMES)
    got = jaccard._answer((0,), rows)
    assert [np.frombuffer(r, np.uint8).tolist() for r in got["ranks"]] == [[0, 2], [2, 0]]
    assert all(jaccard._unpacked(g).tolist() == [int(grams[1])] for g in got["grams"])


def test_hot_class_of_copies_and_clashing_columns(spark):
    rows = [(i, "same text here for all of them", i, "c") for i in range(300)] + [(1000 + i, f"own {i} words that no one else has", i, "c") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, component string").repartition(7)
    df = df.withColumn("rep", F.lit(1)).withColumn("id", F.lit("x"))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()}
    assert all(got[i] == 0 for i in range(300)) and all(got[1000 + i] == 1000 + i for i in range(50))


def test_hashes_pack_and_unpack():
    rng = np.random.default_rng(3)
    for grams in (rng.integers(0, 1 << 64, 5000, np.uint64), rng.integers(0, 1 << 20, 50, np.uint64), np.array([0, 2**64 - 1], np.uint64), np.zeros(0, np.uint64)):
        grams = np.unique(grams)
        assert (jaccard._unpacked(jaccard._packed(grams)) == grams).all()
    for below in (1, 2, 3, 1000, 1024, 1025, 70_000):
        docs = rng.integers(0, below, 3001, np.uint32)
        assert (jaccard._widened(jaccard._narrow(docs, below), below, 3001) == docs).all()
    assert not len(jaccard._widened(jaccard._narrow(np.zeros(0, np.uint32), 5), 5, 0))
