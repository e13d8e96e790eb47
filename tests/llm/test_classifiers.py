import random

import numpy as np
import pytest

from auditlake.llm.queries import op1_toxicity, op6_quality
from auditlake.llm.subword_quality import BUCKETS, quality, repeats, score_quality, subwords, train
from auditlake.llm.toxicity import Words, WordTable, boost, deobfuscated, features, FEATURES, isotonic, toxicity


def corpus(spark, n=600):
    rng = random.Random(2)
    words = [w + e for w in ("lor", "ips", "dol", "sit", "ame", "con") for e in ("em", "um", "or", "is")]
    docs, labels = [], []
    for i in range(n):
        text, toxic, bad = rng.choices(words, k=rng.randint(5, 60)), i % 5 == 0, i % 4 == 0
        if toxic:
            text[1:1] = ["you", rng.choice(["zorp", "idiot", "1d10t"])]
        if bad:
            text = [w + "$$$" for w in text]
        docs.append((i, " ".join(text), "s"))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(n, None, "s"), (n + 1, "", "s"), (3, docs[3][1], "s"), (n + 2, "lorem you " * 30_000, "s")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels + [(1, None, None)], "doc_id long, quality int, toxic int")


def accuracy(rows, labels, column):
    truth = {r.doc_id: r[column] for r in labels.collect() if r[column] is not None}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    return len(held), np.mean([r.predicted == truth[r.doc_id] for r in held])


@pytest.mark.parametrize("operator, column", [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_accuracy_and_odd_rows(spark, operator, column):
    docs, labels = corpus(spark)
    out = operator(docs, labels)
    rows = out.collect()
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and len(rows) == 604
    n, right = accuracy(rows, labels, column)
    assert n > 80 and right > 0.95  # a constant guess has 0.8 and 0.75
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 3}) == 1
    assert len({r.score for r in rows if r.doc_id in (600, 601)}) == 1
    assert operator(docs.limit(0), labels).count() == 0
    assert all(0 <= r.score <= 1 for r in operator(docs, labels.limit(0)).collect())


def balanced(rows, truth):
    """Mean of the shares of both labels that are predicted right: 0.5 for any constant guess."""
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    return len(held), np.mean([np.mean([p == label for t, p in held if t == label]) for label in (0, 1)])


@pytest.mark.parametrize("query, column, least", [(op1_toxicity, "toxic", 0.9), (op6_quality, "quality", 0.95)])
def test_held_out_rows_of_the_table(spark, sf_dir, query, column, least):
    sf_dir = sf_dir.replace("sf0.001", "sf0.1")
    rows = query(spark, sf_dir).collect()
    truth = {r.doc_id: r[column] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r[column] is not None}
    n, right = balanced(rows, truth)
    print(query.__name__, n, right, len({r.score for r in rows}))
    assert n > 500 and right > least and len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_features_of_small_texts():
    table = WordTable(lambda: Words({"zorp": 2.0}))
    x = features([b"", b"YOU are an idiot!", b"a zorp z0rp", b"x " * 9 + b"you", b"id.iot you"], table)
    at = {f: i for i, f in enumerate(FEATURES)}
    assert not x[0].any() and x[1][at["fixed count"]] == 1 and x[1][at["near second"]] == 0.25 and x[1][at["shouted share"]] == 0.25
    assert x[2][at["learned count"]] == 1 and x[2][at["obfuscated count"]] == 1 and x[2][at["learned distinct"]] == 1
    assert x[3][at["near second"]] == 0 and x[4][at["obfuscated count"]] == 1
    assert deobfuscated("$tuuuup1d") == "stupid"


def test_isotonic_is_monotone_and_boost_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = boost(x, y)
    trees.knots, trees.values = isotonic(trees.margin(x), y)
    assert (np.diff(trees.values) >= 0).all() and (np.diff(trees.knots) >= 0).all()
    fresh = rng.normal(size=(2000, 4))
    assert ((trees.score(fresh) >= 0.5) == ((fresh[:, 0] > 0) ^ (fresh[:, 1] > 0.5))).mean() > 0.95


def test_scoring_by_word_equals_the_averaged_vectors(spark):
    rng = np.random.default_rng(3)
    texts = ["some words some words", "other other text", "é"]
    bags = []
    for t in texts:
        words = t.encode().split()
        flat = subwords(words)[0].tolist() + [BUCKETS] * sum(a == b for a, b in zip(words, words[1:], strict=False))
        bags.append((np.array(flat), np.full(len(flat), 1 / len(flat))))
    model = train(bags * 30, np.array([0, 1, 1] * 30), epochs=3)
    model.vectors += rng.normal(0, 0.1, model.vectors.shape)
    want = []
    for b, s in bags:
        z = (s @ model.vectors[b]) @ model.output + model.bias
        want.append(1 / (1 + np.exp(z[0] - z[1])))
    got = {r.doc_id: r.score for r in score_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert np.allclose([got[i] for i in range(3)], want, atol=1e-5)
    assert repeats(np.array([1, 1, 1, 2, 2]), np.array([0, 2, 2, 5])).tolist() == [1, 0, 1]


def test_a_repeated_labelled_id_is_one_training_row(spark):
    from auditlake.llm.labelled import training_rows

    docs = spark.createDataFrame([(i % 40, f"text {i}") for i in range(400)] + [(7, f"copy {i}") for i in range(300)] + [(9, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = training_rows(docs, labels, "quality", 30).collect()
    assert len(rows) <= 30 and len(rows) == len({r["__id"] for r in rows}) > 10
    assert sorted(rows) == sorted(training_rows(docs.repartition(7), labels, "quality", 30).collect())
