import hashlib
import os
import random
import sys
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_jaccard import brute, near  # noqa: E402
from test_mixing import brute_targets  # noqa: E402

import corpus_pipeline  # noqa: E402
from auditlake.llm.pii import all_spans, redacted, train  # noqa: E402
from auditlake.llm.quality_rules import _Measure, measure_texts  # noqa: E402
from auditlake.llm.text import WordTable  # noqa: E402


def fixture(spark, tmp_path):
    rng = random.Random(4)
    syllables = ["re", "the", "tion", "an", "is", "er", "ly", "mo", "sta", "ing"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    texts = []
    for _ in range(60):
        words = [word() for _ in range(rng.randint(30, 120))]
        words[5:5] = rng.choice([[], ["mail", "to", "jo.do@example.com"], ["+1 (555) 234-5678"]])
        texts += [near(rng, words, rng.choice([0, 1, 30])) for _ in range(rng.choice([1, 1, 3]))]
    texts += [None, "", "short", "word " * 80, " ".join(f"%%{i}##" for i in range(60))]
    rows = [(i, t, "en", rng.choice(["a", "b", None]), len(t or ""), i) for i, t in enumerate(texts)]
    rows += [rows[0], rows[3]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return rows


def test_pipeline_equals_plain_loops(spark, tmp_path):
    rows = fixture(spark, tmp_path)
    out = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    good = [r for r in rows if measure_texts([(r[1] or "").encode()], WordTable(lambda: _Measure(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))))[-1][0]]
    assert 0 < len(good) < len(rows)
    component = {d: c for d, _, c in brute([(r[0], r[1]) for r in good])}
    left = {r[0]: r for r in good if component[r[0]] == r[0]}
    weights = train()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: library.encode(redacted(r[1], all_spans(r[1], weights)[1]), add_special_tokens=False).ids for d, r in left.items()}
    got = Counter(o["doc_id"] for o in out)
    assert set(got) <= set(left) and max(got.values()) <= 3
    for o in out:
        want = ids[o["doc_id"]]
        assert o["n_tokens"] == len(want) and o["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    # words taken per source come near the targets
    size = {d: len(redacted(r[1], all_spans(r[1], weights)[1]).encode().split()) for d, r in left.items()}
    by, total = Counter(), Counter()
    for d, k in got.items():
        by[left[d][3]] += k * size[d]
    for d in left:
        total[left[d][3]] += size[d]
    target = brute_targets(total)
    assert all(abs(by[s] - target[s]) <= max(size.values()) for s in target), (by, target)


def test_stages_keep_columns_and_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, script string"
    odd = spark.createDataFrame([(None, "b " * 30, None, None, None, "z"), (None, None, None, None, 1, "z"), (1, "w " * 3, "x", "s", 2, "z"), (1, "w " * 3, "x", "s", 2, "z")], schema)
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            out = stage(spark, docs, "")
            assert name == "BPE" or out.columns == docs.columns
            out.collect()
    assert corpus_pipeline.keep_distinct(spark, odd, "").count() == 3


def test_one_id_on_different_texts_loses_none(spark):
    words = [f"w{i}" for i in range(90)]
    rows = [(1, " ".join(words[:30]), "a"), (1, " ".join(words[30:60]), "b"), (1, " ".join(words[60:]), "c"), (2, " ".join(words[:30]), "d"), (None, " ".join(words[30:60]), "e"), (0, None, "f"), (0, None, "g"), (None, "own text of a row without an id", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = sorted(r.lang for r in corpus_pipeline.keep_distinct(spark, docs, "").collect())
    assert kept == ["a", "b", "c", "f", "g", "h"]


def test_clashing_columns(spark):
    names = ["__place", "_place", "__copies", "__text", "__id", "__key", "size", "mark", "component_id", "kept", "n", "copies", "taken", "spans"]
    row = spark.createDataFrame([(1, "first text of some words", "s"), (2, "first text of some words", "s"), (3, "another one with its own words", None)], "doc_id long, text string, source string")
    docs = row.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert all([r[n] for n in names] == list(range(len(names))) for r in out.collect())
    assert [r.doc_id for r in corpus_pipeline.keep_distinct(spark, docs, "").orderBy("doc_id").collect()] == [1, 3]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 3


def test_every_operator_ignores_clashing_columns(spark):
    """Operators read the columns they need, whatever else there is."""
    from auditlake.llm import bpe, hnsw, jaccard, mixing, pii, quality_rules, subword_quality, toxicity

    names = ["__text", "__id", "__label", "__aside", "__place", "score", "predicted", "held_out", "n_tokens", "kept", "x", "place", "mark", "rep", "c", "n"]
    base = spark.createDataFrame([(i, f"some words of text {i} you idiot" if i % 3 else None, "s") for i in range(30)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 > 0)) for i in range(30)], "doc_id long, quality int, toxic int")
    extra = lambda df: df.select("*", *[F.lit("y").alias(n) for n in names])
    for run in (lambda d: toxicity.toxicity(d, extra(labels)), lambda d: subword_quality.quality(d, extra(labels)), pii.find_pii, quality_rules.quality_rules, bpe.bpe, mixing.mix, jaccard.jaccard_components):
        plain, odd = run(base), run(extra(base))
        assert plain.columns == odd.columns
        assert sorted(map(str, plain.drop("place").collect())) == sorted(map(str, odd.drop("place").collect()))
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    assert sorted(hnsw.nearest_neighbours(vectors).collect()) == sorted(hnsw.nearest_neighbours(extra(vectors)).collect())
