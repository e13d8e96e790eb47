import hashlib
import random

import pytest

from auditlake.llm.quality_rules import SYMBOLS, quality_rules


def brute(text):
    """The base counts of one text, by plain loops."""
    words = (text or "").encode().split()
    n = len(words)
    windows = [tuple(words[i : i + 8]) for i in range(n - 7)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    repeated = sum(x in lines[:i] for i, x in enumerate(lines))
    symbols = sum(c in SYMBOLS.decode() for c in text or "")
    return n, sum(len(w.decode()) for w in words), symbols, repeated, len(covered), n < 20 or 100 * len(covered) > 30 * n


def texts():
    rng = random.Random(3)
    vocabulary = ["the", "Straße", "été", "x#y", "a|b", "日本", "zz z", "%%"]
    made = [None, "", " \t\n", "one", "a " * 19, "a " * 20, "line one\nline one\n\nline one\n x \n x "]
    for n in (7, 8, 9, 16, 40, 300):
        made += [" ".join(rng.choices(vocabulary, k=n)), "\n".join(rng.choices(vocabulary[:2], k=n))]
    made.append("a b c d e f g h " * 2 + " ".join(f"w{i}" for i in range(100)))
    made.append(" ".join(f"word{i % 5000}" for i in range(60_000)))
    return made


def test_base_counts_equal_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, kept string")
    out = quality_rules(docs).collect()
    assert len(out) == len(rows) + 2
    for r in out:
        if len(rows[r.doc_id][1] or "") < 10_000:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(rows[r.doc_id][1])
    long = next(r for r in out if r.n_words == 60_000)
    assert long.n_repeat_words == 60_000 and long.base_failed and not long.kept


def test_verdict_keeps_prose_and_rejects_hashes(spark):
    prose = "It was the best of times, it was the worst of times, it was the age of wisdom and of foolishness, as they say."
    noise = " ".join(f"{hashlib.md5(bytes([i])).hexdigest()[:12].upper()}#" for i in range(60))
    out = {r.doc_id: r for r in quality_rules(spark.createDataFrame([(1, prose), (2, noise)], "doc_id long, text string")).collect()}
    assert out[1].kept and out[1].script == "latin" and 2.5 < out[1].chars_per_token < 6
    assert not out[2].kept and not out[2].base_failed


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("text, script", [("привет мир", "cyrillic"), ("日本語の文章", "cjk"), ("123 456", "none"), ("été", "latin")])
def test_scripts(spark, text, script):
    assert quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().script == script
