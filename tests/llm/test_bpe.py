import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from auditlake.llm.bpe import bpe, chunk_table, decode, encode

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def same(library, texts):
    ids, counts, decoded = encode([t.encode() for t in texts], chunk_table(PATH))
    ends = np.cumsum(counts)
    for t, n, e, d in zip(texts, counts, ends, decoded, strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids[e - n : e].tolist() == want, t
        assert d.decode() == library.decode(want, skip_special_tokens=False) == decode(want, PATH)


def test_equals_library_on_fixed_texts(library):
    rng = random.Random(1)
    texts = ["", " \n", "aaaa aaaaa aaaaaaaaaaaaaaaaaaaa", "I'll don't 'S we've", "x<|endoftext|>Y <|startoftext|><|endoftext|>", "ΑΣ ΟΔΟΣ İstanbul ǅ ẞ",
             "é  nb sp \x85 \x1c", "日本語 한국어 🎉🎉 123456 a1b2", "!!! ... ??!", "<|ENDOFTEXT|> <|endoftext", "à́" * 5, "ß" * 300, " "]
    texts += ["".join(rng.choices("abcdeé'  \n!1Σ", k=n)) for n in (10, 100, 1000, 5000)]
    texts.append("".join(rng.choices("abc", k=20_000)))
    same(library, texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=6))
def test_equals_library(library, texts):
    same(library, texts)


def test_equals_library_on_every_code_point(library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    table = chunk_table(PATH)
    for k in range(0, len(points), 50_000):
        texts = [f"a{chr(c)}b" for c in points[k : k + 50_000]]
        ids, counts, _ = encode([t.encode() for t in texts], table)
        ends = np.cumsum(counts)
        want = library.encode_batch(texts, add_special_tokens=False)
        assert not [t for t, e, n, w in zip(texts, ends, counts, want, strict=True) if ids[e - n : e].tolist() != w.ids]


def test_rows(spark, library):
    texts = [None, "", "Hello, World", "Hello, World", "x " * 50_000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    rows = {r.doc_id: r for r in bpe(docs, full=True).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert rows[i].ids == want and rows[i].n_tokens == len(want)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe(docs.limit(0)).count() == 0
