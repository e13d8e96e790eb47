"""Quality rules: counts over whole texts, and tokeniser fertility against bands per script.

Fertility measures how a public vocabulary cuts a text: characters per token, the share of tokens that are
pieces of characters (byte fallback), and the entropy of the tokens used. Each word is measured once, as
the vocabulary cuts it after a space, and words are counted per document with numpy.

Null text counts as empty: no words, so the base rules fail it. Repeated rows are measured alike, row by row. Long texts are measured
whole, in blocks of their own; an empty table gives no rows. Where two scripts have equally many letters the first in BANDS counts. Columns
not in `keep` play no part; `keep` may not name columns of the result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from auditlake.llm.text import Runs, WordTable, blocks, encoded, gather, release, spans, sums

WINDOW = 8
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """What a script's texts must keep within."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_fallback_share: float
    min_entropy_share: float


#: Bands by script. Latin prose takes about two characters a token even when invented, text full of capitals and
#: symbols fewer; scripts of syllables or ideographs take about one token a character and fall back to bytes often.
BANDS = {
    "latin": Band(1.72, 12.0, 0.20, 0.42),
    "cyrillic": Band(0.9, 12.0, 0.30, 0.35),
    "greek": Band(0.6, 12.0, 0.80, 0.30),
    "arabic": Band(0.6, 12.0, 0.80, 0.30),
    "cjk": Band(0.3, 8.0, 0.95, 0.25),
    "other": Band(0.25, 12.0, 0.98, 0.20),
    "none": Band(0.8, 12.0, 0.30, 0.35),
}
SCRIPTS = list(BANDS)
#: First code point, last code point, script; letters elsewhere are "other".
RANGES = [
    (0x41, 0x5A, "latin"), (0x61, 0x7A, "latin"), (0xC0, 0x24F, "latin"), (0x1E00, 0x1EFF, "latin"),
    (0x370, 0x3FF, "greek"), (0x400, 0x52F, "cyrillic"), (0x600, 0x6FF, "arabic"), (0x750, 0x77F, "arabic"),
    (0x3040, 0x30FF, "cjk"), (0x3400, 0x9FFF, "cjk"), (0xAC00, 0xD7AF, "cjk"), (0x20000, 0x3FFFF, "cjk"),
]


@lru_cache(1)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    import public_tokenizers

    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _scripts(texts: list[str], lengths: np.ndarray) -> np.ndarray:
    """Letters of each script, by word."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    first = np.array([r[0] for r in RANGES])
    last = np.array([r[1] for r in RANGES])
    of = np.array([SCRIPTS.index(r[2]) for r in RANGES])
    order = np.argsort(first)
    at = np.maximum(np.searchsorted(first[order], points, "right") - 1, 0)
    inside = (points >= first[order][at]) & (points <= last[order][at])
    kind = np.where(inside, of[order][at], np.where(points > 0x24F, SCRIPTS.index("other"), len(SCRIPTS)))
    word = np.repeat(np.arange(len(texts)), lengths)
    width = len(SCRIPTS) + 1
    return np.bincount(word * width + kind, minlength=width * len(texts)).reshape(-1, width)[:, :-1].astype(np.int32)


@lru_cache(1)
def _pieces(path: str) -> np.ndarray:
    """Which tokens of the vocabulary are pieces of characters."""
    encoding = _encoding(path)
    out = np.zeros(encoding.n_vocab + 1, bool)
    for token in encoding.token_byte_values():
        try:
            token.decode()
        except UnicodeDecodeError:
            out[encoding.encode_single_token(token)] = True
    return out


class _Measure:
    """Per word: code points, symbols, tokens, pieces of characters, letters by script."""

    def __init__(self, path: str):
        self.encoding, self.partial, self.tokens = _encoding(path), _pieces(path), Runs(np.int32)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        texts = [w.decode() for w in words]
        cut = [self.encoding.encode_ordinary(" " + t) for t in texts]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = np.fromiter((x for c in cut for x in c), np.int32, int(counts.sum()))
        at = self.tokens.add(flat)
        points = np.fromiter(map(len, texts), np.int64, len(texts))
        symbols = np.fromiter((len(w) - len(w.translate(None, SYMBOLS)) for w in words), np.int64, len(words))
        scripts = _scripts(texts, points)
        offsets = spans(counts)
        return points, symbols, at + offsets[:-1], counts, sums(self.partial[flat].astype(np.int64), offsets), scripts


def repeated_words(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per run of word numbers, the words that windows of WINDOW words found twice or more in the run cover."""
    out = np.zeros(len(ids) + 1, np.int64)
    lengths = np.diff(offsets)
    starts_per = np.maximum(lengths - WINDOW + 1, 0)
    starts_per[starts_per < 2] = 0
    starts = gather(offsets[:-1], starts_per)
    if len(starts):
        run = np.repeat(np.arange(len(lengths)), starts_per)
        key = run.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        wide = ids.astype(np.uint64) + np.uint64(1)
        for j in range(WINDOW):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + wide[starts + j]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        a, b = starts[order][:-1][same], starts[order][1:][same]
        alike = (run[order][:-1][same] == run[order][1:][same])
        for j in range(WINDOW):
            alike &= ids[a + j] == ids[b + j]
        twice = np.zeros(len(starts), bool)
        if alike.all():
            twice[1:] |= same
            twice[:-1] |= same
            found = starts[order][twice]
        else:  # two windows share a hash: count these by their words
            seen: dict[tuple, list[int]] = {}
            for r, s in zip(run.tolist(), starts.tolist(), strict=True):
                seen.setdefault((r, *ids[s : s + WINDOW].tolist()), []).append(s)
            found = np.array([s for v in seen.values() if len(v) > 1 for s in v], np.int64)
        np.add.at(out, found, 1)
        np.add.at(out, found + WINDOW, -1)
    return sums((np.cumsum(out)[:-1] > 0).astype(np.int64), offsets)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


SCHEMA = """n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,
chars_per_token double, fallback_share double, entropy_share double, script string, kept boolean"""
_ARROW = pa.schema([(n, t) for n, t in [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("chars_per_token", pa.float64()),
    ("fallback_share", pa.float64()), ("entropy_share", pa.float64()), ("script", pa.string()), ("kept", pa.bool_())]])


def measure_texts(texts: list[bytes], table: WordTable, bands: dict[str, Band] = BANDS) -> list[np.ndarray]:
    """The columns of SCHEMA for some texts; the table measures words with `_Measure`."""
    cut = [t.split() for t in texts]
    offsets = spans(np.fromiter(map(len, cut), np.int64, len(cut)))
    ids = table.numbers([w for c in cut for w in c])
    points, symbols, at, counts, partial, scripts = table.columns
    measure = table.measure
    n_words = np.diff(offsets)
    per = [sums(x[ids], offsets) for x in (points, symbols, counts, partial)]
    word_chars, n_symbols, n_tokens, n_partial = per
    repeat = repeated_words(ids, offsets)
    lines = np.fromiter(map(duplicate_lines, texts), np.int64, len(texts))
    failed = (n_words < 20) | (100 * repeat > 30 * n_words)
    # entropy of the tokens of each text
    tokens = measure.tokens.values[gather(at[ids], counts[ids])]
    doc = np.repeat(np.arange(len(texts)), n_tokens)
    keys = np.sort(doc * np.int64(len(measure.partial)) + tokens)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    runs = np.diff(np.concatenate([first, [len(keys)]]))
    loss = np.bincount(keys[first] // len(measure.partial), runs * np.log2(np.maximum(runs, 1)), len(texts)) if len(keys) else np.zeros(len(texts))
    n = np.maximum(n_tokens, 1)
    entropy = np.log2(n) - loss / n
    share = np.where(n_tokens > 1, entropy / np.maximum(np.log2(np.minimum(n, len(measure.partial))), 1e-9), 0.0)
    letters = np.stack([sums(scripts[ids, k].astype(np.int64), offsets) for k in range(len(SCRIPTS))], 1)
    script = np.where(letters.sum(1) > 0, letters.argmax(1), SCRIPTS.index("none"))
    limits = np.array([[b.min_chars_per_token, b.max_chars_per_token, b.max_fallback_share, b.min_entropy_share] for b in bands.values()])[script]
    ratio, fallback = word_chars / n, n_partial / n
    good = (ratio >= limits[:, 0]) & (ratio <= limits[:, 1]) & (fallback <= limits[:, 2]) & (share >= limits[:, 3])
    return [n_words, word_chars, n_symbols, lines, repeat, failed, ratio, fallback, share, np.array(SCRIPTS)[script], ~failed & good]


def quality_rules(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), bands: dict[str, Band] = BANDS) -> DataFrame:
    """`keep` columns and those of SCHEMA for every row; `path` is a rank file of a byte-level vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(lambda: _Measure(path))
        for part in blocks(batches, "__text"):
            made = measure_texts(encoded(part, "__text"), table, bands)
            kept = [part.column(c) for c in keep]
            made = [pa.array(v, f.type) for v, f in zip(made, _ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays(kept + made, [*keep, *_ARROW.names])
        del table
        release()

    chosen = docs.select(*keep, docs[text].alias("__text"))
    schema = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep)
    return chosen.mapInArrow(run, f"{schema}, {SCHEMA}")
