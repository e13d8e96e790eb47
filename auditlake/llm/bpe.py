"""BPE encoding and decoding by batched numpy merge rounds.

Symbols of many words lie in one flat array. Each round looks every neighbouring pair up by binary search in
the sorted pair keys, takes the lowest rank of each word, and merges all its occurrences from left to right;
words without a pair that merges leave the array. That equals merging one pair at a time, as long as no
merge that uses a symbol ranks before the merge that makes it; `Vocabulary` checks this when it loads.

Texts are cut at ASCII white space, which the vocabulary drops, into chunks; each distinct chunk is normalised,
split and merged once a block, and documents gather their chunks' ids. Letters, numbers and capitals are those
of the library, also where `regex` and `str` know more or fewer; all code points encode alike.

Null and empty texts have no tokens. Long texts are encoded whole, in blocks of their own. Repeated rows give equal rows, an
empty table none. Columns not in `keep` play no part, whatever their names; `keep` may not name n_tokens or the digests. No ties arise: of equal pairs in a word the leftmost merges first.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from auditlake.llm.text import Runs, WordTable, blocks, encoded, gather, release, spans, sums

NEVER = np.int64(1) << 40
#: How the vocabulary file splits normalised text; what no alternative matches is white space, and dropped.
PATTERN = r"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{L}--[LETTERS]]+|[\p{N}--[NUMBERS]]|[^\s[\p{L}--[LETTERS]][\p{N}--[NUMBERS]]]+"
#: Ranges of code points that `regex` takes for letters or numbers and the library, at Unicode 16, does not (fixed values).
NEW_LETTERS = """558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee
11b0a 11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128
1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f
2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"""
NEW_NUMBERS = "11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6"
#: Capitals that the library lower-cases and `str.lower` does not know yet: first, last, what to add (fixed values).
NEW_CAPITALS = [(0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
                (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)]
#: By one character, as the vocabulary's normaliser lower-cases: no final sigma.
_LOWER = {c: c + d for a, b, d in NEW_CAPITALS for c in range(a, b + 1)} | {ord("Σ"): ord("σ")}


def _class(ranges: str) -> str:
    return "".join("-".join(f"\\U{int(c, 16):08x}" for c in r.split("-")) for r in ranges.split())


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand = {b: chr(b) for b in printable}
    return [stand[b] if b in stand else chr(256 + [x for x in range(256) if x not in stand].index(b)) for b in range(256)]


class Vocabulary:
    """A BPE vocabulary file with word ends: ids, sorted pair keys and their ranks."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.token = [""] * self.size
        for t, i in [*ids.items(), *self.special.items()]:
            self.token[i] = t
        self.inner = np.array([ids[c] for c in byte_characters()], np.int64)
        self.last = np.array([ids[c + end] for c in byte_characters()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        born = np.full(self.size, -1, np.int64)
        born[made[::-1]] = np.arange(len(made))[::-1]
        if (born[left] >= np.arange(len(made))).any() or (born[right] >= np.arange(len(made))).any():
            raise ValueError("a merge ranks before the merge that makes its symbol; rounds would not equal single merges")
        self.split = regex.compile(PATTERN.replace("LETTERS", _class(NEW_LETTERS)).replace("NUMBERS", _class(NEW_NUMBERS))).findall
        self.split_ascii = regex.compile(PATTERN.replace("--[LETTERS]", "").replace("--[NUMBERS]", "")).findall
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def words(self, chunk: str) -> list[bytes | int]:
        """Words of a chunk as UTF-8 bytes, special tokens as their ids."""
        parts = self.marks.split(chunk) if self.marks and any(s in chunk for s in self.special) else [chunk]
        out: list[bytes | int] = []
        for p in parts:
            if p in self.special:
                out.append(self.special[p])
            elif p:
                if p.isascii():
                    out += [w.encode() for w in self.split_ascii(p.lower())]
                else:
                    out += [w.encode() for w in self.split(unicodedata.normalize("NFC", p).translate(_LOWER).lower())]
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and the number of ids of each word; no word is empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths)
        if len(words):
            symbols[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_word = [], []
        while len(symbols):
            pair = np.full(len(symbols), NEVER)  # rank of the pair that starts here
            inside = np.flatnonzero(word[1:] == word[:-1])
            at = np.searchsorted(self.keys, key := symbols[inside] * self.size + symbols[inside + 1])
            at = np.minimum(at, len(self.keys) - 1)
            known = self.keys[at] == key
            pair[inside[known]] = self.rank[at[known]]
            place = np.zeros(len(symbols), np.int64)
            place[inside[known]] = at[known]
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(pair, begin)
            counts = np.diff(np.concatenate([begin, [len(symbols)]]))
            over = np.repeat(least == NEVER, counts)
            if over.any():
                done_symbols.append(symbols[over])
                done_word.append(word[over])
            hit = (pair == np.repeat(least, counts)) & ~over
            # of pairs that overlap, every second one
            index = np.arange(len(symbols))
            start = hit & ~np.concatenate([[False], hit[:-1]])
            run = np.maximum.accumulate(np.where(start, index, 0))
            hit &= (index - run) % 2 == 0
            symbols = np.where(hit, self.made[place], symbols)
            stay = ~over & ~np.concatenate([[False], hit[:-1]])
            symbols, word = symbols[stay], word[stay]
        if not done_word:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        all_word = np.concatenate(done_word)
        order = np.argsort(all_word, kind="stable")
        return np.concatenate(done_symbols)[order].astype(np.int32), np.bincount(all_word, minlength=len(words))


class _Measure:
    """Per chunk: where its ids begin, and how many there are; `shown` has its tokens joined by spaces."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.ids, self.shown = vocabulary, Runs(np.int32), []

    def __call__(self, chunks: list[bytes]) -> tuple[np.ndarray, ...]:
        v = self.vocabulary
        words = [v.words(c.decode()) for c in chunks]
        flat = [w for c in words for w in c]
        special = np.fromiter((isinstance(w, int) for w in flat), bool, len(flat))
        numbers: dict[bytes, int] = {}
        where = np.fromiter((-1 if isinstance(w, int) else numbers.setdefault(w, len(numbers)) for w in flat), np.int64, len(flat))
        ids, counts = v.merge(list(numbers))
        starts = spans(counts)[:-1]
        # special tokens follow as runs of one
        ids = np.concatenate([ids, np.array([w for w in flat if isinstance(w, int)], np.int32)])
        size = np.ones(len(flat), np.int64)
        begin = np.zeros(len(flat), np.int64)
        size[~special], begin[~special] = counts[where[~special]], starts[where[~special]]
        begin[special] = int(counts.sum()) + np.arange(int(special.sum()))
        out = ids[gather(begin, size)]
        per = sums(size, spans(np.fromiter(map(len, words), np.int64, len(words))))
        at = self.ids.add(out)
        ends = np.cumsum(per)
        tokens = [v.token[i] for i in out.tolist()]
        self.shown += [" ".join(tokens[e - n : e]).encode() for e, n in zip(ends.tolist(), per.tolist(), strict=True)]
        return at + ends - per, per


#: A worker keeps the last vocabulary, whose size is the file's.
vocabulary = lru_cache(1)(Vocabulary)


def chunk_table(path: str) -> WordTable:
    """What `encode` keeps from block to block."""
    return WordTable(lambda: _Measure(vocabulary(path)), 2 << 20)


def encode(texts: list[bytes], table: WordTable) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids of all texts in order, their counts by text, and each text decoded again from its ids."""
    cut = [t.split() for t in texts]
    chunks = spans(np.fromiter(map(len, cut), np.int64, len(cut)))
    numbers = table.numbers([c for x in cut for c in x])
    at, per = table.columns
    measure = table.measure
    counts = per[numbers]
    ids = measure.ids.values[gather(at[numbers], counts)]
    shown = measure.shown
    listed = numbers[counts > 0].tolist()
    ends = sums((counts > 0).astype(np.int64), chunks).cumsum().tolist()
    decoded = [b" ".join([shown[i] for i in listed[a:b]]) for a, b in zip([0, *ends], ends, strict=False)]
    return ids, sums(counts, chunks), decoded


def decode(ids: Iterable[int], path: str) -> str:
    """The tokens joined by spaces, as a vocabulary file without a decoder asks for."""
    token = vocabulary(path).token
    return " ".join(token[i] for i in ids)


_DIGEST = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
_FULL = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string())}


def bpe(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), full: bool = False) -> DataFrame:
    """`keep` columns, n_tokens, ids_sha256 and decoded_sha256 of every row; with `full`, ids and decoded text too."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    columns = _DIGEST | (_FULL if full else {})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(path)
        for part in blocks(batches, "__text"):
            ids, counts, decoded = encode(encoded(part, "__text"), table)
            raw, offsets = ids.astype("<u4").tobytes(), spans(counts)
            made = [counts, [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], [hashlib.sha256(d).hexdigest() for d in decoded]]
            arrays = [part.column(c) for c in keep] + [pa.array(m, t) for m, (_, t) in zip(made, _DIGEST.values(), strict=True)]
            if full:
                arrays += [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.array([d.decode() for d in decoded])]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *columns])
        del table
        release()

    chosen = docs.select(*keep, docs[text].alias("__text"))
    schema = [f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} {t}" for c, (t, _) in columns.items()]
    return chosen.mapInArrow(run, ", ".join(schema))
