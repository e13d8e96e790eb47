"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

Base spans match fixed patterns and always stay. Where patterns cannot decide (numbers side by side, groups
without a plus sign, spelt-out addresses), the atoms of a region, such as groups of digits, form a lattice: every run of
at most MAX_ATOMS atoms is a candidate segment of every kind, scored on features of the whole span, and
a dynamic program picks boundaries and kinds together. Atoms under a base span are closed to it.

Weights come from maximum likelihood (forward-backward over segments) on seeded templates, as no table
labels spans. Offsets are code points. Null text is empty; an empty text has no spans; rows repeat as given; an empty table gives
no rows. Time grows with a text's length and memory with its entities, so long texts are read whole. Of segmentations that score
alike the one with the earlier first atoms wins. Columns not in `keep` play no part; `keep` may not name columns of the result.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from auditlake.llm.text import blocks

KINDS = ("email", "ip", "card", "phone")
MAX_ATOMS = 8
#: Digits of the longest entity, and atoms whose segments are scored at a time.
MAX_DIGITS = 19
LOT = 4096
Span = tuple[int, int, int]  # start, end, index of kind

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
#: Seven digits or more with at most three separators between two.
_REGION = re.compile(r"[+(]{0,2}+(?:[0-9][ ().+-]{0,3}+){7,}+")
_DIGITS = re.compile(r"[0-9]+")
#: Addresses with spelt-out or spaced signs.
_SPELT = re.compile(
    r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}+(?:"
    r" ?(?:\[at\]|\(at\)|\{at\}|@) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot |\.)(?: ?)[A-Za-z0-9-]{1,63}+){1,4}"
    r"| at [A-Za-z0-9-]{1,63}+(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot ) ?[A-Za-z0-9-]{1,63}+){1,4})",
    re.I,
)
#: One of these is in every match of _SPELT.
_SIGN = re.compile(r"@|\[(?:at|dot)\]|\((?:at|dot)\)|\{(?:at|dot)\}| dot ", re.I)
_CUES = {"phone": re.compile(r"(?:phone|tel|call|mobile|fax|ring)\W*\w{0,8}\W*$", re.I), "card": re.compile(r"(?:card|visa|pay|account|credit)\W*\w{0,8}\W*$", re.I),
         "ip": re.compile(r"(?:\bip|host|server|addr\w*)\W*$", re.I), "not": re.compile(r"(?:version|order|invoice|item|isbn|no\.?|id|#|\$|€)\W*$", re.I)}


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number holds."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find, leftmost and non-overlapping per kind; matches that fail a check are dropped."""
    out: list[Span] = []
    if not _ANY.search(text):
        return out
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), 0))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


class Covered:
    """What spans cover, as disjoint runs that are searched by halving."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b, _ in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, start: int, end: int) -> bool:
        """Whether a character from start to end is covered."""
        k = bisect_left(self.starts, end) - 1
        return k >= 0 and self.ends[k] > start


FEATURES = ["bias", "digits<7", "digits 7-9", "digits 10-11", "digits 12-13", "digits 14-15", "digits 16", "digits 17-19", "digits>19", "atoms 1", "atoms 2", "atoms 3", "atoms 4", "atoms 5+",
            "plus", "parenthesis", "luhn", "valid ip", "dots only", "spaces only", "dashes only", "mixed", "all fours", "ends 3-4", "single 16", "letter before", "letter after", "digit beside",
            "cue phone", "cue card", "cue ip", "cue not", "spelt", "spelt signs", "plain at", "balanced", "plus inside", "covers more"]
_INDEX = {f: i for i, f in enumerate(FEATURES)}


def _features(text: str, atoms: list[tuple[int, int]], i: int, j: int, spelt: bool) -> tuple[list[int], int, int]:
    """Features that hold of the span of atoms i to j, and its start and end."""
    start, end = atoms[i][0], atoms[j][1]
    if not spelt:
        floor = atoms[i - 1][1] if i else max(0, start - 2)
        while start > floor and text[start - 1] in "+(":
            start -= 1
    f = ["bias"]
    if spelt:
        span = text[start:end].lower()
        f += ["spelt", "plain at" if "@" in span else "spelt signs"]
        f += ["covers more"] if re.search(r"\.|dot", span) else []
    else:
        sizes = [b - a for a, b in atoms[i : j + 1]]
        n = sum(sizes)
        f.append("digits<7" if n < 7 else "digits 7-9" if n < 10 else "digits 10-11" if n < 12 else "digits 12-13" if n < 14 else "digits 14-15" if n < 16 else "digits 16" if n == 16 else "digits 17-19" if n < 20 else "digits>19")
        f.append(f"atoms {len(sizes)}" if len(sizes) < 5 else "atoms 5+")
        span = text[start:end]
        between = [text[a[1] : b[0]] for a, b in zip(atoms[i:j], atoms[i + 1 : j + 1], strict=True)]
        if span[0] == "+":
            f.append("plus")
        if "+" in span[1:]:
            f.append("plus inside")
        if "(" in span:
            f += ["parenthesis", *["balanced"] * (span.count("(") == span.count(")"))]
        elif ")" not in span:
            f.append("balanced")
        if 13 <= n <= 19 and luhn("".join(text[a:b] for a, b in atoms[i : j + 1])):
            f.append("luhn")
        if between:
            kinds = set(between)
            f.append("dots only" if kinds == {"."} else "spaces only" if kinds == {" "} else "dashes only" if kinds == {"-"} else "mixed")
            if kinds == {"."} and len(sizes) == 4 and max(sizes) <= 3 and all(int(text[a:b]) <= 255 for a, b in atoms[i : j + 1]):
                f.append("valid ip")
            if sizes[-1] == 4 and sizes[-2] == 3:
                f.append("ends 3-4")
            if set(sizes) == {4}:
                f.append("all fours")
        elif n == 16:
            f.append("single 16")
    before, after = text[start - 1 : start], text[end : end + 1]
    if before.isalpha() or before == "_":
        f.append("letter before")
    if after.isalpha() or after == "_":
        f.append("letter after")
    if before.isdigit() or after.isdigit() or before == "." or (after == "." and text[end + 1 : end + 2].isdigit()):
        f.append("digit beside")
    left = text[max(0, start - 24) : start]
    f += [f"cue {c}" for c, p in _CUES.items() if p.search(left)]
    return [_INDEX[x] for x in f], start, end


class Lattice:
    """Atoms of one region and their candidate segments: single atoms, and runs with no more digits than any entity has."""

    def __init__(self, text: str, atoms: list[tuple[int, int]], spelt: bool):
        self.text, self.atoms, self.spelt, self.size = text, atoms, spelt, len(atoms)

    def segments_from(self, first: int, stop: int) -> tuple[list[tuple], np.ndarray]:
        """Segments that begin at these atoms: first atom, last atom, features, start, end; and their features as rows."""
        out = []
        for i in range(first, stop):
            digits = 0
            for j in range(i, min(self.size, i + MAX_ATOMS)):
                digits += self.atoms[j][1] - self.atoms[j][0]
                if j > i and digits > MAX_DIGITS:
                    break
                out.append((i, j, *_features(self.text, self.atoms, i, j, self.spelt)))
        matrix = np.zeros((len(out), len(FEATURES)))
        for k, s in enumerate(out):
            matrix[k, s[2]] = 1
        return out, matrix

    @cached_property
    def whole(self) -> tuple[list[tuple], np.ndarray]:
        return self.segments_from(0, self.size)


def lattices(text: str, base: list[Span]) -> Iterator[Lattice]:
    """Regions that hold candidates, without atoms under base spans."""
    closed = Covered(base)
    if _ANY.search(text):
        for m in _REGION.finditer(text):
            run: list[tuple[int, int]] = []
            for g in _DIGITS.finditer(text, m.start(), m.end()):
                if not closed.meets(g.start(), g.end()):
                    run.append((g.start(), g.end()))
                elif run:
                    yield Lattice(text, run, False)
                    run = []
            if run:
                yield Lattice(text, run, False)
    if _SIGN.search(text):
        for m in _SPELT.finditer(text):
            if not closed.meets(m.start(), m.end()):
                yield Lattice(text, [(m.start(), m.end())], True)


def _scores(segments: list[tuple], matrix: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Score by segment and label; label 0, outside, takes single atoms only."""
    scores = matrix @ weights.T
    scores[[s[0] != s[1] for s in segments], 0] = -np.inf
    return scores


def decode(lattice: Lattice, weights: np.ndarray) -> list[Span]:
    """The best segmentation's spans; of equal ones that with the earlier first atoms. Segments are scored LOT atoms at a time."""
    best: list[float] = [0.0] + [-np.inf] * lattice.size
    back: list[tuple] = [()] * (lattice.size + 1)
    for first in range(0, lattice.size, LOT):
        segments, matrix = lattice.segments_from(first, min(lattice.size, first + LOT))
        scores = _scores(segments, matrix, weights)
        for (i, j, _, a, b), v, k in zip(segments, scores.max(1).tolist(), scores.argmax(1).tolist(), strict=True):
            if best[i] + v > best[j + 1]:  # by first atom, so best[i] is final
                best[j + 1], back[j + 1] = best[i] + v, (i, a, b, k)
    out, at = [], lattice.size
    while at:
        at, a, b, k = back[at]
        if k:
            out.append((a, b, k - 1))
    return out[::-1]


def _gradient(lattice: Lattice, weights: np.ndarray, gold: dict[tuple[int, int], int]) -> np.ndarray:
    """Of the log likelihood of the gold segmentation; gold: label of (first, last) atoms, others outside."""
    segments, matrix = lattice.whole
    scores = _scores(segments, matrix, weights)
    total = np.logaddexp.reduce(scores, 1)
    fore = np.full(lattice.size + 1, -np.inf)
    back = fore.copy()
    fore[0] = back[-1] = 0
    for k, s in enumerate(segments):
        fore[s[1] + 1] = np.logaddexp(fore[s[1] + 1], fore[s[0]] + total[k])
    for k in range(len(segments) - 1, -1, -1):
        s = segments[k]
        back[s[0]] = np.logaddexp(back[s[0]], back[s[1] + 1] + total[k])
    first, last = (np.array([s[k] for s in segments]) for k in (0, 1))
    chance = np.exp(scores + (fore[first] + back[last + 1] - fore[-1])[:, None])
    covered = {a for i, j in gold for a in range(i, j + 1)}
    truth = np.zeros_like(chance)
    for k, s in enumerate(segments):
        if (s[0], s[1]) in gold:
            truth[k, gold[s[0], s[1]]] = 1
        elif s[0] == s[1] and s[0] not in covered:
            truth[k, 0] = 1
    return (truth - chance).T @ matrix


def _examples(seed: int, count: int) -> Iterator[tuple[str, list[Span]]]:
    """Templates with their gold spans: entities side by side and alone, among numbers that are no one's data."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choices("0123456789", k=n))
    w = lambda: "".join(r.choices("abcdefghilmnorstu", k=r.randint(2, 8)))
    phone = [lambda: f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"+{d(2)} {d(3)} {d(3)} {d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}"]
    card = [lambda: d(16), lambda: d(16), lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(4)}-{d(4)}-{d(4)}-{d(4)}"]
    ip = [lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))]
    mail = [lambda: f"{w()} [at] {w()} [dot] com", lambda: f"{w()}.{d(2)}(at){w()}.example(dot)com", lambda: f"{w()} @ {w()}.org", lambda: f"{w()} at {w()} dot com"]
    other = [lambda: d(r.choice([7, 8, 8, 9, 12, 20, 24])), lambda: f"{d(4)}-{d(2)}-{d(2)} {d(2)}.{d(2)}", lambda: f"version {d(1)}.{d(2)}.{d(5)}", lambda: f"${d(3)} {d(3)} {d(3)}", lambda: f"{d(4)} {d(4)}", lambda: f"{w()}{d(9)}{w()}", lambda: f"order {d(10)}",
             lambda: f"{d(2)}-{d(2)}-{d(4)}", lambda: f"{d(4)} {d(4)} {d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(1)}.{d(1)} {d(1)}.{d(2)} {d(2)}.{d(3)}", lambda: f"sat [at] {w()}", lambda: f"{d(4)}, {d(4)}, {d(4)}"]
    made = [(mail, 0), (ip, 1), (card, 2), (phone, 3), (other, -1)]
    for _ in range(count):
        text, gold = w() + " ", []
        for _ in range(r.randint(1, 3)):
            templates, kind = r.choices(made, [2, 2, 4, 4, 6])[0]
            piece = r.choice(templates)()
            if kind >= 0:
                gold.append((len(text), len(text) + len(piece), kind))
            text += piece + r.choice([" ", " ", " ", f" {w()} ", f", {w()} ", f"### {w()} "])
        yield text + w(), gold


@lru_cache(4)
def train(seed: int = 7, count: int = 500, epochs: int = 14, rate: float = 0.15, decay: float = 1e-4) -> np.ndarray:
    """Weights by label (outside, then KINDS) and feature."""
    cases = []
    for text, gold in _examples(seed, count):
        for lattice in lattices(text, []):
            found = {(s[0], s[1]): k + 1 for s in lattice.whole[0] for a, b, k in gold if (s[3], s[4]) == (a, b)}
            cases.append((lattice, found))
    weights = np.zeros((len(KINDS) + 1, len(FEATURES)))
    order = np.random.default_rng(seed)
    for epoch in range(epochs):
        for k in order.permutation(len(cases)):
            weights += rate / (1 + 0.2 * epoch) * (_gradient(cases[k][0], weights, cases[k][1]) - decay * weights)
    return weights


def all_spans(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """Base spans, and base with added spans; both by start, then kind."""
    base = base_spans(text)
    added = [s for lattice in lattices(text, base) for s in decode(lattice, weights)]
    closed = Covered(base)  # a plus sign or bracket before an atom may be a base span's
    added = [s for s in added if not closed.meets(s[0], s[1])]
    return base, sorted(base + added, key=lambda s: (s[0], s[2], s[1]))


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of spans that overlap, as the kind of its first in brackets."""
    out, done, end = [], 0, 0
    for a, b, k in spans:
        if a >= end:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
        end = done = max(end, b)
    return "".join(out) + text[done:]


_COLUMNS = [(f"n_{k}", "long", pa.int64()) for k in KINDS] + [("base_sha256", "string", pa.string()), ("spans", "string", pa.string()), ("n_added", "long", pa.int64())]


def find_pii(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), weights: np.ndarray | None = None) -> DataFrame:
    """`keep` columns, base counts by kind, digest of base spans, all spans, and how many the method added."""
    weights = train() if weights is None else weights

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "__text"):
            rows = []
            for t in part.column("__text").fill_null("").to_pylist():
                base, every = all_spans(t, weights)
                count = [sum(s[2] == k for s in base) for k in range(len(KINDS))]
                rows.append((*count, hashlib.sha256(shown(base).encode()).hexdigest(), shown(every), len(every) - len(base)))
            made = [pa.array(v, t) for v, (_, _, t) in zip(zip(*rows, strict=True), _COLUMNS, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + made, [*keep, *(c[0] for c in _COLUMNS)])

    chosen = docs.select(*keep, docs[text].alias("__text"))
    schema = [f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep] + [f"{n} {t}" for n, t, _ in _COLUMNS]
    return chosen.mapInArrow(run, ", ".join(schema))


def redact(docs: DataFrame, text: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """The same rows and columns, with personal data in `text` replaced by its kind; null stays null."""
    weights = train() if weights is None else weights

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, text):
            k = part.schema.get_field_index(text)
            texts = [t if t is None else redacted(t, all_spans(t, weights)[1]) for t in part.column(k).to_pylist()]
            yield part.set_column(k, part.schema.field(k), pa.array(texts, part.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)
