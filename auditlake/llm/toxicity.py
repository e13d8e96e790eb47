"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features: densities of a fixed and of a learned lexicon, second-person words near lexicon words, capitals,
punctuation and obfuscation rates. The learned lexicon, trees and calibration come from a bounded sample of
labelled rows (TRAIN_ROWS); every text is then scored whole, long ones in blocks of their own. Null and empty texts have all features 0
and get the model's score for that. Repeated rows are scored alike, and so are ties in features. Without any labelled row the score is 0; an empty table gives
no rows. Columns not in `keep` play no part, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.labelled import training_rows
from auditlake.llm.text import WordTable, blocks, encoded, held_out, spans, stored, sums

#: At most so many labelled documents are read for fitting.
TRAIN_ROWS = 12_000
#: Insults that count before anything is learned (fixed values).
LEXICON = frozenset("""idiot idiots moron morons stupid dumb fool fools clown clowns loser losers trash garbage scum pathetic worthless
disgusting vile filth filthy vermin pig pigs rat rats coward cowards liar liars hate kill die ugly freak freaks imbecile
cretin jerk bastard bitch damn hell crap shit fuck fucking asshole whore slut""".split())
SECOND = frozenset(b"you your yours yourself yourselves youre ur u thou thee du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos ti usted ustedes tus".split())
LEET = str.maketrans("013457@$!|+", "oieastasilt")
_NEAR = 5
_EDGE = re.compile(r"^[^\w@$]+|[^\w@$]+$")

FEATURES = ["fixed density", "fixed count", "fixed distinct", "learned density", "learned count", "learned distinct", "learned weight", "obfuscated density", "obfuscated count",
            "second density", "near second", "capital share", "shouted share", "exclamation rate", "question rate", "punctuation rate", "symbol rate", "digit rate", "inner mark rate", "stretched rate", "log words", "letters a word"]


def plain(word: str) -> str:
    """Lower case, without marks at its ends."""
    return _EDGE.sub("", word.lower())


def deobfuscated(word: str) -> str:
    """A word with look-alikes, inner marks and stretched letters undone."""
    word = re.sub(r"[\W_]+", "", plain(word).translate(LEET))
    return re.sub(r"(.)\1{2,}", r"\1", word)


class Words:
    """Measures of distinct words under a learned lexicon: word -> log odds."""

    def __init__(self, learned: dict[str, float]):
        self.learned = learned

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        n = len(words)
        out = {k: np.zeros(n, np.float32) for k in ("fixed", "learned", "weight", "hidden", "second", "capitals", "letters", "shouted", "marks", "stretched")}
        key = np.zeros(n, np.int64)  # by lexicon word, so distinct ones can be told apart
        for i, raw in enumerate(words):
            w = raw.decode()
            p = w.lower() if w.isalpha() else plain(w)
            out["letters"][i] = len(w) if w.isalpha() else sum(map(str.isalpha, w))
            if w != w.lower():
                out["capitals"][i] = sum(map(str.isupper, w))
                out["shouted"][i] = out["capitals"][i] > 1 and w == w.upper()
            if not p.isalpha() and p:
                out["marks"][i] = any(c.isalpha() for c in p)
            out["fixed"][i] = p in LEXICON
            if p in self.learned:
                out["learned"][i], out["weight"][i] = 1, self.learned[p]
            if out["fixed"][i] or out["learned"][i]:
                key[i] = hash_of(p)
            elif len(p) < 40 and (out["marks"][i] or re.search(r"(.)\1\1", p)):
                out["stretched"][i] = not out["marks"][i]
                d = deobfuscated(w)
                if d != p and (d in LEXICON or d in self.learned):
                    out["hidden"][i], key[i] = 1, hash_of(d)
            out["second"][i] = p.encode() in SECOND
        return tuple(out.values()) + (key,)


def hash_of(word: str) -> int:
    """A positive number of a word that does not change from run to run."""
    import zlib

    return zlib.crc32(word.encode()) + 1


def features(texts: list[bytes], table: WordTable) -> np.ndarray:
    """One row of FEATURES per text."""
    cut = [t.split() for t in texts]
    offsets = spans(np.fromiter(map(len, cut), np.int64, len(cut)))
    ids = table.numbers([w for c in cut for w in c])
    fixed, learned, weight, hidden, second, capitals, letters, shouted, marks, stretched, key = (c[ids] for c in table.columns)
    n = np.maximum(np.diff(offsets), 1).astype(float)
    per = lambda v: sums(v.astype(float), offsets)
    hit = (key > 0).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    # second-person words within _NEAR words of a lexicon word, in the same text
    near = np.zeros(len(ids))
    you = np.flatnonzero(second > 0)
    for d in range(-_NEAR, _NEAR + 1):
        at = you + d
        ok = (at >= 0) & (at < len(ids))
        ok[ok] &= doc[at[ok]] == doc[you[ok]]
        near[at[ok]] = 1

    def distinct(column: np.ndarray) -> np.ndarray:
        chosen = np.unique(doc[column > 0] * (np.int64(1) << 33) + key[column > 0])
        return np.bincount(chosen >> 33, minlength=len(texts)).astype(float)

    counts = np.array([[t.count(b"!"), t.count(b"?"), sum(map(t.count, (b".", b",", b";", b":"))), sum(map(t.count, (b"#", b"*", b"$", b"%", b"&", b"@", b"|"))), len(t) - len(t.translate(None, b"0123456789"))] for t in texts], float).reshape(len(texts), 5)
    size = np.maximum(np.array([len(t) for t in texts], float), 1)
    total = np.maximum(per(letters), 1)
    return np.stack([per(fixed) / n, per(fixed), distinct(fixed), per(learned) / n, per(learned), distinct(learned), per(weight) / n, per(hidden) / n, per(hidden), per(second) / n, per(near * hit) / n, per(capitals) / total, per(shouted) / n,
                     counts[:, 0] / n, counts[:, 1] / n, counts[:, 2] / n, counts[:, 3] / n, counts[:, 4] / size, per(marks) / n, per(stretched) / n, np.log1p(np.diff(offsets)), per(letters) / n], 1)


@dataclass
class Trees:
    """Depth-limited regression trees as flat arrays, with a monotone map from their sum to a probability."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    start: float
    knots: np.ndarray
    values: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        depth = int(np.log2(self.leaf.shape[1]))
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += leaf[node - (len(leaf) - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated chances; inside a step, where calibration says nothing, a thousandth follows the margin."""
        margin = self.margin(x)
        return np.clip(0.999 * np.interp(margin, self.knots, self.values) + 0.001 / (1 + np.exp(-np.clip(margin, -50, 50))), 0, 1)


def isotonic(margins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing values for linear interpolation."""
    order = np.argsort(margins, kind="stable")
    m, y = margins[order], labels[order].astype(float)
    pools: list[list[float]] = []  # sum, count, first, last
    for a, b in zip(m.tolist(), y.tolist(), strict=True):
        pools.append([b, 1, a, a])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][3] == pools[-1][2]):
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    knots, values = [], []
    for s, c, first, last in pools:
        knots += [first, last]
        values += [s / c, s / c]
    return np.array(knots), np.array(values)


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, ridge: float = 2.0, bins: int = 48, least: int = 15) -> Trees:
    """Second-order boosting of the logistic loss with histograms of quantile bins."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    margin = np.full(n, base)
    feature, cut, leaf = (np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            own = node - first
            best = np.full(wide, 1e-9)
            for j in range(width):
                k = len(cuts[j]) + 1
                if k == 1:
                    continue
                at = own * k + binned[:, j]
                gs, hs, cs = (np.bincount(at, v, wide * k).reshape(wide, k).cumsum(1) for v in (g, h, np.ones(n)))
                gl, hl, cl = gs[:, :-1], hs[:, :-1], cs[:, :-1]
                gr, hr, cr = gs[:, -1:] - gl, hs[:, -1:] - hl, cs[:, -1:] - cl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + ridge)
                gain[(cl < least) | (cr < least)] = -1
                top = gain.argmax(1)
                value = gain[np.arange(wide), top]
                better = value > best
                best[better] = value[better]
                feature[t, first : first + wide][better] = j
                cut[t, first : first + wide][better] = cuts[j][top[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        at = node - (2**depth - 1)
        leaf[t] = rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + ridge)
        margin += leaf[t, at]
    return Trees(feature, cut, leaf, base, np.zeros(1), np.zeros(1))


@dataclass
class ToxicityModel:
    learned: dict[str, float]
    trees: Trees


def _lexicon_of(sample: DataFrame, most: int = 3000) -> dict[str, float]:
    """Document counts of words by label over the sample, counted in the tasks and merged; then log odds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = {0: Counter(), 1: Counter()}, {0: 0, 1: 0}
        for part in blocks(batches, "__text"):
            for t, label in zip(part.column("__text").to_pylist(), part.column("__label").to_pylist(), strict=True):
                label = int(label > 0)
                n[label] += 1
                seen[label].update({p for w in set(t.split()) if (p := plain(w)) and len(p) < 40})
        rows = [(w, k, c) for k in seen for w, c in seen[k].items()] + [(None, k, n[k]) for k in n]
        yield pa.RecordBatch.from_arrays([pa.array(v) if i else pa.array(v, pa.string()) for i, v in enumerate(zip(*rows, strict=True))], ["word", "label", "n"])

    counted = sample.mapInArrow(run, "word string, label long, n long").groupBy("word").pivot("label", [0, 1]).sum("n")
    counted = counted.na.fill(0, ["0", "1"]).withColumnsRenamed({"0": "n0", "1": "n1"})
    total = counted.where("word is null").first()
    if total is None or not total.n1 or not total.n0:
        return {}
    # the odds are tested in the plan; only the words that pass, the strongest `most`, reach the driver
    odds = f"ln((n1 + 1) / ({total.n1} + 2)) - ln((n0 + 1) / ({total.n0} + 2))"
    strong = counted.where(f"word is not null and n1 >= 4 and {odds} >= 1.2").selectExpr("word", f"{odds} as odds", "n1").orderBy("n1", "word", ascending=[False, True]).limit(most)
    return {r.word: float(r.odds) for r in strong.collect()}


def _scored(docs: DataFrame, keep: list[str], learned: dict[str, float]) -> DataFrame:
    """`keep` columns and features as an array."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(lambda: Words(learned))
        for part in blocks(batches, "__text"):
            x = features(encoded(part, "__text"), table)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [flat], [*keep, "x"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(run, f"{schema}, x array<double>")


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> ToxicityModel | None:
    """Lexicon, trees and calibration from labelled rows that are not held out; None without both labels.

    A quarter of the rows is set aside for the calibration: neither lexicon nor trees see it.
    """
    aside = F.crc32(F.concat(F.lit("fold "), F.col("__id").cast("string"))) % 4 == 0
    sample = stored(training_rows(docs, labels, "toxic", bound).withColumn("__aside", F.coalesce(aside, F.lit(False)).cast("int")), "sample")
    kinds = {(r["__aside"], r.toxic) for r in sample.groupBy("__aside", (F.col("__label") > 0).alias("toxic")).count().collect()}
    if len({toxic for _, toxic in kinds}) < 2:
        return None
    if len(kinds) < 4:  # too few rows to set some aside
        sample = sample.withColumn("__aside", F.lit(0))
    learned = _lexicon_of(sample.where("__aside = 0"))
    rows = _scored(sample, ["__id", "__label", "__aside"], learned).toPandas().sort_values("__id")
    y, x, fold = (rows["__label"].to_numpy() > 0).astype(float), np.stack(rows["x"].to_numpy()), rows["__aside"].to_numpy() > 0
    trees = boost(x[~fold], y[~fold])
    fold = fold if fold.any() else ~fold
    trees.knots, trees.values = isotonic(trees.margin(x[fold]), y[fold])
    return ToxicityModel(learned, trees)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, score and predicted of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(lambda: Words(model.learned if model else {}))
        for part in blocks(batches, "__text"):
            score = model.trees.score(features(encoded(part, "__text"), table)) if model else np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    chosen = docs.select(*keep, docs[text].alias("__text"))
    schema = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep)
    return chosen.mapInArrow(run, f"{schema}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels, bound))
    return scored.select("doc_id", held_out(scored.doc_id).alias("held_out"), "score", "predicted")
