"""Quality classifier: supervised subword embeddings.

Every word and every character n-gram of it (bytes, with word marks) hashes to a learned vector, and so do pairs
of a word and its repetition, all to one bucket as the pair says the same of any word; a document is the average of its vectors, and a softmax over two outputs scores it. Vectors and softmax are trained together by
numpy stochastic gradient descent on a bounded sample of labelled rows (TRAIN_ROWS). As the output is
linear in the average, scoring looks up one number per distinct word: the sum of its vectors' logits.

Null and empty texts have no vector and score as the bias does. Repeated rows score alike. Long texts are averaged whole, in blocks of
their own; an empty table gives no rows. Ties cannot arise: rows train in the order of their ids. Columns not in `keep` play no part. Without labelled rows
of both kinds every score is the share of label 1, or 0.5 where nothing is labelled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from auditlake.llm.labelled import training_rows
from auditlake.llm.text import Runs, WordTable, blocks, encoded, gather, held_out, spans, sums

#: At most so many labelled documents are read for fitting.
TRAIN_ROWS = 3_000
BUCKETS = 1 << 17
DIMENSIONS = 8
GRAMS = (3, 4)
#: The bucket of a word that repeats the one before it.
AGAIN = BUCKETS


def repeats(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words equal to the word before them, by document."""
    same = np.zeros(len(ids), np.int64)
    same[1:] = ids[1:] == ids[:-1]
    same[offsets[:-1][offsets[:-1] < len(ids)]] = 0
    return sums(same, offsets)


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and its n-grams, word after word, and their number by word."""
    marked = [b"<" + w + b">" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    raw = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    starts = spans(sizes)[:-1]
    mixed = lambda h: ((h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % BUCKETS
    rolled = np.zeros(len(raw) + 1, np.uint64)
    # whole words: a sum of bytes scaled by their place, which needs no loop over words
    place = (np.arange(len(raw)) - np.repeat(starts, sizes)).astype(np.uint64)
    rolled[1:] = np.cumsum((raw + np.uint64(1)) * (place * np.uint64(0xBF58476D1CE4E5B9) ^ (place * place * np.uint64(0x94D049BB133111EB) + np.uint64(0x2545F4914F6CDD1D))), dtype=np.uint64)
    whole = mixed(rolled[starts + sizes] - rolled[starts] + np.uint64(17))
    parts, owner = [whole], [np.arange(len(words))]
    for n in GRAMS:
        count = np.maximum(sizes - n + 1, 0)
        at = gather(starts, count)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) ^ raw[at + j]
        parts.append(mixed(h))
        owner.append(np.repeat(np.arange(len(words)), count))
    of = np.concatenate(owner)
    order = np.argsort(of, kind="stable")
    return np.concatenate(parts)[order].astype(np.int32), np.bincount(of, minlength=len(words))


@dataclass
class QualityModel:
    """Bucket vectors, output weights and bias; `logit` holds each bucket's share of the output difference."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    @property
    def logit(self) -> np.ndarray:
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float64)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, rate: float = 0.4, seed: int = 5) -> QualityModel:
    """Softmax regression on averaged vectors, both learned; bags: buckets and their shares by document."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS + 1, DIMENSIONS))
    output = np.zeros((DIMENSIONS, 2))
    prior = np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3)
    bias = np.log([1 - prior, prior])
    if not 0 < labels.sum() < len(labels):
        return QualityModel(np.zeros_like(vectors), output, bias)
    steps, at = epochs * len(bags), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            step = rate * (1 - at / steps)
            at += 1
            buckets, share = bags[k]
            hidden = share @ vectors[buckets]
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = output @ p
            output -= step * np.outer(hidden, p)
            bias = bias - 0.1 * step * p
            vectors[buckets] -= (step * len(buckets) ** 0.5) * share[:, None] * back
    return QualityModel(vectors, output, bias)


class _Bags:
    def __init__(self):
        self.runs = Runs(np.int32)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        buckets, counts = subwords(words)
        return self.runs.add(buckets) + spans(counts)[:-1], counts


def _bags(sample: DataFrame) -> list:
    """Id, label, buckets and shares of each sampled document, built in the tasks; bounded as the sample is."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "__text"):
            table = WordTable(_Bags)
            rows = []
            for t in encoded(part, "__text"):
                ids = table.numbers(t.split())
                at, counts = table.columns
                again = int(repeats(ids, np.array([0, len(ids)]))[0])
                flat = np.concatenate([table.measure.runs.values[gather(at[ids], counts[ids])], np.full(again, AGAIN, np.int32)])
                buckets, n = np.unique(flat, return_counts=True)
                rows.append((buckets.astype(np.int32).tobytes(), (n / max(1, n.sum())).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("__label"), *(pa.array(v, pa.binary()) for v in zip(*rows, strict=True))], ["id", "label", "buckets", "share"])

    kind = sample.schema["__id"].dataType.simpleString()
    return sample.mapInArrow(run, f"id {kind}, label int, buckets binary, share binary").collect()


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> QualityModel:
    """Trains on labelled rows that are not held out."""
    rows = sorted(_bags(training_rows(docs, labels, "quality", bound)), key=lambda r: r.id)
    bags = [(np.frombuffer(r.buckets, np.int32), np.frombuffer(r.share, np.float32).astype(float)) for r in rows]
    return train(bags, np.array([int(r.label > 0) for r in rows], np.int64))


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and the score of every row."""
    logit, bias = model.logit.astype(np.float32), float(model.bias[1] - model.bias[0])

    def measure(words: list[bytes]) -> tuple[np.ndarray, ...]:
        buckets, counts = subwords(words)
        return sums(logit[buckets].astype(float), spans(counts)), counts

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(lambda: measure)
        for part in blocks(batches, "__text"):
            cut = [t.split() for t in encoded(part, "__text")]
            offsets = spans(np.fromiter(map(len, cut), np.int64, len(cut)))
            ids = table.numbers([w for c in cut for w in c])
            value, count = (sums(c[ids], offsets) for c in table.columns)
            again = repeats(ids, offsets)
            mean = (value + again * float(logit[AGAIN])) / np.maximum(count + again, 1)
            score = 1 / (1 + np.exp(-np.clip(mean + bias, -50, 50)))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(score)], [*keep, "score"])

    chosen = docs.select(*keep, docs[text].alias("__text"))
    schema = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep)
    return chosen.mapInArrow(run, f"{schema}, score double")


def quality(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score_quality(docs, fit_quality(docs, labels, bound))
    return scored.select("doc_id", held_out(scored.doc_id).alias("held_out"), "score", (scored.score >= threshold).cast("int").alias("predicted"))
