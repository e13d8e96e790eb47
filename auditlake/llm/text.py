"""Words, blocks of rows and word caches shared by the text operators.

A word is a maximal run of anything but the six ASCII white-space characters; `bytes.split` cuts UTF-8
text at exactly these, so other Unicode spaces stay inside words.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one step inside a task holds at a time; a longer single text is a block of its own.
BLOCK_BYTES = 1 << 20


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes of text each, one row at least; no row is cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column).fill_null("").cast(pa.large_utf8())
        ends = np.frombuffer(sizes.buffers()[1], np.int64, batch.num_rows + 1, sizes.offset * 8)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def encoded(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts as UTF-8; null reads as empty."""
    return batch.column(column).fill_null("").cast(pa.large_binary()).to_pylist()


def spans(counts: np.ndarray) -> np.ndarray:
    """Offsets, one more than counts, of runs of these lengths."""
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices that list, run after run, starts[i] .. starts[i] + counts[i] - 1."""
    ends = np.cumsum(counts, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each run values[offsets[i]:offsets[i + 1]]; empty runs give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


class WordTable(dict):
    """Numbers distinct words and measures each once; `start` makes the measure, which gets the new words of a block together.

    Grows to `most` bytes of words, then starts anew at the next block with a new measure. Tasks make a table of their own, so
    nothing outlives them in the worker.
    """

    def __init__(self, start: Callable[[], Callable[[list[bytes]], tuple[np.ndarray, ...]]], most: int = 1 << 20):
        super().__init__()
        self.start, self.most = start, most
        self.measure, self.held, self.fresh, self.columns = start(), 0, [], None

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.held += len(word)
        self.fresh.append(word)
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Word numbers, valid until the next call; `columns` then holds the measures by number."""
        if self.held > self.most:
            self.clear()
            self.measure, self.held, self.columns = self.start(), 0, None
        found = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        if self.fresh or self.columns is None:
            new = self.measure(self.fresh)
            self.columns = new if self.columns is None else tuple(np.concatenate(x) for x in zip(self.columns, new, strict=True))
            self.fresh = []
        return found


def release() -> None:
    """At the end of a task: gives freed memory back to the system, as the worker lives on beside others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class Runs:
    """An array of variable-length runs that grows at its end: what a WordTable keeps for words with many values."""

    def __init__(self, dtype):
        self.values, self.used = np.empty(1 << 16, dtype), 0

    def add(self, values: np.ndarray) -> int:
        """Appends and returns where the values begin."""
        at, need = self.used, self.used + len(values)
        if need > len(self.values):
            grown = np.empty(max(need, 2 * len(self.values)), self.values.dtype)
            grown[:at] = self.values[:at]
            self.values = grown
        self.values[at:need] = values
        self.used = need
        return at


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; set for this session if unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: cuts lineage, outlives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """The rows, written first if their plan exchanges them: else monotonically_increasing_id gives a row the same place in every job."""
    return stored(df, "settled") if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column has it."""
    while name.lower() in map(str.lower, df.columns):
        name = f"_{name}"
    return name


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], size: str, most: int = 50_000) -> DataFrame:
    """Left join with a table of one row per key, whose column `size` says how many of the rows have it.

    Keys with more than one in `most` of the counted rows are fewer than `most`, so their rows of the table can be broadcast, and no
    task gets a hot key whole; the others are shuffled. The table should be stored: it is read three times.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    hot = table.where(F.col(size) * most > total).drop(size).withColumn("__hot", F.lit(True))
    cold = table.where(F.col(size) * most <= total).drop(size)
    met = rows.join(F.broadcast(hot), on, "left")
    rest = met.where("__hot is null").select(*rows.columns).join(cold, on, "left")
    return met.where("__hot").drop("__hot").unionByName(rest)


def held_out(doc_id) -> F.Column:
    """True for the fifth of rows that no label is learned from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
