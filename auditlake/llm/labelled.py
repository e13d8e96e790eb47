"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.text import held_out


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """Columns id, label and text of at most `bound` labelled documents, the same ones at each run.

    Held-out rows and null labels never count; of several labels of one id the larger counts, and of its texts one, that
    with the smallest hash. The sample is the
    ids with the smallest hashes, so it is at most `bound` narrow rows and can be broadcast to the scan
    of the texts; only the sampled texts are shuffled.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__label"))
        .where(F.col("__id").isNotNull() & F.col("__label").isNotNull() & ~held_out(F.col("__id")))
        .groupBy("__id")
        .agg(F.max("__label").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(bound)
    )
    texts = docs.select(F.col("doc_id").alias("__id"), F.coalesce("text", F.lit("")).alias("__text"))
    rows = texts.join(F.broadcast(chosen), "__id")
    one = F.min(F.struct(F.xxhash64("__text").alias("hash"), "__text"))["__text"]
    return rows.groupBy("__id", "__label").agg(one.alias("__text"))
