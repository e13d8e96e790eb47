"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source gets ratio = target / source size copies on average: the whole part for certain, and one more
with the fractional part as its probability. Two documents at a time move mass between their
probabilities, at random but so that expected words stay the same, until one is 0 or 1. Documents pair
up inside buckets of about BUCKET rows; each bucket leaves at most one fractional document, and these meet
in a tree of buckets until one is left per source, which is drawn alone. So a source's taken words miss its
target by less than the size of one document, and its copies are fair.

Randomness comes from hashes of source, level and bucket, so reruns agree. Null and empty texts have size 0; documents and sources
of size 0 take nothing. Null sources form one source, ordered last. Repeated rows, repeated ids and null ids count one by one; ties in
size go by id, then text. Long texts are counted whole. An empty table gives no rows. `mix` reads doc_id, source and the text alone, so other columns may have any name;
`mixed` keeps them all.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.text import blocks, encoded, settled, spread_join, stored, unused

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
BUCKET = 4096
FAN = 64
#: So many places and numbers of copies, 12 bytes each, may be broadcast.
BROADCAST_ROWS = 1_000_000


def word_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns and the number of words of `__text`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "__text"):
            size = pa.array([len(t.split()) for t in encoded(part, "__text")], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [size], [*keep, "size"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(run, f"{schema}, size long")


def turns(by: DataFrame) -> DataFrame:
    """Sources with `turn`, their number in code point order, null last: ranges are numbered alone, and offset by those before."""
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    rows = by.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(rows.withColumn("__part", F.spark_partition_id()).withColumn("__nth", F.monotonically_increasing_id() % (1 << 33)), "ranges")
    sizes = rows.groupBy("__part").count()  # one row per partition
    base = sizes.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__base"))
    return rows.join(F.broadcast(base), "__part").withColumn("turn", F.col("__base") + F.col("__nth")).drop("__part", "__nth", "__base")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row per source: source_size, n, target; sizes has columns source and size.

    Targets are min(cap, level * weight). The level starts at an even share by weight and rises as sources that it lifts above their cap
    leave the rest to the others, one aggregate over the sources each time, until none is above.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int"))
    by = turns(by).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(MOST_COPIES))
    by = stored(by.drop("turn").withColumn("reach", F.col("cap") / F.col("weight")), "sources")
    level, full = None, None
    while True:
        above = F.lit(False) if level is None else F.col("reach") < level
        r = by.agg(F.sum("source_size").alias("all"), F.count_if(above).alias("full"), F.sum(F.when(above, F.col("cap"))).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("rest")).first()
        if r.full == full or not r.rest:
            break
        full, level = r.full, (r["all"] - (r.held or 0.0)) / r.rest
    return by.select("source", "source_size", "n", F.least(F.col("cap"), F.lit(level or 0.0) * F.col("weight")).alias("target"))


def pivot_round(size: np.ndarray, chance: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Chances moved to 0 or 1 pair by pair, keeping sum(size * chance); returns them and the row left over, or -1.

    Expected chances stay what they were. Rows of size 0 should not come here.
    """
    chance = chance.astype(float).copy()
    p, s, draws = chance.tolist(), size.astype(float).tolist(), rng.random(len(chance)).tolist()
    held = -1
    for i in range(len(p)):
        if p[i] <= 0.0 or p[i] >= 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        # words that can move from b to a, and from a to b
        up = min((1 - p[a]) * s[a], p[b] * s[b])
        down = min(p[a] * s[a], (1 - p[b]) * s[b])
        if draws[i] * (up + down) < down:
            p[a], p[b] = _end(p[a] + up / s[a]), _end(p[b] - up / s[b])
        else:
            p[a], p[b] = _end(p[a] - down / s[a]), _end(p[b] + down / s[b])
        held = a if 0 < p[a] < 1 else b if 0 < p[b] < 1 else -1
    return np.array(p), held


def _end(p: float) -> float:
    return 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p


def _round_bucket(level: int, seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "mark", "copies", "chance", "place"], ignore_index=True)
        name = key[0] if key[0] is not None and key[0] == key[0] else "\0null"
        start = zlib.crc32(f"{seed}/{level}/{key[1]}/{name}".encode())
        rows["chance"], _ = pivot_round(rows["size"].to_numpy(), rows["chance"].to_numpy(), np.random.default_rng(start))
        return rows

    return run


def mix(docs: DataFrame, text: str = "text", weights: tuple[float, ...] = WEIGHTS, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and `place`, the number of the row in its scan, of every row.

    The hot source spreads over many buckets, and so do rows that repeat one id, or have none. Each level of the tree handles the residuals
    of the last, of which there are 1 / FAN as many; whatever is settled never moves again.
    """
    kind = docs.schema["doc_id"].dataType
    # ids travel as text: pandas would turn whole numbers beside nulls into floats
    chosen = docs.select(docs.doc_id.cast("string"), docs.source.cast("string"), F.monotonically_increasing_id().alias("place"), F.xxhash64(docs[text]).alias("mark"), docs[text].alias("__text"))
    sizes = stored(word_counts(chosen, ["doc_id", "source", "place", "mark"]), "sizes")
    table = stored(targets(sizes, weights), "targets")
    largest = table.agg(F.max("n")).first()[0] or 0
    same = sizes.join(table.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ratio = F.least(F.greatest(ratio, F.lit(0.0)), F.lit(float(MOST_COPIES)))
    rows = same.withColumn("copies", F.floor(ratio)).withColumn("chance", F.when(F.col("size") > 0, ratio - F.floor(ratio)).otherwise(0.0))
    buckets = F.greatest(F.ceil(F.col("n") / BUCKET), F.lit(1))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mark", F.lit(seed)), buckets))
    # a bucket far above its share holds equal rows, which go by their place instead
    crowded = rows.groupBy("source", "bucket").agg(F.count("*").alias("c")).where(F.col("c") > 4 * BUCKET)
    if crowded.limit(1).count():
        crowded = stored(crowded.select(F.coalesce("source", F.lit("\0null")).alias("__s"), F.col("bucket").alias("__b"), F.lit(True).alias("__many"), "c"), "crowded")
        named = rows.withColumns({"__s": F.coalesce("source", F.lit("\0null")), "__b": F.col("bucket")})
        dealt = F.when(F.col("__many"), F.pmod(F.xxhash64("place", F.lit(seed)), buckets)).otherwise(F.col("bucket"))
        rows = spread_join(named, crowded, ["__s", "__b"], "c").withColumn("bucket", dealt).select(*rows.columns)
    live = rows.where("chance > 0 and chance < 1")
    done = [rows.where("not (chance > 0 and chance < 1)")]
    parts, level = math.ceil(largest / BUCKET), 0
    while True:
        rounded = stored(live.groupBy("source", "bucket").applyInPandas(_round_bucket(level, seed), live.schema), f"level{level}")
        done.append(rounded.where("not (chance > 0 and chance < 1)"))
        live = rounded.where("chance > 0 and chance < 1")
        if parts <= 1:
            break
        parts, level = math.ceil(parts / FAN), level + 1
        live = live.withColumn("bucket", F.floor(F.col("bucket") / FAN))
    lone = F.pmod(F.xxhash64("doc_id", "source", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    done.append(live.withColumn("chance", (lone < F.col("chance")).cast("double")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = F.col("copies") + F.col("chance").cast("long")
    return out.select(F.col("doc_id").cast(kind), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "place")


def mixed(docs: DataFrame, text: str = "text", weights: tuple[float, ...] = WEIGHTS, seed: int = 11) -> DataFrame:
    """The rows of `docs`, each as many times as the mix takes it; all columns stay.

    Copies join back by the rows' places, so ids may repeat or be missing.
    """
    docs = settled(docs)
    place, copies, copy = (unused(docs, name) for name in ("__place", "__copies", "__copy"))
    taken = stored(mix(docs, text, weights, seed).where("copies > 0").select(F.col("place").alias(place), F.col("copies").cast("int").alias(copies)), "taken")
    if taken.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # else Spark joins them by place, which moves the texts
        taken = F.broadcast(taken)
    joined = docs.withColumn(place, F.monotonically_increasing_id()).join(taken, place)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(place, copies, copy)
