"""From raw documents to token ids: rules, near duplicates, personal data, mixing, tokens.

Each stage reads what its predecessor wrote as Parquet and works on all of it, in blocks inside its tasks, so very long texts are read whole.
Repeated rows are judged one by one; an empty table gives an empty one. Extra columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.bpe import bpe
from auditlake.llm.jaccard import jaccard_components
from auditlake.llm.mixing import mixed
from auditlake.llm.pii import redact
from auditlake.llm.quality_rules import quality_rules
from auditlake.llm.text import settled, spread_join, stored, unused

#: So many places of dropped rows, 8 bytes each, may be broadcast.
BROADCAST_ROWS = 1_000_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; other columns keep any names they have. Null, empty and short texts fail them."""
    plain = [f"__c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*plain)
    judged = quality_rules(renamed, text=plain[docs.columns.index("text")], keep=tuple(plain))
    return judged.where("kept").select(*plain).toDF(*docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id, null last; of equal ids that with the smallest text hash.

    Rows are told apart by their place in the scan, so rows that share an id, or have none, are judged by their texts alone. Rows
    without words stay.
    """
    place = unused(docs, "__place")
    docs = settled(docs).withColumn(place, F.monotonically_increasing_id())
    placed = docs.select("doc_id", "text", F.col(place).alias("__place"))
    found = stored(jaccard_components(placed, "__place").select("__place", "component_id"), "components")
    sizes = stored(found.groupBy("component_id").agg(F.count("*").alias("c"), F.lit(True).alias("again")).where("c > 1"), "sizes")
    several = stored(spread_join(found, sizes, ["component_id"], "c").where("again").select("__place", "component_id"), "several")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("mark"), "__place")
    firsts = several.join(placed.select("__place", order.alias("o")), "__place").groupBy("component_id").agg(F.min("o").alias("o"))
    lost = stored(several.join(firsts.select("o.__place"), "__place", "left_anti").select("__place"), "lost")
    if lost.count() <= BROADCAST_ROWS:  # else Spark joins them by place, which moves the texts
        lost = F.broadcast(lost)
    return docs.join(lost, docs[place] == lost["__place"], "left_anti").drop(place)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; null stays null, and every row stays."""
    return redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it; those without words are taken no time. Null sources are one source."""
    return mixed(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text per document; a null text has no tokens."""
    return bpe(docs)


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_distinct),
    ("personal data", hide_personal_data),
    ("mixing", mix_sources),
    ("BPE", to_tokens),
]

#: No stage but the join can be put in SQL; tests/llm/test_pipeline.py compares with plain loops instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
