"""One query per operator over its whole table, with production parameters; SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm.bpe import bpe
from auditlake.llm import chat, warc
from auditlake.llm.hnsw import nearest_neighbours
from auditlake.llm import jaccard
from auditlake.llm.mixing import mix
from auditlake.llm.pii import find_pii
from auditlake.llm.quality_rules import quality_rules
from auditlake.llm.subword_quality import quality
from auditlake.llm.toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled rows that are not held out."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and one that imitates the template, read back from their formatted texts."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.createDataFrame([(-1, 0, "user", chat.HOSTILE), (-1, 1, "assistant", chat.HOSTILE)], rows.schema)
    return chat.chat_digests(rows.unionByName(hostile))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reads back from the archives of all pages."""
    return warc.warc_round_trip(_table(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, digest of base spans and all spans per document."""
    return find_pii(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labelled rows that are not held out."""
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and near-duplicate components of all documents."""
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, fertility and verdict per document."""
    return quality_rules(_table(spark, sf_dir, "documents"))


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every fiftieth vector among all others."""
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text per document."""
    return bpe(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_chat, op3_warc, op4_pii, op5_mixing, op6_quality, op7_jaccard, op8_quality_rules, op9_hnsw, op10_bpe)}

ORACLES: dict[str, str] = {"op2_chat": chat.ORACLE_SQL, "op3_warc": warc.ORACLE_SQL, "op7_jaccard": jaccard.ORACLE_SQL}
