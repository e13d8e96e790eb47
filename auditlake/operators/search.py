"""Match modes over a registry of versions: uid, entity_id, version, deleted, fields (map), tokens (map of digests)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.scalars import probe_digest, probe_hmac, probe_ngrams


def latest(versions: DataFrame, order: str = "version") -> DataFrame:
    """The last version of each entity, as a partial aggregate: no sort, no window over a hot entity's whole history."""
    columns = versions.columns
    picked = versions.groupBy("entity_id").agg(F.max_by(F.struct(*columns), order).alias("v"))
    return picked.select(*[F.col(f"v.{c}").alias(c) for c in columns])


def match(value: Column, probe: str, mode: str) -> Column:
    """Plain-text modes. Contains is case-sensitive here, and case-insensitive through an n-gram index."""
    low = F.lower(value)
    if mode == "exact":
        return value == probe
    if mode == "exact_ci":
        return low == probe.lower()
    if mode == "prefix":
        return low.startswith(probe.lower())
    if mode == "contains":
        return value.contains(probe)
    raise ValueError(f"unknown match mode {mode}")


def entities(versions: DataFrame, field: str, probe: str, mode: str = "exact") -> DataFrame:
    """Ids of entities with a version that matches."""
    value = F.col("fields")[field] if "fields" in versions.columns else F.col(field)
    return versions.where(match(value, probe, mode)).select("entity_id").distinct()


def match_hashed(value: Column, probe: str) -> Column:
    """Equality on a SHA-256 field."""
    return value == F.sha2(F.lit(probe).cast("binary"), 256)


def match_keyed(value: Column, probe: str, keys: list[bytes]) -> Column:
    """Equality on a keyed field under any held key version; digests are made here, so no key enters the plan."""
    return value.isin([probe_hmac(probe, k) for k in keys])


def match_tokens(digests: Column, field: str, tokens: list[str], keys: list[bytes | None]) -> Column:
    """Whether one version carries all tokens under one key version."""
    found = F.lit(False)
    for key in keys:
        every = F.lit(True)
        for t in tokens:
            every = every & F.array_contains(digests, probe_digest(field, t, key))
        found = found | every
    return found


def match_ngrams(digests: Column, field: str, probe: str, n: int, keys: list[bytes | None], plain: Column | None = None) -> Column:
    """Candidates by n-grams; with the plain value at hand they are verified, without it false positives stay."""
    tokens = probe_ngrams(probe, n)
    if tokens is None:
        raise ValueError(f"search text is shorter than the index's {n} characters")
    found = match_tokens(digests, field, tokens, keys)
    return found if plain is None else found & F.lower(plain).contains(probe.lower())


def postings(versions: DataFrame, digests: str) -> DataFrame:
    """The inverted index as a table: digest, entity_id, version."""
    return versions.select(F.explode(digests).alias("digest"), "entity_id", "version")


def candidates(index: DataFrame, wanted: list[str]) -> DataFrame:
    """Versions that carry all wanted digests: a filter that the scan can prune by, then one count per version."""
    wanted = sorted(set(wanted))
    found = index.where(F.col("digest").isin(wanted)).groupBy("entity_id", "version").agg(F.count_distinct("digest").alias("n"))
    return found.where(F.col("n") == len(wanted)).select("entity_id", "version")


def delete(versions: DataFrame, deletions: DataFrame) -> DataFrame:
    """Versions with a tombstone for each deleted entity: a copy of its last one, numbered next."""
    last = latest(versions).join(deletions.select("entity_id"), "entity_id", "left_semi").where("not deleted")
    return versions.unionByName(last.withColumn("version", F.col("version") + 1).withColumn("deleted", F.lit(True)))
