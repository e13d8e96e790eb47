"""Retention of whole segments, statistics of segments, and what the write path does to batches of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.ranges import running_sum

#: Upper bounds of the latency histogram in seconds (fixed values).
LATENCY_BOUNDS = (0.0005, 0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.5, 1.0)
#: Well-formed idempotency keys (fixed value).
KEY_PATTERN = r"^[\x21-\x7e]{1,128}$"
#: Facility and severity of mirrored lines (fixed value).
SYSLOG_PRIORITY = 110


def segment_stats(logs: DataFrame, rows: int) -> DataFrame:
    """Per segment of `rows` positions: first position, number of rows, range of times, bytes of addresses."""
    seg = F.floor(F.col("pos") / rows).cast("long")
    return logs.groupBy(seg.alias("seg")).agg(
        F.min("pos").alias("base"), F.count("*").alias("records"), F.min("ts_us").alias("min_ts"), F.max("ts_us").alias("max_ts"), F.sum(F.length("url")).cast("long").alias("bytes")
    )


def kept_by_age(segments: DataFrame, cutoff: int) -> DataFrame:
    """Segments that stay: the active last one, and those with a row at or after the cutoff."""
    last = segments.agg(F.max("seg").alias("active"))
    return segments.crossJoin(F.broadcast(last)).where((F.col("max_ts") >= cutoff) | (F.col("seg") == F.col("active"))).drop("active")


def kept_by_bytes(segments: DataFrame, budget: int) -> DataFrame:
    """Segments that stay when the oldest sealed ones go until the rest fits: those whose sum with all newer ones does."""
    last = segments.agg(F.max("seg").alias("active"))
    every = segments.crossJoin(F.broadcast(last)).withColumn("sealed", F.col("seg") != F.col("active"))
    every = running_sum(every, "bytes", "held", "sealed", F.desc("max_ts"), F.desc("seg"))
    return every.where((F.col("held") <= budget) | ~F.col("sealed")).drop("active", "held", "sealed")


def latency_histogram(seconds: Column, rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cumulative counts per bound, with the count and the sum in microseconds of all."""
    sums = [F.sum((seconds <= b).cast("long")).alias(f"le_{str(b).replace('.', '_')}") for b in LATENCY_BOUNDS]
    return rows.groupBy(*(by or [])).agg(*sums, F.count(seconds).alias("le_inf"), F.sum(F.round(seconds * 1_000_000).cast("long")).alias("sum_us"))


def merged_histograms(histograms: DataFrame, by: list[str]) -> DataFrame:
    """One histogram of several shards': every column adds up."""
    columns = [c for c in histograms.columns if c.startswith("le_") or c == "sum_us"]
    return histograms.groupBy(*by).agg(*[F.sum(c).alias(c) for c in columns])


def deduplicated(events: DataFrame, key: str, order: str, valid: str = KEY_PATTERN) -> DataFrame:
    """The first event of each idempotency key, and all events without one; malformed keys are for `split_valid` to refuse.

    Only keys and orders are grouped, in part before the shuffle, so hot keys shrink; events are compared with the first of their key.
    """
    keyed = events.where(F.col(key).rlike(valid)).groupBy(key).agg(F.min(order).alias("__first"))
    named = events.join(keyed.withColumnRenamed(key, "__key"), F.col(key) == F.col("__key"), "left")
    return named.where(F.col(key).isNull() | (F.col(order) == F.col("__first"))).select(*events.columns)


def judged(events: DataFrame, rules: dict[str, Column | str], errors: list[Column] | None = None) -> DataFrame:
    """Events with the first rule they break as `error`, null if none; `errors` name broken rules themselves."""
    broken = [F.when(~F.coalesce(F.expr(ok) if isinstance(ok, str) else ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return events.withColumn("error", F.coalesce(*broken, *(errors or [])))


def split_valid(events: DataFrame, rules: dict[str, Column | str]) -> tuple[DataFrame, DataFrame]:
    """Events that meet all rules, and the others with the first rule they break as `error`."""
    marked = judged(events, rules)
    return marked.where("error is null").drop("error"), marked.where("error is not null")


def filtered(events: DataFrame, skip: list[Column], enrich: dict[str, Column]) -> DataFrame:
    """Drops events that any filter skips, then sets enriched columns."""
    for s in skip:
        events = events.where(~F.coalesce(s, F.lit(False)))
    return events.withColumns(enrich)


def rule_name(rules: list[tuple[str, str | None, str]]) -> Column:
    """Name of the first rule (name, method or None, path prefix) that an exchange meets."""
    found = F.lit(None).cast("string")
    for name, method, prefix in reversed(rules):
        ok = F.col("url").startswith(prefix)
        if method:
            ok = ok & (F.upper("method") == method.upper())
        found = F.when(ok, F.lit(name)).otherwise(found)
    return found


def rendered_body(body: Column, limit: int, binary: Column | None = None) -> Column:
    """A captured body as JSON: itself if it parses, else a string; a note if too large, or if binary and no text; null if empty."""
    size = F.octet_length(body)
    if binary is not None:
        bad = ~F.is_valid_utf8(binary.cast("string"))
        body, size = F.when(bad, F.concat(F.lit("<"), F.octet_length(binary).cast("string"), F.lit(" bytes, no text>"))).otherwise(binary.cast("string")), F.octet_length(binary)
    # the note's words are fixed values
    note = F.concat(F.lit('"<body of '), size.cast("string"), F.lit(' bytes exceeds the capture limit>"'))
    parsed = F.try_parse_json(body)
    quoted = F.regexp_extract(F.to_json(F.struct(body.alias("b"))), r'^\{"b":(.*)\}$', 1)
    return F.when(size == 0, F.lit(None)).when(size > limit, note).otherwise(F.coalesce(F.to_json(parsed), quoted))


def syslog_line(app: str, host: str, at: Column, summary: Column) -> Column:
    """One RFC 5424 line without structured data; the summary carries no content."""
    return F.concat(F.lit(f"<{SYSLOG_PRIORITY}>1 "), at, F.lit(f" {host} {app} - audit - "), summary)
