"""WARC archives written by Spark and read back by boundary-chain verification.

Writing: one record per page; of pages with equal payloads the one with the smallest id is a response, the others
are revisits without payload that name it. Files are gzip text whose line separator is the record separator, so every
executor writes its own part to the store.

Reading: every place where the record magic stands is a candidate, whether a record begins there or a payload holds
the magic. Tasks read ranges of files, cut at the magic, and emit per candidate the offset its header leads to. Pointer jumping from the start of the file then keeps
exactly the records on the chain from offset 0, in as many rounds as the logarithm of the chain's length. Files of any size work: a task holds a
piece between two magics, and records that hold the magic themselves are put together afterwards.

Null payloads are empty. Rows that share an id and a payload give one response, the others revisit it. Ties between equal payloads go to the smaller id,
null last. Empty input gives an empty archive. Very long payloads are pieces of their own, up to Spark's 2 GiB a field. Only page_id, url and html are read, so other columns may have
any name. A file whose chain stops before its end is reported by `read_warc` with complete = false on all its records.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.text import shared_path, stored

MAGIC = b"WARC/1.1\r\n"
SEPARATOR = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records in a file at most.
FILE_RECORDS = 400


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: eight groups of five hex digits, four characters each."""
    digest = F.sha1(payload)
    groups = [F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)]
    return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for v in groups for s in (15, 10, 5, 0)])


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, digest, and refers_to where a page revisits another's payload of at least `least_bytes` bytes.

    Only ids and digests are shuffled to find the first page of each payload. Joining the few repeated payloads back
    moves pages only where that table is too large to broadcast, which Spark decides at run time. The join is by id and digest.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html"))).withColumn("__bytes", F.octet_length("html"))
    # rows that share id and payload: their place decides which is first
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    keys = stored(rows.select("page_id", "digest", "__bytes", "__row"), "digests")
    first = keys.where(F.col("__bytes") >= least_bytes).groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "__row")).alias("f"), F.count("*").alias("n")).where("n > 1")
    again = keys.join(first.select("digest", "f"), "digest").where(F.col("__bytes") >= least_bytes)
    again = again.where(~((F.col("__row") == F.col("f.__row")) & F.col("page_id").eqNullSafe(F.col("f.page_id"))))
    # one row per page that revisits, so the join keys spread even where one payload holds a third of the pages
    again = again.select(F.xxhash64("page_id", "digest").alias("__key"), F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), F.col("f.page_id").alias("refers_to"), F.lit(True).alias("revisit"))
    twins = stored(again.groupBy("__key", "__page", "__digest").agg(F.first("refers_to").alias("refers_to")), "revisits")
    rows = rows.withColumn("__key", F.xxhash64("page_id", "digest"))
    match = (rows["__key"] == twins["__key"]) & rows["page_id"].eqNullSafe(twins["__page"]) & (rows["digest"] == twins["__digest"])
    joined = rows.join(twins, match, "left").drop(twins["__key"])
    same = F.col("__digest").isNotNull()
    # of rows equal in id and payload that are the first themselves, all but one revisit
    own = F.col("refers_to").eqNullSafe(F.col("page_id"))
    order = F.row_number().over(Window.partitionBy("__key", "page_id").orderBy("__row"))
    plain = joined.where(~F.coalesce(same & own, F.lit(False))).withColumn("record_type", F.when(same, "revisit").otherwise("response"))
    shared = joined.where(F.coalesce(same & own, F.lit(False))).withColumn("record_type", F.when(order > 1, "revisit").otherwise("response"))
    columns = ["page_id", "url", "html", "digest", "__bytes", "record_type", F.when(F.col("record_type") == "revisit", F.col("refers_to")).alias("refers_to")]
    if not twins.where(F.col("refers_to").eqNullSafe(F.col("__page"))).limit(1).count():  # no rows equal in both
        return plain.select(*columns)
    return plain.select(*columns).unionByName(shared.select(*columns))


def _clean(value: Column) -> Column:
    """A header value on one line."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\r\n]", " ")


def record_text(rows: DataFrame) -> Column:
    """A WARC record as text, without the separator that follows it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    response = rows.record_type == "response"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), rows["__bytes"].cast("string"), F.lit(SEPARATOR))
    block = F.concat(http, F.when(response, rows.html).otherwise(""))
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", rows.record_type),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), _clean(rows.page_id), F.lit(">"))),
        line("WARC-Target-URI", _clean(rows.url)),
        F.lit("WARC-Date: 2020-01-01T00:00:00Z\r\n"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), rows.digest)),
        F.when(response, "").otherwise(F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), _clean(rows.refers_to), F.lit(">"))))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(head, block)


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, file_records: int = FILE_RECORDS, compression: str = "gzip") -> None:
    """Writes one archive file per part of the input and `file_records` records; with compression none, readers split files further."""
    rows = with_revisits(pages, least_bytes)
    rows.select(record_text(rows).alias("value")).write.option("lineSep", SEPARATOR).option("compression", compression).option("maxRecordsPerFile", file_records).text(path)


_HEADER = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)\r\n")
#: What a piece of a file says: where it lies, and, if a header stands at its start, what follows from it.
_PIECE = [("file", "string", pa.string()), ("block", "long", pa.int64()), ("nth", "long", pa.int64()), ("local", "long", pa.int64()), ("size", "long", pa.int64()), ("tail", "boolean", pa.bool_()), ("after", "long", pa.int64()),
          ("record_id", "string", pa.string()), ("record_type", "string", pa.string()), ("uri", "string", pa.string()), ("refers_to", "string", pa.string()), ("payload_bytes", "long", pa.int64()), ("payload_digest", "string", pa.string()), ("intact", "boolean", pa.bool_())]
_SCHEMA = ", ".join(f"{n} {t}" for n, t, _ in _PIECE)
_SEPARATOR = SEPARATOR.encode()


def _payload(kind: str, block: bytes, digest: str) -> tuple[int | None, str, bool]:
    """Size and digest of a record's payload, and whether it is what the header says."""
    split = block.find(b"\r\n\r\n")
    if kind == "response":
        payload = block[split + 4 :] if split >= 0 else block
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        return len(payload), found, found == digest
    size = re.search(rb"(?im)^content-length:[ \t]*(\d+)", block[: split + 4] if split >= 0 else b"")
    return int(size[1]) if size else None, digest, True


def candidate(data: bytes) -> tuple:
    """What a header at the start of a piece says: bytes to the record's successor, fields and payload; nulls if there is none.

    A record that goes on behind the piece has no payload yet, and its digest is what its header says.
    """
    none = (None,) * 8
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return none
    fields: dict[bytes, bytes] = {}
    for m in _HEADER.finditer(data, 0, end + 2):
        fields.setdefault(m[1].lower(), m[2])
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or len(length) > 18:
        return none
    stop = end + 4 + int(length)
    text = lambda name: fields.get(name, b"").decode("utf-8", "replace")
    kind, digest = text(b"warc-type"), text(b"warc-payload-digest").removeprefix("sha1:")
    inside = stop + len(_SEPARATOR) <= len(data)
    payload = _payload(kind, data[end + 4 : stop], digest) if inside else (None, digest, None)
    return stop + len(_SEPARATOR), text(b"warc-record-id"), kind, text(b"warc-target-uri"), text(b"warc-refers-to") or None, *payload


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The files below a path cut at every magic, by ranges of a file where it is not compressed: value, file, block.

    Spark's text reader does it, with the magic as the end of a line; it streams, so a task holds one piece at a time.
    """
    rows = spark.read.option("lineSep", MAGIC.decode()).option("pathGlobFilter", "part-*").text(path)
    return rows.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every piece of every file with its place in its range, and what the header says that may stand at its start."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, nth, local = None, 0, 0
        for batch in batches:
            rows = []
            for value, file, block in zip(batch.column("value"), batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
                if place != (file, block):
                    place, nth, local = (file, block), 0, 0
                data = value.as_py()
                rows.append((file, block, nth, local, len(data), data.endswith(_SEPARATOR), *candidate(data)))
                nth, local = nth + 1, local + len(data) + len(MAGIC)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, _, t) in zip(zip(*rows, strict=True), _PIECE, strict=True)], [c[0] for c in _PIECE])

    return pieces(spark, path).mapInArrow(run, _SCHEMA)


def reachable(offset: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which offsets the chain from offset 0 visits; after[i] is where record i leads, in the offsets or not.

    Pointer jumping: what k jumps reach from the marked ones is marked too, then every pointer jumps twice as far.
    """
    order = np.argsort(offset, kind="stable")
    place = np.searchsorted(offset[order], after)
    known = place < len(offset)
    known[known] = offset[order][place[known]] == after[known]
    end = len(offset)
    jump = np.append(np.where(known, order[np.minimum(place, max(end - 1, 0))], end), end)
    marked = np.append(offset == 0, False)
    while True:
        marked[jump[marked]] = True
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    return marked[:-1]


def _chain(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one file's pieces the records on the chain from its start, and the pieces of those that consist of several."""
    rows = rows.sort_values("start", ignore_index=True)
    start, end = rows["start"].to_numpy(), (rows["start"] + rows["size"]).to_numpy()
    size = int(end[-1])
    # a record ends where a piece does, behind a separator; a magic inside a payload leads elsewhere
    after = np.where(rows["after"].isna(), -1, start + rows["after"].fillna(0).to_numpy(np.int64))
    maybe = (start > 0) & np.isin(after, end[rows["tail"].to_numpy(bool)])
    # the successor's magic stands where the piece ends
    on = np.zeros(len(rows), bool)
    on[maybe] = reachable(start[maybe] - len(MAGIC), after[maybe])
    firsts = np.flatnonzero(on)
    owner = np.searchsorted(firsts, np.arange(len(rows)), "right") - 1
    belongs = owner >= 0
    belongs[belongs] = end[belongs] <= after[firsts[owner[belongs]]]
    rows["owner"] = np.where(belongs, start[firsts[np.maximum(owner, 0)]] if len(firsts) else -1, -1)
    parts = np.bincount(owner[belongs], minlength=len(firsts))
    rows["parts"] = np.where(belongs, parts[np.maximum(owner, 0)] if len(firsts) else 0, 0)
    rows["first"], rows["complete"], rows["file_bytes"] = on, bool((after[on] == size).any()), size
    return rows[belongs & (on | (rows["parts"].to_numpy() > 1))]


def _whole(kinds: dict[str, str]):
    """The payload of a record of several pieces."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start", ignore_index=True)
        data = MAGIC.join(bytes(v) for v in rows["value"])
        found = candidate(data)
        out = rows.head(1).copy()
        out["payload_bytes"], out["payload_digest"], out["intact"] = found[5], found[6], bool(found[7])
        return out[list(kinds)]

    return run


_RECORD = ["file", "offset", "next", "file_bytes", "record_id", "record_type", "uri", "refers_to", "payload_bytes", "payload_digest", "intact", "complete"]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records on the chains of all files.

    Tasks cut ranges of files at every magic and say where each piece would lead; pieces before a range give its offset. A group is one
    file's pieces, a few numbers and header fields each. Only records with a magic inside are read again, and put together from their pieces.
    """
    found = stored(candidates(spark, path), "pieces")
    ranges = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("file").orderBy("block")) - F.col("bytes")
    placed = found.join(ranges.select("file", "block", before.alias("before")), ["file", "block"]).withColumn("start", F.col("before") + F.col("local")).drop("before", "local")
    chained = placed.groupBy("file").applyInPandas(_chain, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema) + ", owner long, parts long, first boolean, complete boolean, file_bytes long")
    chained = stored(chained, "chain")
    out = chained.where("first and parts = 1")
    several = chained.where("parts > 1")
    if several.limit(1).count():
        kinds = {f.name: f.dataType.simpleString() for f in chained.schema}
        text = pieces(spark, path)
        numbered = text.mapInArrow(_number, "value binary, file string, block long, nth long")
        whole = several.join(numbered, ["file", "block", "nth"]).groupBy("file", "owner").applyInPandas(_whole(kinds), ", ".join(f"`{n}` {t}" for n, t in kinds.items()))
        out = out.unionByName(whole)
    return out.withColumns({"offset": F.col("start") - len(MAGIC), "next": F.col("start") + F.col("after")}).select(*_RECORD)


def _number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their numbers in their ranges."""
    place, nth = None, 0
    for batch in batches:
        numbers = []
        for at in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
            place, nth = (at, 0) if place != at else (at, nth + 1)
            numbers.append(nth)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, "nth"])


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives to the shared folder, reads them back, and returns a row per record."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_warc(pages, path)
    kind = pages.schema["page_id"].dataType
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("")).cast(kind)
    records = read_warc(spark, path)
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "intact", "complete")


_GROUP = "('0x' || substr(d, {0}, 5))::INT"
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, {" || ".join(f"substr('{BASE32}', (({_GROUP.format(5 * g + 1)} >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))} AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to, true AS intact, true AS complete FROM f
"""
