"""Scalar functions as Spark columns; all stay in the JVM."""

from __future__ import annotations

import hashlib
import hmac as _hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Domain separation of hashed search tokens (fixed value).
TOKEN_PREFIX = "idx:"


def canonical_number(c: Column) -> Column:
    """Whole numbers below 1e15 without a point, others as Spark prints them; NaN is refused at ingest."""
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string"))


def number_text(value: float) -> str:
    """What Spark prints for a number that is no whole one below 1e15: digits as Python finds them, in Java's notation."""
    if 1e-3 <= abs(value) < 1e7:
        return repr(value)
    digits, _, exponent = f"{value!r}".partition("e")
    if not exponent:  # Python writes these out, Java does not
        sign, digits = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
        whole, _, part = digits.partition(".")
        every = (whole + part).lstrip("0").rstrip("0")
        power = len(whole) - 1 if whole.strip("0") else -(len(part) - len(part.lstrip("0"))) - 1
        return f"{sign}{every[0]}.{every[1:] or '0'}E{power}"
    return f"{digits if '.' in digits else digits + '.0'}E{int(exponent)}"


def canonical_json(c: Column) -> Column:
    """JSON text with sorted keys and no spaces."""
    return F.to_json(F.parse_json(c))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def rfc3339(us: Column) -> Column:
    """UTC with six digits and Z, from microseconds; the session's zone plays no part."""
    ntz = F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.date_format(ntz, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def uid(us: Column, serial: Column) -> Column:
    """32 hex digits: 12 of milliseconds, 20 of a serial number; text order is time order."""
    return F.lower(F.concat(F.lpad(F.hex(F.floor(us / 1000).cast("long")), 12, "0"), F.lpad(F.hex(serial), 20, "0")))


def uid_millis(c: Column) -> Column:
    return F.conv(F.substring(c, 1, 12), 16, 10).cast("long")


def exact_tokens(c: Column) -> Column:
    return F.array(F.lower(c))


def prefix_tokens(c: Column, n: int) -> Column:
    """The first 1 to n characters, lower-cased; none of an empty text."""
    low = F.lower(c)
    made = F.transform(F.sequence(F.lit(1), F.least(F.lit(n), F.greatest(F.length(low), F.lit(1)))), lambda i: F.substring(low, F.lit(1), i))
    return F.when(F.length(low) > 0, made).otherwise(F.array().cast("array<string>"))


def ngram_tokens(c: Column, n: int) -> Column:
    """Windows of n characters, lower-cased, distinct and sorted; a shorter text is one token, an empty one none."""
    low = F.lower(c)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - (n - 1), F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))
    return F.when(F.length(low) > 0, F.sort_array(F.array_distinct(windows))).otherwise(F.array().cast("array<string>"))


def probe_ngrams(text: str, n: int) -> list[str] | None:
    """The n-grams of a search text, or None if it is shorter than n."""
    low = text.lower()
    return sorted({low[i : i + n] for i in range(len(low) - n + 1)}) if len(low) >= n else None


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer pad of HMAC-SHA-256."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_hex(c: Column, key: Column) -> Column:
    """HMAC-SHA-256 from two nested SHA-256 calls; `key` is a column of pads, as `with_pads` adds."""
    return F.sha2(F.concat(key["outer"], F.unhex(F.sha2(F.concat(key["inner"], c.cast("binary")), 256))), 256)


def probe_hmac(text: str, key: bytes) -> str:
    return _hmac.new(key, text.encode(), hashlib.sha256).hexdigest()


def token_text(field: str, token: Column) -> Column:
    return F.concat(F.lit(TOKEN_PREFIX + field + "\0"), token)


def token_digests(field: str, tokens: Column, key: Column | None = None) -> Column:
    """Digest of each token under its field's name, keyed if a column of pads is given."""
    return F.transform(tokens, lambda t: sha256_hex(token_text(field, t)) if key is None else hmac_hex(token_text(field, t), key))


def probe_digest(field: str, token: str, key: bytes | None = None) -> str:
    text = f"{TOKEN_PREFIX}{field}\0{token}"
    return probe_hmac(text, key) if key else hashlib.sha256(text.encode()).hexdigest()


def fingerprint(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields' names and canonical texts, by name."""
    parts = [F.concat(F.lit(k), F.lit("\0"), F.coalesce(fields[k].cast("string"), F.lit("")), F.lit("\0")) for k in sorted(fields)]
    return sha256_hex(F.concat(*parts))


def leaf_hash(payload: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.unhex(F.lit("00")), payload.cast("binary")), 256))


def map_fingerprint(fields: Column) -> Column:
    """The same of a map of canonical texts; null values do not count."""
    known = F.array_sort(F.map_keys(F.map_filter(fields, lambda k, v: v.isNotNull())))
    return sha256_hex(F.array_join(F.transform(known, lambda k: F.concat(k, F.lit("\0"), fields[k], F.lit("\0"))), ""))


def node_hash(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\x01" + left + right).digest()
