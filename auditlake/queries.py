"""The registered queries, each with its DuckDB counterpart; names are those of the operator inventory in SURVEY §2."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.functions import scalars as X
from auditlake.functions.keys import Envelope, RsaRing, decrypted, encrypted, with_data_keys, with_pads
from auditlake.operators import integrity, lifecycle, search
from auditlake.operators.ranges import positions
from auditlake.operators.sharding import Ring, merged_page
from auditlake.operators.versions import pinned
from auditlake.plans.audited import AuditedReader
from auditlake.plans.catalog import Catalog, CustomColumn, Field, Policy
from auditlake.plans.query import Dataset, LogQuery, TargetFilter, conditions
from auditlake.sources import views as V
from auditlake.sources.scratch import shared_path, spread, stored
from auditlake.streaming.ingest import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    """Registers a query under its name with its SQL."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


DAY = 86_400_000_000
FROM, TO = 1_704_067_200_000_000 + 9 * DAY, 1_704_067_200_000_000 + 12 * DAY
LOG = ["pos", "ts_us", "method", "url", "actor_id", "k"]
LOGS = ", ".join(LOG)
E_LOGS = f"(WITH e AS ({V.EVENT_LOGS}) SELECT {LOGS} FROM e)"
#: Entities that one task protects or digests the tokens of: much work for few bytes, so splits of files would be too large.
ENTITIES = 1 << 13
KEYS = {1: b"first key", 2: b"second key, longer than a block of sixty-four bytes so that it is hashed once"}


def _logs(spark, sf_dir):
    return V.event_logs(spark, sf_dir).select(*LOG)


def _dealt(spark, sf_dir, kind):
    """A registry dealt to tasks of ENTITIES rows."""
    rows = V.registry(spark, sf_dir, kind)
    return spread(rows, rows.count(), ENTITIES, "entity_id")


def _where(q: LogQuery):
    def run(spark, sf_dir):
        logs = V.event_logs(spark, sf_dir)
        for c in conditions(q, "ts", V.at):
            logs = logs.where(c)
        for name, value in q.custom.items():
            logs = logs.where(F.col(name) == value)
        return logs.select(*LOG)

    return run


# -- scans, filters, pages ------------------------------------------------------------------------------------------------

for _name, _q, _sql in [
    ("log_scan", LogQuery(), "true"),
    ("filter_time_range", LogQuery(FROM, TO), f"ts_us BETWEEN {FROM} AND {TO}"),
    ("filter_method_ci", LogQuery(method="PurChase"), "method = 'PURCHASE'"),
    ("filter_url_prefix", LogQuery(url_prefix="/users/1"), "starts_with(url, '/users/1')"),
    ("filter_custom_eq", LogQuery(custom={"k": "42"}), "k = '42'"),
    ("filter_conjunction", LogQuery(FROM - 9 * DAY, TO + 8 * DAY, "view", "/users/1", custom={"k": "7"}), f"ts_us BETWEEN {FROM - 9 * DAY} AND {TO + 8 * DAY} AND method = 'VIEW' AND starts_with(url, '/users/1') AND k = '7'"),
]:
    query(f"SELECT {LOGS} FROM {E_LOGS} WHERE {_sql}", _name)(_where(_q))


@query(f"SELECT {LOGS} FROM {E_LOGS} WHERE pos > 100 ORDER BY pos LIMIT 500")
def log_scan_asc(spark, sf_dir):
    """Positions after a cursor, oldest first."""
    return _logs(spark, sf_dir).where("pos > 100").orderBy("pos").limit(500)


@query(f"SELECT {LOGS} FROM {E_LOGS} WHERE pos < 900 ORDER BY pos DESC LIMIT 500")
def log_scan_desc(spark, sf_dir):
    """Positions before a cursor, newest first."""
    return _logs(spark, sf_dir).where("pos < 900").orderBy(F.desc("pos")).limit(500)


@query(f"SELECT {LOGS} FROM {E_LOGS} WHERE ts_us BETWEEN {FROM} AND {FROM + DAY}")
def time_range_pruned(spark, sf_dir):
    """A narrow window as a condition on the stored column, which the Parquet scan prunes row groups by."""
    return V.event_logs(spark, sf_dir).where(F.col("ts").between(V.at(FROM), V.at(FROM + DAY))).select(*LOG)


@query(f"SELECT count(*)::BIGINT AS n FROM {E_LOGS} WHERE method = 'CLICK' AND ts_us >= {FROM}")
def count_logs(spark, sf_dir):
    """Matches of a query; columns that only rendering needs are not read."""
    return _where(LogQuery(FROM, method="click"))(spark, sf_dir).agg(F.count("*").alias("n"))


def _page(after: str | None, limit: int, sql: str):
    def run(spark, sf_dir):
        rows = _where(LogQuery(method="view"))(spark, sf_dir)
        return (rows.where(after) if after else rows).orderBy(F.desc("pos")).limit(limit)

    return run, f"SELECT {LOGS} FROM {E_LOGS} WHERE method = 'VIEW' {sql} ORDER BY pos DESC LIMIT {limit}"


for _name, _after, _limit in [("query_page_first", None, 51), ("query_page_next", "pos < 700", 51), ("query_page_last", "pos < 40", 51)]:
    _run, _sql = _page(_after, _limit, f"AND {_after}" if _after else "")
    query(_sql, _name)(_run)


@query("SELECT event_id AS pos, epoch_us(ts) AS ts_us FROM events WHERE epoch_us(ts) < (SELECT max(epoch_us(ts)) FROM events) - 86400000000 * 20 ORDER BY event_id")
def late_arrivals(spark, sf_dir):
    """Events far behind the newest stay where they arrived; none is dropped for being late."""
    logs = V.event_logs(spark, sf_dir)
    newest = logs.agg((F.max("ts_us") - 20 * DAY).alias("limit"))
    return logs.crossJoin(F.broadcast(newest)).where("ts_us < limit").select("pos", "ts_us")


SEGMENTS = f"""SELECT pos // 256 AS seg, min(pos) AS base, count(*)::BIGINT AS records, min(ts_us) AS min_ts, max(ts_us) AS max_ts, sum(length(url))::BIGINT AS bytes FROM {E_LOGS} GROUP BY 1"""


@query(SEGMENTS)
def segment_stats(spark, sf_dir):
    """Zone map of segments of 256 rows."""
    return lifecycle.segment_stats(_logs(spark, sf_dir), 256)


@query(f"SELECT max(pos) + 1 AS tree_size, count(*)::BIGINT AS records, min(pos) AS purged FROM {E_LOGS} WHERE pos >= 128")
def tree_counts(spark, sf_dir):
    """Tree size counts purged rows too; here the first 128 are gone."""
    return _logs(spark, sf_dir).where("pos >= 128").agg((F.max("pos") + 1).alias("tree_size"), F.count("*").alias("records"), F.min("pos").alias("purged"))


@query("SELECT o_orderkey AS log, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders")
def log_positions(spark, sf_dir):
    """Dense positions in a declared order: rows are ranked inside ranges, and ranges offset by the counts before them."""
    rows = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("log"), "o_orderdate")
    return positions(rows, "pos", "o_orderdate", "log").select("log", "pos")


# -- registries and joins -------------------------------------------------------------------------------------------------

UV = f"({V.USER_VERSIONS})"


@query(f"SELECT entity_id, version, pos, state, fingerprint FROM {UV}")
def entity_versions(spark, sf_dir):
    """Versions from changes; rows that repeat the latest fields make none."""
    return V.user_versions(spark, sf_dir).select("entity_id", "version", "pos", "state", "fingerprint")


LATEST = f"(SELECT entity_id, max(version) AS version, max_by(state, version) AS state FROM {UV} GROUP BY 1)"


@query(f"SELECT entity_id, version, state FROM {LATEST}")
def latest_versions(spark, sf_dir):
    """The last version of each entity."""
    return search.latest(V.user_versions(spark, sf_dir).select("entity_id", "version", "state"))


@query(f"SELECT entity_id, version, state FROM {LATEST} WHERE entity_id % 10 <> 0 ORDER BY entity_id")
def list_entities(spark, sf_dir):
    """Live entities by id; every tenth is deleted."""
    return search.latest(V.user_versions(spark, sf_dir).select("entity_id", "version", "state")).where("entity_id % 10 <> 0").orderBy("entity_id")


@query(f"SELECT entity_id, version, state FROM {UV} WHERE entity_id = 7 ORDER BY version")
def entity_history(spark, sf_dir):
    """All versions of one entity, oldest first."""
    return V.user_versions(spark, sf_dir).where("entity_id = 7").select("entity_id", "version", "state").orderBy("version")


@query(f"SELECT entity_id, version, state, false AS deleted FROM {UV} UNION ALL SELECT entity_id, version + 1, state, true FROM {LATEST} WHERE entity_id % 10 = 0")
def entity_delete(spark, sf_dir):
    """Deletion adds a tombstone that copies the last version."""
    versions = V.user_versions(spark, sf_dir).select("entity_id", "version", "state", F.lit(False).alias("deleted"))
    return search.delete(versions, versions.where("entity_id % 10 = 0").select("entity_id").distinct())


@query(f"SELECT pos, ts_us, method, url, actor_id FROM ({V.ORDER_LOGS}) WHERE actor_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def filter_actor(spark, sf_dir):
    """Logs of actors that match: a semi join."""
    who = search.entities(V.registry(spark, sf_dir, "customer"), "segment", "BUILDING").withColumnRenamed("entity_id", "actor_id")
    return V.order_logs(spark, sf_dir).join(who, "actor_id", "left_semi").select("pos", "ts_us", "method", "url", "actor_id")


def _touched(spark, sf_dir, kind, field, probe, mode="exact"):
    found = search.entities(V.registry(spark, sf_dir, kind), field, probe, mode)
    return V.relations(spark, sf_dir, distinct=False).where(F.col("entity_type") == kind).join(found, "entity_id", "left_semi").select(F.col("log").alias("pos"))


PART, SUPPLIER = "red widget", "Supplier#000000001"
BY_PART = f"SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name = '{PART}'"
BY_SUPPLIER = f"SELECT l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_name = '{SUPPLIER}'"


@query(f"SELECT pos, ts_us, method, url, actor_id FROM ({V.ORDER_LOGS}) WHERE pos IN ({BY_PART})")
def filter_target_exact(spark, sf_dir):
    """Logs that touched an entity with a name: chained semi joins."""
    return V.order_logs(spark, sf_dir).join(_touched(spark, sf_dir, "part", "name", PART), "pos", "left_semi").select("pos", "ts_us", "method", "url", "actor_id")


@query(f"SELECT pos, ts_us, method, url, actor_id FROM ({V.ORDER_LOGS}) WHERE pos IN ({BY_PART}) AND pos IN ({BY_SUPPLIER})")
def filter_targets_and(spark, sf_dir):
    """Logs that touched both."""
    logs = V.order_logs(spark, sf_dir)
    for kind, probe in (("part", PART), ("supplier", SUPPLIER)):
        logs = logs.join(_touched(spark, sf_dir, kind, "name", probe), "pos", "left_semi")
    return logs.select("pos", "ts_us", "method", "url", "actor_id")


@query(f"SELECT entity_id, version FROM {UV} WHERE entity_id IN (SELECT entity_id FROM {UV} WHERE state = 'error')")
def entity_expand_versions(spark, sf_dir):
    """All versions of the entities that ever matched."""
    versions = V.user_versions(spark, sf_dir)
    return versions.join(search.entities(versions, "state", "error"), "entity_id", "left_semi").select("entity_id", "version")


_NEWEST = f"SELECT pos, ts_us, url FROM ({V.ORDER_LOGS}) WHERE method = 'PUT' ORDER BY pos DESC LIMIT 25"


@query(f"SELECT p.pos, p.ts_us, p.url, count(r.entity_id)::BIGINT AS n_targets, coalesce(sum(r.entity_id), 0)::BIGINT AS target_sum FROM ({_NEWEST}) p LEFT JOIN ({V.RELATIONS}) r ON r.log = p.pos GROUP BY ALL")
def page_with_targets(spark, sf_dir):
    """The page is cut first; only then are its relations fetched."""
    page = stored(V.order_logs(spark, sf_dir).where("method = 'PUT'").select("pos", "ts_us", "url").orderBy(F.desc("pos")).limit(25), "page")
    touched = V.relations(spark, sf_dir).join(F.broadcast(page.select(F.col("pos").alias("log"))), "log", "left_semi")
    sums = touched.groupBy("log").agg(F.count("*").alias("n"), F.sum("entity_id").alias("s"))
    return page.join(sums, page.pos == sums.log, "left").select("pos", "ts_us", "url", F.coalesce("n", F.lit(0)).alias("n_targets"), F.coalesce("s", F.lit(0)).alias("target_sum"))


_STEPS = "(SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)"


@query(f"""SELECT pos, entity_id, CASE WHEN (entity_id + version) % 7 <> 0 THEN version END AS version, CASE WHEN (entity_id + version) % 7 <> 0 THEN state END AS state, (entity_id + version) % 7 = 0 AS missing FROM
 (SELECT event_id AS pos, user_id AS entity_id, event_type AS state, sum((event_type IS DISTINCT FROM before)::INT) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS version FROM {_STEPS})""")
def render_as_recorded(spark, sf_dir):
    """Every log with its actor as the pinned version recorded it, found by the version's id; one that is gone is marked."""
    touches = V.user_touches(spark, sf_dir)
    logs = touches.select("pos", "entity_id", F.col("uid").alias("pin"))
    known = touches.where("new and (entity_id + version) % 7 <> 0").select("uid", "version", "state")
    return logs.join(known, F.col("pin") == F.col("uid"), "left").select("pos", "entity_id", "version", "state", F.isnull("uid").alias("missing"))


@query("""SELECT r.log, r.entity_type, r.entity_id, p.p_name AS name, (p.p_partkey IS NULL) AS missing FROM (SELECT DISTINCT l_orderkey AS log, 'part' AS entity_type, l_partkey AS entity_id FROM lineitem) r
 LEFT JOIN (SELECT * FROM part WHERE p_partkey % 7 <> 0) p ON p.p_partkey = r.entity_id""")
def render_as_recorded_all(spark, sf_dir):
    """Targets of every order, from a registry with one version each."""
    parts = V.registry(spark, sf_dir, "part").where("entity_id % 7 <> 0").select(F.col("entity_id").alias("id"), "name")
    rel = V.relations(spark, sf_dir).where("entity_type = 'part'")
    return rel.join(parts, rel.entity_id == parts.id, "left").select("log", "entity_type", "entity_id", "name", F.isnull("id").alias("missing"))


@query(f"SELECT e.event_id AS pos, e.user_id AS entity_id, max(v.version)::BIGINT AS version FROM events e JOIN {UV} v ON v.entity_id = e.user_id AND v.pos <= e.event_id GROUP BY 1, 2")
def pin_versions_asof(spark, sf_dir):
    """The version that was current at each log, by windows instead of a range join."""
    return pinned(V.event_logs(spark, sf_dir), V.user_versions(spark, sf_dir), "actor_id")


@query("SELECT DISTINCT l_orderkey AS log, l_partkey AS entity_id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0)")
def missing_references(spark, sf_dir):
    """Relations without a registry row."""
    rel = V.relations(spark, sf_dir).where("entity_type = 'part'").select("log", "entity_id")
    return rel.join(V.registry(spark, sf_dir, "part").where("entity_id % 7 <> 0").select("entity_id"), "entity_id", "left_anti").select("log", "entity_id")


@query(f"SELECT entity_id FROM {LATEST} WHERE state = 'view' AND entity_id % 10 <> 0")
def match_latest_only(spark, sf_dir):
    """Entities whose last live version matches."""
    last = search.latest(V.user_versions(spark, sf_dir).select("entity_id", "version", "state")).where("entity_id % 10 <> 0")
    return search.entities(last, "state", "view")


@query("SELECT p_partkey AS entity_id, sha256('brand' || chr(0) || p_brand || chr(0) || 'name' || chr(0) || p_name || chr(0) || 'size' || chr(0) || p_size::VARCHAR || chr(0)) AS fingerprint FROM part")
def fingerprint(spark, sf_dir):
    """Digest of an entity's field set."""
    parts = V.registry(spark, sf_dir, "part")
    return parts.select("entity_id", X.fingerprint({"name": F.col("name"), "brand": F.col("brand"), "size": F.col("size")}).alias("fingerprint"))


# -- search ---------------------------------------------------------------------------------------------------------------

for _mode, _probe, _sql in [("exact", PART, f"p_name = '{PART}'"), ("exact_ci", "Red WIDGET", "lower(p_name) = 'red widget'"), ("prefix", "SMALL b", "starts_with(lower(p_name), 'small b')"), ("contains", "d wid", "contains(p_name, 'd wid')")]:

    def _run(spark, sf_dir, mode=_mode, probe=_probe):
        return search.entities(V.registry(spark, sf_dir, "part"), "name", probe, mode)

    query(f"SELECT DISTINCT p_partkey AS entity_id FROM part WHERE {_sql}", {"exact": "match_exact_plain"}.get(_mode, f"match_{_mode}"))(_run)

NGRAMS = "list_sort(list_distinct(list_transform(range(1, greatest(len(s) - 2, 1) + 1), lambda i: substr(s, i, 3))))"
PREFIXES = "list_transform(range(1, least(4, len(s)) + 1), lambda i: substr(s, 1, i))"
NAMES = "(SELECT p_partkey AS entity_id, lower(p_name) AS s, p_name FROM part)"


def _tokens(parts, tokens):
    return parts.select("entity_id", F.array_join(tokens, "|").alias("tokens"))


@query(f"SELECT entity_id, s AS tokens FROM {NAMES}")
def tok_exact(spark, sf_dir):
    """One token: the whole value, lower-cased."""
    return _tokens(V.registry(spark, sf_dir, "part"), X.exact_tokens(F.col("name")))


@query(f"SELECT entity_id, array_to_string({PREFIXES}, '|') AS tokens FROM {NAMES}")
def tok_prefix(spark, sf_dir):
    """Prefixes of up to four characters."""
    return _tokens(V.registry(spark, sf_dir, "part"), X.prefix_tokens(F.col("name"), 4))


@query(f"SELECT entity_id, array_to_string({NGRAMS}, '|') AS tokens FROM {NAMES}")
def tok_ngram(spark, sf_dir):
    """Windows of three characters."""
    return _tokens(V.registry(spark, sf_dir, "part"), X.ngram_tokens(F.col("name"), 3))


_SHA = "sha256('idx:name' || chr(0) || {})"


@query(f"SELECT entity_id, array_to_string(list_transform({NGRAMS}, lambda t: {_SHA.format('t')}), '|') AS tokens FROM {NAMES}")
def tok_digests(spark, sf_dir):
    """What a blind index stores instead of tokens."""
    return _tokens(_dealt(spark, sf_dir, "part"), X.token_digests("name", X.ngram_tokens(F.col("name"), 3)))


def _indexed(spark, sf_dir, tokens, key=None):
    """Parts with the digests of their tokens, as the write path stores them."""
    parts = _dealt(spark, sf_dir, "part").withColumn("version", F.lit(0).cast("long"))
    if key is None:
        return parts.withColumn("digests", X.token_digests("name", tokens))
    return with_pads(parts, {"__k": key}).withColumn("digests", X.token_digests("name", tokens, F.col("__k"))).drop("__k")


@query(f"SELECT entity_id FROM {NAMES} WHERE s = 'red widget'")
def match_exact_ci_indexed(spark, sf_dir):
    """Case-insensitive equality through one digest."""
    rows = _indexed(spark, sf_dir, X.exact_tokens(F.col("name")))
    return rows.where(search.match_tokens(F.col("digests"), "name", ["red widget"], [None])).select("entity_id")


@query(f"SELECT entity_id FROM {NAMES} WHERE starts_with(s, 'sma')")
def match_prefix_indexed(spark, sf_dir):
    """A prefix through one digest."""
    rows = _indexed(spark, sf_dir, X.prefix_tokens(F.col("name"), 4))
    return rows.where(search.match_tokens(F.col("digests"), "name", ["sma"], [None])).select("entity_id")


@query(f"SELECT entity_id FROM {NAMES} WHERE contains(s, 'widget')")
def match_contains_ngram_plain(spark, sf_dir):
    """Candidates by n-grams, verified on the plain value."""
    rows = _indexed(spark, sf_dir, X.ngram_tokens(F.col("name"), 3))
    return rows.where(search.match_ngrams(F.col("digests"), "name", "WidGet", 3, [None], F.col("name"))).select("entity_id")


_ALL = " AND ".join(f"list_contains({NGRAMS}, '{g}')" for g in ("wid", "idg", "dge", "get"))


@query(f"SELECT entity_id FROM {NAMES} WHERE {_ALL}")
def match_contains_ngram_hashed(spark, sf_dir):
    """Candidates by n-grams of a hashed field; nothing to verify them with."""
    rows = _indexed(spark, sf_dir, X.ngram_tokens(F.col("name"), 3), KEYS[1])
    return rows.where(search.match_ngrams(F.col("digests"), "name", "widget", 3, [KEYS[1]])).select("entity_id")


@query(f"SELECT entity_id, 0::BIGINT AS version FROM {NAMES} WHERE {_ALL}")
def token_candidates_posting(spark, sf_dir):
    """The same through a posting table."""
    index = search.postings(_indexed(spark, sf_dir, X.ngram_tokens(F.col("name"), 3)), "digests")
    return search.candidates(index, [X.probe_digest("name", t) for t in X.probe_ngrams("widget", 3)])


# -- protected fields -----------------------------------------------------------------------------------------------------


def _hmac_sql(text: str, key: bytes) -> str:
    inner, outer = X.pads(key)
    return f"sha256(unhex('{outer.hex()}') || unhex(sha256(unhex('{inner.hex()}') || encode({text}))))"


@query("SELECT c_custkey AS entity_id, sha256(c_name) AS digest FROM customer")
def protect_sha256(spark, sf_dir):
    """Hashed names."""
    return V.registry(spark, sf_dir, "customer").select("entity_id", X.sha256_hex(F.col("name")).alias("digest"))


@query(f"SELECT c_custkey AS entity_id, 2 AS key_version, {_hmac_sql('c_name', KEYS[2])} AS digest FROM customer")
def protect_hmac(spark, sf_dir):
    """Keyed digests under the active key version."""
    return with_pads(V.registry(spark, sf_dir, "customer"), {"__k": KEYS[2]}).select("entity_id", F.lit(2).alias("key_version"), X.hmac_hex(F.col("name"), F.col("__k")).alias("digest"))


@query("SELECT c_custkey AS entity_id FROM customer WHERE c_name = 'Customer#000000007'")
def match_exact_sha256(spark, sf_dir):
    """Equality on a hashed field."""
    rows = protect_sha256(spark, sf_dir)
    return rows.where(search.match_hashed(F.col("digest"), "Customer#000000007")).select("entity_id")


@query("SELECT c_custkey AS entity_id FROM customer WHERE c_name = 'Customer#000000007'")
def match_exact_hmac(spark, sf_dir):
    """Equality on a keyed field; the probe is digested on the driver."""
    return protect_hmac(spark, sf_dir).where(search.match_keyed(F.col("digest"), "Customer#000000007", [KEYS[2]])).select("entity_id")


@query("SELECT c_custkey AS entity_id FROM customer WHERE c_mktsegment = 'BUILDING'")
def match_multi_key_version(spark, sf_dir):
    """Rows under two key versions, matched under every held one."""
    rows = with_pads(V.registry(spark, sf_dir, "customer"), {"__k1": KEYS[1], "__k2": KEYS[2]})
    digest = F.when(F.col("entity_id") % 2 == 0, X.hmac_hex(F.col("segment"), F.col("__k1"))).otherwise(X.hmac_hex(F.col("segment"), F.col("__k2")))
    return rows.where(search.match_keyed(digest, "BUILDING", list(KEYS.values()))).select("entity_id")


@query("SELECT c_custkey AS entity_id FROM customer WHERE contains(lower(c_name), '0007')")
def match_contains_rsa(spark, sf_dir):
    """Encrypted values: candidates by n-grams, their data key unwrapped by the private key, decrypted in the JVM and verified."""
    rsa, fresh = RsaRing({1: Envelope(spark)}), Envelope.new_data_key()
    version, wrapped = rsa.wrap(fresh)
    rows = with_pads(_dealt(spark, sf_dir, "customer"), {"__pads": KEYS[1]}).withColumn("sealed", F.lit(0).cast("long"))
    rows = with_data_keys(rows, {0: fresh}, "sealed")
    rows = rows.select("entity_id", "sealed", X.token_digests("name", X.ngram_tokens(F.col("name"), 3), F.col("__pads")).alias("digests"), encrypted(F.col("name"), F.col("__key")).alias("stored"))
    rows = with_data_keys(stored(rows, "sealed"), {0: rsa.unwrap(version, wrapped)}, "sealed")
    return rows.where(search.match_ngrams(F.col("digests"), "name", "0007", 3, [KEYS[1]], decrypted(F.col("stored"), F.col("__key")))).select("entity_id")


PROTECTED = Catalog().define_type("person", (
    Field("name", indexed=True, search="ngram", size=3), Field("mail", protection="hmac", indexed=True, search="exact"), Field("note", protection="rsa", search="ngram", size=3), Field("segment", protection="sha256", indexed=True, search="prefix", size=4)))


def _people(spark, sf_dir) -> Dataset:
    """Customers as protected entities, written once, and orders as the logs that touched them."""
    rsa, fresh = RsaRing({1: Envelope(spark)}), Envelope.new_data_key()
    version, wrapped = rsa.wrap(fresh)
    rows = _dealt(spark, sf_dir, "customer").select(F.lit("person").alias("entity_type"), "entity_id", F.create_map(*[x for f, c in (("name", "name"), ("mail", "name"), ("note", "name"), ("segment", "segment")) for x in (F.lit(f), F.col(c))]).alias("plain"), F.lit(0).cast("long").alias("sealed"))
    rows = with_data_keys(with_pads(rows, {"__pads": KEYS[2]}), {0: fresh}, "sealed")
    fields = PROTECTED.protected(F.col("entity_type"), F.col("plain"), F.col("__pads"), F.col("__key"))
    rows = rows.select(F.concat(F.lit("c"), F.col("entity_id").cast("string")).alias("uid"), "entity_id", F.lit(0).cast("long").alias("version"), F.lit(False).alias("deleted"), fields.alias("fields"), PROTECTED.tokens(F.col("entity_type"), F.col("plain"), F.col("__pads")).alias("tokens"), "sealed")
    logs = V.order_logs(spark, sf_dir)
    touched = logs.select(F.col("pos").alias("log"), F.concat(F.lit("c"), F.col("actor_id").cast("string")).alias("uid"), F.lit("person").alias("entity_type"))
    return Dataset(logs, touched, {"person": stored(rows, "people")}, catalog=PROTECTED, keys=list(KEYS.values()), data_keys={0: rsa.unwrap(version, wrapped)})


for _name, _field, _value, _mode, _sql in [
    ("query_plain_contains", "name", "0005", "contains", "contains(c_name, '0005')"), ("query_hmac_exact", "mail", "Customer#000000007", "exact", "c_name = 'Customer#000000007'"),
    ("query_hmac_ci", "mail", "CUSTOMER#000000007", "exact_ci", "c_name = 'Customer#000000007'"), ("query_rsa_contains", "note", "00011", "contains", "contains(c_name, '00011')"),
    ("query_sha256_exact", "segment", "BUILDING", "exact", "c_mktsegment = 'BUILDING'"), ("query_sha256_prefix", "segment", "mach", "prefix", "starts_with(c_mktsegment, 'MACH')"),
]:

    def _run(spark, sf_dir, filter_=TargetFilter("person", _field, _value, _mode)):
        return _people(spark, sf_dir).matching(LogQuery(targets=(filter_,))).select("pos", "actor_id")

    _run.__doc__ = f"Logs of entities by a protected field: {_field}, {_mode}."
    query(f"SELECT o_orderkey AS pos, o_custkey AS actor_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE {_sql}", _name)(_run)


# -- integrity ------------------------------------------------------------------------------------------------------------


def _leaves(spark, sf_dir, events=None):
    e = V.table(spark, sf_dir, "events") if events is None else events
    payload = F.concat_ws("|", F.col("event_id").cast("string"), X.micros(F.col("ts")).cast("string"), F.col("user_id").cast("string"), "event_type", "props")
    return e.select(F.col("event_id").alias("idx"), X.leaf_hash(payload).alias("hash"))


LEAVES = "SELECT event_id AS idx, unhex(sha256(unhex('00') || encode(event_id::VARCHAR || '|' || epoch_us(ts)::VARCHAR || '|' || user_id::VARCHAR || '|' || event_type || '|' || props))) AS hash FROM events"
LEVELS = 20


def _levels(leaves: str = LEAVES) -> str:
    """Level tables l0 .. of a tree of up to 2 ** LEVELS leaves."""
    out = [f"l0 AS MATERIALIZED ({leaves})"]
    for k in range(1, LEVELS + 1):
        out.append(
            f"l{k} AS MATERIALIZED (SELECT idx // 2 AS idx, CASE WHEN count(*) = 2 THEN unhex(sha256(unhex('01') || min_by(hash, idx) || max_by(hash, idx))) ELSE min_by(hash, idx) END AS hash FROM l{k - 1} GROUP BY idx // 2)"
        )
    return "WITH " + ", ".join(out)


@query(f"SELECT idx, lower(hex(hash)) AS hash FROM ({LEAVES})")
def merkle_leaves(spark, sf_dir):
    """Leaf hashes of the event log."""
    return _leaves(spark, sf_dir).select("idx", F.lower(F.hex("hash")).alias("hash"))


@query(f"{_levels()} SELECT lower(hex(hash)) AS root FROM l{LEVELS}")
def merkle_root(spark, sf_dir):
    """Root of the event log's tree, folded block by block."""
    leaves = _leaves(spark, sf_dir)
    size = V.table(spark, sf_dir, "events").count()
    return integrity.merkle_root(leaves, size).select(F.lower(F.hex("hash")).alias("root"))


def _union(wanted) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS step, lower(hex(hash)) AS hash FROM l{h} WHERE idx = {idx}" for i, (h, idx) in enumerate(wanted))


def _tree(spark, sf_dir) -> integrity.Tree:
    """The event log's tree with its full blocks written, as the store's commits leave it."""
    size, leaves = V.table(spark, sf_dir, "events").count(), _leaves(spark, sf_dir)
    none = spark.createDataFrame([], "height int, idx long, hash binary")
    made = integrity.new_nodes(leaves, none, 0, size)
    return integrity.Tree(leaves, none if made is None else stored(made, "nodes"), size)


def _proof(spark, wanted, hashes, key):
    """A proof's hashes, as many as the tree is high, as rows."""
    rows = [(i if key == "step" else h, x.hex()) for i, ((h, _), x) in enumerate(zip(wanted, hashes, strict=True))]
    return spark.createDataFrame(rows, f"{key} int, hash string")


@query(f"{_levels()} {' UNION ALL '.join(f'SELECT {h} AS height, lower(hex(hash)) AS hash FROM l{h} WHERE idx = {(777 >> h) ^ 1}' for h in range(LEVELS))}")
def inclusion_proof(spark, sf_dir):
    """Siblings on the path of leaf 777, from stored nodes and one block of leaves."""
    tree = _tree(spark, sf_dir)
    return _proof(spark, integrity.inclusion_path(777, tree.size), tree.inclusion(777), "height")


_UP = " UNION ALL ".join(f"SELECT {h} AS k, hash FROM l{h} WHERE idx = {(511 >> h) ^ 1}" for h in range(9, LEVELS))


@query(f"{_levels()} SELECT (row_number() OVER (ORDER BY k) - 1)::INT AS step, lower(hex(hash)) AS hash FROM ({_UP})")
def consistency_proof(spark, sf_dir):
    """That the tree of the first 512 rows, which is one full node, is a prefix of the whole log's."""
    tree = _tree(spark, sf_dir)
    return _proof(spark, integrity.consistency_path(512, tree.size), tree.consistency(512), "step")


#: The first node of a proof from 600 rows, (height, idx), and from its height up the siblings on the way to the root.
_FIRST = integrity.consistency_path(600, 1000)[0]
_ABOVE = " UNION ALL ".join(f"SELECT {h + 1} AS k, hash FROM l{h} WHERE idx = {(599 >> h) ^ 1}" for h in range(_FIRST[0], LEVELS))


@query(f"{_levels()} SELECT (row_number() OVER (ORDER BY k) - 1)::INT AS step, lower(hex(hash)) AS hash FROM (SELECT 0 AS k, hash FROM l{_FIRST[0]} WHERE idx = {_FIRST[1]} UNION ALL {_ABOVE})")
def consistency_proof_all(spark, sf_dir):
    """That the tree of 600 rows is a prefix of the whole log's."""
    tree = _tree(spark, sf_dir)
    return _proof(spark, integrity.consistency_path(600, tree.size), tree.consistency(600), "step")


@query("SELECT event_id AS idx FROM events WHERE event_id % 97 = 5")
def verify_leaves(spark, sf_dir):
    """Rows whose leaf is not the recorded one; here every 97th was changed."""
    leaves = _leaves(spark, sf_dir)
    changed = leaves.withColumn("hash", F.when(F.col("idx") % 97 == 5, F.unhex(F.sha2("hash", 256))).otherwise(F.col("hash")))
    return integrity.broken_leaves(changed, leaves)


@query("SELECT * FROM (VALUES (1, 'rollback'), (2, 'rewrite'), (3, 'missing')) t(shard, problem)")
def verify_global(spark, sf_dir):
    """Shards compared with a checkpoint of their sizes and Merkle roots; since then one lost its last row, one row of another changed, and one is gone."""
    events = V.table(spark, sf_dir, "events")
    size = events.count()
    shard = F.col("idx") % 4

    def roots(e):
        leaves = _leaves(spark, sf_dir, e).select(shard.cast("int").alias("shard"), F.floor(F.col("idx") / 4).alias("idx"), "hash")
        return integrity.shard_roots(leaves, -(-size // 4))

    last, middle = (size - 2) // 4 * 4 + 1, size // 8 * 4 + 2
    idx = F.col("event_id")
    altered = events.where((idx != last) & (idx % 4 != 3)).withColumn("props", F.when(idx == middle, F.concat("props", F.lit(" "))).otherwise(F.col("props")))
    return integrity.verify_global(roots(altered), roots(events))


# -- retention, shards, pipeline ------------------------------------------------------------------------------------------


@query(f"SELECT * FROM ({SEGMENTS}) WHERE max_ts >= {FROM} OR seg = (SELECT max(pos // 256) FROM {E_LOGS})")
def retention_age(spark, sf_dir):
    """Segments that an age limit keeps."""
    return lifecycle.kept_by_age(segment_stats(spark, sf_dir), FROM)


@query(f"SELECT seg, base, records, min_ts, max_ts, bytes FROM (SELECT *, sum(bytes) OVER (ORDER BY max_ts DESC, seg DESC) AS held FROM ({SEGMENTS})) WHERE held <= 9000 OR seg = (SELECT max(pos // 256) FROM {E_LOGS})")
def retention_bytes(spark, sf_dir):
    """Segments that a byte budget keeps."""
    return lifecycle.kept_by_bytes(segment_stats(spark, sf_dir), 9000)


RING = Ring((0, 1, 2, 3), seed=11)
SHARDED = f"(SELECT *, {RING.route_sql('actor_id')} AS shard FROM {E_LOGS})"


def _sharded(spark, sf_dir):
    return _logs(spark, sf_dir).withColumn("shard", RING.route(F.col("actor_id")))


@query(f"SELECT c_custkey AS tenant, {RING.route_sql('c_custkey')} AS shard FROM customer")
def route_tenant(spark, sf_dir):
    """The shard that owns each tenant."""
    return V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tenant"), RING.route(F.col("c_custkey")).alias("shard"))


_TENANT = RING.read_targets("17")


@query(f"SELECT {LOGS}, shard FROM {SHARDED} WHERE shard IN ({', '.join(map(str, _TENANT))})")
def shard_pruned_read(spark, sf_dir):
    """A tenant's read opens only its shards' folders and returns all of their rows."""
    return stored(_sharded(spark, sf_dir), "shards", by=("shard",)).where(F.col("shard").isin(_TENANT))


@query(f"SELECT shard, count(*)::BIGINT AS n FROM {SHARDED} GROUP BY 1")
def count_sharded(spark, sf_dir):
    """Matches per shard."""
    return _sharded(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"))


@query(f"SELECT ts_us, pos, shard FROM {SHARDED} WHERE method = 'ERROR'")
def fanout_merge(spark, sf_dir):
    """All shards' matches in one order of time and position."""
    return _sharded(spark, sf_dir).where("method = 'ERROR'").select("ts_us", "pos", "shard").orderBy("ts_us", "pos")


@query(f"SELECT ts_us, pos, shard FROM {SHARDED} ORDER BY ts_us DESC, pos DESC LIMIT 41")
def fanout_page(spark, sf_dir):
    """The newest page over shards, with one row more."""
    return merged_page(_sharded(spark, sf_dir).select("ts_us", "pos", "shard"), 40)


@query(f"SELECT ts_us, pos, shard FROM {SHARDED} WHERE (ts_us, pos) < ({TO}, 1000000) ORDER BY ts_us DESC, pos DESC LIMIT 41")
def fanout_page_next(spark, sf_dir):
    """The page behind a key."""
    return merged_page(_sharded(spark, sf_dir).select("ts_us", "pos", "shard"), 40, (TO, 1_000_000))


@query(f"SELECT entity_id, version, state, {RING.route_sql('entity_id')} AS shard FROM {LATEST}")
def list_entities_sharded(spark, sf_dir):
    """Entities of all shards, one shard after the other."""
    rows = search.latest(V.user_versions(spark, sf_dir).select("entity_id", "version", "state")).withColumn("shard", RING.route(F.col("entity_id")))
    out = None
    for s in RING.read_targets(None):
        part = rows.where(F.col("shard") == s)
        out = part if out is None else out.unionByName(part)
    return out


_BUCKETS = ", ".join(f"sum((value / 500 <= {b})::INT)::BIGINT AS le_{str(b).replace('.', '_')}" for b in lifecycle.LATENCY_BOUNDS)


@query(f"SELECT event_type, {_BUCKETS}, count(value)::BIGINT AS le_inf, sum(round(value / 500 * 1000000)::BIGINT)::BIGINT AS sum_us FROM events GROUP BY 1")
def latency_histogram(spark, sf_dir):
    """Cumulative histogram by kind of event."""
    return lifecycle.latency_histogram(F.col("value") / 500, V.table(spark, sf_dir, "events"), ["event_type"])


@query(f"SELECT event_type, {_BUCKETS}, count(value)::BIGINT AS le_inf, sum(round(value / 500 * 1000000)::BIGINT)::BIGINT AS sum_us FROM events GROUP BY 1")
def metrics_merged(spark, sf_dir):
    """The histograms of four shards as one."""
    e = V.table(spark, sf_dir, "events").withColumn("shard", RING.route(F.col("user_id")))
    return lifecycle.merged_histograms(lifecycle.latency_histogram(F.col("value") / 500, e, ["shard", "event_type"]), ["event_type"])


_ASKED = [("ann", LogQuery(method="click")), ("bob", LogQuery(url_prefix="/users/1")), ("ann", LogQuery(FROM, TO))]
_ASKED_SQL = ["method = 'CLICK'", "starts_with(url, '/users/1')", f"ts_us BETWEEN {FROM} AND {TO}"]


@query(" UNION ALL ".join(f"SELECT {i}::BIGINT AS nth, '{who}' AS actor, 'count' AS operation, '{q.summary()}' AS params, count(*)::BIGINT AS result_count FROM {E_LOGS} WHERE {w}" for i, ((who, q), w) in enumerate(zip(_ASKED, _ASKED_SQL, strict=True)) if who == "ann"))
def access_query(spark, sf_dir):
    """What one reader asked, from the access records that three audited reads left, oldest first; no probe is in them."""
    data = Dataset(V.event_logs(spark, sf_dir), V.relations(spark, sf_dir), {})
    reader = AuditedReader(spark, data, shared_path(spark, "access"), Policy(default=frozenset({"query"})))
    for who, q in _ASKED:
        reader.count(who, "reader", q)
    every = positions(reader.records(), "nth", "ts_us", "id")
    return every.where("actor = 'ann'").select("nth", "actor", "operation", "params", "result_count")


@query("SELECT min(event_id) AS event_id, user_id || '-' || event_type AS idem FROM events GROUP BY 2")
def idempotent_dedup(spark, sf_dir):
    """The first event of each idempotency key."""
    e = V.table(spark, sf_dir, "events").select("event_id", F.concat(F.col("user_id").cast("string"), F.lit("-"), "event_type").alias("idem"))
    return lifecycle.deduplicated(e, "idem", "event_id")


_RULES = {"unknown type": "event_type IN ('view', 'click', 'signup', 'purchase')", "value range": "value < 300"}
_RULE_SQL = "CASE WHEN event_type NOT IN ('view', 'click', 'signup', 'purchase') THEN 'unknown type' WHEN NOT value < 300 THEN 'value range' END"


@query(f"SELECT event_id, {_RULE_SQL} AS error FROM events WHERE ({_RULE_SQL}) IS NOT NULL")
def dlq_split(spark, sf_dir):
    """Events that break a rule, with the first one they break."""
    return lifecycle.split_valid(V.table(spark, sf_dir, "events"), _RULES)[1].select("event_id", "error")


@query("SELECT event_id, CASE WHEN NOT value < 300 THEN 'value range' END AS error FROM events WHERE event_type NOT IN ('view', 'click', 'signup', 'purchase') OR NOT value < 300")
def dlq_redrive(spark, sf_dir):
    """Dead letters replayed after a missing type was defined: most pass, the rest are parked again."""
    parked = lifecycle.split_valid(V.table(spark, sf_dir, "events"), _RULES)[1].drop("error")
    good, bad = lifecycle.split_valid(parked, {"value range": _RULES["value range"]})
    return good.select("event_id", F.lit(None).cast("string").alias("error")).unionByName(bad.select("event_id", "error"))


INGEST = Catalog().define_type("user", (Field("state", indexed=True),)).define_type("item", (Field("kind", indexed=True),)).define_column(CustomColumn("k", "number"), now=0)


def ingested(spark, sf_dir, path: str) -> Store:
    """A new store with all events: users act on items, and every fiftieth value lacks a key."""
    e = V.table(spark, sf_dir, "events").orderBy("event_id")
    entity = lambda kind, i, field, value: F.struct(F.lit(kind).alias("entity_type"), i.cast("string").alias("entity_id"), F.create_map(F.lit(field), value).alias("fields"))
    events = e.select(
        F.when(F.col("event_id") % 50 != 0, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("event_id"), X.micros(F.col("ts")).alias("occurred_at"),
        entity("user", F.col("user_id"), "state", F.col("event_type")).alias("actor"), F.upper("event_type").alias("method"), F.concat(F.lit("/events/"), F.col("event_id").cast("string")).alias("url"), F.col("props").alias("content"),
        F.array(entity("item", F.col("event_id") % 97, "kind", F.when(F.col("value") < 50, "low").otherwise("high"))).alias("targets"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("custom"),
    )
    store = Store(spark, path, INGEST)
    store.apply(events, 0)
    return store


_ITEMS = "(SELECT event_id, CASE WHEN value < 50 THEN 'low' ELSE 'high' END AS kind, lag(CASE WHEN value < 50 THEN 'low' ELSE 'high' END) OVER (PARTITION BY event_id % 97 ORDER BY event_id) AS before FROM events)"


@query(f"""SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, url, k, actor_version, item_version FROM
 (SELECT event_id, '/events/' || event_id::VARCHAR AS url, sum((event_type IS DISTINCT FROM before)::INT) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS actor_version FROM {_STEPS})
 JOIN (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events) USING (event_id)
 JOIN (SELECT event_id, sum((kind IS DISTINCT FROM before)::INT) OVER (PARTITION BY event_id % 97 ORDER BY event_id) - 1 AS item_version FROM {_ITEMS}) USING (event_id)""")
def ingest_events(spark, sf_dir):
    """All events through the store's write path; read back, each log with the versions that it pins."""
    now = ingested(spark, sf_dir, shared_path(spark, "store")).snapshot()
    actors, items = now.registry("user").select(F.col("uid").alias("actor_uid"), F.col("version").alias("actor_version")), now.registry("item").select("uid", F.col("version").alias("item_version"))
    pins = now.relations.join(items, "uid").select(F.col("log").alias("pos"), "item_version")
    return now.logs.join(actors, "actor_uid").join(pins, "pos").select("pos", "url", F.col("custom")["k"].alias("k"), "actor_version", "item_version")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.zz') IS NULL AS known FROM events")
def tagged_json(spark, sf_dir):
    """JSON read with a declared schema; keys that it does not know are found, not dropped."""
    e = V.table(spark, sf_dir, "events")
    parsed = F.from_json("props", "k long")
    known = F.size(F.array_except(F.json_object_keys("props"), F.array(F.lit("k")))) == 0
    return e.select("event_id", parsed["k"].alias("k"), known.alias("known"))


@query("SELECT event_id, upper(event_type) AS method, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity FROM events WHERE event_type <> 'signup' AND value >= 1")
def pre_post_filters(spark, sf_dir):
    """Filters that skip, then columns that later filters add."""
    e = V.table(spark, sf_dir, "events")
    out = lifecycle.filtered(e, [F.col("event_type") == "signup", F.col("value") < 1], {"method": F.upper("event_type"), "severity": F.when(F.col("event_type") == "error", "error").otherwise("info")})
    return out.select("event_id", "method", "severity")


@query(f"""SELECT pos, CASE WHEN method = 'ERROR' AND starts_with(url, '/users/1') THEN 'errors of 1' WHEN starts_with(url, '/users/1') THEN 'any of 1' WHEN method = 'VIEW' THEN 'views' END AS rule,
 CASE WHEN pos % 5 = 0 THEN NULL WHEN octet_length(encode(url)) > 14 THEN '"<body of ' || octet_length(encode(url))::VARCHAR || ' bytes exceeds the capture limit>"' WHEN pos % 2 = 0 THEN '"' || url || '"' ELSE pos::VARCHAR END AS body FROM {E_LOGS}""")
def capture_rules(spark, sf_dir):
    """The first rule an exchange meets, and its body as JSON."""
    rules = [("errors of 1", "error", "/users/1"), ("any of 1", None, "/users/1"), ("views", "view", "/")]
    raw = F.when(F.col("pos") % 5 == 0, "").when((F.col("pos") % 2 == 0) | (F.octet_length("url") > 14), F.col("url")).otherwise(F.col("pos").cast("string"))
    return _logs(spark, sf_dir).select("pos", lifecycle.rule_name(rules).alias("rule"), lifecycle.rendered_body(raw, 14).alias("body"))


_STAMP = "strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S') || '.' || lpad((ts_us % 1000000)::VARCHAR, 6, '0') || 'Z'"


@query(f"SELECT pos, '<110>1 ' || {_STAMP} || ' host app - audit - ' || '{{\"log_id\":' || pos::VARCHAR || ',\"method\":\"' || method || '\",\"url\":\"' || url || '\"}}' AS line FROM {E_LOGS}")
def syslog_line(spark, sf_dir):
    """Mirrored lines with metadata only."""
    summary = F.to_json(F.struct(F.col("pos").alias("log_id"), "method", "url"))
    return _logs(spark, sf_dir).select("pos", lifecycle.syslog_line("app", "host", X.rfc3339(F.col("ts_us")), summary).alias("line"))


_TARGETS = "(SELECT l_orderkey AS log, '[' || string_agg('{\"entity_type\":\"part\",\"uid\":\"p' || k || '\",\"entity_id\":' || k || ',\"version\":0,\"fields\":\"{\\\"name\\\":\\\"' || p_name || '\\\"}\",\"missing\":false}', ',' ORDER BY 'p' || k) || ']' AS t FROM (SELECT DISTINCT l_orderkey, l_partkey::VARCHAR AS k, p_name FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1)"


@query(f"""SELECT pos, '{{"pos":' || pos::VARCHAR || ',"ts_us":' || ts_us::VARCHAR || ',"method":"' || method || '","url":"' || url || '","actor_uid":"c' || actor_id::VARCHAR || '","targets":' || coalesce(t, '[]') || '}}' AS line
 FROM ({V.ORDER_LOGS}) LEFT JOIN {_TARGETS} ON log = pos WHERE method = 'PUT'""")
def export_ndjson(spark, sf_dir):
    """One JSON line per log that matches, whole, with its targets as recorded."""
    logs = V.order_logs(spark, sf_dir).select("pos", "ts_us", "method", "url", F.concat(F.lit("c"), F.col("actor_id").cast("string")).alias("actor_uid"))
    rel = V.relations(spark, sf_dir).where("entity_type = 'part'").select("log", F.concat(F.lit("p"), F.col("entity_id").cast("string")).alias("uid"), "entity_type")
    parts = V.registry(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("entity_id").cast("string")).alias("uid"), "entity_id", F.lit(0).cast("long").alias("version"), F.lit(False).alias("deleted"), F.create_map(F.lit("name"), F.col("name")).alias("fields"))
    return Dataset(logs, rel, {"part": parts}).exported(LogQuery(method="put"))


@query(f"SELECT pos, {_STAMP} AS at FROM {E_LOGS}")
def fmt_rfc3339(spark, sf_dir):
    """Times as text."""
    return _logs(spark, sf_dir).select("pos", X.rfc3339(F.col("ts_us")).alias("at"))


@query("SELECT event_id AS pos, lower(lpad(to_hex(epoch_us(ts) // 1000), 12, '0') || lpad(to_hex(event_id), 20, '0')) AS uid, epoch_us(ts) // 1000 AS ms FROM events")
def uid_timestamp(spark, sf_dir):
    """Ids that sort by time, and the milliseconds read back from them."""
    made = _logs(spark, sf_dir).select("pos", X.uid(F.col("ts_us"), F.col("pos")).alias("uid"))
    return made.withColumn("ms", X.uid_millis(F.col("uid")))


@query("SELECT p_partkey AS entity_id, CASE WHEN p_size % 8 = 0 THEN (p_size // 8)::BIGINT::VARCHAR ELSE (p_size / 8.0)::DOUBLE::VARCHAR END AS number, '{\"a\":' || p_size::VARCHAR || ',\"b\":\"' || p_brand || '\"}' AS json FROM part")
def canonical_text(spark, sf_dir):
    """Canonical numbers and JSON, the base of all digests."""
    parts = V.registry(spark, sf_dir, "part")
    raw = F.concat(F.lit('{ "b" : "'), "brand", F.lit('", "a":'), F.col("size").cast("string"), F.lit("}"))
    return parts.select("entity_id", X.canonical_number(F.col("size") / F.lit(8.0)).alias("number"), X.canonical_json(raw).alias("json"))


@query(f"""SELECT p.pos, p.ts_us, p.url, c.c_name AS actor, string_agg(DISTINCT pt.p_name, '|' ORDER BY pt.p_name) AS parts FROM (SELECT * FROM ({V.ORDER_LOGS}) WHERE pos IN
 (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE starts_with(p_name, 'red')) AND pos IN ({BY_SUPPLIER}) ORDER BY pos DESC LIMIT 50) p
 LEFT JOIN customer c ON c.c_custkey = p.actor_id JOIN lineitem l ON l.l_orderkey = p.pos JOIN part pt ON pt.p_partkey = l.l_partkey GROUP BY 1, 2, 3, 4""")
def flagship(spark, sf_dir):
    """The newest 50 orders that touched a red part and one supplier, with customer and parts as recorded."""
    logs = V.order_logs(spark, sf_dir)
    logs = logs.join(_touched(spark, sf_dir, "part", "name", "red", "prefix"), "pos", "left_semi").join(_touched(spark, sf_dir, "supplier", "name", SUPPLIER), "pos", "left_semi")
    page = stored(logs.orderBy(F.desc("pos")).limit(50), "page")
    actor = V.registry(spark, sf_dir, "customer").select(F.col("entity_id").alias("actor_id"), F.col("name").alias("actor"))
    touched = V.relations(spark, sf_dir).where("entity_type = 'part'").join(F.broadcast(page.select(F.col("pos").alias("log"))), "log", "left_semi")
    names = touched.join(V.registry(spark, sf_dir, "part").select("entity_id", "name"), "entity_id").groupBy("log").agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("parts"))
    return page.join(actor, "actor_id", "left").join(names, page.pos == names.log).select("pos", "ts_us", "url", "actor", "parts")
