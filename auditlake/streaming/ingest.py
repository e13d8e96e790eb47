"""The store of an audit log: streaming ingest in commits, snapshots of them, and the tables that readers open.

Tables are Parquet folders partitioned by commit. A commit writes its own partitions of all tables and its record last; readers see
commits up to one number, so what a commit has not finished is invisible, and a batch that runs again writes the same partitions anew.
What the next commit must know is in the last record: the tree's size and the sources' batches. Entities' last versions are compacted from
time to time into a table of heads, so no batch scans the history.
"""

from __future__ import annotations

import base64
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.functions.keys import Envelope, KeyRing, RsaRing, with_data_keys, with_pads
from auditlake.functions.scalars import hmac_hex, leaf_hash, map_fingerprint
from auditlake.operators.integrity import HEIGHT, Tree, new_nodes
from auditlake.operators.lifecycle import KEY_PATTERN, judged
from auditlake.operators.search import latest
from auditlake.operators.versions import version_uid, versioned
from auditlake.plans.catalog import Catalog
from auditlake.plans.query import Dataset, LogQuery, decode_cursor

ENTITY = "struct<entity_type:string,entity_id:string,fields:map<string,string>>"
EVENT = f"event_id string, occurred_at long, actor {ENTITY}, method string, url string, content string, targets array<{ENTITY}>, custom map<string,string>"
PIN = "struct<entity_type:string,uid:string>"
RESOLVED = f"event_id string, occurred_at long, actor {PIN}, method string, url string, content string, targets array<{PIN}>, custom map<string,string>"
LOG = "pos long, ts_us long, event_id string, actor_uid string, actor_type string, method string, url string, content string, custom map<string,string>, batch long"
RELATION = "log long, ord int, uid string, entity_type string, ts_us long, batch long"
VERSION = "idx long, uid string, entity_type string, entity_id string, version long, deleted boolean, fields map<string,string>, tokens array<string>, fingerprint string, recorded_at long, sealed long, batch long"
HEAD = "entity_type string, entity_id string, version long, deleted boolean, fingerprint string"
DEAD = f"{EVENT}, error string, failed_at long, batch long"
SPINE = "idx long, hash binary, batch long"
NODE = "height int, idx long, hash binary, batch long"
KEY = "n long, key_version int, wrapped string"
#: One row per commit: the range of its logs' times, for pruning, and its record as JSON.
COMMIT = "n long, min_ts long, max_ts long, added long, record string"
#: Rows of a range of arrivals, as a power of two.
PART = 13
#: Commits between two tables of heads.
HEADS_EVERY = 20
#: Idempotency keys that are remembered at least (fixed value).
KEY_WINDOW = 65_536

SCHEMAS = {"logs": LOG, "relations": RELATION, "versions": VERSION, "dead": DEAD, "spine_logs": SPINE, "spine_versions": SPINE, "nodes_logs": NODE, "nodes_versions": NODE}


def log_leaf(entities: Column) -> Column:
    """Leaf of a log: its columns and the versions it pins, in order."""
    return leaf_hash(F.to_json(F.struct("pos", "ts_us", "event_id", "actor_uid", "actor_type", "method", "url", "content", F.array_sort(F.map_entries("custom")).alias("custom"), entities.alias("targets"))))


def version_leaf() -> Column:
    """Leaf of a version: what is stored of it, but for its digests of tokens, which a new key changes."""
    return leaf_hash(F.to_json(F.struct("idx", "uid", "entity_type", "entity_id", "version", "deleted", F.array_sort(F.map_entries("fields")).alias("fields"), "fingerprint", "recorded_at")))


def numbered(rows: DataFrame, part: str, order: list[str], name: str, base: int) -> DataFrame:
    """Dense numbers from `base`: rows are ranked inside parts, and parts offset by the counts before them, one row each."""
    sizes = rows.groupBy(part).agg(F.count("*").alias("__c"))
    before = sizes.select(F.col(part).alias("__p"), (F.sum("__c").over(Window.orderBy(part)) - F.col("__c")).alias("__before"))
    nth = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return rows.withColumn("__nth", nth).join(F.broadcast(before), F.col(part) == F.col("__p")).withColumn(name, F.col("__before") + F.col("__nth") + F.lit(base)).drop("__p", "__before", "__nth")


@dataclass(frozen=True)
class Snapshot:
    """The tables as of one commit; later commits do not show."""

    store: Store
    record: dict

    def table(self, name: str) -> DataFrame:
        folder = f"versions/gen={self.record['gen']}" if name == "versions" else name
        rows = self.store.read(folder, SCHEMAS[name]).where(F.col("batch") <= self.record["n"])
        return rows.where(~F.col("batch").isin(self.record["gone"])) if self.record["gone"] and name in ("logs", "relations") else rows

    @property
    def logs(self) -> DataFrame:
        return self.table("logs")

    @property
    def relations(self) -> DataFrame:
        return self.table("relations")

    @property
    def versions(self) -> DataFrame:
        return self.table("versions")

    @property
    def dead(self) -> DataFrame:
        """Events that were refused and not replayed since."""
        return self.table("dead").where(F.col("batch") >= self.record["dead_from"])

    def registry(self, kind: str) -> DataFrame:
        return self.versions.where(F.col("entity_type") == kind)

    def entities(self, kind: str, deleted: bool = False) -> DataFrame:
        """The last version of every entity of a type by id; deleted ones only if asked for."""
        last = latest(self.registry(kind))
        return (last if deleted else last.where("not deleted")).orderBy("entity_id")

    def history(self, kind: str, entity_id: str) -> DataFrame:
        """All versions of an entity, oldest first; an unknown one is an error."""
        rows = self.registry(kind).where(F.col("entity_id") == entity_id)
        if not rows.limit(1).count():
            raise KeyError(f"{kind}/{entity_id}")
        return rows.orderBy("version")

    def dataset(self, search_keys: bool = True) -> Dataset:
        """What log queries run over, with the keys that the store holds."""
        kinds = {k: self.registry(k) for k in self.store.catalog.types}
        return Dataset(self.logs, self.relations, kinds, catalog=self.store.catalog, keys=self.store.ring.held() if search_keys else [], data_keys=self.store.data_keys() if search_keys else {})

    def page(self, q: LogQuery) -> tuple[DataFrame, str | None, int]:
        """A page, its cursor, and how many commits were opened for it.

        Commits whose times lie outside the query's, or behind its cursor, stay shut. The nearest are opened first, twice as many each time,
        until the page is full: a page of the newest logs opens the last commits alone.
        """
        spans = self.store.commits().where((F.col("n") <= self.record["n"]) & (F.col("added") > 0)).select("n", "min_ts", "max_ts", "added").orderBy("n").collect()  # a short row per commit
        first, lots = 0, []
        for r in spans:
            lots.append((r, first, first + r.added))
            first += r.added
        (at,) = decode_cursor(q.cursor, q.order) if q.cursor else (None,)
        behind = lambda low, high: at is None or (low < at if q.order == "desc" else high - 1 > at)
        fit = [r.n for r, low, high in lots if r.n not in self.record["gone"] and behind(low, high) and (q.from_micros is None or r.max_ts >= q.from_micros) and (q.to_micros is None or r.min_ts <= q.to_micros)]
        fit = fit[::-1] if q.order == "desc" else fit
        whole, most = self.dataset(), 1 if q.limit is not None else len(fit)
        while True:
            some = fit[:most]
            rows, cursor = replace(whole, logs=whole.logs.where(F.col("batch").isin(some) if some else F.lit(False))).page(q)
            if cursor or most >= len(fit) or not q.limit:
                break
            most *= 4
        return rows, cursor, len(some)

    def tree(self, name: str = "logs") -> Tree:
        """Roots and proofs of the tree of logs or versions."""
        return Tree(self.table(f"spine_{name}"), self.table(f"nodes_{name}"), self.record[f"{name}_size"])


class Store:
    """The tables below one folder, and the write path into them."""

    def __init__(self, spark: SparkSession, path: str, catalog: Catalog, ring: KeyRing | None = None, rsa: RsaRing | None = None, sink: Callable[[DataFrame], None] | None = None, retries: int = 0, rules: dict[str, Column] | None = None):
        """`sink` gets the committed logs of each batch; its errors undo nothing. Batches are tried again `retries` times."""
        self.spark, self.path, self.catalog, self.ring, self.rsa, self.sink, self.retries = spark, path.rstrip("/"), catalog, ring or KeyRing(), rsa, sink, retries
        known = F.col("targets").isNull() | F.forall("targets", lambda t: catalog.entity_rules(t).isNull())
        target = F.get(F.filter(F.transform("targets", catalog.entity_rules), lambda e: e.isNotNull()), F.lit(0))
        self.rules = {
            "malformed key": F.col("event_id").isNull() | F.col("event_id").rlike(KEY_PATTERN),
            "missing actor": F.col("actor").isNotNull() & F.col("actor.entity_id").isNotNull(),
            "missing url": F.col("url").isNotNull(),
            "missing time": F.col("occurred_at").isNotNull(),
        } | (rules or {}) | catalog.custom_rules(F.col("custom"), F.col("occurred_at"))
        self.broken = {"actor": catalog.entity_rules(F.col("actor")), "targets": F.when(~F.coalesce(known, F.lit(True)), target)}
        self.last = self._newest()

    # -- reading ----------------------------------------------------------------------------------------------------------

    def read(self, name: str, schema: str) -> DataFrame:
        """The table, or no rows before its first commit."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def _newest(self) -> dict:
        row = self.read("commits", COMMIT).orderBy(F.desc("n")).first()
        return json.loads(row.record) if row else {"n": -1, "gen": 0, "logs_size": 0, "versions_size": 0, "sources": {}, "heads": -1, "dead_from": 0, "purged": 0, "gone": [], "recent": {}, "span": (None, None, 0)}

    def commits(self) -> DataFrame:
        """All commit records, as JSON."""
        return self.read("commits", COMMIT)

    def snapshot(self, n: int | None = None) -> Snapshot:
        """The store as of a commit, by default the newest this object knows; `refresh` looks for newer ones."""
        if n is None or n == self.last["n"]:
            return Snapshot(self, self.last)
        row = self.commits().where(F.col("n") == n).first()
        if row is None:
            raise KeyError(n)
        return Snapshot(self, json.loads(row.record))

    def refresh(self) -> Snapshot:
        self.last = self._newest()
        return self.snapshot()

    def data_keys(self) -> dict[int, bytes]:
        """Data keys by commit, as far as private keys are held."""
        if not self.rsa or not self.catalog.encrypts:
            return {}
        rows = self.read(f"keys/gen={self.last['gen']}", KEY).where(F.col("n") <= self.last["n"]).collect()  # one short row per commit that encrypted
        opened = {r.n: self.rsa.unwrap(r.key_version, base64.b64decode(r.wrapped)) for r in rows}
        return {n: k for n, k in opened.items() if k is not None}

    # -- writing ----------------------------------------------------------------------------------------------------------

    def write(self, rows: DataFrame, name: str, n: int) -> None:
        rows.drop("batch").write.mode("overwrite").parquet(f"{self.path}/{name}/batch={n}")

    def staged(self, rows: DataFrame, name: str, source: str) -> DataFrame:
        """Rows of a batch that several steps read, written once below the folder of its source."""
        path = f"{self.path}/staging/{name}/{source}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def commit(self, record: dict) -> None:
        """The record makes everything written under its number visible."""
        row = self.spark.createDataFrame([(record["n"], *record["span"], json.dumps(record, sort_keys=True))], COMMIT).coalesce(1)
        row.write.mode("overwrite").parquet(f"{self.path}/commits/c={record['n']}")
        self.last = record

    def heads(self) -> DataFrame:
        """The last version of every entity: the newest table of heads and the versions since."""
        now = self.last
        since = self.snapshot().versions.where(F.col("batch") > now["heads"]).select(*[c.split()[0] for c in HEAD.split(", ")])
        both = since if now["heads"] < 0 else since.unionByName(self.read(f"heads/upto={now['heads']}", HEAD))
        last = both.groupBy("entity_type", "entity_id").agg(F.max_by(F.struct("version", "deleted", "fingerprint"), "version").alias("v"))
        return last.select("entity_type", "entity_id", "v.*")

    def _seen(self) -> DataFrame:
        """Keys of the last commits that together hold KEY_WINDOW events."""
        return self.snapshot().logs.where((F.col("batch") >= self._since("logs", KEY_WINDOW)) & F.col("event_id").isNotNull()).select("event_id")

    def _since(self, name: str, rows: int) -> int:
        """The commit from which on at least so many rows of a table came, as far as there are."""
        n, held = self.last["n"], 0
        for at, size in reversed(self.last["recent"].get(name, [])):
            n, held = at, held + size
            if held >= rows:
                break
        return n

    def _recent(self, name: str, n: int, added: int) -> list[list[int]]:
        """First commit and rows of the lots that `_since` needs, oldest first; old lots are joined, so the list stays short."""
        lots = [*self.last["recent"].get(name, []), [n, added]]
        while len(lots) > 1 and sum(s for _, s in lots[1:]) >= KEY_WINDOW:
            lots = lots[1:]
        return [[lots[0][0], lots[0][1] + lots[1][1]], *lots[2:]] if len(lots) > 256 else lots

    def _protected(self, rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame | None]:
        """Versions' rows with `stored` and `tokens`, and the wrapped data key of the commit."""
        key, pads, data_key = None, None, None
        if self.catalog.keyed:
            rows, pads = with_pads(rows, {"__pads": self.ring.keys[self.ring.active]}), F.col("__pads")
        if self.catalog.encrypts:
            if self.rsa is None:
                raise ValueError("encrypted fields need a key pair")
            fresh = Envelope.new_data_key()
            version, wrapped = self.rsa.wrap(fresh)
            key = self.spark.createDataFrame([(n, version, base64.b64encode(wrapped).decode())], KEY)
            rows, data_key = with_data_keys(rows.withColumn("__commit", F.lit(n).cast("long")), {n: fresh}, "__commit"), F.col("__key")
        made = rows.withColumn("stored", self.catalog.protected(F.col("entity_type"), F.col("fields"), pads, data_key)).withColumn("tokens", self.catalog.tokens(F.col("entity_type"), F.col("fields"), pads))
        return made.drop("__pads", "__key", "__commit"), key

    def _fingerprint(self, rows: DataFrame) -> DataFrame:
        """Rows with the digest of their canonical fields; keyed with the ring's first key where a type has keyed fields, so that it tells nothing; dropping that key makes entities look changed once."""
        if not self.catalog.keyed:
            return rows.withColumn("fingerprint", map_fingerprint(F.col("fields")))
        keyed = with_pads(rows, {"__f": self.ring.keys[min(self.ring.keys)]})
        return keyed.withColumn("fingerprint", hmac_hex(map_fingerprint(F.col("fields")), F.col("__f"))).drop("__f")

    def _append(self, n: int, fresh: DataFrame) -> int:
        """Writes new versions (pos, ord, entity, fields, ...) with their spine; returns how many there are now."""
        base, gen = self.last["versions_size"], self.last["gen"]
        rows, key = self._protected(numbered(fresh, "__part", ["pos", "ord"], "idx", base), n)
        if key is not None:
            key.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/keys/gen={gen}/batch={n}")
        rows = rows.select("idx", "uid", "entity_type", "entity_id", "version", "deleted", F.col("stored").alias("fields"), "tokens", "fingerprint", "recorded_at", F.lit(n).cast("long").alias("sealed"))
        self.write(rows, f"versions/gen={gen}", n)
        stored = self.read(f"versions/gen={gen}/batch={n}", VERSION.removesuffix(", batch long"))
        self.write(stored.select("idx", version_leaf().alias("hash")), "spine_versions", n)
        return base + stored.count()

    def _grow(self, name: str, n: int, size: int) -> None:
        """The node table's new rows, from the spine's."""
        old = self.last[f"{name}_size"]
        spine = self.read(f"spine_{name}", SPINE).where((F.col("batch") <= n) & (F.col("batch") >= self._since(name, 1 << HEIGHT)))
        made = new_nodes(spine, self.snapshot().table(f"nodes_{name}"), old, size)
        if made is not None:
            self.write(made, f"nodes_{name}", n)

    def apply(self, events: DataFrame, batch: int, source: str = "stream") -> None:
        """One micro-batch: the foreachBatch of `start`. A batch of a source that is committed already is skipped."""
        if self.last["sources"].get(source, -1) >= batch:
            return
        for left in range(self.retries, -1, -1):
            try:
                record = self._apply(events, batch, source)
                break
            except Exception:
                if not left:
                    raise
        if self.sink:
            try:
                self.sink(self.snapshot().logs.where(F.col("batch") == record["n"]))
            except Exception as e:  # noqa: BLE001  a sink is someone else's code
                self.sink_error = str(e)

    def _apply(self, events: DataFrame, batch: int, source: str) -> dict:
        n, started = self.last["n"] + 1, time.time_ns() // 1000
        # what arrived, once, with its place and the first rule it breaks; all else is read from here
        staged = judged(events.withColumn("__place", F.monotonically_increasing_id()), self.rules, list(self.broken.values()))
        staged = self.staged(staged, "events", source)
        self.write(staged.where("error is not null").drop("__place").withColumn("failed_at", F.lit(started)), "dead", n)
        good = staged.where("error is null").drop("error")
        # of several events with one key the first to arrive counts, and none that was committed lately
        later = good.where("event_id is not null").groupBy("event_id").agg(F.min("__place").alias("__first"), F.count("*").alias("c")).where("c > 1").drop("c")
        # repeated keys are few, as a rule, and then a table small enough for Spark to broadcast, so that whole events are not shuffled by key
        later = self.staged(later, "repeated", source)
        good = good.join(later.withColumnRenamed("event_id", "__e"), F.col("event_id") == F.col("__e"), "left").where("__first is null or __place = __first").drop("__e", "__first")
        good = good.join(self._seen(), "event_id", "left_anti")
        rows = self.staged(numbered(good.withColumn("__part", F.shiftright("__place", PART)), "__part", ["__place"], "pos", self.last["logs_size"]), "numbered", source)
        actor = F.array(F.struct("actor.entity_type", "actor.entity_id", "actor.fields"))
        touched = rows.select("pos", "occurred_at", "__part", F.posexplode(F.concat(actor, F.coalesce("targets", F.array().cast(f"array<{ENTITY}>")))).alias("ord", "e"))
        touched = touched.select("pos", "occurred_at", "__part", "ord", "e.entity_type", "e.entity_id", self.catalog.canonical(F.col("e.entity_type"), F.coalesce("e.fields", F.create_map().cast("map<string,string>"))).alias("fields"))
        last = self.heads().select("entity_type", "entity_id", F.when(~F.col("deleted"), F.col("fingerprint")).alias("old"), F.col("version").alias("top"))
        seen = versioned(self._fingerprint(touched), last, lambda rows: self.staged(rows, "touched", source))
        seen = self.staged(seen, "pinned", source)
        fresh = seen.where("new").withColumn("deleted", F.lit(False)).withColumnRenamed("occurred_at", "recorded_at")
        # registries first, then relations, then the logs that refer to both
        versions = self._append(n, fresh)
        pins = seen.select(F.col("pos").alias("log"), (F.col("ord") - 1).alias("ord"), "uid", "entity_type", F.col("occurred_at").alias("ts_us"))
        span = self._log(n, rows, pins, source)
        more = {"sources": self.last["sources"] | {source: batch}} | ({"dead_from": n} if source == "redrive" else {})
        return self.finish(n, self.last["logs_size"] + span[2], versions, more | {"span": span})

    def _log(self, n: int, rows: DataFrame, pins: DataFrame, source: str) -> tuple:
        """Writes relations and logs from numbered rows and the versions they pin (log, ord from -1, uid, entity_type, ts_us)."""
        self.write(pins.where("ord >= 0"), "relations", n)
        uids = pins.groupBy("log").agg(F.array_sort(F.collect_list(F.struct("ord", "uid")))["uid"].alias("u"))
        out = rows.join(uids, F.col("pos") == F.col("log")).select("pos", F.col("occurred_at").alias("ts_us"), "event_id", F.col("u")[0].alias("actor_uid"), F.col("actor.entity_type").alias("actor_type"), "method", "url", "content", "custom", F.slice("u", 2, F.size("u")).alias("__targets"))
        out = self.staged(out.withColumn("__leaf", log_leaf(F.col("__targets"))).drop("__targets"), "logs", source)
        self.write(out.drop("__leaf"), "logs", n)
        self.write(out.select(F.col("pos").alias("idx"), F.col("__leaf").alias("hash")), "spine_logs", n)
        return tuple(out.agg(F.min("ts_us"), F.max("ts_us"), F.count("*")).first())

    def append_resolved(self, events: DataFrame, batch: int, source: str = "resolved") -> None:
        """Logs whose versions the caller holds already: `RESOLVED` rows, none of which makes a version. An unknown uid refuses the batch."""
        if self.last["sources"].get(source, -1) >= batch:
            return
        n = self.last["n"] + 1
        staged = self.staged(events.withColumn("__place", F.monotonically_increasing_id()), "events", source)
        rows = self.staged(numbered(staged.withColumn("__part", F.shiftright("__place", PART)), "__part", ["__place"], "pos", self.last["logs_size"]), "numbered", source)
        pins = rows.select(F.col("pos").alias("log"), F.col("occurred_at").alias("ts_us"), F.posexplode(F.concat(F.array("actor"), F.coalesce("targets", F.array().cast(f"array<{PIN}>")))).alias("ord", "e"))
        pins = pins.select("log", (F.col("ord") - 1).alias("ord"), "e.uid", "e.entity_type", "ts_us")
        if pins.join(self.snapshot().versions.select("uid"), "uid", "left_anti").limit(1).count():
            raise KeyError("a uid that no version has")
        span = self._log(n, rows, pins, source)
        self.finish(n, self.last["logs_size"] + span[2], self.last["versions_size"], {"sources": self.last["sources"] | {source: batch}, "span": span})

    def finish(self, n: int, logs: int, versions: int, more: dict[str, Any] | None = None) -> dict:
        """Nodes, from time to time heads, and the commit's record."""
        for name, size in (("logs", logs), ("versions", versions)):
            self._grow(name, n, size)
        recent = {name: self._recent(name, n, size - self.last[f"{name}_size"]) for name, size in (("logs", logs), ("versions", versions))}
        record = self.last | {"span": (None, None, 0)} | (more or {}) | {"n": n, "recent": recent, "logs_size": logs, "versions_size": versions, "committed_at": time.time_ns() // 1000}
        self.commit(record)
        if n - record["heads"] > HEADS_EVERY:
            self.heads().write.mode("overwrite").parquet(f"{self.path}/heads/upto={n}")
            self.commit(record | {"heads": n})
        return self.last

    def delete(self, kind: str, ids: DataFrame, at: int) -> int:
        """Tombstones for live entities of a type (entity_id): copies of their last version, numbered next. Returns how many."""
        n = self.last["n"] + 1
        last = self.heads().where((F.col("entity_type") == kind) & ~F.col("deleted")).join(ids.select("entity_id").distinct(), "entity_id", "left_semi")
        whole = self.snapshot().registry(kind).join(last.select("entity_id", "version"), ["entity_id", "version"])
        rows = whole.withColumn("version", F.col("version") + 1).withColumn("deleted", F.lit(True)).withColumn("uid", version_uid()).withColumn("recorded_at", F.lit(at).cast("long"))
        # the copy keeps the stored fields, and so the data key of the commit that encrypted them
        rows = numbered(rows.withColumn("__part", F.pmod(F.xxhash64("entity_id"), F.lit(64))), "__part", ["entity_id"], "idx", self.last["versions_size"])
        rows = rows.select("idx", "uid", "entity_type", "entity_id", "version", "deleted", "fields", "tokens", "fingerprint", "recorded_at", "sealed")
        self.write(rows, f"versions/gen={self.last['gen']}", n)
        stored = self.read(f"versions/gen={self.last['gen']}/batch={n}", VERSION.removesuffix(", batch long"))
        self.write(stored.select("idx", version_leaf().alias("hash")), "spine_versions", n)
        gone = stored.count()
        self.finish(n, self.last["logs_size"], self.last["versions_size"] + gone)
        return gone

    def start(self, events: DataFrame, checkpoint: str, **trigger):
        """A streaming query that appends each micro-batch; late events keep their time and go by arrival."""
        return events.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def redrive(self) -> None:
        """Replays all waiting dead letters with their own times in one commit; those that fail again are parked again by it.

        An event with a key that was committed lately is skipped, so replaying twice is harmless. Corrupt files are left out.
        """
        waiting = self.waiting().select(*[f.name for f in self.spark.createDataFrame([], EVENT).schema])
        self.apply(waiting, self.last["sources"].get("redrive", -1) + 1, "redrive")

    def waiting(self) -> DataFrame:
        """Dead letters not replayed yet; unreadable files are passed over, `quarantined` lists them."""
        rows = self.spark.read.schema(DEAD).option("ignoreCorruptFiles", "true")
        try:
            found = rows.parquet(f"{self.path}/dead")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], DEAD)
            raise
        return found.where((F.col("batch") >= self.last["dead_from"]) & (F.col("batch") <= self.last["n"]))

    def quarantined(self) -> DataFrame:
        """Paths of dead-letter files that hold no readable row group."""
        every = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{self.path}/dead").select("path", F.substring("content", 1, 4).alias("head"), F.substring("content", -4, 4).alias("tail"))
        magic = F.lit(b"PAR1")
        return every.where((F.col("head") != magic) | (F.col("tail") != magic)).select("path")
