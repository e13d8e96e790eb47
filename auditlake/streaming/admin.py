"""Work on a whole store: verification, checkpoints, retention, re-keying."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

from pyspark.sql import functions as F

from auditlake.functions.keys import KeyRing, RsaRing, decrypted, with_data_keys, with_pads
from auditlake.operators.checkpoints import checkpoint, holds, problems, signed
from auditlake.operators.integrity import HEIGHT, block_roots, broken_leaves, verify_consistency
from auditlake.streaming.ingest import KEY, VERSION, Store, log_leaf, version_leaf

RECORD = "kind string, record string"


def _signed_records(store: Store, kind: str) -> list[dict]:
    """Signed records of a kind, oldest first."""
    rows = store.read("signed", RECORD).where(F.col("kind") == kind).collect()  # one short row per checkpoint or re-key
    return sorted((json.loads(r.record) for r in rows), key=lambda r: (r["created_at"], r["size"]))


def _keep(store: Store, kind: str, record: dict) -> None:
    store.spark.createDataFrame([(kind, json.dumps(record, sort_keys=True))], RECORD).coalesce(1).write.mode("append").parquet(f"{store.path}/signed")


def write_checkpoint(store: Store, at: int, anchor: Callable[[dict], None] | None = None) -> dict | None:
    """A signed checkpoint of the log's tree as of the last commit, kept beside the tables; None without a private key."""
    if store.rsa is None or not store.rsa.can_sign():
        return None
    made = checkpoint(store.snapshot().tree(), store.rsa, at, anchor)
    _keep(store, "checkpoint", {k: v for k, v in made.items() if k != "anchor_error"})
    return made


def verify(store: Store) -> dict:
    """Checks logs, relations and versions against their trees, and the trees against what was signed.

    ok, segments_checked (commits with logs), log_records, and problems. Purged logs count as gone; their leaves still hold the tree up.
    """
    now, found = store.snapshot(), []
    logs, relations, versions = now.logs, now.relations, now.versions
    pins = relations.groupBy(F.col("log").alias("__log")).agg(F.array_sort(F.collect_list(F.struct("ord", "uid")))["uid"].alias("__u"))
    leaves = logs.join(pins, F.col("pos") == F.col("__log"), "left").withColumn("__u", F.coalesce("__u", F.array().cast("array<string>")))
    for name, rows, size in (("log", leaves.select(F.col("pos").alias("idx"), log_leaf(F.col("__u")).alias("hash")), now.record["logs_size"]), ("version", versions.select("idx", version_leaf().alias("hash")), now.record["versions_size"])):
        spine = now.table(f"spine_{name}s").select("idx", "hash")
        bad = broken_leaves(rows, spine).groupBy().agg(F.count("*").alias("n"), F.min("idx").alias("first")).first()
        if bad.n:
            found.append(f"{bad.n} {name} records differ from the tree, first {bad.first}")
        held = rows.agg(F.count("*").alias("n"), F.count_distinct("idx").alias("d")).first()
        if held.n != held.d or spine.count() != size or held.n != size - (now.record["purged"] if name == "log" else 0):
            found.append(f"{name} records are missing or repeated")
        # the stored nodes against the spine
        tree = now.tree(f"{name}s")
        again = block_roots(spine.where(F.col("idx") < size >> HEIGHT << HEIGHT))
        nodes = tree.nodes.where(F.col("height") == HEIGHT).select(F.col("idx").alias("__i"), F.col("hash").alias("__h"))
        if again.join(nodes, F.col("idx") == F.col("__i"), "full").where("not (hash <=> __h)").limit(1).count():
            found.append(f"{name} nodes differ from the spine")
    known = versions.select(F.col("uid").alias("__uid"))
    if logs.join(known, F.col("actor_uid") == F.col("__uid"), "left_anti").limit(1).count() or relations.join(known, F.col("uid") == F.col("__uid"), "left_anti").limit(1).count():
        found.append("a pinned version is missing")
    if store.rsa is not None:
        found += problems(now.tree(), _signed_records(store, "checkpoint"), store.rsa)
        found += _rekey_problems(store)
    return {"ok": not found, "segments_checked": logs.select("batch").distinct().count(), "log_records": logs.count(), "problems": found}


def merged_reports(reports: dict[int, dict]) -> dict:
    """One report of several shards': all must hold, counts add up, problems name their shard."""
    return {
        "ok": all(r["ok"] for r in reports.values()),
        "segments_checked": sum(r["segments_checked"] for r in reports.values()),
        "log_records": sum(r["log_records"] for r in reports.values()),
        "problems": [f"shard {s}: {p}" for s, r in sorted(reports.items()) for p in r["problems"]],
    }


# -- retention ------------------------------------------------------------------------------------------------------------


def segments(store: Store):
    """Per table and commit: rows, newest time and bytes on disk, of logs and relations."""
    out = None
    for name in ("logs", "relations"):
        rows = store.snapshot().table(name).select("batch", "ts_us", "_metadata.file_path", "_metadata.file_size")
        files = rows.groupBy("batch", "file_path", "file_size").agg(F.count("*").alias("rows"), F.max("ts_us").alias("max_ts"))
        one = files.groupBy("batch").agg(F.sum("rows").alias("rows"), F.max("max_ts").alias("max_ts"), F.sum("file_size").alias("bytes")).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def retained_bytes(store: Store) -> int:
    return segments(store).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first().b


def purge(store: Store, cutoff: int | None = None, budget: int | None = None, at: int = 0) -> list[int]:
    """Drops whole commits of logs and relations that are older than the cutoff, or oldest first until the rest fits; returns their numbers.

    Never the newest one, and a commit's logs and relations go together. The record comes first: files that a failure leaves are not read.
    """
    stats = segments(store).groupBy("batch").agg(F.max(F.when(F.col("name") == "logs", F.col("rows"))).alias("rows"), F.max("max_ts").alias("max_ts"), F.sum("bytes").alias("bytes")).collect()  # a row per commit
    stats = sorted(stats, key=lambda r: (r.max_ts, r.batch))
    newest, held, gone = max((r.batch for r in stats), default=-1), sum(r.bytes for r in stats), []
    for r in stats:
        if r.batch == newest:
            continue
        if (cutoff is not None and r.max_ts < cutoff) or (budget is not None and held > budget):
            gone.append(r)
            held -= r.bytes
    if not gone:
        return []
    before, numbers = store.last["gone"], [r.batch for r in gone]
    store.commit(store.last | {"n": store.last["n"] + 1, "span": (None, None, 0), "gone": numbers, "purged": store.last["purged"] + sum(r.rows or 0 for r in gone)})
    for batch in [*before, *numbers]:  # those of the last purge again, should it have been cut short
        for name in ("logs", "relations"):
            _drop(store, f"{name}/batch={batch}")
    write_checkpoint(store, at)
    return [r.batch for r in gone]


def _drop(store: Store, folder: str) -> None:
    path = store.spark._jvm.org.apache.hadoop.fs.Path(f"{store.path}/{folder}")
    path.getFileSystem(store.spark._jsc.hadoopConfiguration()).delete(path, True)


# -- keys -----------------------------------------------------------------------------------------------------------------


def rekey(store: Store, ring: KeyRing, rsa: RsaRing, at: int) -> dict:
    """A new generation of versions under the newest keys: data keys are wrapped anew, tokens of encrypted fields digested anew.

    Ciphertexts, fingerprints and keyed digests stay, as their plain values are not at hand. The signed record says which tree of versions
    it was; the old generation stays readable for snapshots before.
    """
    now, n, gen = store.snapshot(), store.last["n"] + 1, store.last["gen"] + 1
    opened = store.data_keys()
    wrapped = [(k, *rsa.wrap(key)) for k, key in opened.items()]
    rows = store.spark.createDataFrame([(k, v, base64.b64encode(w).decode()) for k, v, w in wrapped], KEY)
    lost = store.read(f"keys/gen={store.last['gen']}", KEY).where(F.col("n") <= store.last["n"]).join(rows.select("n"), "n", "left_anti").select("n", "key_version", "wrapped")
    rows.unionByName(lost).coalesce(1).write.mode("overwrite").parquet(f"{store.path}/keys/gen={gen}/batch={n}")
    versions, columns = now.versions, [c.split()[0] for c in VERSION.split(", ")]
    if opened and store.catalog.encrypts:
        keyed = with_pads(with_data_keys(versions, opened, "sealed"), {"__pads": ring.keys[ring.active]})
        tokens = F.col("tokens")
        for name, known in store.catalog.types.items():
            secret = [f for f in known if f.protection == "rsa" and f.search != "none"]
            if not secret:
                continue
            plain = {f.name: decrypted(F.col("fields")[f.name], F.col("__key")) for f in secret}
            fresh = F.concat(*[f.tokens(plain[f.name], F.col("__pads")) for f in secret])
            others = [f for f in known if f.search != "none" and f not in secret]
            # digests do not say which field they are of: a type's other indexed fields keep theirs beside the new ones
            kept = F.col("tokens") if others else F.array().cast("array<string>")
            tokens = F.when((F.col("entity_type") == name) & F.col("__key").isNotNull(), F.array_sort(F.array_distinct(F.concat(kept, fresh)))).otherwise(tokens)
        versions = keyed.withColumn("tokens", tokens)
    versions.select(*columns).write.mode("overwrite").partitionBy("batch").parquet(f"{store.path}/versions/gen={gen}")
    tree = now.tree("versions")
    made = signed({"created_at": at, "size": tree.size, "root": tree.root().hex(), "gen": gen}, rsa)
    _keep(store, "rekey", made)
    store.ring, store.rsa = ring, rsa
    store.commit(store.last | {"n": n, "gen": gen, "span": (None, None, 0)})
    return made


def _rekey_problems(store: Store) -> list[str]:
    """Bad signatures, or a tree of versions that is not a continuation of the one the last re-key saw."""
    records, tree = _signed_records(store, "rekey"), store.snapshot().tree("versions")
    out = [f"re-key {i}: bad signature" for i, r in enumerate(records) if not holds(r, store.rsa)]
    if records:
        last = records[-1]
        if last["gen"] != store.last["gen"]:
            out.append("the last re-key is of another generation")
        if tree.size < last["size"] or not verify_consistency(last["size"], tree.size, tree.consistency(last["size"]), bytes.fromhex(last["root"]), tree.root()):
            out.append("the versions of the last re-key are no prefix of those now")
    return out
