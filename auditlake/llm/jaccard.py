"""N-gram Jaccard join by vertical partitioning: which documents share at least 75 % of their five-word shingles.

The global n-gram order (rarer first, then by hash) is cut into fragments by hash range, and every step counts inside
fragments and sums over them:

1. Tasks turn blocks of documents into shingle hashes and send each fragment its part: every distinct n-gram of the block once, with
   its number of documents. A fragment adds these up and answers each block which of its n-grams occur in two documents or more. A
   document whose shared n-grams, summed over fragments, are fewer than 75 % of its set links with nothing but copies.
2. Documents with equal sets form a class; only its smallest id goes on.
3. Prefix filter: documents that link share one of the rarest n-grams of each. Each document first meets the leader of the
   n-gram groups it is in most often, so groups of near copies become one component without their pairs.
4. The rest is exact: in every n-gram group, members of different components that could still link are paired, except inside the
   group's largest component. Two bounds decide who could: what is left of both sets behind the n-gram, as if it were the first
   they share, and the parities of PARITIES small fragments, where each that differs costs the overlap one n-gram of
   one of the sets. Pairs are verified by partial overlaps per fragment, summed per pair.

An n-gram travels once per block, or once per relay of many blocks where the table is large, whatever share of the documents holds
it. Links inside a component found in step 3 do not change components, so leaving them out loses no class. Sets are told apart by
128 bits, n-grams by a 64-bit hash: that two different ones share it is the one way a result could be off, by one in an overlap.

Null and empty texts, and texts without words, have an empty set and link with nothing. Rows that share an id are one node
with the links of all of them. A null id is counted but links with nothing and has no component.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.components import components
from auditlake.llm.text import WordTable, blocks, encoded, gather, release, spans, spread_join, stored

WORDS = 5
SHARE, OF = 3, 4  # 75 %
#: Text a task turns into shingles at a time, and text whose n-grams make about one fragment.
BLOCK = 2 << 20
FRAGMENT = 4 << 20
#: Fragments that one source sends to at most.
FAN = 1024
#: Fragments of the verification.
SEGMENTS = 4
#: Fragments whose parities bound an overlap; a multiple of 64.
PARITIES = 1024
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _word_hashes(words: list[bytes]) -> tuple[np.ndarray, ...]:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)),)


def shingles(texts: list[bytes], table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted inside it, and their number by text."""
    cut = [t.translate(_LOWER).split() for t in texts]
    offsets = spans(np.fromiter(map(len, cut), np.int64, len(cut)))
    ids = table.numbers([w for c in cut for w in c])
    word = table.columns[0][ids]
    lengths = np.diff(offsets)
    per = np.maximum(lengths - WORDS + 1, 0)
    starts = gather(offsets[:-1], per)
    h = np.full(len(starts), WORDS, np.uint64)
    for j in range(WORDS):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + word[starts + j])
    at = spans(per)
    out = []
    for i in range(len(texts)):
        if per[i]:
            out.append(np.unique(h[at[i] : at[i + 1]]))
        else:  # fewer words: the whole sequence is one n-gram
            v = np.full(min(1, lengths[i]), lengths[i], np.uint64)
            for w in word[offsets[i] : offsets[i + 1]]:
                v = _mix(v * _U(0x9E3779B97F4A7C15) + w)
            out.append(v)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.fromiter(map(len, out), np.int64, len(out))


def _packed(grams: np.ndarray) -> bytes:
    """Sorted hashes: the first high pair of bytes, how many hashes have each from it on, then the low six bytes of all."""
    if not len(grams):
        return b""
    high = (grams >> _U(48)).astype(np.int64)
    counts = np.bincount(high - high[0])
    low = np.ascontiguousarray(grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    return np.array([high[0], len(counts), *counts], "<u4").tobytes() + low.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    first, n = np.frombuffer(raw, "<u4", 2).tolist()
    counts = np.frombuffer(raw, "<u4", n, 8)
    wide = np.zeros((int(counts.sum()), 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8, offset=8 + 4 * n).reshape(-1, 6)
    return wide.view("<u8").ravel() | np.repeat(np.arange(first, first + n, dtype=np.uint64) << _U(48), counts)


def _narrow(values: np.ndarray, below: int) -> bytes:
    """Numbers below a bound in as many bits as it needs."""
    bits = np.arange(max(1, (below - 1).bit_length()))
    return np.packbits(((values[:, None] >> bits.astype(values.dtype)) & 1).astype(np.uint8)).tobytes()


def _widened(raw: bytes, below: int, count: int) -> np.ndarray:
    width, out = max(1, (below - 1).bit_length()), np.zeros(count, np.int64)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=count * width).reshape(count, width)
    for i in range(width):
        out |= bits[:, i].astype(np.int64) << i
    return out


_SENT = "fragment long, source string, grams binary, counts binary, ranks binary, body binary"
_NAMES = [c.split()[0] for c in _SENT.split(", ")]
_TYPES = [pa.int64(), pa.string(), *[pa.binary()] * 4]


def _lots(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Message rows, few at a time so that a batch stays small."""
    for at in range(0, len(rows), 64):
        columns = zip(*rows[at : at + 64], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def _place(source: str, slots: int) -> int:
    """Below zero: where a row waits that no fragment counts."""
    return -1 - xxhash.xxh32_intdigest(source) % slots


def _fragment(grams: np.ndarray, fragments: int) -> np.ndarray:
    """Equal ranges of the hash order, numbered."""
    return ((grams >> _U(32)) * _U(fragments) >> _U(32)).astype(np.int64)


def _messages(source: str, grams: np.ndarray, counts: np.ndarray, fragments: int) -> list[tuple]:
    """A row for each fragment that sorted distinct n-grams fall in; counts above 255 read 255, which only order uses."""
    cut = _fragment(grams, fragments)
    edge = np.flatnonzero(np.concatenate([[True], cut[1:] != cut[:-1], [True]])) if len(cut) else np.zeros(1, np.int64)
    small = np.minimum(counts, 255).astype(np.uint8)
    return [(int(cut[a]), source, _packed(grams[a:b]), small[a:b].tobytes(), None, None) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by n-gram, where each distinct one begins in it, and how often it occurs."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(grams) else np.zeros(0, np.int64)
    return order, first, np.diff(np.append(first, len(grams)))


def _speakers(ids: list, meta: np.ndarray) -> np.ndarray:
    """Rows with the smallest id of their set; one of several equal ones, and none with a null id."""
    first: dict[bytes, int] = {}
    for i, k in enumerate(ids):
        if k is not None and ((j := first.get(key := meta[i].tobytes())) is None or k < ids[j]):
            first[key] = i
    out = np.zeros(len(ids), bool)
    out[list(first.values())] = True
    return out


def _send(fragments: int, block_bytes: int):
    """Rows of a task: one per block and fragment, and one per block that waits for the answers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, serial = WordTable(lambda: _word_hashes), 0
        for part in blocks(batches, "__text", block_bytes):
            h, n = shingles(encoded(part, "__text"), table)
            ids = part.column("__id").cast(pa.int64())
            source = f"{TaskContext.get().partitionId()}/{serial}"  # a task that runs again sends the same blocks
            serial += 1
            edge = spans(n)
            sums_ = []
            for salt in (0, 0x5851F42D4C957F2D):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(h ^ _U(salt)), dtype=np.uint64)])
                sums_.append((total[edge[1:]] - total[edge[:-1]]).view(np.int64))
            meta = np.stack([n.astype(np.int64), *sums_], 1)
            # of equal sets in a block only the smallest id speaks: no other can be its class's first
            speaks = _speakers(ids.to_pylist(), meta)
            h, doc = h[np.repeat(speaks, n)], np.repeat(np.arange(len(n), dtype=np.uint32)[speaks], n[speaks])
            order, first, size = _distinct(h)
            rows = _messages(source, h[order][first], size, fragments)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", pa.int64())])) as w:
                w.write_batch(pa.RecordBatch.from_arrays([ids], ["id"]))
            rows.append((_place(source, fragments), source, _narrow(doc[order], len(n)), size.astype("<u4").tobytes(), meta.tobytes(), sink.getvalue().to_pybytes()))
            yield from _lots(rows)
        del table
        release()

    return run


def _relay(fragments: int, most: int):
    """Joins the messages of a coarse fragment, so that n-grams many blocks hold go on once, to finer fragments."""

    def flush(held: list[tuple], source: str) -> Iterator[pa.RecordBatch]:
        grams = np.concatenate([_unpacked(g) for _, _, g, _ in held])
        counts = np.concatenate([np.frombuffer(c, np.uint8) for _, _, _, c in held]).astype(np.int64)
        order, first, size = _distinct(grams)
        back = np.empty(len(grams), np.uint32)  # which distinct n-gram an entry is
        back[order] = np.repeat(np.arange(len(first), dtype=np.uint32), size)
        rows = _messages(source, grams[order][first], np.add.reduceat(counts[order], first), fragments)
        head = [(f, s, len(c)) for f, s, _, c in held]
        rows.append((_place(source, fragments), source, back.tobytes(), None, None, json.dumps(head).encode()))
        yield from _lots(rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, serial = [], 0, 0
        for batch in batches:
            for f, s, g, c, r, b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if f < 0:  # waits for answers to a block or an earlier relay
                    yield from _lots([(f, s, g, c, r, b)])
                    continue
                if held and (held[0][0] != f or size > most):
                    yield from flush(held, f"r{fragments}/{TaskContext.get().partitionId()}/{serial}")
                    held, size, serial = [], 0, serial + 1
                held.append((f, s, g, c))
                size += len(g)
        if held:
            yield from flush(held, f"r{fragments}/{TaskContext.get().partitionId()}/{serial}")

    return run


def _answer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Counts one fragment over all sources; each gets the order of its n-grams, 0 for those of one document, and the others."""
    if key[0] < 0:
        return rows
    parts = [_unpacked(g) for g in rows["grams"]]
    grams = np.concatenate(parts)
    counts = np.concatenate([np.frombuffer(c, np.uint8) for c in rows["counts"]]).astype(np.int64)
    order, first, size = _distinct(grams)
    total = np.add.reduceat(counts[order], first)
    ranks = np.empty(len(grams), np.uint8)
    ranks[order] = np.repeat(np.where(total > 1, np.log2(total).astype(np.uint8) + 1, 0).astype(np.uint8), size)
    del grams, order, counts
    mine = np.split(ranks, spans(np.fromiter(map(len, parts), np.int64, len(parts)))[1:-1])
    return rows.assign(grams=[_packed(g[r > 0]) for g, r in zip(parts, mine, strict=True)], counts=None, ranks=[r.tobytes() for r in mine])


def _replies(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Order numbers of all n-grams a source sent, in its order, and the n-grams of several documents."""
    rows = rows.sort_values("fragment")
    none = [np.zeros(0, np.uint8)]
    return np.concatenate([np.frombuffer(r, np.uint8) for r in rows["ranks"]] or none), np.concatenate([_unpacked(g) for g in rows["grams"]] or [np.zeros(0, np.uint64)])


def _unrelay(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """What a relay's sources would have been answered."""
    waiting = rows["fragment"] < 0
    if not key[0].startswith("r") or waiting.all() or not waiting.any():  # a block's, or its turn is yet to come
        return rows
    last = rows[waiting].iloc[0]
    ranks, grams = _replies(rows[~waiting])
    every = np.zeros(len(ranks), np.uint64)
    every[ranks > 0] = grams
    back, out, at = np.frombuffer(last["grams"], np.uint32), [], 0
    for f, s, n in json.loads(last["body"]):
        mine = back[at : at + n]
        at += n
        out.append((f, s, _packed(every[mine][ranks[mine] > 0]), None, ranks[mine].tobytes(), None))
    return pd.DataFrame(out, columns=_NAMES)


_BLOCK = "id long, n long, set1 long, set2 long, grams array<long>, parities array<long>"


def _parities(grams: np.ndarray) -> np.ndarray:
    """Whether each small fragment of the n-gram order holds an odd number of a set's n-grams, as bits."""
    odd = np.bincount((_mix(grams.astype(np.uint64)) % _U(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums a block's answers: documents with enough shared n-grams get them in the global order, others null."""
    waiting = rows["fragment"] < 0
    last = rows[waiting].iloc[0]
    ids = pa.ipc.open_stream(last["body"]).read_all().column("id").to_pylist()
    meta = np.frombuffer(last["ranks"], np.int64).reshape(-1, 3)
    n, size = meta[:, 0], np.frombuffer(last["counts"], "<u4").astype(np.int64)
    docs = _widened(last["grams"], len(n), int(size.sum()))
    ranks, grams = _replies(rows[~waiting])
    kept = size[ranks > 0]
    doc = docs[gather(spans(size)[:-1][ranks > 0], kept)]
    gram, rank = np.repeat(grams, kept), np.repeat(ranks[ranks > 0], kept)
    enough = (OF * np.bincount(doc, minlength=len(n)) >= SHARE * n) & (n > 0)
    chosen = enough[doc]
    doc, gram, rank = doc[chosen], gram[chosen], rank[chosen]
    order = np.lexsort((gram, rank, doc))
    edges = np.searchsorted(doc[order], np.arange(len(n) + 1))
    ordered = gram[order].view(np.int64)
    lists = [ordered[edges[i] : edges[i + 1]] if enough[i] and ids[i] is not None else None for i in range(len(n))]
    bits = [None if x is None else _parities(x) for x in lists]
    return pd.DataFrame({"id": pd.array(ids, "Int64"), "n": n, "set1": meta[:, 1], "set2": meta[:, 2], "grams": lists, "parities": bits})


def shared_grams(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int | None = None, fragment: int | None = None, fan: int | None = None) -> DataFrame:
    """id, n, a 128-bit sum of the set, and, where enough n-grams are shared, these in the global order.

    A source never sends to more than `fan` times the fragments it got its own n-grams from: up to `fan` fragments blocks send
    straight to them, beyond that to `fan` coarse ones, whose relays send on. So rows stay large and grow with the input alone.
    """
    fan = fan or FAN
    rows = docs.select(docs[key].cast("long").alias("__id"), docs[text].alias("__text"))
    size = rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    fragments = min(max(1, -(-size // (fragment or FRAGMENT))), 1 << 31)
    steps, width = [min(fragments, fan)], fan
    while width < fragments:
        width *= fan
        steps.append(min(width, fragments))
    sent = rows.mapInArrow(_send(steps[0], block or BLOCK), _SENT)
    for finer in steps[1:]:  # sorted, so that a relay that runs again holds the same messages
        sent = sent.repartition("fragment").sortWithinPartitions("fragment", "source").mapInArrow(_relay(finer, 4 * (block or BLOCK)), _SENT)
    answered = sent.groupBy("fragment").applyInPandas(_answer, _SENT)
    for _ in steps[1:]:
        answered = answered.groupBy("source").applyInPandas(_unrelay, _SENT)
    return answered.groupBy("source").applyInPandas(_gather, _BLOCK)


def _can_link(a: str, b: str):
    """Whether two sets could share enough: overlap is at most the shared n-grams of either."""
    least = F.least(F.col(f"{a}.o"), F.col(f"{b}.o"))
    return (SHARE + OF) * least >= SHARE * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _could_link(a: str, b: str):
    """The same from what both have left behind a shared n-gram, were it the first, and from parities that differ."""
    need = SHARE * (F.col(f"{a}.n") + F.col(f"{b}.n"))
    left = F.least(F.col(f"{a}.o") - F.col(f"{a}.at"), F.col(f"{b}.o") - F.col(f"{b}.at"))
    apart = F.lit(0)
    for i in range(PARITIES // 64):
        apart = apart + F.bit_count(F.col(f"{a}.parities")[i].bitwiseXOR(F.col(f"{b}.parities")[i]))
    return ((SHARE + OF) * left >= need) & ((SHARE + OF) * (F.col(f"{a}.o") + F.col(f"{b}.o") - apart) >= 2 * need)


def verified(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """Of pairs (a, b, n as the sum of both set sizes), those that link: partial overlaps by fragment, summed."""
    part = F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), lambda s: F.struct(s.alias("s"), F.filter("grams", lambda g: F.pmod(g, F.lit(SEGMENTS)) == s).alias("g")))
    segments = grams.select("id", F.explode(part).alias("p")).select("id", "p.s", "p.g")
    left = segments.select(F.col("id").alias("a"), "s", F.col("g").alias("ga"))
    right = segments.select(F.col("id").alias("b"), "s", F.col("g").alias("gb"))
    counted = pairs.join(left, "a").join(right, ["b", "s"]).select("a", "b", "n", F.size(F.array_intersect("ga", "gb")).alias("i"))
    return counted.groupBy("a", "b").agg(F.first("n").alias("n"), F.sum("i").alias("i")).where(f"{SHARE + OF} * i >= {SHARE} * n").select("a", "b")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_shingles and component_id (the smallest id reachable by links) of every row."""
    kind = docs.schema[key].dataType
    rows = stored(shared_grams(docs, key, text), "grams")
    # classes of equal sets; only those of several rows are joined back
    sets = ["n", "set1", "set2"]
    linked = rows.where("n > 0 and id is not null")
    classes = stored(linked.groupBy(*sets).agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1"), "classes")
    named = spread_join(rows.select("id", *sets), classes, sets, "c").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    named = stored(named, "named")
    # the class's smallest id carries its n-grams on, once
    first = F.min_by(F.struct("id", "grams", "parities"), "id").alias("f")
    firsts = linked.where("grams is not null").groupBy(*sets).agg(first).select("f.*", *sets)
    # rows of one id with different sets hold several n-gram lists: each is a node of its own below the id
    firsts = stored(firsts.select(F.xxhash64("id", *sets).alias("node"), "id", "n", "grams", "parities"), "firsts")
    least = F.ceil(F.col("n") * SHARE / OF).cast("long")
    prefix = (F.size("grams") - least + 1).cast("int")
    grams = firsts.select(F.col("node").alias("id"), "grams")
    posted = firsts.select("node", "n", F.size("grams").alias("o"), F.posexplode(F.slice("grams", F.lit(1), prefix)).alias("at", "gram"))
    # a group's leader is the member that shares most of its set: the text that others are edits of
    leaders = posted.groupBy("gram").agg(F.max_by(F.struct("node", "n", "o"), F.struct(F.col("o") / F.col("n"), "node")).alias("l"), F.count("*").alias("c")).where("c > 1").drop("c")
    posted = stored(posted.join(leaders, "gram").select("gram", "node", "n", "o", "at", "l"), "posted")
    # each node meets the leader it shares most rare n-grams with
    met = posted.select(F.struct("node", "n", "o").alias("m"), "l").where("m.node <> l.node").where(_can_link("m", "l"))
    met = met.groupBy("m", "l").count().groupBy("m").agg(F.max(F.struct("count", "l")).alias("best"))
    met = stored(met.select(F.least("m.node", "best.l.node").alias("a"), F.greatest("m.node", "best.l.node").alias("b"), (F.col("m.n") + F.col("best.l.n")).alias("n")).distinct(), "met")
    links = stored(verified(met, grams), "links")
    joined = components(links)
    # what is left: members of different components in one group, but none inside the group's largest
    placed = posted.join(joined, posted.node == joined.node, "left").select("gram", posted.node, "n", "o", "at", F.coalesce("component", posted.node).alias("component"))
    counts = placed.groupBy("gram", "component").agg(F.count("*").alias("c"))
    main = counts.groupBy("gram").agg(F.max(F.struct("c", "component"))["component"].alias("main"), F.count("*").alias("k")).where("k > 1").drop("k")
    placed = stored(placed.join(main, "gram").join(firsts.select("node", "parities"), "node"), "placed")
    few = placed.where("component <> main").alias("x")
    all_ = placed.alias("y")
    pair = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))) & _could_link("x", "y")
    rest = few.join(all_, pair).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), (F.col("x.n") + F.col("y.n")).alias("n")).distinct()
    rest = stored(rest.join(met.select("a", "b"), ["a", "b"], "left_anti"), "rest")
    links = links.unionByName(stored(verified(rest, grams), "late"))
    # from nodes to ids: an id's classes belong together
    to_id = firsts.select("node", "id")
    edges = links.join(to_id.withColumnsRenamed({"node": "a", "id": "ia"}), "a").join(to_id.withColumnsRenamed({"node": "b", "id": "ib"}), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"))
    twice = named.where("n > 0 and id is not null").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.collect_set("rep").alias("r")).where("a <> b")
    edges = edges.unionByName(twice.select("a", F.explode("r").alias("b"))).unionByName(twice.select(F.col("id").alias("a"), F.col("a").alias("b")))
    whole = components(edges)
    sized = named.groupBy("rep").agg(F.count("*").alias("c")).join(whole, F.col("rep") == F.col("node")).select("rep", "component", "c")
    out = spread_join(named, stored(sized, "sized"), ["rep"], "c")
    return out.select(F.col("id").cast(kind).alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "rep")).cast(kind).alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 7 * count(*) >= 3 * (nx.n + ny.n)),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id WHERE r.c < l.b)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.c) AS component_id FROM n JOIN r USING (doc_id) GROUP BY 1, 2
"""
