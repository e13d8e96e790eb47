"""RFC 6962 Merkle trees over ordered rows.

Blocks of 2 ** HEIGHT nodes are folded to the node above them in the JVM, and blocks of those again, so each task holds one block
whatever the size of the log. A table of such nodes answers proofs: a node of any height folds from at most 2 ** HEIGHT stored ones,
so a proof reads that many rows per HEIGHT levels, found by range.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.scalars import node_hash

HEIGHT = 10
EMPTY = hashlib.sha256(b"").digest()


def fold(hashes: list[bytes]) -> bytes:
    """Root of a list of hashes: levels are paired, an odd last one moves up as it is."""
    while len(hashes) > 1:
        hashes = [node_hash(hashes[i], hashes[i + 1]) if i + 1 < len(hashes) else hashes[i] for i in range(0, len(hashes), 2)]
    return hashes[0] if hashes else EMPTY


def folded(hashes: Column, height: int = HEIGHT) -> Column:
    """The same for an array of at most 2 ** height hashes."""

    def up(level: Column) -> Column:
        half = F.ceil(F.size(level) / 2).cast("int")
        pair = lambda i: F.unhex(F.sha2(F.concat(F.lit(b"\x01"), level[2 * i], level[2 * i + 1]), 256))
        return F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.when(2 * i + 1 < F.size(level), pair(i)).otherwise(level[2 * i]))

    return F.aggregate(F.sequence(F.lit(1), F.lit(height)), hashes, lambda level, _: up(level))[0]


def block_roots(nodes: DataFrame, height: int = HEIGHT, by: tuple[str, ...] = ()) -> DataFrame:
    """`by`, idx and hash of the nodes `height` levels above those given (idx, hash); a last block that is not full folds too."""
    block = nodes.groupBy(*by, F.shiftright("idx", height).alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash")))["hash"].alias("h"))
    return block.select(*by, F.col("up").alias("idx"), folded(F.col("h"), height).alias("hash"))


def merkle_root(leaves: DataFrame, size: int, height: int = HEIGHT) -> DataFrame:
    """One row with the root of leaves (idx from 0, hash); size is their number."""
    if not size:
        return leaves.sparkSession.createDataFrame([(0, bytearray(EMPTY))], "idx long, hash binary")
    nodes = leaves
    while True:
        nodes, size = block_roots(nodes, height), -(-size // (1 << height))
        if size == 1:
            return nodes


def shard_roots(leaves: DataFrame, largest: int, height: int = HEIGHT) -> DataFrame:
    """shard, size and root (hex) of every shard, from leaves (shard, idx from 0 in the shard, hash); largest bounds the shards' numbers of leaves."""
    nodes = leaves.groupBy("shard", F.shiftright("idx", height).alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash")))["hash"].alias("h"))
    nodes = nodes.select("shard", F.col("up").alias("idx"), folded(F.col("h"), height).alias("hash"), F.size("h").cast("long").alias("size"))
    while (largest := -(-largest // (1 << height))) > 1:
        sized = nodes.groupBy("shard", F.shiftright("idx", height).alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash")))["hash"].alias("h"), F.sum("size").alias("size"))
        nodes = sized.select("shard", F.col("up").alias("idx"), folded(F.col("h"), height).alias("hash"), "size")
    return nodes.select("shard", "size", F.lower(F.hex("hash")).alias("root"))


def new_nodes(leaves: DataFrame, nodes: DataFrame, old: int, size: int, height: int = HEIGHT) -> DataFrame | None:
    """height, idx and hash of the blocks that became full as the tree grew from `old` to `size` leaves; None if none did.

    Reads the leaves of those blocks alone, and of `nodes` (height, idx, hash) the lower ones that the new blocks join.
    """
    out, below, level = None, leaves.select("idx", "hash"), height
    while size >> level > old >> level:
        first, last = (old >> level) << height, (size >> level) << height
        made = block_roots(below.where((F.col("idx") >= first) & (F.col("idx") < last)), height)
        out = made.select(F.lit(level).alias("height"), "idx", "hash") if out is None else out.unionByName(made.select(F.lit(level).alias("height"), "idx", "hash"))
        below = nodes.where(F.col("height") == level).select("idx", "hash").where(F.col("idx") < old >> level).unionByName(made)
        level += height
    return out


class Tree:
    """Roots and proofs of the first `size` leaves, from the leaves and a table of full blocks."""

    def __init__(self, leaves: DataFrame, nodes: DataFrame, size: int, height: int = HEIGHT):
        self.leaves, self.nodes, self.size, self.height = leaves, nodes, size, height

    def _ranges(self, height: int, idx: int) -> list[tuple[int, int, int]]:
        """Level and range (first, end) of the stored nodes below a node, left to right; a node at the right edge may not be full."""
        first, end = idx << height, min((idx + 1) << height, self.size)
        out, level = [], height // self.height * self.height
        while first < end:
            stop = end >> level << level
            if stop > first:
                out.append((level, first >> level, stop >> level))
                first = stop
            level -= self.height
        return out

    def rows(self, wanted: list[tuple[int, int]]) -> DataFrame:
        """Level, idx and hash of the stored nodes that some nodes (height, idx) fold from."""
        by: dict[int, list[tuple[int, int]]] = {}
        for w in wanted:
            for level, first, end in self._ranges(*w):
                by.setdefault(level, []).append((first, end))
        out = self.nodes.select(F.lit(0).alias("height"), "idx", "hash").where("false")
        for level, ranges in by.items():
            table = self.leaves if level == 0 else self.nodes.where(F.col("height") == level)
            inside = F.lit(False)
            for first, end in ranges:
                inside = inside | ((F.col("idx") >= first) & (F.col("idx") < end))
            out = out.unionByName(table.where(inside).select(F.lit(level).alias("height"), "idx", "hash"))
        return out

    def hashes(self, wanted: list[tuple[int, int]]) -> list[bytes]:
        """Hashes of nodes (height, idx); what is collected is at most 2 ** HEIGHT short rows per node and HEIGHT levels."""
        found = {(r.height, r.idx): bytes(r.hash) for r in self.rows(wanted).collect()} if wanted else {}
        return [_joined([(level, [found[level, i] for i in range(first, end)]) for level, first, end in self._ranges(*w)]) for w in wanted]

    def root(self) -> bytes:
        return self.hashes([((self.size - 1).bit_length(), 0)])[0] if self.size else EMPTY

    def inclusion(self, index: int) -> list[bytes]:
        return self.hashes(inclusion_path(index, self.size))

    def consistency(self, old: int) -> list[bytes]:
        return self.hashes(consistency_path(old, self.size))


def peaks(parts: list[tuple[int, list[bytes]]]) -> list[tuple[int, bytes]]:
    """Heights and hashes of the largest full subtrees, left to right, of nodes given by level, left to right."""
    out: list[tuple[int, bytes]] = []
    for level, hashes in parts:
        for h in hashes:
            out.append((level, h))
            while len(out) > 1 and out[-1][0] == out[-2][0]:
                (height, left), (_, right) = out[-2:]
                out[-2:] = [(height + 1, node_hash(left, right))]
    return out


def _joined(parts: list[tuple[int, list[bytes]]]) -> bytes:
    """Peaks joined from the right."""
    at, *rest = [h for _, h in reversed(peaks(parts))]
    for left in rest:
        at = node_hash(left, at)
    return at


def inclusion_path(index: int, size: int) -> list[tuple[int, int]]:
    """Nodes of the proof that leaf `index` is in a tree of `size` leaves, lowest first."""
    if not 0 <= index < size:
        raise IndexError(index)
    out, height, last = [], 0, size - 1
    while last:
        sibling = index ^ 1
        if sibling <= last:
            out.append((height, sibling))
        index, last, height = index >> 1, last >> 1, height + 1
    return out


def consistency_path(old: int, size: int) -> list[tuple[int, int]]:
    """Nodes of the proof that a tree of `old` leaves is a prefix of one of `size`."""
    if not 0 <= old <= size:
        raise IndexError(old)

    def node(first: int, end: int) -> tuple[int, int]:
        h = (end - first - 1).bit_length()
        return h, first >> h

    def walk(m: int, first: int, end: int, whole: bool) -> list[tuple[int, int]]:
        n = end - first
        if m == n:
            return [] if whole else [node(first, end)]
        k = 1 << ((n - 1).bit_length() - 1)
        if m <= k:
            return [*walk(m, first, first + k, whole), node(first + k, end)]
        return [*walk(m - k, first + k, end, False), node(first, first + k)]

    return walk(old, 0, size, True) if 0 < old < size else []


def verify_inclusion(leaf: bytes, index: int, size: int, proof: list[bytes], root: bytes) -> bool:
    """Whether the proof leads from the leaf to the root."""
    if not 0 <= index < size:
        return False
    last, at, rest = size - 1, leaf, list(proof)
    while last:
        if index & 1 or index < last:
            if not rest:
                return False
            other = rest.pop(0)
            at = node_hash(other, at) if index & 1 else node_hash(at, other)
        index, last = index >> 1, last >> 1
    return not rest and at == root


def verify_consistency(old: int, size: int, proof: list[bytes], old_root: bytes, root: bytes) -> bool:
    """Whether the proof shows the old tree as a prefix of the new one."""
    if not 0 <= old <= size:
        return False
    if old == size:
        return not proof and old_root == root
    if not old:
        return not proof and old_root == EMPTY
    rest = list(proof)
    index, last = old - 1, size - 1
    while index & 1:
        index, last = index >> 1, last >> 1
    if index and not rest:
        return False
    a = b = rest.pop(0) if index else old_root
    while last:
        if index & 1 or index < last:
            if not rest:
                return False
            other = rest.pop(0)
            if index & 1:
                a, b = node_hash(other, a), node_hash(other, b)
            else:
                b = node_hash(b, other)
        index, last = index >> 1, last >> 1
    return not rest and a == old_root and b == root


def broken_leaves(records: DataFrame, spine: DataFrame) -> DataFrame:
    """Positions whose recomputed leaf is not the one on the spine; records without one count, purged ones do not."""
    s = spine.select(F.col("idx").alias("__i"), F.col("hash").alias("__h"))
    both = records.join(s, records.idx == s["__i"], "left")
    return both.where(~F.col("hash").eqNullSafe(F.col("__h"))).select("idx")


def verify_global(now: DataFrame, then: DataFrame) -> DataFrame:
    """shard and problem, comparing (shard, size, root) with a checkpoint of the same columns."""
    n, t = now.alias("n"), then.alias("t")
    both = t.join(n, F.col("t.shard") == F.col("n.shard"), "left")
    problem = (
        F.when(F.col("n.shard").isNull(), "missing")
        .when(F.col("n.size") < F.col("t.size"), "rollback")
        .when((F.col("n.size") == F.col("t.size")) & (F.col("n.root") != F.col("t.root")), "rewrite")
    )
    return both.select(F.col("t.shard").alias("shard"), problem.alias("problem")).where("problem is not null")
