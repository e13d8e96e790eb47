"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, merged over shards.

Vectors are dealt to equal shards by a hash of their id: about SHARDS of them, of LEAST_ROWS to MOST_ROWS vectors. Equal directions inside a shard are one node with the
smallest ids of its members, so a vector that is very common costs one node and cannot clog the graph. A
graph is a few flat arrays: unit vectors, and per level a table of neighbour numbers. It grows in batches: each
batch searches the graph so far and its own members, then links both ways under the diversity rule.
Searches run for many queries at a time, one beam each. A task reads a shard's graph once, and all blocks of queries stream past it;
the shards' nearest are merged and ranked by exact cosine of the original vectors. So every query is searched in every shard: that work
is queries times shards, and only larger shards, whose searches take little longer, lessen it.

Vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no part; an empty
table gives no rows. Rows that share a vec_id count as one, the first in the order of their components. Ties in score go to the
smaller vec_id. Columns other than vec_id and embedding play no part. Vectors of any width work; a shard's memory grows with it.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.text import stored

#: Shards aimed at, and the fewest and most vectors of one.
SHARDS = 32
LEAST_ROWS = 4096
MOST_ROWS = 65_536
LINKS = 16
BUILD_BEAM = 64
BEAM = 128
#: Vectors that are searched at a time, and queries of a block.
BATCH = 256


class Graph:
    """Unit vectors of the nodes and, per level, the nodes on it and their neighbours (-1: none)."""

    def __init__(self, unit: np.ndarray, links: int = LINKS):
        self.unit = unit
        self.links = links
        self.neighbours: list[np.ndarray] = []
        self.entry = 0

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, unit=self.unit, entry=self.entry, **{f"level{i}": n for i, n in enumerate(self.neighbours)})
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Graph:
        with np.load(io.BytesIO(raw)) as z:
            g = Graph(z["unit"])
            g.entry = int(z["entry"])
            g.neighbours = [z[f"level{i}"] for i in range(len(z.files) - 2)]
        return g

    def search(self, queries: np.ndarray, beam: int, level: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and closeness of each query's beam on a level, closest first; -1 where it has fewer."""
        table, n, count = self.neighbours[level], len(self.unit), len(queries)
        width = table.shape[1]
        rows = np.arange(count)
        nodes = np.full((count, beam), -1, np.int64)
        near = np.full((count, beam), -np.inf, np.float32)
        fresh = np.zeros((count, beam), bool)
        seen = np.zeros((count, n), bool)
        nodes[:, 0] = starts
        near[:, 0] = np.einsum("ij,ij->i", queries, self.unit[starts])
        fresh[:, 0] = seen[rows, starts] = True
        live = rows
        while len(live):
            at = np.where(fresh[live], near[live], -np.inf).argmax(1)
            going = fresh[live, at]
            live, at = live[going], at[going]
            if not len(live):
                break
            fresh[live, at] = False
            around = table[nodes[live, at]]
            new = (around >= 0) & ~seen[live[:, None], around]
            seen[live[:, None], np.where(new, around, around[:, :1] * 0 + nodes[live, at][:, None])] = True
            sim = np.full((len(live), width), -np.inf, np.float32)
            q, k = np.nonzero(new)
            sim[q, k] = np.einsum("ij,ij->i", queries[live[q]], self.unit[around[q, k]])
            some = (sim > near[live, -1:]).any(1)
            if not some.any():
                continue
            sub = live[some]
            both = np.concatenate([near[sub], sim[some]], 1)
            order = np.argsort(-both, 1, kind="stable")[:, :beam]
            near[sub] = np.take_along_axis(both, order, 1)
            nodes[sub] = np.take_along_axis(np.concatenate([nodes[sub], around[some]], 1), order, 1)
            fresh[sub] = np.take_along_axis(np.concatenate([fresh[sub], np.ones((len(sub), width), bool)], 1), order, 1) & np.isfinite(near[sub])
        nodes[~np.isfinite(near)] = -1
        return nodes, near

    def descend(self, queries: np.ndarray, level: int) -> np.ndarray:
        """The closest node found above a level, where the search on it starts."""
        at = np.full(len(queries), self.entry)
        for above in range(len(self.neighbours) - 1, level, -1):
            at = self.search(queries, 4, above, at)[0][:, 0]
        return at

    def nearest(self, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Closest nodes of unit queries, a block at a time."""
        if not len(self.unit):
            return np.zeros((len(queries), 0), np.int64), np.zeros((len(queries), 0), np.float32)
        parts = [self.search(q, beam, 0, self.descend(q, 0)) for q in np.array_split(queries, max(1, -(-len(queries) // BATCH)))]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def diverse(unit: np.ndarray, nodes: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of candidates sorted closest first, those closer to the query than to any already chosen; then the closest others."""
    count, width = nodes.shape
    v = unit[np.maximum(nodes, 0)]
    among = np.matmul(v, v.transpose(0, 2, 1))
    chosen = np.zeros((count, width), bool)
    closest = np.full((count, width), -np.inf, np.float32)  # to any chosen one
    for j in range(width):
        take = (nodes[:, j] >= 0) & (closest[:, j] < near[:, j]) & (chosen.sum(1) < most)
        chosen[:, j] = take
        closest[take] = np.maximum(closest[take], among[take, j])
    rank = np.where(nodes < 0, 2 * width, np.where(chosen, 0, width)) + np.arange(width)
    order = np.argsort(rank, 1, kind="stable")[:, :most]
    return np.take_along_axis(nodes, order, 1)


def build(unit: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 3) -> Graph:
    """A graph over unit vectors without repeats."""
    g, n = Graph(unit, links), len(unit)
    if not n:
        return g
    level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(links)).astype(int), 6)
    for l in range(level.max() + 1):
        g.neighbours.append(np.full((n, 2 * links if l == 0 else links), -1, np.int32))
    order = np.argsort(-level, kind="stable")  # high nodes first, so that every level's entry stands
    g.entry = int(order[0])
    done = 1
    while done < n:
        batch = order[done : done + min(BATCH, max(1, done))]
        for l in range(level[batch].max(), -1, -1):
            own = batch[level[batch] >= l]
            q = unit[own]
            nodes, near = g.search(q, beam, l, g.descend(q, l))
            among = q @ q.T  # members of the batch do not see each other in the graph yet
            np.fill_diagonal(among, -np.inf)
            k = min(len(own), links)
            top = np.argsort(-among, 1, kind="stable")[:, :k]
            nodes = np.concatenate([nodes, np.where(np.isfinite(np.take_along_axis(among, top, 1)), own[top], -1)], 1)
            near = np.concatenate([near, np.take_along_axis(among, top, 1)], 1)
            by = np.argsort(-near, 1, kind="stable")
            nodes, near = np.take_along_axis(nodes, by, 1), np.take_along_axis(near, by, 1)
            table = g.neighbours[l]
            most = table.shape[1]
            picked = diverse(unit, nodes, near, links)
            table[own, : picked.shape[1]] = picked
            _link_back(g, table, own, picked, most)
        done += len(batch)
    return g


def _link_back(g: Graph, table: np.ndarray, own: np.ndarray, picked: np.ndarray, most: int) -> None:
    """Adds the reverse links; nodes with more than `most` keep a diverse choice."""
    source, target = np.repeat(own, picked.shape[1]), picked.ravel()
    ok = target >= 0
    source, target = source[ok], target[ok]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    touched, first, counts = np.unique(target, return_index=True, return_counts=True)
    wide = int(counts.max()) if len(counts) else 0
    if not wide:
        return
    added = np.full((len(touched), wide), -1, np.int64)
    added[np.repeat(np.arange(len(touched)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
    for lot in np.array_split(np.arange(len(touched)), max(1, -(-len(touched) // 512))):
        every = np.concatenate([table[touched[lot]].astype(np.int64), added[lot]], 1)
        every = np.sort(every, 1)[:, ::-1]
        every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
        near = np.einsum("ij,ikj->ik", g.unit[touched[lot]], g.unit[np.maximum(every, 0)])
        near[every < 0] = -np.inf
        by = np.argsort(-near, 1, kind="stable")
        every, near = np.take_along_axis(every, by, 1), np.take_along_axis(near, by, 1)
        full = (every >= 0).sum(1) > most
        kept = every[:, :most].copy()
        if full.any():
            # the closest 2 * most compete; the rest are farther than all of them
            kept[full] = diverse(g.unit, every[full][:, : 2 * most], near[full][:, : 2 * most], most)
        table[touched[lot], : kept.shape[1]] = kept


def usable(embeddings: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """__id and __v, one row per id, of the vectors that take part."""
    v = F.col(vector)
    good = v.isNotNull() & F.forall(v, lambda x: F.coalesce((x.cast("double") - x.cast("double")) == 0, F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = embeddings.where(F.col(id_column).isNotNull() & good).select(F.col(id_column).alias("__id"), F.transform(v, lambda x: x.cast("double")).alias("__v"))
    return rows.groupBy("__id").agg(F.min("__v").alias("__v"))


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_list()).astype(np.float64) if len(series) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _build_shard(most: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__id", ignore_index=True)
        x = _matrix(rows["__v"])
        unit = _unit(x).astype(np.float32)
        _, first, node = np.unique(unit.view([("", unit.dtype)] * unit.shape[1]).ravel(), return_index=True, return_inverse=True)
        # a query needs its `most` nearest besides itself; of equal vectors, which have one node, the smallest ids win
        _, alike = np.unique((x + 0.0).view([("", x.dtype)] * x.shape[1]).ravel(), return_inverse=True)  # -0 as 0
        order = np.argsort(alike, kind="stable")  # equal vectors by id
        starts = np.searchsorted(alike[order], np.arange(alike.max() + 1))
        rank = np.arange(len(order)) - starts[alike[order]]
        keep = np.sort(order[rank <= most])
        g = build(unit[first])
        out = io.BytesIO()
        original = x[keep].astype(np.float32)
        original = original if (original == x[keep]).all() else x[keep]  # half the bytes where they hold all digits
        np.savez(out, ids=rows["__id"].to_numpy()[keep], node=node[keep], original=original)
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "graph": [g.save()], "members": [out.getvalue()]})

    return run


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows of a with the rows of b that stand beside them, in double precision."""
    a, b = a / np.abs(a).max(-1, keepdims=True), b / np.abs(b).max(-1, keepdims=True)
    return (a * b).sum(-1) / (np.linalg.norm(a, axis=-1) * np.linalg.norm(b, axis=-1))


def search_shard(graph: Graph, ids: np.ndarray, node: np.ndarray, original: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> pd.DataFrame:
    """The k nearest members in one shard of each query, by exact cosine; the query's own row is left out."""
    found, _ = graph.nearest(_unit(queries).astype(np.float32), beam)
    order = np.argsort(node, kind="stable")
    starts = np.searchsorted(node[order], np.arange(len(graph.unit) + 1))
    out = []
    for i in range(len(queries)):
        nodes = found[i][found[i] >= 0]
        members = order[np.concatenate([np.arange(starts[n], starts[n + 1]) for n in nodes.tolist()])] if len(nodes) else np.zeros(0, np.int64)
        members = members[ids[members] != query_ids[i]]
        score = cosines(queries[i][None], original[members].astype(np.float64)) if len(members) else np.zeros(0)
        best = np.lexsort((ids[members], -score))[:k]
        out.append((np.full(len(best), query_ids[i]), ids[members][best], score[best]))
    q, v, s = (np.concatenate([o[j] for o in out]) if out else np.zeros(0) for j in range(3))
    return pd.DataFrame({"query_id": q.astype(np.int64), "vec_id": v.astype(np.int64), "score": s.astype(float)})


def nearest_neighbours(embeddings: DataFrame, every: int = 50, k: int = 5, beam: int = BEAM, shard_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found to every vector whose id is divisible by `every`."""
    vectors = stored(usable(embeddings), "vectors")
    width = F.size("__v")
    n = vectors.groupBy(width.alias("w")).count().orderBy(F.desc("count"), "w").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if n is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    vectors = vectors.where(width == n.w)
    rows = shard_rows or min(max(n["count"] // SHARDS, LEAST_ROWS), MOST_ROWS)
    shards = max(1, -(-n["count"] // rows))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("__id"), F.lit(shards)).cast("int"))
    graphs = stored(dealt.groupBy("shard").applyInPandas(_build_shard(k), "shard int, graph binary, members binary"), "graphs")
    asked = vectors.where(F.pmod("__id", F.lit(every)) == 0)
    blocks = max(1, -(-(n["count"] // every + 1) // BATCH))
    block = F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(blocks)).cast("int")
    asked = stored(asked.groupBy(block.alias("block")).agg(F.collect_list(F.struct("__id", "__v")).alias("q")), "queries")
    # every shard's graph goes to one task, and blocks of queries stream past it
    past = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = graphs.select("shard", F.lit(-1).alias("block"), "graph", "members").unionByName(past, allowMissingColumns=True)
    both = both.repartition(min(shards, 100_000), "shard").sortWithinPartitions("shard", "block").select("graph", "members", "q")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("graph")[i].is_valid:
                    graph = Graph.load(batch.column("graph")[i].as_py())
                    with np.load(io.BytesIO(batch.column("members")[i].as_py())) as z:
                        ids, node, original = z["ids"], z["node"], z["original"]
                    continue
                q = batch.column("q")[i].values
                asked_ids, asked_vectors = q.flatten()
                queries = asked_vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(q), -1)
                found = search_shard(graph, ids, node, original, asked_ids.to_numpy(), queries, k, beam)
                yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score")))
    merged = found.groupBy("query_id").agg(F.slice(order, 1, k).alias("top"))
    return merged.select("query_id", F.posexplode("top").alias("p", "t")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "t.vec_id", "t.score")
