"""Sharded hierarchical navigable small-world graphs.

Entries are hashed into shards of bounded size; an Arrow function builds one
seeded graph per shard, which is stored as a binary value. A search runs on every
shard in parallel, and the best k of all are merged.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.errors import DimensionMismatch
from lodestone.operators.knn import MOST_QUERIES, keep_best, knn

TOP_LEVEL = 16
#: Entries of a graph; a table has as many graphs as it takes.
SHARD_ROWS = 4096
#: A search that comes back short is repeated so much wider.
WIDEN = 4
#: Nodes that are linked at a time; pairs of neighbours in memory.
BLOCK, PAIRS = 256, 1 << 22
#: Queries that walk together, and nodes that each of them leaves in one step.
WALK, EXPAND = 64, 8


@dataclass(frozen=True)
class HnswParams:
    m: int = 16
    ef_construction: int = 128
    ef_search: int = 64
    seed: int = 0x5EED_1234_ABCD_9876

    def degree(self, level: int) -> int:
        return 2 * self.m if level == 0 else self.m


class Graph:
    """One shard's graph over unit vectors, linked in the order of ids.

    A node's candidates on a layer are the ef_construction nearest of the nodes before
    it there. A shard is small, so they come from products of its vectors, a block of
    nodes at a time, and not from a walk for each node."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, params: HnswParams = HnswParams()):
        size = np.linalg.norm(vectors, axis=1, keepdims=True) if len(vectors) else np.ones((0, 1))
        self.ids = ids
        self.x = (vectors / np.where(size > 0, size, 1)).astype(np.float32)
        self.params = params
        draws = np.random.Generator(np.random.PCG64(params.seed)).random(len(ids))
        levels = np.array([min(TOP_LEVEL, int(-math.log(max(draw, 1e-12)) / math.log(params.m))) for draw in draws], dtype=int)
        self.links: list[list[list[int]]] = [[[] for _ in range(n + 1)] for n in levels]
        self.entry = int(np.argmax(levels)) if len(levels) else -1
        for layer in range(int(levels.max(initial=-1)) + 1):
            self._link(np.flatnonzero(levels >= layer), layer)

    def _dist(self, nodes: list[int], q: np.ndarray) -> np.ndarray:
        return 1.0 - self.x[nodes] @ q

    def _link(self, nodes: np.ndarray, layer: int) -> None:
        x, n = self.x[nodes], len(nodes)
        edges = [np.zeros((0, 2), int)]
        for a in range(0, n, BLOCK):
            b = min(n, a + BLOCK)
            d = 1.0 - x[a:b] @ x[:b].T
            d[np.arange(b) >= np.arange(a, b)[:, None]] = np.inf
            width = min(b, self.params.ef_construction)
            near = np.sort(np.argpartition(d, width - 1, axis=1)[:, :width], axis=1)
            chosen = _diverse(x, near, np.take_along_axis(d, near, 1), self.params.m)
            at, place = np.nonzero(chosen >= 0)
            edges.append(np.stack([at + a, chosen[at, place]], axis=1))
        one_way = np.concatenate(edges)
        both = np.concatenate([one_way, one_way[:, ::-1]])
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        start = np.searchsorted(both[:, 0], np.arange(n + 1))
        count, most = np.diff(start), self.params.degree(layer)
        for i in np.flatnonzero(count <= most):
            self.links[nodes[i]][layer] = nodes[both[start[i] : start[i + 1], 1]].tolist()
        many = np.flatnonzero(count > most)
        many = many[np.argsort(count[many], kind="stable")[::-1]]
        while len(many):
            width = int(count[many[0]])
            some, many = np.split(many, [max(1, PAIRS // width**2)])
            place = np.arange(width)
            real = place < count[some][:, None]
            near = np.where(real, both[np.minimum(start[some][:, None] + place, len(both) - 1), 1], 0)
            d = np.where(real, 1.0 - np.einsum("bwd,bd->bw", x[near], x[some]), np.inf)
            for i, kept in zip(some, _diverse(x, near, d, most)):
                self.links[nodes[i]][layer] = nodes[kept].tolist()

    def _descend(self, q: np.ndarray, at: int, layer: int) -> int:
        best = float(self._dist([at], q)[0])
        while nodes := self.links[at][layer]:
            d = self._dist(nodes, q)
            i = int(np.argmin(d))
            if d[i] >= best:
                break
            at, best = nodes[i], float(d[i])
        return at

    def _layer(self, q, near, ef: int, layer: int, allow: np.ndarray | None = None, budget: int | None = None) -> list[tuple[float, int]]:
        """Best-first search; with ``allow``, other nodes are passed through but
        not admitted to the result."""
        seen = {n for _, n in near}
        open_ = list(near)
        heapq.heapify(open_)
        found = [(-d, -n) for d, n in near if allow is None or allow[n]]
        heapq.heapify(found)
        steps = 0
        while open_:
            d, node = heapq.heappop(open_)
            if len(found) >= ef and d > -found[0][0]:
                break
            steps += 1
            if budget is not None and steps > budget:
                break
            fresh = [n for n in self.links[node][layer] if n not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for e, n in zip(self._dist(fresh, q).tolist(), fresh):
                if len(found) < ef or e < -found[0][0]:
                    heapq.heappush(open_, (e, n))
                    if allow is None or allow[n]:
                        heapq.heappush(found, (-e, -n))
                        if len(found) > ef:
                            heapq.heappop(found)
        return sorted((-d, -n) for d, n in found)

    def search(self, query: np.ndarray, k: int, ef: int | None = None, allow: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """ids and distances of about the k nearest."""
        if self.entry < 0 or k <= 0:
            return np.zeros(0, np.int64), np.zeros(0)
        q = np.zeros(self.x.shape[1], dtype=np.float32)
        n = min(len(query), len(q))
        q[:n] = query[:n]
        size = float(np.linalg.norm(q))
        q = q / size if size > 0 else q
        ef = max(ef or self.params.ef_search, k)
        at = self.entry
        for layer in range(len(self.links[at]) - 1, 0, -1):
            at = self._descend(q, at, layer)
        budget = max(ef * self.params.m * 8, 1024) if allow is not None else None
        near = self._layer(q, [(float(self._dist([at], q)[0]), at)], ef, 0, allow, budget)
        nodes = np.array([x for _, x in near], dtype=int)
        dist = np.array([d for d, _ in near])
        best = keep_best(self.ids[nodes], dist, k)
        return self.ids[nodes[best]], dist[best]

    def search_many(self, queries: np.ndarray, k: int, ef: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the queries, ids and distances of about the k nearest of each. The
        queries of a block take their steps together, each from its EXPAND nearest
        nodes that it has not left yet."""
        if self.entry < 0 or k <= 0 or not len(queries):
            return np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
        dim, width = self.x.shape[1], max(ef or self.params.ef_search, k)
        layers = [self._padded(layer) for layer in range(len(self.links[self.entry]))]
        places, ids, dists = [], [], []
        for a in range(0, len(queries), WALK):
            q = np.zeros((len(queries[a : a + WALK]), dim), dtype=np.float32)
            q[:, : queries.shape[1]] = queries[a : a + WALK, :dim]
            size = np.linalg.norm(q, axis=1, keepdims=True)
            near, dist = self._walk(q / np.where(size > 0, size, 1), width, layers)
            for i in range(len(q)):
                node = near[i][near[i] < len(self.ids)]
                best = keep_best(self.ids[node], dist[i][: len(node)], k)
                places.append(np.full(len(best), a + i))
                ids.append(self.ids[node[best]])
                dists.append(dist[i][best])
        return np.concatenate(places), np.concatenate(ids), np.concatenate(dists)

    def _padded(self, layer: int) -> np.ndarray:
        """A row of neighbours for each node, filled up with a node that is none."""
        out = np.full((len(self.ids) + 1, self.params.degree(layer)), len(self.ids))
        for node, layers in enumerate(self.links):
            if layer < len(layers):
                out[node, : len(layers[layer])] = layers[layer]
        return out

    def _walk(self, q: np.ndarray, width: int, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and distances of the ``width`` nearest that a walk meets, nearest first,
        filled up with a node that is none."""
        none, row = len(self.ids), np.arange(len(q))[:, None]
        d = np.full((len(q), none + 1), np.inf, dtype=np.float32)
        d[:, :none] = 1.0 - q @ self.x.T
        at = np.full(len(q), self.entry)
        for near in layers[:0:-1]:
            while True:
                next_ = np.take_along_axis(near[at], np.argmin(d[row, near[at]], axis=1)[:, None], 1)[:, 0]
                nearer = d[row[:, 0], next_] < d[row[:, 0], at]
                if not nearer.any():
                    break
                at = np.where(nearer, next_, at)
        seen = np.zeros(d.shape, dtype=bool)
        seen[:, none] = seen[row[:, 0], at] = True
        pool = np.full((len(q), width), none)
        pool[:, 0] = at
        left = np.ones(pool.shape, dtype=bool)
        left[:, 0] = False  # True: nothing more to do from there
        step = min(EXPAND, width)
        while not left.all():
            first = np.argsort(left, axis=1, kind="stable")[:, :step]  # the pool is in order of distance
            go = np.where(np.take_along_axis(left, first, 1), none, np.take_along_axis(pool, first, 1))
            np.put_along_axis(left, first, True, 1)
            fresh = np.sort(layers[0][go].reshape(len(q), -1), axis=1)
            known = seen[row, fresh]
            known[:, 1:] |= fresh[:, 1:] == fresh[:, :-1]
            fresh = np.where(known, none, fresh)
            seen[row, fresh] = True
            nodes = np.concatenate([pool, fresh], axis=1)
            best = np.argsort(d[row, nodes], axis=1, kind="stable")[:, :width]
            pool = np.take_along_axis(nodes, best, 1)
            left = np.take_along_axis(np.concatenate([left, fresh == none], axis=1), best, 1)
        return pool, d[row, pool]

    def dump(self) -> bytes:
        flat, offsets = [], [0]
        for node in self.links:
            for layer in node:
                flat += layer
                offsets.append(len(flat))
        out = io.BytesIO()
        np.savez(out, ids=self.ids, x=self.x, flat=np.array(flat, np.int32), offsets=np.array(offsets, np.int64), levels=np.array([len(n) for n in self.links], np.int32), entry=self.entry)
        return out.getvalue()

    @staticmethod
    def load(data: bytes, params: HnswParams = HnswParams()) -> Graph:
        z = np.load(io.BytesIO(data))
        g = Graph.__new__(Graph)
        g.ids, g.x, g.params, g.entry = z["ids"], z["x"], params, int(z["entry"])
        layers = [z["flat"][a:b].tolist() for a, b in zip(z["offsets"][:-1], z["offsets"][1:])]
        g.links, at = [], 0
        for n in z["levels"].tolist():
            g.links.append(layers[at : at + n])
            at += n
        return g


def _diverse(x: np.ndarray, near: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """For each row of candidates (places in x; those at an infinite distance are none)
    the ``most`` to link, -1 where there are fewer: neighbours nearer to the node than to
    each other come first; the nearest of the rest fill up."""
    order = np.argsort(dist, axis=1, kind="stable")
    near, dist = np.take_along_axis(near, order, 1), np.take_along_axis(dist, order, 1)
    v = x[near]
    apart = 1.0 - v @ v.transpose(0, 2, 1)
    real = np.isfinite(dist)
    chosen, closest = np.zeros(near.shape, dtype=bool), np.full(near.shape, np.inf, dtype=np.float32)
    count = np.zeros(len(near), dtype=int)
    for i in range(near.shape[1]):
        take = np.flatnonzero(real[:, i] & (count < most) & (closest[:, i] >= dist[:, i]))
        chosen[take, i] = True
        count[take] += 1
        closest[take] = np.minimum(closest[take], apart[take, i])
    first = np.argsort(np.where(chosen, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :most]
    return np.where(np.take_along_axis(real, first, 1), np.take_along_axis(near, first, 1), -1)


def build_graphs(entries: DataFrame, shards: int, params: HnswParams = HnswParams()) -> DataFrame:
    """shard, graph, nodes, dim of entries(entry_id, embedding)."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("entry_id")
        vectors = group.column("embedding").combine_chunks()
        if len(pc.unique(pc.list_value_length(vectors))) > 1:
            raise DimensionMismatch()
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        graph = Graph(group.column("entry_id").to_numpy(), flat.reshape(len(vectors), -1), params)
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "graph": pa.array([graph.dump()], pa.binary()), "nodes": pa.array([len(vectors)], pa.int64()), "dim": pa.array([graph.x.shape[1]], pa.int32())})

    rows = entries.select(_shard(shards), F.col("entry_id").cast("long").alias("entry_id"), "embedding")
    return rows.groupBy("shard").applyInArrow(run, "shard int, graph binary, nodes long, dim int")


def _shard(shards: int):
    return F.pmod(F.xxhash64("entry_id"), F.lit(shards)).cast("int").alias("shard")


def search_graphs(graphs: DataFrame, queries: DataFrame, k: int, ef: int | None = None, allowed: DataFrame | None = None, shards: int = 1, params: HnswParams = HnswParams()) -> DataFrame:
    """query_id, entry_id, dist, rank for queries(query_id, embedding); with
    ``allowed`` (entry_id) only those are admitted."""
    rows = queries.select("query_id", "embedding").limit(MOST_QUERIES + 1).collect()
    if len(rows) > MOST_QUERIES:
        parts = -(-queries.count() // (MOST_QUERIES // 2))
        near = None
        for i in range(parts):
            part = search_graphs(graphs, queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i), k, ef, allowed, shards, params)
            near = part if near is None else near.unionByName(part)
        return near
    kind = queries.schema["query_id"].dataType.simpleString()
    if not rows:
        return graphs.sparkSession.createDataFrame([], f"query_id {kind}, entry_id long, dist double, rank int")
    query_ids, asked = [r.query_id for r in rows], [np.array(r.embedding, dtype=np.float64) for r in rows]
    names = pa.array(query_ids)
    alike = len({len(v) for v in asked}) == 1
    schema = f"query_id {kind}, entry_id long, dist double"

    def found(graph: Graph, allow: np.ndarray | None) -> pa.Table:
        if allow is None and alike and len(asked) > 1:
            place, ids, dist = graph.search_many(np.array(asked), k, ef)
        else:
            each = [graph.search(vector, k, ef, allow) for vector in asked]
            place = np.repeat(np.arange(len(each)), [len(i) for i, _ in each])
            ids, dist = np.concatenate([i for i, _ in each]), np.concatenate([d for _, d in each])
        return pa.table({"query_id": names.take(pa.array(place, pa.int64())), "entry_id": pa.array(ids, pa.int64()), "dist": np.round(dist.astype(np.float64), 6)})

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("graph").to_pylist():
                yield from found(Graph.load(data, params), None).to_batches()

    def some(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "entry_id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        graph = Graph.load(left.column("graph")[0].as_py(), params)
        return found(graph, np.isin(graph.ids, right.column("entry_id").to_numpy()))

    if allowed is None:
        near = graphs.select("graph").mapInArrow(every, schema)
    else:
        ids = allowed.select(_shard(shards), F.col("entry_id").cast("long").alias("entry_id"))
        near = graphs.select("shard", "graph").groupBy("shard").cogroup(ids.groupBy("shard")).applyInArrow(some, schema)
    order = Window.partitionBy("query_id").orderBy("dist", "entry_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def shards_for(entries: int) -> int:
    return max(1, -(-entries // SHARD_ROWS))


def search_escalating(graphs: DataFrame, entries: DataFrame, query: list[float], k: int, candidates: int, ef: int | None = None, filtered: bool = False, shards: int = 1) -> tuple[DataFrame, bool]:
    """query_id (0), entry_id, dist, rank of the k nearest of ``entries``, which are
    all that the graphs hold or, if ``filtered``, some. A search that finds fewer
    than min(k, candidates) is repeated WIDEN times as wide, and after that the
    entries are scanned; the flag tells whether the graphs were enough."""
    spark = graphs.sparkSession
    asked = spark.createDataFrame([(0, [float(x) for x in query])], "query_id long, embedding array<double>")
    allowed = entries.select("entry_id") if filtered else None
    enough, pool = False, entries
    for width in (ef, max(ef or 0, HnswParams().ef_search) * WIDEN):
        found = [r.entry_id for r in search_graphs(graphs, asked, k, width, allowed, shards).collect()]  # at most k
        if len(found) >= min(k, candidates):
            enough, pool = True, entries.where(F.col("entry_id").isin(found))
            break
    # Graphs hold single-precision vectors; what they found is measured exactly.
    rows = [(0, r.entry_id, r.dist, i + 1) for i, r in enumerate(knn(pool, query, k).collect())]
    return spark.createDataFrame(rows, "query_id long, entry_id long, dist double, rank int"), enough
