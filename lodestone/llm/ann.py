"""Approximate nearest neighbours by a forest of random-projection trees.

One forest is fitted on a bounded sample (``sample_rows`` vectors of a dimension,
those with the smallest hash of vec_id); its leaves are cells of about ``CELL_ROWS``
rows of the whole table, and every row lies in one cell of each tree. A query walks
all trees with one priority queue, by the largest margin, and asks for the cells it
reaches until they hold as many candidates as needed. Only these cells get the
query; their rows are reranked exactly, in double precision, and the best of all
cells are merged.

How many candidates are needed is measured on the whole table: up to ``PROBES``
queries are answered by a full scan, and the number is the one at which the walk
meets ``target`` of their true neighbours. So it follows the data at any size, and
where they can be told apart, the share of the table that a query meets falls as the
table grows.

A cell with many rows is cut into parts of at most about ``PART_ROWS``, its queries
into parts of ``PART_QUERIES``, and each pair of parts is a task's group, so no hot
cell comes together in one place. A query that finds fewer than k in its cells, as
may happen where many rows bear its own id, asks all cells of the first tree.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part; a candidate has the query's dimension and another
vec_id; of rows that repeat a query's vec_id, the smallest vector is the query;
rows of a repeated candidate id each count; null vec_ids take no part; ties go
to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import bound_arrow, staged

TREES = 2
CELL_ROWS = 4096
SAMPLE_ROWS = 32_768
PART_ROWS = 16_384
PART_QUERIES = 4096
PROBES = 128
#: Sampled rows that a leaf is left with at least, whatever the table's size.
LEAF_SAMPLE = 16


class Forest:
    """Trees of median splits along random directions between two rows. A cell is
    numbered over all trees; a tree without splits is one cell."""

    def __init__(self, x: np.ndarray, leaves: int, trees: int = TREES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.planes: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.children: list[tuple[int, int]] = []  # node ids; a leaf is -1 - its cell
        self.cells = 0
        depth = max(0, int(np.ceil(np.log2(max(1, min(leaves, len(x) // LEAF_SAMPLE))))))
        self.roots = [self._grow(x, np.arange(len(x)), rng, depth) for _ in range(trees if depth else 1)]
        self.normals = np.array(self.planes) if self.planes else np.zeros((0, x.shape[1]))
        self.offsets = np.array(self.cuts)

    def _grow(self, x: np.ndarray, rows: np.ndarray, rng, depth: int) -> int:
        if depth and len(rows) > 1:
            a, b = x[rng.choice(rows, 2, replace=False)]
            normal = a / np.linalg.norm(a) - b / np.linalg.norm(b)
            size = np.linalg.norm(normal)
            normal = normal / size if size > 0 else rng.standard_normal(x.shape[1])
            at = x[rows] @ normal
            cut = float(np.median(at))
            left, right = rows[at <= cut], rows[at > cut]
            if len(left) and len(right):
                node = len(self.planes)
                self.planes.append(normal)
                self.cuts.append(cut)
                self.children.append((0, 0))
                self.children[node] = (self._grow(x, left, rng, depth - 1), self._grow(x, right, rng, depth - 1))
                return node
        self.cells += 1
        return -self.cells

    def cells_of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row in each tree."""
        out = np.zeros((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            open_ = [(root, np.arange(len(x)))]
            while open_:
                node, rows = open_.pop()
                if node < 0:
                    out[rows, t] = -1 - node
                elif len(rows):
                    left = x[rows] @ self.normals[node] <= self.offsets[node]
                    open_ += [(self.children[node][0], rows[left]), (self.children[node][1], rows[~left])]
        return out

    def walk(self, margins: list[float]) -> Iterator[int]:
        """Cells in the order in which a query with these margins meets them."""
        queue = [(-np.inf, root) for root in self.roots]
        while queue:
            worst, node = heapq.heappop(queue)
            if node < 0:
                yield -1 - node
                continue
            m, (left, right) = margins[node], self.children[node]
            heapq.heappush(queue, (max(worst, m), left))
            heapq.heappush(queue, (max(worst, -m), right))

    def margins(self, queries: np.ndarray) -> np.ndarray:
        return queries @ self.normals.T - self.offsets


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, ties to the smaller id; -inf is no candidate."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    at = at[scores[at] > -np.inf]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def nearest_of(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, row's place, score) of the k best rows for each query. Products
    of matrices find them, with room for their rounding; the scores are then summed
    row by row, so that equal vectors get equal scores wherever they stand."""
    out_q, out_r, out_s = [], [], []
    step = max(1, 4_000_000 // max(1, len(x)))
    for start in range(0, len(queries), step):
        found = queries[start : start + step] @ x.T
        for i, s in enumerate(found, start):
            s[ids == query_ids[i]] = -np.inf
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                rows = np.flatnonzero((s >= least - 1e-9 * (1 + abs(least))) & (s > -np.inf))
            else:
                rows = np.flatnonzero(s > -np.inf)
            exact = (x[rows] * queries[i]).sum(axis=1)
            rows, exact = (v[best(exact, ids[rows], k)] for v in (rows, exact))
            out_q.append(np.full(len(rows), i))
            out_r.append(rows)
            out_s.append(exact)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_q]), np.concatenate([none, *out_r]), np.concatenate([np.zeros(0), *out_s])


def usable(rows: DataFrame) -> DataFrame:
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = pa.compute.list_value_length(batch.column("embedding")).to_numpy()
    for d in np.unique(sizes).tolist():
        yield d, batch.filter(pa.array(sizes == d))


def _placed(rows: DataFrame, forests: dict[int, Forest]) -> DataFrame:
    """row, vec_id, embedding, dim, cells of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in _by_dimension(batch):
                forest = forests.get(d)
                cells = forest.cells_of(_matrix(part.column("embedding"))) if forest else np.zeros((part.num_rows, 1), np.int64)
                columns = [*part.columns, pa.array([d] * part.num_rows, pa.int32()), pa.array(cells.tolist(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "vec_id", "embedding", "dim", "cells"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.select("row", "vec_id", "embedding").mapInArrow(run, f"row long, vec_id long, embedding {kind}, dim int, cells array<bigint>")


def needed(forest: Forest, sizes: np.ndarray, queries: np.ndarray, truth: list[list[list[int]]], target: float) -> int:
    """How many candidates the cells that a query asks must hold, so that the walks
    meet ``target`` of the true neighbours (given as their cells, for each query)."""
    met = []
    for margins, neighbours in zip(forest.margins(queries).tolist(), truth):
        held, at = 0, {}
        for cell in forest.walk(margins):
            held += int(sizes[cell])
            at[cell] = held
        met += [min(at[c] for c in cells) for cells in neighbours]
    met.sort()
    return met[max(0, int(np.ceil(target * len(met))) - 1)] if met else 0


def _scan(placed: DataFrame, probes: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """query_id, dim, cells, score of the true k nearest of the probes, by full scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in _by_dimension(batch):
                if d not in probes:
                    continue
                query_ids, queries = probes[d]
                q, r, s = nearest_of(query_ids, queries, part.column("vec_id").to_numpy(), _matrix(part.column("embedding")), k)
                found = part.take(pa.array(r))
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[q], pa.int64()), found.column("dim"), found.column("vec_id"), found.column("cells"), pa.array(s)], names=["query_id", "dim", "vec_id", "cells", "score"])

    near = placed.mapInArrow(run, "query_id long, dim int, vec_id long, cells array<bigint>, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _routed(asked: DataFrame, forests: dict[int, Forest], sizes: dict[int, np.ndarray], wanted: dict[int, int], everything: bool = False) -> DataFrame:
    """dim, cell, query_id, query: a row for each cell that a query asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in _by_dimension(batch):
                at, cells = [], []
                if d not in forests:
                    at, cells = list(range(part.num_rows)), [0] * part.num_rows
                elif everything:
                    first = sorted(_leaves(forests[d], forests[d].roots[0]))
                    at, cells = np.repeat(np.arange(part.num_rows), len(first)).tolist(), first * part.num_rows
                else:
                    for i, margins in enumerate(forests[d].margins(_matrix(part.column("embedding"))).tolist()):
                        held = 0
                        for cell in forests[d].walk(margins):
                            at.append(i)
                            cells.append(cell)
                            held += int(sizes[d][cell])
                            if held >= wanted[d]:
                                break
                found = part.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(at), pa.int32()), pa.array(cells, pa.int64()), found.column("vec_id"), found.column("embedding")], names=["dim", "cell", "query_id", "query"])

    kind = asked.schema["embedding"].dataType.simpleString()
    return asked.select("vec_id", "embedding").mapInArrow(run, f"dim int, cell long, query_id long, query {kind}")


def _leaves(forest: Forest, node: int) -> list[int]:
    if node < 0:
        return [-1 - node]
    return [c for child in forest.children[node] for c in _leaves(forest, child)]


def _met(placed: DataFrame, routed: DataFrame, k: int) -> DataFrame:
    """query_id, row, vec_id, score: the k best of each pair of parts of a cell."""
    cell = ["dim", "cell"]
    rows = placed.select("dim", F.explode("cells").alias("cell"), "row", "vec_id", "embedding")
    parts = lambda df, most, name: df.groupBy(*cell).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / most)).cast("int").alias(name))
    # A cell's counts are a row each; the forest bounds the number of cells.
    cuts = F.broadcast(parts(rows, PART_ROWS, "row_parts").join(parts(routed, PART_QUERIES, "query_parts"), cell))
    part_of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(cuts, cell).select(*cell, part_of("row", "row_parts").alias("r"), every("query_parts").alias("q"), "row", "vec_id", "embedding")
    right = routed.join(cuts, cell).select(*cell, every("row_parts").alias("r"), part_of("query_id", "query_parts").alias("q"), "query_id", "query")

    def run(x: pa.Table, asked: pa.Table) -> pa.Table:
        x, asked = x.combine_chunks(), asked.combine_chunks()
        one = lambda t, c: t.column(c).combine_chunks() if t.num_rows else t.column(c)
        if not x.num_rows or not asked.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        query_ids, ids = asked.column("query_id").to_numpy(), x.column("vec_id").to_numpy()
        q, r, s = nearest_of(query_ids, _matrix(one(asked, "query")), ids, _matrix(one(x, "embedding")), k)
        return pa.table({"query_id": query_ids[q], "row": x.column("row").to_numpy()[r], "vec_id": ids[r], "score": s})

    key = [*cell, "r", "q"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "query_id long, row long, vec_id long, score double")


def _ranked(met: DataFrame, k: int, trees: int) -> DataFrame:
    """A row is met in up to ``trees`` cells: so many times k are kept, then each
    row once. All windows are over one partitioning, a query's few rows."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row")
    few = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k * trees)
    again = F.lag("row").over(order)
    once = few.withColumn("again", F.coalesce(again == F.col("row"), F.lit(False))).where(~F.col("again"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(rows: DataFrame, queries: DataFrame, k: int = 20, target: float = 0.95, sample_rows: int = SAMPLE_ROWS, cell_rows: int = CELL_ROWS, trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by inner product."""
    bound_arrow(rows.sparkSession)
    indexed = staged(usable(rows).withColumn("row", F.monotonically_increasing_id()), "ann-rows")
    asked = staged(usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "ann-queries")
    dim = F.size("embedding").alias("dim")
    forests: dict[int, Forest] = {}
    for r in indexed.groupBy(dim).count().where(F.col("count") > cell_rows).collect():  # a row per large dimension
        sample = indexed.where(F.size("embedding") == r.dim).orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(sample_rows).select("embedding").toArrow()
        forests[r.dim] = Forest(_matrix(sample.column("embedding").combine_chunks()), -(-r["count"] // cell_rows), trees)
    placed = staged(_placed(indexed, forests), "ann-placed")
    sizes = {d: np.zeros(f.cells, np.int64) for d, f in forests.items()}
    for r in placed.select("dim", F.explode("cells").alias("cell")).groupBy("dim", "cell").count().collect():  # a row per cell
        if r.dim in sizes:
            sizes[r.dim][r.cell] = r["count"]
    probes = {}
    for d in forests:
        some = asked.where(F.size("embedding") == d).orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(PROBES).toArrow()
        if some.num_rows:
            probes[d] = (some.column("vec_id").to_numpy(), _matrix(some.column("embedding").combine_chunks()))
    wanted = {d: 0 for d in forests}
    if probes:
        true: dict[tuple[int, int], list[list[int]]] = {}
        for r in _scan(placed, probes, k).select("dim", "query_id", "cells").collect():  # k rows per probe
            true.setdefault((r.dim, r.query_id), []).append(r.cells)
        for d, (ids, vectors) in probes.items():
            wanted[d] = max(needed(forests[d], sizes[d], vectors, [true.get((d, int(i)), []) for i in ids], target), (k + 1) * len(forests[d].roots))
    near = _ranked(_met(placed, _routed(asked, forests, sizes, wanted), k), k, trees)
    if not forests:
        return near
    near = staged(near, "ann-near")
    have = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    short = asked.join(have, asked.vec_id == have.query_id, "left").where((F.coalesce("n", F.lit(0)) < k) & F.size("embedding").isin(list(forests))).select("vec_id", "embedding")
    if not short.limit(1).count():
        return near
    short = staged(short, "ann-short")
    full = _ranked(_met(placed, _routed(short, forests, sizes, wanted, True), k), k, 1)
    return near.join(short, near.query_id == short.vec_id, "left_anti").unionByName(full)
