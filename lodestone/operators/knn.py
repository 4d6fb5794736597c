"""Exact nearest neighbours by cosine distance.

One query is a constant in the projection, and the k best are kept in bounded
heaps per task (TakeOrderedAndProject). A set of queries is scored in blocks: the
entries are not shuffled unless they are in few files, each task multiplies its Arrow batches with the
queries, a block of each at a time, and keeps k rows per query, and only these are
merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.errors import DimensionMismatch
from lodestone.functions.vectors import distance, dot

#: Queries of a batch are sent to every task, so their number is checked.
MOST_QUERIES = 20_000
#: Rows and queries that a task multiplies at a time, and results that wait for a merge.
BLOCK_ROWS, BLOCK_QUERIES, WAITING = 4096, 512, 1 << 18


def _constant(query: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in query))


def _checked(query: list[float]) -> Column:
    """The entries' vectors; one of another dimension ends the query."""
    message = f"[E3007] The query has {len(query)} components"
    return F.when(F.size("embedding") == len(query), F.col("embedding")).otherwise(F.when(F.col("embedding").isNotNull(), F.raise_error(F.lit(message)).cast("array<float>")))


def similarity(entries: DataFrame, entry_id: int, query: list[float]) -> DataFrame:
    """entry_id, similarity of one entry with the query; no row for an unknown id."""
    return entries.where(F.col("entry_id") == entry_id).select("entry_id", F.round(dot(_checked(query), _constant(query)), 6).alias("similarity"))


def knn(entries: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """entry_id, dist, similarity of the k nearest of entries(entry_id, embedding)."""
    if where is not None:
        entries = entries.where(where)
    scored = entries.select("entry_id", (F.round(distance(_checked(query), _constant(query)), 6) + 0.0).alias("dist"))  # + 0.0: no -0.0
    return scored.orderBy(F.col("dist").asc_nulls_last(), "entry_id").limit(k).withColumn("similarity", F.round(1 - F.col("dist"), 6))


def knn_worst(nearest: DataFrame, k: int) -> DataFrame:
    """The k-th distance, or null where there are fewer than k."""
    return nearest.agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("worst"))


def keep_best(ids: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest, NaN last, ties to the lower id."""
    if k <= 0:
        return np.zeros(0, dtype=int)
    value = np.where(np.isnan(dist), np.inf, dist)
    if len(value) > k:
        at = np.flatnonzero(value <= np.partition(value, k - 1)[k - 1])
    else:
        at = np.arange(len(value))
    return at[np.lexsort((ids[at], np.isnan(dist[at]), value[at]))][:k]


class Best:
    """The k nearest rows of each query so far. Of a block of products only what is as
    near as a query's k-th is looked at, and that waits until it is as much as was kept."""

    def __init__(self, queries: int, k: int):
        self.k = max(0, k)
        self.q, self.ids, self.dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.worst = np.full(queries, np.inf)
        self.more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, first: int, products: np.ndarray, ids: np.ndarray) -> None:
        """Inner products of the queries from ``first`` on with the rows of ``ids``."""
        if not self.k:
            return
        worst = self.worst[first : first + len(products)]
        new = np.isinf(worst)
        if new.all() and len(ids) > self.k:  # nothing is known yet: the block's own k-th
            kth = np.partition(np.where(np.isnan(products), -np.inf, products), -self.k, axis=1)[:, -self.k]
            worst = np.where(np.isinf(kth), np.inf, 1.0 - kth)
        # Distances are compared as rounded, so that ties are kept for the lower id.
        q, row = np.nonzero(~(products < (1.0 - worst - 2e-6)[:, None]))
        self.more.append((q + first, ids[row], np.round(1.0 - products[q, row], 6) + 0.0))
        self.waiting += len(q)
        if self.waiting > max(WAITING, len(self.q)):
            self._merge()

    def _merge(self) -> None:
        q, ids, dist = (np.concatenate([a, *b]) for a, b in zip((self.q, self.ids, self.dist), zip(*self.more) if self.more else ((), (), ())))
        value = np.where(np.isnan(dist), np.inf, dist)
        order = np.lexsort((ids, np.isnan(dist), value, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        at = order[place < self.k]
        full = order[place == self.k - 1]
        self.worst[q[place == self.k - 1]] = value[full]
        self.q, self.ids, self.dist = q[place < self.k], ids[at], dist[at]
        self.more, self.waiting = [], 0

    def kept(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        self._merge()
        for a in range(0, len(self.q), WAITING):
            yield self.q[a : a + WAITING], self.ids[a : a + WAITING], self.dist[a : a + WAITING]


def knn_batch(entries: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, entry_id, dist, rank for queries(query_id, embedding)."""
    rows = queries.select("query_id", "embedding").limit(MOST_QUERIES + 1).collect()
    if len(rows) > MOST_QUERIES:
        parts = -(-queries.count() // (MOST_QUERIES // 2))
        found = None
        for i in range(parts):
            part = knn_batch(entries, queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i), k)
            found = part if found is None else found.unionByName(part)
        return found
    kind = queries.schema["query_id"].dataType.simpleString()
    if not rows:
        return entries.sparkSession.createDataFrame([], f"query_id {kind}, entry_id long, dist double, rank int")
    query_ids = [r.query_id for r in rows]
    matrix = np.array([r.embedding for r in rows], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(matrix), k)
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(flat) != batch.num_rows * matrix.shape[1]:
                raise DimensionMismatch(f"The queries have {matrix.shape[1]} components")
            rows, ids = flat.reshape(-1, matrix.shape[1]), batch.column(0).to_numpy()
            for at in range(0, len(rows), BLOCK_ROWS):
                for q in range(0, len(matrix), BLOCK_QUERIES):
                    best.add(q, matrix[q : q + BLOCK_QUERIES] @ rows[at : at + BLOCK_ROWS].T, ids[at : at + BLOCK_ROWS])
        for q, entry_id, dist in best.kept():
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(entry_id, pa.int64()), pa.array(dist)], names=["q", "entry_id", "dist"])

    many = entries.sparkSession.sparkContext.defaultParallelism
    if len(matrix) > BLOCK_QUERIES and len(entries.inputFiles()) < many:  # few files make few tasks
        entries = entries.repartition(many)
    near = entries.select(F.col("entry_id").cast("long").alias("entry_id"), "embedding").mapInArrow(run, "q long, entry_id long, dist double")
    order = Window.partitionBy("q").orderBy(F.col("dist").asc_nulls_last(), "entry_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = entries.sparkSession.createDataFrame(list(enumerate(query_ids)), f"q long, query_id {kind}")
    return ranked.join(F.broadcast(names), "q").select("query_id", "entry_id", "dist", "rank")
