"""Maximal Marginal Relevance over the pool of each query.

The choice is sequential, so a query's pool (at most max(4k, 50) rows when the
engine makes it) is one group of an Arrow function; queries run in parallel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAMBDA = 0.7


def clamp_relevance(relevance: Column) -> Column:
    """Between 0 and 1; what is no finite number is 0.5."""
    value = relevance.cast("double")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def choose(relevance: np.ndarray, vectors: np.ndarray, k: int, weight: float = LAMBDA) -> list[int]:
    """The first stays first; then, each time, the best trade of relevance
    against likeness to what was chosen, the earlier one of equals."""
    n = len(relevance)
    if n == 0 or k <= 0:
        return []
    weight = min(1.0, max(0.0, weight))
    chosen, left = [0], np.ones(n, dtype=bool)
    left[0] = False
    alike = vectors @ vectors[0]
    while len(chosen) < min(k, n):
        value = np.where(left, np.round(weight * relevance - (1 - weight) * alike, 9), -np.inf)
        best = int(np.argmax(value))
        chosen.append(best)
        left[best] = False
        alike = np.maximum(alike, vectors @ vectors[best])
    return chosen


def mmr(pool: DataFrame, k: int, weight: float = LAMBDA) -> DataFrame:
    """query_id, entry_id, rank of pool(query_id, entry_id, position, relevance,
    embedding), in the order of position."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("position", "ascending"), ("entry_id", "ascending")])
        vectors = np.array(group.column("embedding").to_pylist(), dtype=np.float64)
        at = choose(group.column("relevance").to_numpy(), vectors, k, weight)
        out = group.select(["query_id", "entry_id"]).take(pa.array(at, pa.int64()))
        return out.append_column("rank", pa.array(range(1, len(at) + 1), pa.int32()))

    rows = pool.select("query_id", "entry_id", "position", clamp_relevance(F.col("relevance")).alias("relevance"), F.col("embedding").cast("array<double>").alias("embedding"))
    kind = pool.schema["query_id"].dataType.simpleString()
    return rows.groupBy("query_id").applyInArrow(run, f"query_id {kind}, entry_id long, rank int")
