"""Reciprocal Rank Fusion of rankings(query_id, entry_id, rank), rank from 1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60


def _term(rank: Column) -> Column:
    """1 / (60 + rank) in single precision; absent is nothing."""
    return F.coalesce((F.lit(1.0) / (F.lit(K) + rank)).cast("float"), F.lit(0.0).cast("float"))


def rrf(rankings: list[DataFrame], k: int) -> DataFrame:
    """query_id, entry_id, rrf, rank of the k best, ties to the lower id.

    Terms are added in the order of the rankings, in single precision, so sums
    that are equal stay equal; an entry that a ranking repeats gets the sum of its
    terms there."""
    if k <= 0:
        rankings = [r.limit(0) for r in rankings]
    sides = []
    for i, ranking in enumerate(rankings):
        ranks = F.array_sort(F.collect_list("rank"))
        total = F.aggregate(ranks, F.lit(0.0).cast("float"), lambda acc, r: acc + _term(r))
        sides.append(ranking.groupBy("query_id", "entry_id").agg(total.alias(f"part{i}")))
    joined = reduce(lambda a, b: a.join(b, ["query_id", "entry_id"], "full_outer"), sides)
    zero = F.lit(0.0).cast("float")
    score = reduce(lambda a, b: a + b, [F.coalesce(f"part{i}", zero) for i in range(len(sides))])
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "entry_id")
    scored = joined.select("query_id", "entry_id", score.alias("rrf"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
