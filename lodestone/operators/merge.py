"""Appending new commits to an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Places of the order that are numbered together, with all their columns; what
#: follows in the same stage has as many tasks at most as there are ranges.
RANGE = 1 << 10


def fresh_rows(old: DataFrame, new: DataFrame, order: str = "walk_pos") -> DataFrame:
    """The rows of ``new`` whose hash is not in ``old``, of a hash that is new
    twice the first, with entry_ids that go on after those of ``old``.

    Numbering is by ranges of the order: counts per range give each its first id,
    so that no task sees all new rows."""
    fresh = new.join(old.select("hash").distinct(), "hash", "left_anti")
    first = fresh.groupBy("hash").agg(F.min(order).alias(order))
    fresh = fresh.join(first, ["hash", order], "left_semi").dropDuplicates(["hash"])
    start = old.agg(F.coalesce(F.max("entry_id") + 1, F.lit(0)).alias("start"))
    placed = numbered(fresh, order).crossJoin(F.broadcast(start))  # one row
    return placed.withColumn("entry_id", F.col("entry_id") + F.col("start")).drop("start", order)


def merge_new(old: DataFrame, new: DataFrame, order: str = "walk_pos") -> DataFrame:
    """Old entries as they are, then the new ones in their order."""
    return old.unionByName(fresh_rows(old, new, order).select(*old.columns))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """Dense entry_id from 0 in the given order, an integer column."""
    parts = rows.withColumn("__part", F.floor(F.col(order) / RANGE))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    base = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(order, "hash"))
    return parts.join(base, "__part").withColumn("entry_id", (F.col("__base") + local - 1).cast("long")).drop("__part", "__base")
