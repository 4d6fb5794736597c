"""Continuous indexing: each micro-batch of new commits is appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.engine import Engine


def stream_into(engine: Engine, commits: DataFrame, checkpoint: str):
    """Start a query that appends commits(hash, author, date, message,
    diff_summary). Hashes that are indexed already are skipped, so a batch that is
    repeated after a failure changes nothing."""

    def append(batch: DataFrame, _epoch: int) -> None:
        rows = batch.withColumn("walk_pos", F.monotonically_increasing_id())
        if not engine.storage.exists():
            if rows.limit(1).count():
                engine.build(rows)
            return
        entries, meta = engine.storage.load()
        engine.append_rows(entries, meta, rows)

    return commits.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
