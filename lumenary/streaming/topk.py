"""Nearest neighbours of a query kept up to date from a stream of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lumenary.functions.distances import Distance
from lumenary.operators.search import linear_search, merge_results


def incremental_topk(stream: DataFrame, query: DataFrame, k: int, dist: str | Distance, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start a query that keeps the k nearest rows of `stream` (key, vector) to the one row of `query` under `path`.

    Each batch's own top k is merged with that of the batches before, so the state is k rows. Every batch writes
    path/batch=<id>; a batch that is repeated after a failure overwrites its own result and reads the one before, so
    each row counts once. Read the result with `current`. once: process what is there and stop.
    """
    spark = stream.sparkSession

    def update(rows: DataFrame, batch: int) -> None:
        best = linear_search(rows, query, k, dist)
        if batch:
            best = merge_results(spark.read.parquet(f"{path}/batch={batch - 1}"), best, k)
        best.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(query: StreamingQuery, stream: DataFrame, path: str) -> DataFrame:
    """(rank, distance, key) after the last finished batch."""
    return stream.sparkSession.read.parquet(f"{path}/batch={query.lastProgress['batchId']}")
