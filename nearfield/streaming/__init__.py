"""Queries that arrive as a stream, against an index that stays as it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def stream_queries(stream: DataFrame, index, sink: Callable[[DataFrame, int], None], k: int = 15, checkpoint: str | None = None, trigger: dict | None = None, **params):
    """Starts a streaming query that answers each micro-batch of vectors (id, vec) with the index and hands (result, batch number) to ``sink``."""

    def answer(batch: DataFrame, number: int) -> None:
        sink(index.query(batch, k, **params), number)

    writer = stream.writeStream.foreachBatch(answer).trigger(**(trigger or {"availableNow": True}))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
