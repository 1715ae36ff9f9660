"""Incremental transfer: a stream's batches through the same conversion as whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..transfer.planner import plan


def incremental(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every batch converted and handed to ``sink(frame, batch)``, once all that is there has been read."""
    return stream.writeStream.foreachBatch(lambda df, n: sink(plan(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
