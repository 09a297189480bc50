"""Structured Streaming into tables: exactly once, by the batch number in the commit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.table import Table


def upsert_sink(stream: DataFrame, table: Table, name: str, checkpoint: str, order_by: Column | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch is one commit; a batch that was committed before a failure is not applied again."""

    def apply(batch: DataFrame, number: int) -> None:
        if table.state().metadata["keys"]:
            table.upsert(batch, batch=(name, number), order_by=order_by)
        else:
            table.append(batch, batch=(name, number))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
