"""Extensions for unbounded inputs: the static operators on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.keyed_table import KeyedTable


def upsert_stream(batches: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Upsert each micro-batch of the table's columns and `ord`. A batch that is sent again after a failure changes nothing; each batch writes the buckets it touches."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        KeyedTable(batch.sparkSession, table.root, table.schema, table.keys, table.buckets).upsert(batch)

    return batches.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
