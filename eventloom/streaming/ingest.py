"""Documents from a stream: each micro-batch goes through the same idempotent insert as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from eventloom.plans.pipeline import EventLoom


def ingest(stream: DataFrame, loom: EventLoom, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts inserting the text column of a stream. A batch that runs again after a failure adds nothing twice."""

    def insert(batch: DataFrame, _: int) -> None:
        loom.insert(batch.select("text"))

    return stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
