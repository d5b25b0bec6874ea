"""Streaming append: each micro-batch is produced under its own id, so replays are no-ops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def start(source: DataFrame, store: Store, stream_id: int, checkpoint: str, size: int, once: bool = True) -> StreamingQuery:
    """Append a stream of messages (the columns of ``Store.produce``) exactly once per idempotency key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        store.produce(stream_id, batch, f"{checkpoint.rstrip('/').rsplit('/', 1)[-1]}-{batch_id}", size)

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def heads_stream(source: DataFrame) -> DataFrame:
    """Heads as a streaming aggregate, for update-mode sinks."""
    rows = source.where("compaction_rank is not null and message_key is not null")
    best = rows.groupBy(F.col("message_key").alias("compaction_key")).agg(F.max(F.struct("schema_version", "compaction_rank", "id")).alias("h"))
    return best.select("compaction_key", F.col("h.id").alias("message_id"), "h.schema_version", "h.compaction_rank")


def deduplicated(source: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """First message of each idempotency key within the ttl, by event time."""
    return source.withWatermark("created_at", ttl).dropDuplicatesWithinWatermark(["idempotency_key"])
