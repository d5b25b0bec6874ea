"""Schemas of the log and control tables, and the id-to-partition rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTITION_SIZE = 1_000_000

SCHEMAS = {
    "message_log": "id long, schema_version int, routing_key string, message_key string, compaction_rank long, payload string, concurrency string, created_at timestamp",
    "idempotency_key": "idempotency_key string, created_at timestamp",
    "exception_queue": "consumer_group_id long, message_id long, status string, message_key string, concurrency string, attempts int, delays int, can_run_after timestamp, last_error string, lease_token string, lease_expires_at timestamp, created_at timestamp, updated_at timestamp",
    "delivery_log": "consumer_group_id long, message_id long, attempt int, status string, error string, attempted_at timestamp",
    "consumer_group_cursor": "consumer_group_id long, claimed long, committed long",
    "claim_lease": "consumer_group_id long, token string, low long, high long, expires_at timestamp, reclaims int",
    "message_key_lease": "consumer_group_id long, message_key string, token string, expires_at timestamp",
    "compaction_head": "compaction_key string, message_id long, schema_version int, compaction_rank long, created_at timestamp, updated_at timestamp",
    "binding_config": "consumer_group_id long, pattern string, pattern_regex string",
    "binding_config_log": "id long, consumer_group_id long, status string, patterns array<string>, declared_by string, declared_at timestamp, attempted_at timestamp",
    "stream_config": "id long, name string, partition_size long, retention_ns long, key_ttl_ns long, delivery_log_mode string, allow_drop_past_committed boolean, created_at timestamp, updated_at timestamp",
    "stream_config_log": "id long, stream_id long, name string, partition_size long, retention_ns long, key_ttl_ns long, delivery_log_mode string, allow_drop_past_committed boolean, declared_by string, declared_at timestamp",
    "consumer_group_config": "id long, stream_id long, name string, created_at timestamp",
    "worker_config": "id long, name string, system_id long, stream_id long, consumer_group_id long, target_instances int, metadata string, created_at timestamp",
    "worker_config_log": "id long, worker_id long, target_instances int, metadata string, declared_by string, declared_at timestamp",
    "worker_instance": "worker_id long, token string, expires_at timestamp, attempts int, created_at timestamp",
    "worker_instance_log": "id long, worker_id long, token string, started_at timestamp, expires_at timestamp, released_at timestamp",
    "schedule_config": "id long, name string, stream_id long, cron string, payload string, schema_version int, suspended boolean, created_at timestamp",
    "schedule_cursor": "schedule_id long, next_at timestamp, last_scheduled_at timestamp",
    "migration_log": "id long, scope string, owner_id long, version int, min_compatible int, status string, error string, applied_at timestamp",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])


def part(message_id: Column, size: int = PARTITION_SIZE) -> Column:
    """Number of the id range that a message lies in."""
    return F.floor(message_id / F.lit(size)).cast("long")


def in_range(low: int, high: int, size: int = PARTITION_SIZE, partitioned: bool = True) -> Column:
    """``low < id <= high``, with the partition range that lets whole directories be skipped."""
    ids = (F.col("id") > low) & (F.col("id") <= high)
    return ids & F.col("part").between((low + 1) // size, high // size) if partitioned else ids
