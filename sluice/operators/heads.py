"""Compaction heads: the winner of each key by version, then rank, then id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = ("schema_version", "compaction_rank", "id")


def heads(log: DataFrame) -> DataFrame:
    """Winners recomputed from the log: one aggregate with map-side combination."""
    rows = log.where("compaction_rank is not null and message_key is not null")
    best = rows.groupBy(F.col("message_key").alias("compaction_key")).agg(F.max(F.struct(*ORDER)).alias("h"))
    return best.select("compaction_key", F.col("h.id").alias("message_id"), "h.schema_version", "h.compaction_rank")


def merged(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Maintained heads after a batch of messages: an empty head gives way, else the greater of version, rank, id wins.

    Keys whose winner was deleted stay as they are maintained; older rows are not promoted.
    """
    new = heads(batch)
    order = F.struct("schema_version", "compaction_rank", "message_id")
    both = current.select("compaction_key", "message_id", "schema_version", "compaction_rank").unionByName(new)
    return both.groupBy("compaction_key").agg(F.max(F.when(F.col("message_id").isNotNull(), order)).alias("h")).select("compaction_key", "h.message_id", "h.schema_version", "h.compaction_rank")


def listed(heads: DataFrame, log: DataFrame) -> DataFrame:
    """Messages that are heads."""
    return heads.where("message_id is not null").select("compaction_key", F.col("message_id").alias("id")).join(log, "id")


def head_of(heads: DataFrame, log: DataFrame, key: str) -> DataFrame:
    return listed(heads.where(F.col("compaction_key") == key), log)


def lockable(heads: DataFrame, key: str, now: Column) -> DataFrame:
    """Heads after making sure that ``key`` has one, empty if need be; an empty one's update time is renewed."""
    spark = heads.sparkSession
    none = {c: F.lit(None).cast(t) for c, t in heads.dtypes if c not in ("compaction_key", "created_at", "updated_at")}
    made = spark.range(1).select(F.lit(key).alias("compaction_key"), *[v.alias(k) for k, v in none.items()], now.alias("created_at"), now.alias("updated_at")).select(heads.columns)
    touched = heads.withColumn("updated_at", F.when((F.col("compaction_key") == key) & F.col("message_id").isNull(), now).otherwise(F.col("updated_at")))
    return touched.unionByName(made.join(heads, "compaction_key", "left_anti"))
