"""Retention: whole partitions that may go, rows that may be swept, and what they leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def floor(cursors: DataFrame) -> int | None:
    """The slowest group's committed id; None without groups."""
    return cursors.agg(F.min("committed")).first()[0]


def partitions(log: DataFrame, size: int) -> DataFrame:
    """Per partition: its first and last id, rows, and the times of its oldest and newest row (by id)."""
    part = F.expr(f"id div {size}").alias("part")
    return log.groupBy(part).agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("rows"), F.min_by("created_at", "id").alias("oldest_at"), F.max_by("created_at", "id").alias("newest_at")
    )


def droppable(log: DataFrame, size: int, head: int, ttl: Column | None, now: Column, committed: int | None, past_committed: bool = False) -> DataFrame:
    """Partitions before the active one whose newest row has outlived the ttl and that every group has committed.

    ``ttl`` null keeps everything; ``committed`` null (no groups) sets no floor.
    """
    if ttl is None:
        return partitions(log, size).where(F.lit(False))
    p = partitions(log, size).where((F.col("part") < head // size) & (F.col("newest_at") <= now - ttl))
    return p if past_committed or committed is None else p.where(F.col("last_id") <= committed)


def sweepable(log: DataFrame, size: int, ttl: Column, now: Column, committed: int | None, past_committed: bool = False, grace: Column | None = None) -> DataFrame:
    """Expired rows (with ``part``) of partitions that begin before the cutoff.

    Rows count as expired once they have outlived the ttl and the ``grace`` period, so that a
    partition that will soon be dropped whole isn't taken apart row by row.
    """
    cutoff = now - ttl if grace is None else now - ttl - grace
    begun = partitions(log, size).where(F.col("oldest_at") < cutoff).select("part")
    rows = log.withColumn("part", F.expr(f"id div {size}")).where(F.col("created_at") < cutoff)
    if not past_committed and committed is not None:
        rows = rows.where(F.col("id") <= committed)
    return rows.join(begun, "part", "left_semi")


def first_batch(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """One transaction's worth of rows."""
    return rows.orderBy(*order).limit(limit)


def first_of_each(rows: DataFrame, limit: int) -> DataFrame:
    """One transaction's worth of each partition's rows (id, part), by id: a backlog in one holds up no other."""
    n = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    return rows.withColumn("_n", n).where(F.col("_n") <= limit).drop("_n")


def without(dependents: DataFrame, swept: DataFrame, column: str = "message_id") -> DataFrame:
    """Dependent rows whose message stays."""
    return dependents.join(swept.select(F.col("id").alias(column)), column, "left_anti").select(dependents.columns)


def orphans(dependents: DataFrame, swept: DataFrame, column: str = "message_id") -> DataFrame:
    """Dependent rows that go with their message."""
    return dependents.join(swept.select(F.col("id").alias(column)), column, "left_semi").select(dependents.columns)


def expired_keys(keys: DataFrame, ttl: Column, now: Column) -> DataFrame:
    """Idempotency keys past their ttl; a zero ttl is not forever."""
    return keys.where(F.col("created_at") < now - ttl)


def idle_heads(heads: DataFrame, ttl: Column, now: Column) -> DataFrame:
    """Heads without a message that nobody touched within the ttl."""
    return heads.where(F.col("message_id").isNull() & (F.col("updated_at") < now - ttl))


def expired_leases(leases: DataFrame, now: Column) -> DataFrame:
    return leases.where(F.col("expires_at") < now)


def stale_waiting(declarations: DataFrame, ttl: Column, now: Column) -> DataFrame:
    """Old waiting declarations, but never the newest one of a declarer in a group."""
    newest = declarations.where("status = 'waiting'").groupBy("consumer_group_id", "declared_by").agg(F.max("id").alias("id")).select("id")
    return declarations.where((F.col("status") == "waiting") & (F.col("declared_at") < now - ttl)).join(newest, "id", "left_anti")
