"""Lag, health and liveness at an instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import owner_kind
from ..sources.schema import PARTITION_SIZE
from .claims import UNRESOLVED

COUNTED_GROUPS = 1000


def groups(cursors: DataFrame, exceptions: DataFrame, leases: DataFrame, log: DataFrame, now: Column) -> DataFrame:
    """Per group: positions, backlog and inflight (not below zero), exceptions by status, age of the oldest unresolved, open leases."""
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    unresolved = F.col("status").isin(*UNRESOLVED)
    x = exceptions.groupBy("consumer_group_id").agg(*[status(s) for s in ("ready", "inflight", "deferred", "dead")], F.min(F.when(unresolved, F.unix_micros("created_at"))).alias("_oldest"))
    x = x.withColumnRenamed("inflight", "exceptions_inflight")
    opened = leases.groupBy("consumer_group_id").agg(F.count("*").alias("open_leases"))
    head = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("head"))
    all_of = cursors.crossJoin(F.broadcast(head)).join(x, "consumer_group_id", "left").join(opened, "consumer_group_id", "left")  # head is one row
    zero = F.lit(0).cast("long")
    return all_of.select(
        "consumer_group_id", "head", "claimed", "committed", F.greatest(F.col("head") - F.col("committed"), zero).alias("backlog"), F.greatest(F.col("claimed") - F.col("committed"), zero).alias("inflight"),
        *[F.coalesce(c, zero).alias(c) for c in ("ready", "exceptions_inflight", "deferred", "dead", "open_leases")], (F.unix_micros(now) - F.col("_oldest")).alias("oldest_unresolved_us"),
    )


def stream(log: DataFrame, heads: DataFrame, size: int, now: Column) -> DataFrame:
    """One row: partitions, whether anything is compacted, heads without a message and the oldest one's age."""
    p = log.agg(F.count_distinct(F.expr(f"id div {size}")).alias("partitions"))
    empty = F.col("message_id").isNull()
    h = heads.agg((F.count("*") > 0).alias("compacted"), F.count_if(empty).alias("headless"), F.min(F.when(empty, F.unix_micros("updated_at"))).alias("_oldest"))
    return p.crossJoin(h).select("partitions", "compacted", "headless", (F.unix_micros(now) - F.col("_oldest")).alias("oldest_headless_us"))  # one row each


def version_counts(log: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows and heads per payload version."""
    h = heads.where("message_id is not null").select(F.col("message_id").alias("id"), F.lit(1).alias("is_head"))
    return log.select("id", "schema_version").join(h, "id", "left").groupBy("schema_version").agg(F.count("*").alias("messages"), F.count("is_head").alias("heads"))


def version_lag(log: DataFrame, cursors: DataFrame, exceptions: DataFrame, version: int) -> DataFrame:
    """Per group: messages at a version above its committed id, and unresolved exceptions at it.

    The groups of a stream are few: a pass over the log with a conditional count per group.
    Where they are more than ``COUNTED_GROUPS``, messages are counted by id range; a group's
    count is that of the ranges above its position, and of the messages above it in its own range.
    """
    at = log.where(F.col("schema_version") == version).select("id")
    marks = cursors.select("consumer_group_id", "committed").limit(COUNTED_GROUPS + 1).collect()
    spark = log.sparkSession
    if 0 < len(marks) <= COUNTED_GROUPS:
        counted = at.agg(*[F.count_if(F.col("id") > r["committed"]).alias(f"g{i}") for i, r in enumerate(marks)])
        rows = F.explode(F.array(*[F.struct(F.lit(r["consumer_group_id"]).cast("long").alias("consumer_group_id"), F.col(f"g{i}").alias("unconsumed")) for i, r in enumerate(marks)]))
        above = counted.select(rows.alias("r")).select("r.*")
    elif not marks:
        above = spark.createDataFrame([], "consumer_group_id long, unconsumed long")
    else:
        ids, places = at.withColumn("_range", F.expr(f"id div {PARTITION_SIZE}")), cursors.withColumn("_range", F.expr(f"committed div {PARTITION_SIZE}"))
        later = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
        both = places.select("_range").distinct().join(ids.groupBy("_range").agg(F.count("*").alias("_n")), "_range", "full")
        beyond = both.select("_range", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_beyond"))
        inside = places.join(ids, "_range").where("id > committed").groupBy("consumer_group_id").agg(F.count("*").alias("_inside"))
        above = places.join(beyond, "_range").join(inside, "consumer_group_id", "left").select("consumer_group_id", (F.col("_beyond") + F.coalesce("_inside", F.lit(0))).alias("unconsumed"))
    x = exceptions.where(F.col("status").isin(*UNRESOLVED)).join(at.select(F.col("id").alias("message_id")), "message_id", "left_semi").groupBy("consumer_group_id").agg(F.count("*").alias("unresolved"))
    out = cursors.select("consumer_group_id").join(above, "consumer_group_id", "left").join(x, "consumer_group_id", "left")
    return out.select("consumer_group_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("unconsumed", "unresolved")])


def retire_verdicts(counts: DataFrame, lags: dict[int, DataFrame], names: DataFrame) -> DataFrame:
    """Whether a version can be retired: unsafe while it has heads, or while groups lag (they are named), else safe."""
    lagging = None
    for version, lag in lags.items():
        g = lag.where("unconsumed > 0 or unresolved > 0").join(names, lag["consumer_group_id"] == names["id"]).agg(F.array_sort(F.collect_list("name")).alias("groups")).withColumn("schema_version", F.lit(version))
        lagging = g if lagging is None else lagging.unionByName(g)
    joined = counts.join(lagging, "schema_version", "left")
    verdict = F.when(F.col("heads") > 0, "unsafe: heads").when(F.size("groups") > 0, F.concat(F.lit("unsafe: "), F.array_join("groups", ","))).otherwise("safe")
    return joined.select("schema_version", "messages", "heads", verdict.alias("verdict"))


def workers(config: DataFrame, instances: DataFrame, streams: DataFrame, groups: DataFrame, now: Column) -> DataFrame:
    """Per worker: live instances, worst failure streak, owner, and state (suspended, failing, claimed, unclaimed)."""
    live = F.col("expires_at") > now
    i = instances.groupBy(F.col("worker_id").alias("id")).agg(F.count_if(live).alias("live"), F.max(F.when(live, F.col("attempts"))).alias("attempts"), F.max(F.unix_micros("expires_at")).alias("_last"))
    named = config.join(i, "id", "left").join(streams.select(F.col("id").alias("stream_id"), F.col("name").alias("stream")), "stream_id", "left")
    named = named.join(groups.select(F.col("id").alias("consumer_group_id"), F.col("name").alias("consumer_group")), "consumer_group_id", "left")
    live, attempts = F.coalesce("live", F.lit(0).cast("long")), F.coalesce("attempts", F.lit(0))
    state = F.when(F.col("target_instances") == 0, "suspended").when(attempts > 0, "failing").when(live > 0, "claimed").otherwise("unclaimed")
    idle = F.unix_micros(now) - F.coalesce("_last", F.unix_micros("created_at"))
    return named.select(
        "id", "name", owner_kind(F.col("system_id"), F.col("stream_id"), F.col("consumer_group_id")).alias("owner_kind"), "stream", "consumer_group", "target_instances",
        live.alias("live"), attempts.alias("attempts"), state.alias("state"), F.when(state == "unclaimed", idle).alias("unclaimed_us"),
    )


def schedules(config: DataFrame, cursor: DataFrame, streams: DataFrame, now: Column, overdue_after_s: int = 600) -> DataFrame:
    """Per schedule: seconds past its due time, and whether that counts as overdue."""
    c = config.join(cursor, config["id"] == cursor["schedule_id"]).join(streams.select(F.col("id").alias("stream_id"), F.col("name").alias("stream")), "stream_id")
    late = ((F.unix_micros(now) - F.unix_micros("next_at")) / 1_000_000).cast("long")
    return c.select(config["id"], config["name"], "stream", "suspended", late.alias("overdue_s"), (~F.col("suspended") & (late > overdue_after_s)).alias("overdue"))
