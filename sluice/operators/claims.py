"""Claiming id ranges and committing them: arithmetic on cursors, leases and unresolved rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNRESOLVED = ("ready", "inflight", "deferred")
MAX_RECLAIMS = 3


def snapshot(cursors: DataFrame, leases: DataFrame, head: int, now: Column) -> DataFrame:
    """Per group: head, claimed, and whether an expired lease can be taken over."""
    expired = leases.where(F.col("expires_at") < now).groupBy("consumer_group_id").agg(F.count("*").alias("n"))
    return cursors.join(expired, "consumer_group_id", "left").select("consumer_group_id", F.lit(head).cast("long").alias("head"), "claimed", (F.coalesce("n", F.lit(0)) > 0).alias("reclaimable"))


def fresh_ranges(cursors: DataFrame, head: int, limit: int) -> DataFrame:
    """The next range ``(low, high]`` of each group: at most ``limit`` ids, up to the head; groups at the head have none."""
    high = F.least(F.col("claimed") + limit, F.lit(head))
    return cursors.select("consumer_group_id", F.col("claimed").alias("low"), high.alias("high")).where("high > low")


def reclaimed(leases: DataFrame, now: Column, max_reclaims: int = MAX_RECLAIMS) -> DataFrame:
    """One expired lease per group, the lowest, with its count raised; too many reclaims mean quarantine."""
    old = leases.where(F.col("expires_at") < now)
    first = old.groupBy("consumer_group_id").agg(F.min_by(F.struct("token", "low", "high", "reclaims"), F.struct("low", "token")).alias("l"))
    return first.select("consumer_group_id", "l.token", "l.low", "l.high", (F.col("l.reclaims") + 1).alias("reclaims"), (F.col("l.reclaims") >= max_reclaims).alias("quarantine"))


def surrendered(leases: DataFrame, token: str, now: Column) -> DataFrame:
    """Leases after giving one back unstarted: expired at once, and the coming takeover won't count."""
    mine = F.col("token") == token
    return leases.withColumn("expires_at", F.when(mine, now).otherwise(F.col("expires_at"))).withColumn("reclaims", F.when(mine, F.greatest(F.col("reclaims") - 1, F.lit(-1))).otherwise(F.col("reclaims")))


def quarantined(leases: DataFrame, log: DataFrame, now: Column, max_reclaims: int = MAX_RECLAIMS) -> DataFrame:
    """Every message of the ranges that were reclaimed too often, as ready exceptions, whatever its version or binding."""
    bad = reclaimed(leases, now, max_reclaims).where("quarantine").select("consumer_group_id", "low", "high")
    rows = log.join(F.broadcast(bad), (F.col("id") > F.col("low")) & (F.col("id") <= F.col("high")))  # a lease per group at most
    return rows.select("consumer_group_id", F.col("id").alias("message_id"), F.lit("ready").alias("status"), "message_key", "concurrency", F.lit(0).alias("attempts"), F.lit(0).alias("delays"))


def watermark(cursors: DataFrame, leases: DataFrame, exceptions: DataFrame) -> DataFrame:
    """committed moved to the least of open leases, unresolved messages and claimed; it never moves back."""
    open_from = leases.groupBy("consumer_group_id").agg(F.min("low").alias("lease"))
    unresolved = exceptions.where(F.col("status").isin(*UNRESOLVED)).groupBy("consumer_group_id").agg((F.min("message_id") - 1).alias("exception"))
    all_of = cursors.join(open_from, "consumer_group_id", "left").join(unresolved, "consumer_group_id", "left")
    target = F.least("lease", "exception", "claimed")
    return all_of.select("consumer_group_id", "claimed", target.alias("target"), F.greatest("committed", target).alias("committed"))


def resolved_prefix(ids: DataFrame) -> DataFrame:
    """Per range: the last id of the run of resolved messages at its start (low where there is none).

    ``ids`` has token, low, id, resolved.  The prefix ends before the first unresolved id.
    """
    g = ids.groupBy("token", "low").agg(F.min(F.when(~F.col("resolved"), F.col("id"))).alias("stop"), F.max("id").alias("high"))
    last = ids.join(g, ["token", "low"]).where(F.col("stop").isNull() | (F.col("id") < F.col("stop"))).groupBy("token", "low").agg(F.max("id").alias("last"))
    return g.join(last, ["token", "low"], "left").select("token", "low", F.coalesce("last", "low").alias("last_processed"), F.col("stop").isNull().alias("complete"))


def recorded(outcomes: DataFrame, now: Column, initial_backoff: Column) -> DataFrame:
    """Exception rows that a range's outcomes leave: success and superseded leave none.

    ``outcomes`` has consumer_group_id, message_id, outcome and delay_us.
    """
    kept = outcomes.where(~F.col("outcome").isin("success", "superseded"))
    status = F.when(F.col("outcome") == "terminal", "dead").when(F.col("outcome") == "deferred", "deferred").otherwise("ready")
    wait = F.when(F.col("outcome") == "exception", initial_backoff).when(F.col("outcome") == "delayed", F.col("delay_us")).otherwise(F.lit(0))
    return kept.select(
        "consumer_group_id", "message_id", status.alias("status"), F.lit(0).alias("attempts"), F.when(F.col("outcome") == "delayed", 1).otherwise(0).alias("delays"),
        (F.unix_micros(now) + wait).cast("long").alias("can_run_after_us"),
    )


def log_rows(outcomes: DataFrame, mode: str = "failures") -> DataFrame:
    """Delivery-log rows of outcomes at attempt 0: none in mode ``off``, successes only in mode ``all``."""
    status = F.when(F.col("outcome").isin("exception", "terminal"), "failure").otherwise(F.col("outcome"))
    rows = outcomes.select("consumer_group_id", "message_id", F.lit(0).alias("attempt"), status.alias("status"))
    return rows.where(F.lit(mode != "off")) if mode != "failures" else rows.where("status <> 'success'")
