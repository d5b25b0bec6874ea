"""Schedules: what is due, who it reaches, and how its messages fared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def listed_due(config: DataFrame, cursor: DataFrame, now: Column) -> DataFrame:
    """Unsuspended schedules whose time has come, the oldest due first."""
    return config.where("not suspended").join(cursor, config["id"] == cursor["schedule_id"]).where(F.col("next_at") <= now).orderBy("next_at", "id")


def produced(config: DataFrame, cursor: DataFrame, now, zone: str = "UTC") -> DataFrame:
    """Runs to append for due schedules, the newest due time only, with deterministic keys and the next time.

    Schedules are a control table kept by hand, so their expressions are read on the driver,
    in order of due time; the result is a table like any other.
    """
    from datetime import UTC, datetime

    from ..functions import cron
    from ..functions.expr import schedule_key_of

    at = now if isinstance(now, datetime) else datetime.fromisoformat(now).replace(tzinfo=UTC)
    rows = []
    for r in listed_due(config, cursor, F.lit(at)).select("id", "name", "cron", F.unix_micros("next_at").alias("us")).toLocalIterator():
        newest, after = cron.due(cron.schedulable(r["cron"]), datetime.fromtimestamp(r["us"] / 1e6, UTC), at)
        us = int(newest.timestamp() * 1_000_000)
        rows.append((r["id"], r["name"], us, str(schedule_key_of(us // 1000, r["id"])), int(after.timestamp() * 1_000_000) if after else None))
    return config.sparkSession.createDataFrame(rows, "schedule_id long, message_key string, scheduled_us long, idempotency_key string, next_us long")


def matching_groups(groups: DataFrame, bindings: DataFrame, names: DataFrame) -> DataFrame:
    """Groups that a routing key reaches: those with a matching pattern, and those without patterns.

    ``names`` has the routing keys as ``name`` (schedules and groups are control tables).
    """
    bound = bindings.select("consumer_group_id").distinct()
    free = groups.join(bound, groups["id"] == bound["consumer_group_id"], "left_anti")
    hit = names.select("name").join(bindings, F.rlike("name", "pattern_regex")).select("name", F.col("consumer_group_id").alias("id")).distinct()
    named = groups.select("id", F.col("name").alias("consumer_group"))
    return hit.join(named, "id").unionByName(free.select("id", F.col("name").alias("consumer_group")).crossJoin(names.select("name")).select("id", "name", "consumer_group"))


def outcomes(log_rows: DataFrame) -> DataFrame:
    """Per group and message: whether it succeeded, failed (failure, expired, killed) or was deferred."""
    s = F.col("status")
    return log_rows.groupBy("consumer_group_id", "message_id").agg(F.bool_or(s == "success").alias("succeeded"), F.bool_or(s.isin("failure", "expired", "killed")).alias("failed"), F.bool_or(s == "deferred").alias("deferred"))


def messages(log: DataFrame, outcomes: DataFrame, key: str, group: int) -> DataFrame:
    """A schedule's messages for a group: ran, succeeded, and the message that superseded each (the next of the key)."""
    w = Window.partitionBy("message_key").orderBy("id")
    m = log.where(F.col("message_key") == key).select("id", F.unix_micros("created_at").alias("created_us"), F.lead("id").over(w).alias("superseded_by"), "message_key")
    o = outcomes.where(F.col("consumer_group_id") == group)
    j = m.join(o, m["id"] == o["message_id"], "left")
    no = F.lit(False)
    return j.select("id", "created_us", (F.coalesce("succeeded", no) | F.coalesce("failed", no)).alias("ran"), F.coalesce("succeeded", no).alias("succeeded"), "superseded_by")


def status(log: DataFrame, heads: DataFrame, outcomes: DataFrame, keys: DataFrame, groups: DataFrame) -> DataFrame:
    """Per key and group: messages, those that ran, succeeded, failed or were superseded unrun.

    ``keys`` has message_key; ``groups`` the groups' ids (few: a cross join of control rows
    with one key's counts would repeat the log, so outcomes are joined and counted first).
    """
    m = log.join(keys, "message_key", "left_semi").select("id", "message_key")
    h = heads.select(F.col("message_id").alias("id"), F.lit(True).alias("is_head"))
    m = m.join(h, "id", "left").withColumn("is_head", F.coalesce("is_head", F.lit(False)))
    all_of = m.groupBy("message_key").agg(F.count("*").alias("messages"), F.count_if(~F.col("is_head")).alias("not_head"))
    ran = m.join(outcomes, m["id"] == outcomes["message_id"]).where("succeeded or failed")
    per = ran.groupBy("message_key", "consumer_group_id").agg(F.count("*").alias("ran"), F.count_if("succeeded").alias("succeeded"), F.count_if(~F.col("succeeded")).alias("failed"), F.count_if(~F.col("is_head")).alias("_old"))
    g = groups.select(F.col("id").alias("consumer_group_id"))
    out = all_of.crossJoin(F.broadcast(g)).join(per, ["message_key", "consumer_group_id"], "left")  # groups of a stream are few control rows
    zero = F.lit(0).cast("long")
    return out.select("message_key", "consumer_group_id", "messages", *[F.coalesce(c, zero).alias(c) for c in ("ran", "succeeded", "failed")], (F.col("not_head") - F.coalesce("_old", zero)).alias("superseded"))
