"""Retries, dead letters and per-key concurrency over the sparse exception table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import retry_delay
from .claims import UNRESOLVED


def budget_left(max_retries: int) -> Column:
    return F.col("attempts") - F.col("delays") < max_retries


def claimable(exceptions: DataFrame, log: DataFrame, key_leases: DataFrame, version: int, max_retries: int, now: Column) -> DataFrame:
    """Exception rows that may run: in budget, at the group's version, due, their key free, and not behind an earlier ordered row."""
    due = ((F.col("status") == "ready") & (F.col("can_run_after") <= now)) | ((F.col("status") == "inflight") & (F.col("lease_expires_at") < now)) | (F.col("status") == "deferred")
    rows = exceptions.where(budget_left(max_retries) & due)
    at_version = log.where(F.col("schema_version") == version).select(F.col("id").alias("message_id"))
    held = key_leases.where(F.col("expires_at") > now).select("consumer_group_id", "message_key")
    first = exceptions.where(F.col("status").isin(*UNRESOLVED) & F.col("message_key").isNotNull()).groupBy("consumer_group_id", "message_key").agg(F.min("message_id").alias("_first"))
    rows = rows.join(at_version, "message_id", "left_semi").join(held, ["consumer_group_id", "message_key"], "left_anti")
    rows = rows.join(first, ["consumer_group_id", "message_key"], "left")
    behind = (F.col("concurrency") == "ordered") & (F.col("_first") < F.col("message_id"))
    return rows.where(~F.coalesce(behind, F.lit(False))).drop("_first").select(exceptions.columns)


def claimed(rows: DataFrame, limit: int, now: Column, lease: Column) -> DataFrame:
    """The first claimable rows of each group by message, taken: inflight, one attempt more, leased."""
    n = F.row_number().over(Window.partitionBy("consumer_group_id").orderBy("message_id"))
    taken = rows.withColumn("_n", n).where(F.col("_n") <= limit).drop("_n")
    return taken.withColumn("status", F.lit("inflight")).withColumn("attempts", F.col("attempts") + 1).withColumn("lease_expires_at", now + lease)


def overrun(exceptions: DataFrame, now: Column) -> DataFrame:
    """Inflight rows whose lease ran out: a logging claim writes them down as expired."""
    return exceptions.where((F.col("status") == "inflight") & (F.col("lease_expires_at") < now))


def killed(exceptions: DataFrame, max_retries: int, now: Column) -> DataFrame:
    """Rows that crashed through their budget, made dead, with a note on the last error."""
    rows = overrun(exceptions, now).where(~budget_left(max_retries))
    note = F.concat_ws("", "last_error", F.lit(" (killed: lease expired with no retries left)"))
    return rows.withColumn("status", F.lit("dead")).withColumn("last_error", note)


def transitions(events: DataFrame, max_retries: int, max_delays: int, base: int, maximum: int, exponent: float, now: Column) -> DataFrame:
    """Next state of inflight rows under their outcomes, and the log status.

    ``events`` has consumer_group_id, message_id, attempts, delays, event and delay_us, where
    event is success, failure, permanent, delayed, superseded or busy.  ``next_status`` null
    means that the row goes.
    """
    spent = F.col("attempts") - F.col("delays") >= max_retries
    e = F.col("event")
    may_delay = (e == "delayed") & (F.lit(max_delays == 0) | (F.col("delays") < max_delays))
    failed = (e == "failure") | ((e == "delayed") & ~may_delay)
    status = F.when(e == "success", F.lit(None)).when(e == "permanent", "dead").when(may_delay, "ready").when(failed & spent, "dead").when(failed, "ready")
    status = status.when(e == "superseded", "superseded").when(e == "busy", "deferred")
    given_back = e.isin("superseded", "busy")
    curve = retry_delay(F.col("attempts") - F.col("delays") - 1, F.lit(base), F.lit(maximum), F.lit(exponent))
    wait = F.when(may_delay, F.col("delay_us")).when(failed & ~spent, curve).otherwise(F.when(e == "busy", F.lit(0)))
    logged = F.when(e == "success", "success").when(may_delay, "delayed").when(e == "superseded", "superseded").when(e == "busy", "deferred").otherwise("failure")
    return events.select(
        "consumer_group_id", "message_id", "event", status.alias("next_status"), (F.col("attempts") - F.when(given_back, 1).otherwise(0)).alias("next_attempts"),
        (F.col("delays") + F.when(may_delay, 1).otherwise(0)).alias("next_delays"), (F.unix_micros(now) + wait).cast("long").alias("can_run_after_us"),
        logged.alias("log_status"), F.col("attempts").alias("log_attempt"),
    )


def verdicts(messages: DataFrame, heads: DataFrame, exceptions: DataFrame, key_leases: DataFrame, committed: DataFrame, log: DataFrame, low: int, now: Column) -> DataFrame:
    """What a keyed message of a claimed range may do: acquired, busy or superseded.

    ``messages`` has consumer_group_id, id, message_key, concurrency, compaction_rank.  A
    message that is no longer its key's head is superseded.  A key under an unexpired lease
    is busy, and so is an ordered message with an earlier unresolved exception, or an earlier
    uncommitted message of its key before the range (``low``).  A dead message holds nothing.
    """
    head = heads.select(F.col("compaction_key").alias("message_key"), F.col("message_id").alias("_head"))
    held = key_leases.where(F.col("expires_at") > now).select("consumer_group_id", "message_key").withColumn("_held", F.lit(True))
    first = exceptions.where(F.col("status").isin(*UNRESOLVED)).groupBy("consumer_group_id", "message_key").agg(F.min("message_id").alias("_first"))
    asked = messages.where("message_key is not null and concurrency = 'ordered'").select("message_key").distinct()
    before = log.where(F.col("id") <= low).join(asked, "message_key", "left_semi")
    open_log = before.join(F.broadcast(committed.select("consumer_group_id", "committed")), F.col("id") > F.col("committed"))  # a row per group
    earlier = open_log.groupBy("consumer_group_id", "message_key").agg(F.min("id").alias("_earlier"))
    m = messages.where("message_key is not null and concurrency <> 'parallel'").join(head, "message_key", "left")
    for side in (held, first, earlier):
        m = m.join(side, ["consumer_group_id", "message_key"], "left")
    behind = (F.col("concurrency") == "ordered") & (F.coalesce(F.col("_first") < F.col("id"), F.lit(False)) | F.coalesce(F.col("_earlier") < F.col("id"), F.lit(False)))
    verdict = F.when(F.col("compaction_rank").isNotNull() & ~F.col("id").eqNullSafe(F.col("_head")), "superseded").when(F.col("_held").isNotNull() | behind, "busy").otherwise("acquired")
    return m.select("consumer_group_id", "id", "message_key", verdict.alias("verdict"))


def chained(outcomes: DataFrame) -> DataFrame:
    """In-range chains of ordered keys: after a failure that is not terminal, the rest of the chain is deferred.

    ``outcomes`` has token, message_key, id and outcome; superseded and terminal outcomes let the chain go on.
    """
    stop = F.col("outcome").isin("exception", "delayed", "deferred")
    stops = outcomes.where(stop).groupBy("token", "message_key").agg(F.min("id").alias("_stop"))
    held = F.coalesce(F.col("id") > F.col("_stop"), F.lit(False))
    return outcomes.join(stops, ["token", "message_key"], "left").withColumn("outcome", F.when(held, "deferred").otherwise(F.col("outcome"))).drop("_stop")


def fanned_out(scanned: DataFrame, eligible_ids: DataFrame, existing: DataFrame) -> DataFrame:
    """New delivery rows for eligible messages of a scan; messages that have a row already are left alone."""
    new = scanned.join(eligible_ids.select("id"), "id", "left_semi").join(existing.select(F.col("message_id").alias("id")), "id", "left_anti")
    return new.select(F.col("id").alias("message_id"), F.lit("ready").alias("status"), F.lit(0).alias("attempts"), "message_key")


def fan_out_mark(log: DataFrame, committed: int, limit: int) -> DataFrame:
    """The new mark: the head, or the last scanned id when the scan was full."""
    scan = log.where(F.col("id") > committed).orderBy("id").limit(limit).agg(F.count("*").alias("n"), F.max("id").alias("last"))
    head = log.agg(F.max("id").alias("head"))
    return scan.crossJoin(head).select(F.greatest(F.lit(committed), F.when(F.col("n") >= limit, F.col("last")).otherwise(F.col("head"))).cast("long").alias("mark"))  # one row each


def lifecycle_outcome(rows: DataFrame, max_attempts: int) -> DataFrame:
    """Per-delivery path: success keeps the row as done; failure is ready at once, or dead at the last attempt."""
    failed = F.when(F.col("attempts") >= max_attempts, "dead").otherwise("ready")
    return rows.withColumn("status", F.when(F.col("event") == "success", "done").when(F.col("event") == "permanent", "dead").otherwise(failed))
