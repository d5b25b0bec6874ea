"""Alert conditions over retained measurements, and what is published about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import measurement_key  # noqa: F401  (part of the alert surface)

PENDING_S, MAX_GAP_S, REPEAT_S = 120, 120, 4 * 3600
#: Name, scope and condition of the built-in alerts (fixed values).
ALERTS = (
    ("partition_count", "stream", "partitions at or above the threshold"),
    ("compaction_read_cost", "stream", "compacted and partitions at or above 10000"),
    ("worker_liveness", "stream", "any unclaimed worker"),
    ("metrics_collector_progress", "system", "completion older than the maximum age while leases are continuous"),
)
READ_COST_PARTITIONS = 10_000


def evaluated(samples: DataFrame, subjects: DataFrame, now: Column, pending_s: int = PENDING_S, gap_s: int = MAX_GAP_S, disable_pending: bool = False) -> DataFrame:
    """State of each subject from its condition samples (subject, id, created_at, state).

    Without samples, with the newest in the future, too old or insufficient: insufficient
    evidence.  A newest sample that isn't active, or ``disable_pending``: its own state.
    Else the span of consecutive active samples back from the newest (the highest id at an
    instant counts; a gap above ``gap_s``, another state, or the window's start end it)
    decides between pending and active.
    """
    us = F.unix_micros(now)
    limit, window = gap_s * 1_000_000, (pending_s + 2 * gap_s) * 1_000_000
    s = samples.select("subject", "id", F.unix_micros("created_at").alias("at"), "state")
    newest = s.groupBy("subject").agg(F.max(F.struct("at", "id", "state")).alias("n"))
    # rows before the window can't count, so the sorted span holds a bounded time
    recent = s.where(F.col("at") >= us - window).groupBy("subject", "at").agg(F.max_by("state", "id").alias("state"))
    back = Window.partitionBy("subject").orderBy(F.desc("at"))
    stops = F.when((F.col("state") != "active") | (F.coalesce(F.lag("at").over(back), F.col("at")) - F.col("at") > limit), 1).otherwise(0)
    run = recent.withColumn("_stop", stops).withColumn("_stops", F.sum("_stop").over(back)).where("_stops = 0").groupBy("subject").agg(F.min("at").alias("since"))
    j = subjects.join(newest, "subject", "left").join(run, "subject", "left")
    at, state = F.col("n.at"), F.col("n.state")
    unknown = at.isNull() | (at > us) | (us - at > limit) | (state == "insufficient_evidence")
    own = (state != "active") | F.lit(disable_pending)
    span = at - F.coalesce("since", at)
    out = F.when(unknown, "insufficient_evidence").when(own, state).when(span >= pending_s * 1_000_000, "active").otherwise("pending")
    return j.select("subject", out.alias("state"), F.when(unknown | own, 0).otherwise(span).alias("observed_us"))


def whole(value: Column) -> Column:
    """Whether a measured value is a whole, non-negative count that fits 64 bits."""
    return F.coalesce(~F.isnan(value) & (value >= 0) & (value < 2.0**63) & (value == F.floor(value)), F.lit(False))


def partition_evidence(m: DataFrame, threshold: int, ceiling: int) -> DataFrame:
    """State by a partitions gauge; threshold 0 is half the ceiling."""
    limit = threshold or ceiling // 2
    right = F.coalesce((F.col("name") == "stream.state.partitions") & (F.col("kind") == "gauge") & (F.col("unit") == "{partition}"), F.lit(False))
    state = F.when(~right | ~whole(F.col("value")), "insufficient_evidence").when(F.col("value") >= limit, "active").otherwise("healthy")
    return m.withColumn("state", state)


def liveness_evidence(m: DataFrame) -> DataFrame:
    """State by an unclaimed-workers gauge, whose metadata must list as many workers as its value says."""
    listed = F.json_array_length(F.get_json_object("metadata", "$.workers"))
    right = F.coalesce((F.col("name") == "stream.workers.unclaimed") & (F.col("kind") == "gauge"), F.lit(False)) & whole(F.col("value"))
    sound = right & F.coalesce(listed == F.col("value"), F.lit(False))
    return m.withColumn("state", F.when(~sound, "insufficient_evidence").when(F.col("value") > 0, "active").otherwise("healthy"))


def read_cost_evidence(m: DataFrame, threshold: int = READ_COST_PARTITIONS) -> DataFrame:
    """State by partitions (value) of streams that are compacted."""
    sound = whole(F.col("value")) & F.col("compacted").isNotNull()
    return m.withColumn("state", F.when(~sound, "insufficient_evidence").when(F.col("compacted") & (F.col("value") >= threshold), "active").otherwise("healthy"))


def coverage(leases: DataFrame) -> DataFrame:
    """Start of the unbroken lease coverage that ends with each worker's latest lease: touching intervals are merged."""
    w = Window.partitionBy("worker_id").orderBy("started_at", "expires_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max("expires_at").over(w)
    island = F.sum(F.when(before.isNull() | (F.col("started_at") > before), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    spans = leases.withColumn("_island", island).groupBy("worker_id", "_island").agg(F.min("started_at").alias("start"), F.max("expires_at").alias("end"))
    last = spans.groupBy("worker_id").agg(F.max_by(F.struct("start", "end"), "_island").alias("s"), F.count("*").alias("spans"))
    return last.select("worker_id", F.unix_micros("s.start").alias("covered_from_us"), F.unix_micros("s.end").alias("covered_to_us"), "spans")


def progress_evidence(completions: DataFrame, covered: DataFrame, now: Column, poll_s: int) -> DataFrame:
    """State of collectors: completion older than max(2 minutes, three polls) while leases have covered that time.

    ``completions`` has worker_id and completed_us (null for never); uncovered time proves nothing.
    """
    us, age = F.unix_micros(now), max(120, 3 * poll_s) * 1_000_000
    j = completions.join(covered, "worker_id", "left")
    live = F.coalesce(F.col("covered_to_us") >= us, F.lit(False))
    since = F.greatest("completed_us", "covered_from_us")
    state = F.when(F.col("completed_us") > us, "insufficient_evidence").when(us - F.col("completed_us") <= age, "healthy").when(live & (us - since > age), "active").otherwise("insufficient_evidence")
    return j.select("worker_id", state.alias("state"))


def published(findings: DataFrame, heads: DataFrame, now: Column, repeat_s: int = REPEAT_S) -> DataFrame:
    """What is published: an active alert over no active head, another severity or an elapsed repeat; resolved over an active head.

    ``findings`` has subject, state and severity; pending and insufficient states publish nothing.
    """
    j = findings.join(heads.select("subject", F.col("status").alias("head"), F.col("severity").alias("head_severity"), F.col("created_at").alias("head_at")), "subject", "left")
    lapsed = F.unix_micros(now) - F.unix_micros("head_at") >= repeat_s * 1_000_000
    over = F.col("head").isNull() | (F.col("head") == "resolved") | (F.col("head_severity") != F.col("severity")) | lapsed
    status = F.when((F.col("state") == "active") & over, "active").when((F.col("state") == "healthy") & (F.col("head") == "active"), "resolved")
    return j.select("subject", "state", status.alias("published"))


def check_summary(results: DataFrame) -> DataFrame:
    """Counts of one check run: evaluated, failed (no evidence), published, resolved."""
    return results.agg(
        F.count("*").alias("streams_evaluated"), F.count_if(F.col("state") == "insufficient_evidence").alias("streams_failed"), F.count_if(F.col("published") == "active").alias("published_alerts"), F.count_if(F.col("published") == "resolved").alias("resolved_alerts")
    )
