"""Control-plane tables: bindings, workers, migrations, options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import filled, normal_json, resolved_concurrency

# bindings


def effective(declarations: DataFrame) -> DataFrame:
    """The newest installed declaration of each group."""
    return declarations.where("status = 'installed'").groupBy("consumer_group_id").agg(F.max_by(F.struct("id", "patterns", "declared_by"), "id").alias("d")).select("consumer_group_id", "d.id", "d.patterns", "d.declared_by")


def newest_declarations(declarations: DataFrame, groups: DataFrame) -> DataFrame:
    """The newest row of each group, status and declarer, with the group's name."""
    best = declarations.groupBy("consumer_group_id", "status", "declared_by").agg(F.max_by(F.struct("id", "patterns"), "id").alias("d"))
    return best.join(groups.select(F.col("id").alias("consumer_group_id"), F.col("name").alias("consumer_group")), "consumer_group_id").select("consumer_group", "consumer_group_id", "status", "declared_by", "d.id", "d.patterns")


def open_waiters(declarations: DataFrame) -> DataFrame:
    """Newest waiting rows whose declarer did not install later and whose patterns differ from the group's."""
    waiting = declarations.where("status = 'waiting'").groupBy("consumer_group_id", "declared_by").agg(F.max_by(F.struct("id", "patterns"), "id").alias("w"))
    installed = declarations.where("status = 'installed'").groupBy("consumer_group_id", "declared_by").agg(F.max("id").alias("_installed"))
    now = effective(declarations).select("consumer_group_id", F.array_sort(F.array_distinct("patterns")).alias("_now"))
    j = waiting.join(installed, ["consumer_group_id", "declared_by"], "left").join(now, "consumer_group_id", "left")
    differs = ~F.array_sort(F.array_distinct("w.patterns")).eqNullSafe(F.col("_now"))
    return j.where((F.col("_installed").isNull() | (F.col("_installed") < F.col("w.id"))) & differs).select("consumer_group_id", "declared_by", "w.id", "w.patterns")


def declaration_outcome(found: bool, stored: list[str], patterns: list[str], live: bool) -> str:
    """First declarer installs, an equal set joins, without live instances a new set installs, else it waits."""
    if not found:
        return "installed"
    if sorted(set(stored)) == sorted(set(patterns)):
        return "joined"
    return "waiting" if live else "installed"


# workers


def on_owner(workers: DataFrame, streams: DataFrame, groups: DataFrame, stream_id: int) -> DataFrame:
    """Workers of a stream and of its groups."""
    g = groups.select(F.col("id").alias("consumer_group_id"), F.col("stream_id").alias("_of"))
    return workers.join(g, "consumer_group_id", "left").where((F.col("stream_id") == stream_id) | (F.col("_of") == stream_id)).drop("_of")


def live_counts(workers: DataFrame, instances: DataFrame, now: Column) -> DataFrame:
    """Per worker: live instances, and whether another may start (target -1 is unbounded, 0 suspended)."""
    live = instances.where(F.col("expires_at") > now).groupBy(F.col("worker_id").alias("id")).agg(F.count("*").alias("live"))
    j = workers.join(live, "id", "left").withColumn("live", F.coalesce("live", F.lit(0).cast("long")))
    target = F.col("target_instances")
    return j.select("id", "target_instances", "live", ((target < 0) | (F.col("live") < target)).alias("admits"))


def reconciled(desired: DataFrame, running: DataFrame) -> DataFrame:
    """Changes that make the running workers the desired ones: start, stop, replace (other metadata), keep."""
    d = desired.select("name", normal_json(F.col("metadata")).alias("want"))
    r = running.select("name", normal_json(F.col("metadata")).alias("have"))
    j = d.join(r, "name", "full_outer")
    change = F.when(F.col("have").isNull(), "start").when(F.col("want").isNull(), "stop").when(F.col("want") != F.col("have"), "replace").otherwise("keep")
    return j.select("name", change.alias("change"))


def overlapping(log: DataFrame, start: Column, end: Column) -> DataFrame:
    """Instance history that overlaps a window, by worker and time."""
    return log.where((F.col("started_at") <= end) & (F.col("expires_at") >= start)).orderBy("worker_id", "started_at", "id")


# migrations


def schema_state(log: DataFrame, scope: str) -> DataFrame:
    """Per owner: the version of the latest success by id, and the greatest minimum that the versions up to it ask for."""
    ok = log.where((F.col("scope") == scope) & (F.col("status") == "success"))
    last = ok.groupBy("owner_id").agg(F.max_by("version", "id").alias("current"))
    floor = ok.join(last, "owner_id").where("version <= current").groupBy("owner_id").agg(F.max("min_compatible").alias("min_compatible"))
    return last.join(floor, "owner_id").select("owner_id", F.col("current").alias("version"), "min_compatible")


def support(version: Column, min_compatible: Column, build: int) -> Column:
    """Whether a build may run on a schema: not older than the build needs, not newer than it understands."""
    return F.when(version < build, "older").when(F.lit(build) < min_compatible, "newer").otherwise("supported")


# options


def resolved_options(messages: DataFrame, defaults: dict, minimum: dict, maximum: dict, override: str = "") -> DataFrame:
    """Options of stored messages as a consumer applies them: bounds before the message before the defaults.

    ``messages`` has max_retries, timeout_ms and concurrency; zero and the empty string are unset.
    """
    def bounded(c: str) -> Column:
        v = filled(F.col(c), F.lit(defaults[c]))
        v = F.greatest(v, F.lit(minimum[c])) if minimum.get(c) else v
        return F.least(v, F.lit(maximum[c])) if maximum.get(c) else v

    policy = resolved_concurrency(F.col("concurrency"), F.lit(defaults.get("concurrency", "")), F.lit(override))
    return messages.withColumns({"max_retries": bounded("max_retries"), "timeout_ms": bounded("timeout_ms"), "concurrency": policy})
