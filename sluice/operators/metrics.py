"""Measurements: collection from snapshots, series reads, routine pairing, export."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import measurement_key

#: Name, kind, unit and scope of the gauges and counters that the engine writes itself (fixed values).
CATALOGUE = {
    "consumer.session": ("counter", "consumer_session", {
        "claimed": "{message}", "success": "{message}", "superseded": "{message}", "ready": "{message}", "deferred": "{message}", "dead": "{message}",
        "reclaimed": "{lease}", "quarantined": "{range}", "abandoned": "{routine}", "lease_lost": "{commit}",
    }),
    "worker.state": ("gauge", "system", {"unclaimed_workers": "{worker}", "oldest_unclaimed_age": "ms", "failing_workers": "{worker}"}),
    "schedule.state": ("gauge", "system", {"overdue": "{found}", "oldest_due_age": "ms", "suspended": "{found}"}),
    "alert.state": ("gauge", "system", {"active_alerts": "{alert}", "resolved_alerts": "{alert}"}),
    "alert.check": ("gauge", "system", {"streams_evaluated": "{stream}", "streams_failed": "{stream}", "published_alerts": "{alert}", "resolved_alerts": "{alert}"}),
    "stream.state": ("gauge", "stream", {"compacted": "", "partitions": "{partition}"}),
    "stream.workers": ("gauge", "stream", {"unclaimed": "{worker}"}),
    "consumer.cursor": ("gauge", "consumer_group", {"head": "{message}", "claimed": "{message}", "committed": "{message}", "backlog": "{message}", "inflight": "{message}"}),
    "consumer.exceptions": ("gauge", "consumer_group", {"ready": "{exception}", "inflight": "{exception}", "deferred": "{exception}", "dead": "{exception}", "oldest_unresolved_age": "ms"}),
    "consumer": ("gauge", "consumer_group", {"open_leases": "{lease}"}),
    "consumer.abandoned_routines": ("gauge", "consumer_group", {"outstanding": "{routine}", "total": "{routine}", "self_clear_latency_avg": "ms"}),
    "metrics.collector": ("gauge", "system", {"completed_timestamp": "s"}),
    "otel": ("gauge", "exporter", {"source.read_success": "", "measurements.rejected": "{measurement}"}),
}


def definitions(scope: str | None = None) -> list[tuple[str, str, str, str]]:
    """Name, kind, unit and scope of every built-in metric, in order of name."""
    found = [(f"{family}.{m}", kind, unit, where) for family, (kind, where, members) in CATALOGUE.items() for m, unit in members.items()]
    return sorted(x for x in found if scope is None or x[3] == scope)


def gauges(df: DataFrame, names: dict[str, str], attributes: Column, at: Column) -> DataFrame:
    """Unpivot snapshot columns into measurements: name, value, attributes, key, at; nulls are not measured."""
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("value")) for c, name in names.items()])
    rows = df.select(attributes.alias("attributes"), F.explode(pairs).alias("m")).select("m.name", "m.value", "attributes").where("value is not null")
    return rows.select("name", "value", "attributes", measurement_key(F.col("name"), F.col("attributes")).alias("message_key"), at.alias("at"))


GROUP_GAUGES = {
    "head": "consumer.cursor.head", "claimed": "consumer.cursor.claimed", "committed": "consumer.cursor.committed", "backlog": "consumer.cursor.backlog", "inflight": "consumer.cursor.inflight",
    "ready": "consumer.exceptions.ready", "exceptions_inflight": "consumer.exceptions.inflight", "deferred": "consumer.exceptions.deferred", "dead": "consumer.exceptions.dead", "open_leases": "consumer.open_leases",
}


def group_gauges(snapshot: DataFrame, names: DataFrame, stream: str, at: Column) -> DataFrame:
    """All gauges of all groups in one pass over their snapshot."""
    n = snapshot.join(names.select(F.col("id").alias("consumer_group_id"), F.col("name").alias("group")), "consumer_group_id")
    return gauges(n, GROUP_GAUGES, F.create_map(F.lit("stream"), F.lit(stream), F.lit("group"), F.col("group")), at)


def session_counters(outcomes: DataFrame, attributes: Column, at: Column) -> DataFrame:
    """Counters of a consumer session from its outcomes: what was claimed, and where each message went."""
    n = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    one = outcomes.agg(F.count("*").alias("claimed"), n("success").alias("success"), n("superseded").alias("superseded"), n("exception", "delayed").alias("ready"), n("deferred").alias("deferred"), n("terminal").alias("dead"))
    return gauges(one, {c: f"consumer.session.{c}" for c in one.columns}, attributes, at)


def worker_gauges(workers: DataFrame, at: Column) -> DataFrame:
    """System gauges of a worker snapshot."""
    is_ = lambda s: F.count_if(F.col("state") == s)
    one = workers.agg(is_("unclaimed").alias("a"), (F.max("unclaimed_us") / 1000).cast("long").alias("b"), is_("failing").alias("c"))
    return gauges(one, {"a": "worker.state.unclaimed_workers", "b": "worker.state.oldest_unclaimed_age", "c": "worker.state.failing_workers"}, F.lit(None).cast("map<string,string>"), at)


def schedule_gauges(schedules: DataFrame, at: Column) -> DataFrame:
    """System gauges of a schedule snapshot."""
    due = ~F.col("suspended") & (F.col("overdue_s") > 0)
    one = schedules.agg(F.count_if("overdue").alias("a"), F.max(F.when(due, F.col("overdue_s") * 1000)).alias("b"), F.count_if("suspended").alias("c"))
    return gauges(one, {"a": "schedule.state.overdue", "b": "schedule.state.oldest_due_age", "c": "schedule.state.suspended"}, F.lit(None).cast("map<string,string>"), at)


def alert_gauges(heads: DataFrame, at: Column) -> DataFrame:
    """Active and resolved alerts, by their latest publication."""
    one = heads.agg(F.count_if(F.col("status") == "active").alias("a"), F.count_if(F.col("status") == "resolved").alias("b"))
    return gauges(one, {"a": "alert.state.active_alerts", "b": "alert.state.resolved_alerts"}, F.lit(None).cast("map<string,string>"), at)


def stream_gauges(snapshot: DataFrame, stream: str, unclaimed: int, at: Column) -> DataFrame:
    """Gauges of one stream's snapshot row."""
    one = snapshot.select("partitions", F.col("compacted").cast("int").alias("compacted"), F.lit(unclaimed).alias("unclaimed"))
    return gauges(one, {"partitions": "stream.state.partitions", "compacted": "stream.state.compacted", "unclaimed": "stream.workers.unclaimed"}, F.create_map(F.lit("stream"), F.lit(stream)), at)


def keyed(measurements: DataFrame) -> DataFrame:
    return measurements.withColumn("message_key", measurement_key(F.col("name"), F.col("attributes")))


def latest_series(measurements: DataFrame) -> DataFrame:
    """The newest measurement of each series."""
    best = keyed(measurements).groupBy("message_key").agg(F.max_by(F.struct("name", "kind", "unit", "value", "at"), F.struct("at", "id")).alias("m"))
    return best.select("message_key", "m.*")


def series(measurements: DataFrame, key: str, start: Column, end: Column) -> DataFrame:
    """A series' measurements in an inclusive window, newest first; retention must exceed the window."""
    return keyed(measurements).where((F.col("message_key") == key) & F.col("at").between(start, end)).orderBy(F.desc("at"), F.desc("id"))


def filtered_series(measurements: DataFrame, name: str, attributes: dict[str, str], limit: int) -> DataFrame:
    """The latest of at most ``limit`` series of a metric that have all the given attributes, by key."""
    wanted = F.lit(True)
    for k, v in attributes.items():
        wanted = wanted & (F.element_at("attributes", k) == v)
    return latest_series(measurements.where((F.col("name") == name) & F.coalesce(wanted, F.lit(False)))).orderBy("message_key").limit(limit)


def routine_pairs(events: DataFrame) -> DataFrame:
    """Abandoned routines per group: all, still outstanding, and mean time to clear themselves (whole microseconds).

    ``events`` has routing_key and a JSON payload with type, message_id, attempt and at_us;
    the earliest event of each kind counts for a message's attempt.
    """
    j = lambda k, t: F.get_json_object("payload", f"$.{k}").cast(t)
    e = events.select("routing_key", j("type", "string").alias("type"), j("message_id", "long").alias("message_id"), j("attempt", "int").alias("attempt"), j("at_us", "long").alias("at_us"))
    at = lambda kind: F.min(F.when(F.col("type") == kind, F.col("at_us")))
    pairs = e.groupBy("routing_key", "message_id", "attempt").agg(at("abandoned").alias("a"), at("cleared").alias("c")).where("a is not null")
    done = F.col("c").isNotNull()
    return pairs.groupBy("routing_key").agg(F.count("*").alias("total"), F.count_if(~done).alias("outstanding"), F.expr("sum(if(c is null, 0, c - a)) div nullif(count(c), 0)").alias("latency_us"))


# export


def export_name(name: Column, unit: Column, kind: Column) -> Column:
    """A metric's name in the text format: other characters become underscores, unit and counter suffixes are added."""
    plain = F.regexp_replace(name, "[^a-zA-Z0-9_:]", "_")
    plain = F.when(plain.rlike("^[0-9]"), F.concat(F.lit("_"), plain)).otherwise(plain)
    suffix = F.when(unit == "ms", "_milliseconds").when(unit == "s", "_seconds").otherwise("")
    plain = F.when((suffix != "") & ~F.endswith(plain, suffix), F.concat(plain, suffix)).otherwise(plain)
    return F.when((kind == "counter") & ~F.endswith(plain, F.lit("_total")), F.concat(plain, F.lit("_total"))).otherwise(plain)


def families(latest: DataFrame) -> DataFrame:
    """Export families and whether they are rejected whole: kinds or units that differ under one exported name."""
    e = latest.withColumn("export_name", export_name(F.col("name"), F.col("unit"), F.col("kind")))
    g = e.groupBy("export_name").agg(F.count("*").alias("series"), F.count_distinct("name", "kind", "unit").alias("variants"))
    return g.select("export_name", "series", (F.col("variants") > 1).alias("rejected"))


def exposition(latest: DataFrame, read_ok: bool = True) -> DataFrame:
    """Lines of the text format, sorted by family, with the exporter's own gauges."""
    e = latest.withColumn("export_name", export_name(F.col("name"), F.col("unit"), F.col("kind")))
    good = e.join(families(latest).where("not rejected"), "export_name", "left_semi")
    labels = F.regexp_extract("message_key", r"^[^|]*\|(.*)$", 1)
    shown = F.when(labels == "", "").otherwise(F.concat(F.lit("{"), F.regexp_replace(labels, "([^,=]+)=([^,]*)", '$1="$2"'), F.lit("}")))
    lines = good.select(F.concat("export_name", shown, F.lit(" "), F.col("value").cast("string")).alias("line"))
    own = latest.sparkSession.range(1).select(F.lit(f"otel_source_read_success {1 if read_ok else 0}").alias("line"))
    return lines.unionByName(own)


def valid_label(name: str) -> bool:
    return re.fullmatch(r"[a-zA-Z_][a-zA-Z0-9_]*", name) is not None
