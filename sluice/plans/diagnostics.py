"""Diagnostic reads attached to condition codes: small filters over the log and control tables.

``REGISTERED`` maps a query name to its plan over ``Tables`` and its oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.fixtures import PARTITION, now

REGISTERED: dict = {}


def diagnostic(name: str, oracle: str):
    def register(f):
        REGISTERED[f"diag_{name}"] = (f, oracle)
        return f

    return register


def _group(df, group=1):
    return df.where(F.col("consumer_group_id") == group)


@diagnostic("sql0019_outcomes_at_commit", "SELECT message_id, status FROM exception_queue WHERE consumer_group_id = 1 ORDER BY updated_at DESC, message_id DESC LIMIT 20")
def _(t):
    return _group(t.exception_queue).orderBy(F.desc("updated_at"), F.desc("message_id")).limit(20).select("message_id", "status")


@diagnostic("sql0019_range_lease", "SELECT token, low, high FROM claim_lease WHERE token = 't2'")
def _(t):
    return t.claim_lease.where("token = 't2'").select("token", "low", "high")


@diagnostic("sql0066_head_row", "SELECT compaction_key, message_id FROM compaction_head WHERE compaction_key = 'user:9'")
def _(t):
    return t.compaction_head.where("compaction_key = 'user:9'").select("compaction_key", "message_id")


@diagnostic("sql0066_messages_of_key", "SELECT id, compaction_rank FROM message_log WHERE message_key = 'user:9' ORDER BY id DESC LIMIT 20")
def _(t):
    return t.message_log.where("message_key = 'user:9'").orderBy(F.desc("id")).limit(20).select("id", "compaction_rank")


@diagnostic("sql0014_groups_of_stream", "SELECT s.name AS stream, g.name AS consumer_group FROM consumer_group_config g JOIN stream_config s ON s.id = g.stream_id WHERE s.name = 'orders'")
def _(t):
    s = t.stream_config.where("name = 'orders'").select(F.col("id").alias("stream_id"), F.col("name").alias("stream"))
    return t.consumer_group_config.join(s, "stream_id").select("stream", F.col("name").alias("consumer_group"))


@diagnostic("sql0014_group_row", "SELECT CAST(id AS BIGINT) AS id, name FROM consumer_group_config WHERE id = 2")
def _(t):
    return t.consumer_group_config.where("id = 2").select("id", "name")


@diagnostic("sql0014_cursor_row", "SELECT claimed, committed FROM consumer_group_cursor WHERE consumer_group_id = 2")
def _(t):
    return _group(t.consumer_group_cursor, 2).select("claimed", "committed")


@diagnostic("sql0015_live_instances", "SELECT i.token, w.id FROM worker_instance i JOIN worker_config w ON w.id = i.worker_id WHERE w.consumer_group_id = 1 AND i.expires_at > NOW()")
def _(t):
    w = _group(t.worker_config).select(F.col("id"))
    return t.worker_instance.where(F.col("expires_at") > now()).join(w, F.col("worker_id") == F.col("id")).select("token", "id")


@diagnostic("sql0016_rows_by_status", "SELECT status, count(*) AS n FROM exception_queue WHERE consumer_group_id = 1 GROUP BY 1")
def _(t):
    return _group(t.exception_queue).groupBy("status").agg(F.count("*").alias("n"))


@diagnostic("sql0016_dead_rows", "SELECT message_id, last_error FROM exception_queue WHERE consumer_group_id = 1 AND status = 'dead'")
def _(t):
    return _group(t.exception_queue).where("status = 'dead'").orderBy("message_id").select("message_id", "last_error")


@diagnostic("sql0026_leases_of_group", "SELECT token, low, high, reclaims FROM claim_lease WHERE consumer_group_id = 1")
def _(t):
    return _group(t.claim_lease).orderBy("low").select("token", "low", "high", "reclaims")


@diagnostic("sql0026_left_by_reclaimed_range", "SELECT message_id, status FROM exception_queue e JOIN claim_lease l ON l.token = 't1' AND e.consumer_group_id = l.consumer_group_id AND message_id BETWEEN l.low + 1 AND l.high")
def _(t):
    n = t.max_id * 80 // 100
    return _group(t.exception_queue).where(F.col("message_id").between(n + 1, n + t.max_id // 100)).orderBy("message_id").select("message_id", "status")


@diagnostic("sql0027_quarantined_exceptions", "SELECT message_id, attempts FROM exception_queue e JOIN claim_lease l ON l.token = 't2' AND e.consumer_group_id = l.consumer_group_id AND message_id BETWEEN l.low + 1 AND l.high")
def _(t):
    n = t.max_id * 85 // 100
    return _group(t.exception_queue).where(F.col("message_id").between(n + 1, n + t.max_id // 100)).orderBy("message_id").select("message_id", "attempts")


@diagnostic("sql0027_messages_in_range", "SELECT id, schema_version, payload FROM message_log m JOIN claim_lease l ON l.token = 't2' AND m.id BETWEEN l.low + 1 AND l.high")
def _(t):
    n = t.max_id * 85 // 100
    return t.message_log.where(F.col("id").between(n + 1, n + t.max_id // 100)).orderBy("id").select("id", "schema_version", "payload")


@diagnostic("sql0028_dead_newest_first", "SELECT message_id, attempts FROM exception_queue WHERE consumer_group_id = 2 AND status = 'dead'")
def _(t):
    return _group(t.exception_queue, 2).where("status = 'dead'").orderBy(F.desc("updated_at")).select("message_id", "attempts")


@diagnostic("sql0028_errors_of_dead", "SELECT last_error, count(*) AS n FROM exception_queue WHERE consumer_group_id = 1 AND status = 'dead' GROUP BY 1")
def _(t):
    return _group(t.exception_queue).where("status = 'dead'").groupBy("last_error").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


_ONE = "(SELECT min(message_id) FROM delivery_log)"


def _first_logged(t):
    return t.delivery_log.agg(F.min("message_id")).first()[0]


@diagnostic("sql0029_delivery_row", f"SELECT message_id, attempt, status FROM delivery_log WHERE message_id = {_ONE} AND attempt = 0")
def _(t):
    return t.delivery_log.where((F.col("message_id") == _first_logged(t)) & (F.col("attempt") == 0)).select("message_id", "attempt", "status")


@diagnostic("sql0029_attempts_oldest_first", f"SELECT attempt, status, error FROM delivery_log WHERE message_id = {_ONE}")
def _(t):
    return t.delivery_log.where(F.col("message_id") == _first_logged(t)).orderBy("attempt").select("attempt", "status", "error")


@diagnostic("sql0029_message", f"SELECT id, payload FROM message_log WHERE id = {_ONE}")
def _(t):
    return t.message_log.where(F.col("id") == _first_logged(t)).select("id", "payload")


@diagnostic("sql0030_dead_exception", "SELECT message_id, status, attempts FROM exception_queue WHERE consumer_group_id = 1 AND message_id = (SELECT min(message_id) FROM exception_queue WHERE consumer_group_id = 1 AND status = 'dead')")
def _(t):
    dead = _group(t.exception_queue).where("status = 'dead'")
    return dead.orderBy("message_id").limit(1).select("message_id", "status", "attempts")


@diagnostic("sql0030_attempts_of_exceptions", "SELECT d.message_id, d.attempt, d.status FROM delivery_log d WHERE d.consumer_group_id = 1 AND d.message_id IN (SELECT message_id FROM exception_queue WHERE consumer_group_id = 1 AND status = 'dead')")
def _(t):
    dead = _group(t.exception_queue).where("status = 'dead'").select("message_id")
    return _group(t.delivery_log).join(dead, "message_id", "left_semi").select("message_id", "attempt", "status")


@diagnostic("sql0031_killed_attempts", "SELECT message_id, attempt FROM delivery_log WHERE consumer_group_id = 1 AND status = 'killed' ORDER BY attempted_at DESC, message_id DESC, attempt DESC LIMIT 20")
def _(t):
    return _group(t.delivery_log).where("status = 'killed'").orderBy(F.desc("attempted_at"), F.desc("message_id"), F.desc("attempt")).limit(20).select("message_id", "attempt")


@diagnostic("sql0031_killed_rows", "SELECT message_id, last_error FROM exception_queue WHERE consumer_group_id = 1 AND status = 'dead' AND last_error LIKE '%2'")
def _(t):
    return _group(t.exception_queue).where("status = 'dead' and last_error like '%2'").orderBy(F.desc("updated_at")).select("message_id", "last_error")


@diagnostic("sql0060_group_worker_config", "SELECT w.name, w.metadata FROM worker_config w JOIN consumer_group_config g ON g.id = w.consumer_group_id WHERE g.name = 'billing'")
def _(t):
    g = t.consumer_group_config.where("name = 'billing'").select(F.col("id").alias("consumer_group_id"))
    return t.worker_config.join(g, "consumer_group_id").orderBy("id").select("name", "metadata")


@diagnostic("sql0022_migrations_newest_first", "SELECT CAST(id AS BIGINT) AS id, version, status FROM migration_log ORDER BY id DESC LIMIT 5")
def _(t):
    return t.migration_log.orderBy(F.desc("id")).limit(5).select("id", "version", "status")


@diagnostic("sql0023_migrations_newest_first", "SELECT CAST(id AS BIGINT) AS id, scope, CAST(owner_id AS BIGINT) AS owner_id, version, status FROM migration_log ORDER BY id DESC LIMIT 5")
def _(t):
    return t.migration_log.orderBy(F.desc("id")).limit(5).select("id", "scope", "owner_id", "version", "status")


@diagnostic("sql0023_floor_raised_by", "SELECT CAST(id AS BIGINT) AS id, version FROM migration_log WHERE status = 'success' AND min_compatible > 1")
def _(t):
    return t.migration_log.where("status = 'success' and min_compatible > 1").orderBy("id").select("id", "version")


@diagnostic("sql0062_schedule_row", "SELECT CAST(id AS BIGINT) AS id, suspended FROM schedule_config WHERE name = 'view.2'")
def _(t):
    return t.schedule_config.where("name = 'view.2'").select("id", "suspended")


@diagnostic("sql0005_stream_by_name", "SELECT CAST(id AS BIGINT) AS id FROM stream_config WHERE name = 'orders'")
def _(t):
    return t.stream_config.where("name = 'orders'").select("id")


@diagnostic("sql0005_stream_by_id", "SELECT name FROM stream_config WHERE id = 3")
def _(t):
    return t.stream_config.where("id = 3").select("name")


@diagnostic("sql0005_streams", "SELECT name FROM stream_config")
def _(t):
    return t.stream_config.orderBy("name").select("name")


@diagnostic("sql0006_messages_at_stake", "SELECT count(*) AS messages, max(id) AS newest FROM message_log")
def _(t):
    return t.message_log.agg(F.count("*").alias("messages"), F.max("id").alias("newest"))


@diagnostic("sql0006_newest_messages", "SELECT id, epoch_us(created_at) AS created_us FROM message_log ORDER BY id DESC LIMIT 10")
def _(t):
    return t.message_log.orderBy(F.desc("id")).limit(10).select("id", F.unix_micros("created_at").alias("created_us"))


@diagnostic("sql0020_partitions_attached", f"SELECT 'orders' AS stream, id // {PARTITION} AS part, count(*) AS rows FROM message_log GROUP BY 2")
def _(t):
    return t.message_log.groupBy(F.expr(f"id div {PARTITION}").alias("part")).agg(F.count("*").alias("rows")).select(F.lit("orders").alias("stream"), "part", "rows")


@diagnostic("sql0020_still_producing", "SELECT max(id) AS head, epoch_us(max(created_at)) AS newest_us FROM message_log")
def _(t):
    return t.message_log.agg(F.max("id").alias("head"), F.unix_micros(F.max("created_at")).alias("newest_us"))


@diagnostic("sql0061_declarations_newest_first", "SELECT CAST(id AS BIGINT) AS id, status, declared_by FROM binding_config_log WHERE consumer_group_id = 1 ORDER BY id DESC LIMIT 10")
def _(t):
    return _group(t.binding_config_log).orderBy(F.desc("id")).limit(10).select("id", "status", "declared_by")


@diagnostic("sql0034_instances_of_worker", "SELECT i.token, w.name FROM worker_instance i JOIN worker_config w ON w.id = i.worker_id WHERE w.name = 'worker3' AND i.expires_at > NOW()")
def _(t):
    w = t.worker_config.where("name = 'worker3'").select(F.col("id").alias("worker_id"), "name")
    return t.worker_instance.where(F.col("expires_at") > now()).join(w, "worker_id").select("token", "name")


@diagnostic("sql0035_suspended_workers", "SELECT id, name FROM worker_config WHERE target_instances = 0")
def _(t):
    return t.worker_config.where("target_instances = 0").orderBy("id").select("id", "name")


@diagnostic("sql0036_failure_streaks", "SELECT w.id, i.token, i.attempts FROM worker_config w LEFT JOIN worker_instance i ON i.worker_id = w.id WHERE w.name = 'worker3'")
def _(t):
    i = t.worker_instance.select(F.col("worker_id").alias("id"), "token", "attempts")
    return t.worker_config.where("name = 'worker3'").join(i, "id", "left").select("id", "token", "attempts")


@diagnostic("sql0059_worker_declarations", "SELECT id, metadata FROM worker_config WHERE name = 'worker1' ORDER BY created_at DESC, id LIMIT 10")
def _(t):
    return t.worker_config.where("name = 'worker1'").orderBy(F.desc("created_at"), "id").limit(10).select("id", "metadata")
