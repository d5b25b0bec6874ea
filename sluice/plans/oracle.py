"""The derived tables of ``sources.fixtures`` written down again in plain SQL, for independent comparison."""

from __future__ import annotations

NOW = "TIMESTAMP '2024-01-31 00:00:00'"

TABLES: dict[str, str] = {
    "message_log": """
        SELECT event_id + 1 AS id, CASE WHEN event_id % 10 = 0 THEN 2 ELSE 1 END AS schema_version,
               CASE WHEN event_id % 17 <> 0 THEN event_type || '.' || CAST(user_id % 4 AS VARCHAR) END AS routing_key,
               CASE WHEN event_id % 5 <> 0 THEN 'user:' || CAST(user_id AS VARCHAR) END AS message_key,
               CASE WHEN event_id % 5 <> 0 AND event_id % 2 = 0 THEN CAST(floor(value) AS BIGINT) END AS compaction_rank, props AS payload,
               CASE event_id % 7 WHEN 0 THEN 'exclusive' WHEN 1 THEN 'ordered' ELSE 'parallel' END AS concurrency, ts AS created_at
        FROM events""",
    "bounds": "SELECT max(id) AS n FROM message_log",
    "kept_head": """
        SELECT message_key AS compaction_key, id AS message_id, schema_version, compaction_rank, created_at, created_at AS updated_at FROM (
            SELECT *, row_number() OVER (PARTITION BY message_key ORDER BY schema_version DESC, compaction_rank DESC, id DESC) AS rn
            FROM message_log WHERE compaction_rank IS NOT NULL AND message_key IS NOT NULL) WHERE rn = 1""",
    "compaction_head": f"""
        SELECT * FROM kept_head UNION ALL
        SELECT 'idle:' || CAST(s_suppkey AS VARCHAR), NULL, NULL, NULL, {NOW} - to_hours(s_suppkey % 100), {NOW} - to_hours(s_suppkey % 100) FROM supplier""",
    "binding_config": "SELECT * FROM (VALUES (1, 'click.*', '^click[.].*$'), (1, 'error.1', '^error[.]1$'), (2, '*.2', '^.*[.]2$')) AS b(consumer_group_id, pattern, pattern_regex)",
    "consumer_group_config": "SELECT * FROM (VALUES (1, 1, 'billing'), (2, 1, 'audit'), (3, 1, 'search'), (4, 2, 'idle')) AS g(id, stream_id, name)",
    "consumer_group_cursor": """
        SELECT CAST(1 AS BIGINT) AS consumer_group_id, n * 9 // 10 AS claimed, n * 4 // 10 AS committed FROM bounds
        UNION ALL SELECT 2, n, n * 95 // 100 FROM bounds UNION ALL SELECT 3, n * 6 // 10, n * 6 // 10 FROM bounds""",
    "exception_queue": f"""
        SELECT consumer_group_id, id AS message_id, CASE id % 11 WHEN 0 THEN 'dead' WHEN 1 THEN 'inflight' WHEN 2 THEN 'deferred' WHEN 3 THEN 'superseded' ELSE 'ready' END AS status,
               message_key, concurrency, CAST(id % 5 AS INTEGER) AS attempts, CASE WHEN id % 13 = 0 THEN 1 ELSE 0 END AS delays,
               CASE WHEN id % 3 = 0 THEN {NOW} + INTERVAL 1 HOUR ELSE {NOW} - INTERVAL 1 HOUR END AS can_run_after, CASE WHEN id % 5 <> 0 THEN 'error ' || CAST(id % 4 AS VARCHAR) END AS last_error,
               CASE WHEN id % 11 = 1 THEN CASE WHEN id % 2 = 0 THEN {NOW} - INTERVAL 10 MINUTE ELSE {NOW} + INTERVAL 10 MINUTE END END AS lease_expires_at, created_at, created_at AS updated_at
        FROM message_log JOIN consumer_group_cursor ON (id + consumer_group_id) % 23 = 0 AND id > committed AND id <= claimed""",
    "claim_lease": f"""
        SELECT CAST(1 AS BIGINT) AS consumer_group_id, 't1' AS token, n * 80 // 100 AS low, n * 80 // 100 + n // 100 AS high, {NOW} - INTERVAL 5 MINUTE AS expires_at, 1 AS reclaims FROM bounds
        UNION ALL SELECT 1, 't2', n * 85 // 100, n * 85 // 100 + n // 100, {NOW} - INTERVAL 1 MINUTE, 3 FROM bounds
        UNION ALL SELECT 2, 't3', n * 99 // 100, n, {NOW} + INTERVAL 5 MINUTE, 0 FROM bounds""",
    "message_key_lease": f"""
        SELECT 1 + c_custkey % 2 AS consumer_group_id, 'user:' || CAST(c_custkey AS VARCHAR) AS message_key,
               CASE WHEN c_custkey % 11 = 0 THEN {NOW} + INTERVAL 1 MINUTE ELSE {NOW} - INTERVAL 1 MINUTE END AS expires_at
        FROM customer""",
    "delivery_log": """
        SELECT 1 + id % 2 AS consumer_group_id, id AS message_id, attempt,
               CASE (id + attempt) % 6 WHEN 0 THEN 'success' WHEN 1 THEN 'expired' WHEN 2 THEN 'deferred' WHEN 3 THEN 'killed' ELSE 'failure' END AS status,
               'error ' || CAST(id % 4 AS VARCHAR) AS error, created_at + to_minutes(attempt) AS attempted_at
        FROM message_log, (VALUES (0), (1), (2)) AS a(attempt) WHERE id % 9 = 0""",
    "idempotency_key": f"SELECT 'order-' || CAST(o_orderkey AS VARCHAR) AS idempotency_key, {NOW} - to_hours(o_orderkey % 50) AS created_at FROM orders",
    "produced": """
        SELECT l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_orderkey % 2 = 0 THEN 'order-' ELSE 'line-' END || CAST(l_orderkey AS VARCHAR) AS idempotency_key,
               max('part:' || CAST(l_partkey % 40 AS VARCHAR)) AS message_key, max(l_partkey) AS compaction_rank
        FROM lineitem GROUP BY 1, 2""",
    "binding_config_log": f"""
        SELECT *, {NOW} - to_hours(20 - id) AS declared_at FROM (VALUES
            (1, 1, 'installed', ['click.*'], 'a'), (2, 1, 'waiting', ['click.*', 'error.1'], 'b'), (3, 1, 'waiting', ['error.1'], 'c'), (4, 1, 'installed', ['click.*', 'error.1'], 'b'),
            (5, 2, 'installed', ['*.2'], 'a'), (6, 2, 'waiting', ['*.3'], 'd'), (7, 2, 'waiting', ['*.2'], 'e'), (8, 2, 'waiting', ['*.4'], 'd'), (9, 1, 'waiting', ['view.*'], 'c'))
        AS d(id, consumer_group_id, status, patterns, declared_by)""",
    "stream_config": "SELECT * FROM (VALUES (1, 'orders'), (2, '__system.metrics'), (3, '__system.alerts')) AS s(id, name)",
    "worker_config": f"""
        SELECT s_suppkey AS id, 'worker' || CAST(s_nationkey % 5 AS VARCHAR) AS name, CASE WHEN s_suppkey % 3 = 2 THEN 1 END AS system_id, CASE WHEN s_suppkey % 3 = 1 THEN 1 + s_suppkey % 3 END AS stream_id,
               CASE WHEN s_suppkey % 3 = 0 THEN 1 + s_suppkey % 4 END AS consumer_group_id, CAST(s_suppkey % 4 - 1 AS INTEGER) AS target_instances,
               '{{"rate": ' || CAST(s_suppkey % 7 AS VARCHAR) || '}}' AS metadata, {NOW} - to_hours(s_suppkey) AS created_at FROM supplier""",
    "worker_instance": f"""
        SELECT c_custkey AS n, c_custkey % 97 AS worker_id, 'i' || CAST(c_custkey AS VARCHAR) AS token,
               CASE WHEN c_custkey % 4 = 0 THEN {NOW} + INTERVAL 30 SECOND ELSE {NOW} - to_minutes(c_custkey % 60 + 1) END AS expires_at,
               CAST(c_custkey % 3 AS INTEGER) AS attempts, {NOW} - to_hours(c_custkey % 200) AS created_at FROM customer""",
    "worker_instance_log": "SELECT event_id AS id, user_id % 10 AS worker_id, ts AS started_at, ts + to_minutes(1 + event_id % 30) AS expires_at FROM events",
    "schedule_config": "SELECT * FROM (VALUES (1, 'click.1', 1, false), (2, 'error.1', 1, false), (3, 'view.2', 1, true), (4, 'signup.3', 1, false)) AS s(id, name, stream_id, suspended)",
    "schedule_cursor": f"SELECT schedule_id, {NOW} + to_minutes(m) AS next_at FROM (VALUES (1, -31), (2, -5), (3, -500), (4, 60)) AS s(schedule_id, m)",
    "migration_log": """SELECT * FROM (VALUES (1, 'system', 1, 1, 1, 'success'), (2, 'stream', 1, 1, 1, 'success'), (3, 'system', 1, 2, 1, 'failure'), (4, 'system', 1, 2, 1, 'success'),
        (5, 'stream', 1, 2, 2, 'success'), (6, 'stream', 2, 1, 1, 'success'), (7, 'stream', 1, 3, 2, 'failure')) AS m(id, scope, owner_id, version, min_compatible, status)""",
    "measurement": """
        SELECT min(event_id) AS id, 'app.' || event_type AS name, CASE WHEN event_type = 'error' THEN 'counter' ELSE 'gauge' END AS kind, '{event}' AS unit, CAST(count(*) AS DOUBLE) AS value,
               'app.' || event_type || '|area=' || CAST(user_id % 3 AS VARCHAR) || ',user=' || CAST(user_id AS VARCHAR) AS message_key, user_id % 3 AS area, date_trunc('hour', ts) AS seen
        FROM events GROUP BY event_type, user_id, date_trunc('hour', ts)""",
    "routine_event": """
        SELECT CASE WHEN event_type = 'error' THEN 'abandoned' ELSE 'cleared' END AS type, event_id % 400 AS message_id, event_id % 3 AS attempt, epoch_us(ts) AS at_us, 'group.' || CAST(event_id % 2 AS VARCHAR) AS routing_key
        FROM events WHERE event_type IN ('error', 'view')""",
    "evaluation": """
        SELECT user_id AS subject, event_id AS id, epoch_us(ts) AS seen, CASE WHEN event_id % 29 = 0 THEN 'insufficient_evidence' WHEN value < 2 THEN 'healthy' ELSE 'active' END AS state FROM events""",
    "alert_head": f"""
        SELECT c_custkey AS subject, CASE WHEN c_custkey % 3 = 0 THEN 'resolved' ELSE 'active' END AS status, CASE WHEN c_custkey % 5 = 0 THEN 'critical' ELSE 'warn' END AS severity, {NOW} - to_hours(c_custkey % 9) AS created_at
        FROM (SELECT DISTINCT o_custkey AS c_custkey FROM orders)""",
}

#: Tables that the text of another one reads.
_NEEDS = {
    "bounds": ("message_log",), "kept_head": ("message_log",), "compaction_head": ("kept_head",), "consumer_group_cursor": ("bounds",),
    "exception_queue": ("message_log", "consumer_group_cursor"), "claim_lease": ("bounds",), "delivery_log": ("message_log",),
}


def sql(body: str) -> str:
    """``body`` with the derived tables it names in front."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, ()):
            add(n)
        if name not in wanted:
            wanted.append(name)

    import re

    for name in TABLES:
        if re.search(rf"\b{name}\b", body):
            add(name)
    head = ",\n".join(f"{n} AS ({TABLES[n].strip()})" for n in wanted)
    body = body.strip().replace("NOW()", NOW)
    if not wanted:
        return body
    return f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"
