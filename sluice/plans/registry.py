"""Named queries of the message-log engine and their independent SQL oracles.

Names begin with the operator's number where it has one.  A query takes ``(spark,
sf_dir)``; its oracle is plain SQL over the source tables, written without the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import alerts, claims, control, deliveries, heads, log, metrics, reads, retention, schedules, snapshots
from ..sources.fixtures import NOW, PARTITION, Tables, now
from . import diagnostics
from .oracle import sql

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f: Callable[[Tables], DataFrame]):
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLES[name] = sql(oracle)
        return f

    return register


def hours(n: int):
    return F.expr(f"interval {n} hours")


# append, keys, heads


@query(
    "o01_append_batch",
    """WITH marked AS (SELECT p.*, row_number() OVER (PARTITION BY p.idempotency_key ORDER BY seq) AS rn, k.idempotency_key IS NOT NULL AS known
         FROM produced p LEFT JOIN (SELECT DISTINCT idempotency_key FROM idempotency_key) k ON p.idempotency_key = k.idempotency_key)
       SELECT seq, idempotency_key, message_key, compaction_rank, CASE WHEN rn = 1 AND NOT known THEN (SELECT n FROM bounds) + row_number() OVER (PARTITION BY rn = 1 AND NOT known ORDER BY seq) ELSE 0 END AS id,
              NOT (rn = 1 AND NOT known) AS duplicate FROM marked""",
)
def _(t):
    return log.append_plan(t.produced, t.idempotency_key, t.max_id).select("seq", "idempotency_key", "message_key", "compaction_rank", "id", "duplicate")


@query(
    "o01_append_merged_heads",
    """WITH fresh AS (SELECT p.*, (SELECT n FROM bounds) + row_number() OVER (ORDER BY seq) AS id FROM (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY seq) AS rn FROM produced) p
         WHERE rn = 1 AND idempotency_key NOT IN (SELECT idempotency_key FROM idempotency_key)),
       every AS (SELECT compaction_key, message_id, schema_version, compaction_rank FROM compaction_head WHERE message_id IS NOT NULL UNION ALL SELECT message_key, id, 1, compaction_rank FROM fresh)
       SELECT k.compaction_key, w.message_id, w.schema_version, w.compaction_rank FROM (SELECT compaction_key FROM compaction_head UNION SELECT message_key FROM fresh) k LEFT JOIN
         (SELECT *, row_number() OVER (PARTITION BY compaction_key ORDER BY schema_version DESC, compaction_rank DESC, message_id DESC) AS rn FROM every) w ON k.compaction_key = w.compaction_key AND rn = 1""",
)
def _(t):
    plan = log.append_plan(t.produced, t.idempotency_key, t.max_id).where("not duplicate").withColumn("schema_version", F.lit(1))
    return heads.merged(t.compaction_head, plan)


@query(
    "o02_idempotency_keys",
    """WITH h AS (SELECT o_orderkey, sha1(unhex('b6f6c1934e2b45c19d3f6a821e0c7a54') || encode('order-' || CAST(o_orderkey AS VARCHAR))) AS h FROM orders)
       SELECT o_orderkey AS id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS resolved FROM h""",
)
def _(t):
    o = t.source("orders")
    return o.select(F.col("o_orderkey").alias("id"), expr.resolve_key(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))).alias("resolved"))


@query("o03_heads_recomputed", "SELECT compaction_key, message_id, schema_version, compaction_rank FROM kept_head")
def _(t):
    return heads.heads(t.message_log)


@query("o03_list_heads", "SELECT compaction_key, m.id, m.schema_version, m.compaction_rank, m.routing_key, m.payload, epoch_us(m.created_at) AS created_us FROM compaction_head h JOIN message_log m ON m.id = h.message_id")
def _(t):
    h = heads.listed(t.compaction_head, t.message_log)
    return h.select("compaction_key", "id", "schema_version", "compaction_rank", "routing_key", "payload", F.unix_micros("created_at").alias("created_us"))


@query("o03_one_head", "SELECT m.id, m.schema_version, m.compaction_rank FROM kept_head h JOIN message_log m ON m.id = h.message_id WHERE compaction_key = 'user:7'")
def _(t):
    return heads.head_of(t.compaction_head, t.message_log, "user:7").select("id", "schema_version", "compaction_rank")


@query("key_history", "SELECT id, schema_version, compaction_rank FROM message_log WHERE message_key = 'user:42' ORDER BY id DESC LIMIT 20")
def _(t):
    return log.key_history(t.message_log, "user:42", 20).select("id", "schema_version", "compaction_rank")


@query("key_history_window", "SELECT id, epoch_us(created_at) AS created_us FROM message_log WHERE message_key = 'user:42' AND created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def _(t):
    w = log.key_window(t.message_log, "user:42", F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))
    return w.select("id", F.unix_micros("created_at").alias("created_us"))


@query("message_by_id", "SELECT id, payload FROM message_log WHERE id = 77")
def _(t):
    return log.message(t.message_log, 77).select("id", "payload")


@query(
    "presented_log",
    "SELECT id, schema_version, coalesce(routing_key, '') AS routing_key, coalesce(message_key, '') AS message_key, coalesce(compaction_rank, 0) AS compaction_rank, compaction_rank IS NOT NULL AS compacted, payload FROM message_log",
)
def _(t):
    return log.presented(t.message_log).drop("created_at")


# eligible reads

_ELIGIBLE = """SELECT m.id, m.routing_key, m.message_key, m.payload FROM message_log m WHERE m.id > 1000 % 7 AND m.id <= {high} AND m.schema_version = {version}
  AND (NOT EXISTS (SELECT 1 FROM binding_config b WHERE b.consumer_group_id = {group}) OR EXISTS (SELECT 1 FROM binding_config b WHERE b.consumer_group_id = {group} AND regexp_matches(m.routing_key, b.pattern_regex)))
  AND (m.compaction_rank IS NULL OR m.id = (SELECT h.message_id FROM kept_head h WHERE h.compaction_key = m.message_key))"""


def _eligible(t, group, version=1, high=10**12):
    e = reads.eligible(t.message_log, t.compaction_head, t.binding_config, group, version, 1000 % 7, high)
    return e.select("id", "routing_key", "message_key", "payload")


@query("o05_eligible_read_two_bindings", _ELIGIBLE.format(group=1, version=1, high=10**12))
def _(t):
    return _eligible(t, 1)


@query("o05_eligible_read_one_binding", _ELIGIBLE.format(group=2, version=1, high="9000 * (SELECT n FROM bounds) // 10000"))
def _(t):
    return _eligible(t, 2, high=9000 * t.max_id // 10000)


@query("o05_eligible_read_all", _ELIGIBLE.format(group=3, version=1, high=10**12))
def _(t):
    return _eligible(t, 3)


@query("o05_eligible_read_version_2", _ELIGIBLE.format(group=3, version=2, high=10**12))
def _(t):
    return _eligible(t, 3, version=2)


@query(
    "o14_routing_matches",
    "SELECT b.consumer_group_id, b.pattern, count(*) AS messages, count(DISTINCT m.routing_key) AS keys FROM binding_config b JOIN message_log m ON regexp_matches(m.routing_key, b.pattern_regex) GROUP BY 1, 2",
)
def _(t):
    counts = t.message_log.where("routing_key is not null").groupBy("routing_key").count()
    j = counts.join(F.broadcast(t.binding_config), F.rlike("routing_key", "pattern_regex"))  # patterns are declared by hand
    return j.groupBy("consumer_group_id", "pattern").agg(F.sum("count").alias("messages"), F.count("*").alias("keys"))


# claims


@query("o04_claim_snapshot", "SELECT c.consumer_group_id, (SELECT n FROM bounds) AS head, c.claimed, EXISTS (SELECT 1 FROM claim_lease l WHERE l.consumer_group_id = c.consumer_group_id AND l.expires_at < NOW()) AS reclaimable FROM consumer_group_cursor c")
def _(t):
    return claims.snapshot(t.consumer_group_cursor, t.claim_lease, t.max_id, now())


@query("o04_fresh_ranges", "SELECT consumer_group_id, claimed AS low, least(claimed + 64, (SELECT n FROM bounds)) AS high FROM consumer_group_cursor WHERE claimed < (SELECT n FROM bounds)")
def _(t):
    return claims.fresh_ranges(t.consumer_group_cursor, t.max_id, 64)


@query(
    "o06_commit_watermark",
    """WITH x AS (SELECT c.*, least((SELECT min(low) FROM claim_lease l WHERE l.consumer_group_id = c.consumer_group_id), (SELECT min(message_id) - 1 FROM exception_queue e WHERE e.consumer_group_id = c.consumer_group_id AND status IN ('ready', 'inflight', 'deferred')), claimed) AS target FROM consumer_group_cursor c)
       SELECT consumer_group_id, claimed, target, greatest(committed, target) AS committed FROM x""",
)
def _(t):
    return claims.watermark(t.consumer_group_cursor, t.claim_lease, t.exception_queue)


@query(
    "o07_reclaim",
    "SELECT consumer_group_id, token, low, high, reclaims + 1 AS reclaims, reclaims >= 3 AS quarantine FROM (SELECT *, row_number() OVER (PARTITION BY consumer_group_id ORDER BY low, token) AS rn FROM claim_lease WHERE expires_at < NOW()) WHERE rn = 1",
)
def _(t):
    return claims.reclaimed(t.claim_lease, now())


@query(
    "o07_quarantine",
    "SELECT l.consumer_group_id, m.id AS message_id, 'ready' AS status, m.message_key, m.concurrency, 0 AS attempts, 0 AS delays FROM claim_lease l JOIN message_log m ON m.id > l.low AND m.id <= l.high WHERE l.token = 't1'",
)
def _(t):
    return claims.quarantined(t.claim_lease.where("token = 't1'"), t.message_log, now(), 1)


@query("o07_force_reclaim", "SELECT consumer_group_id, token, CASE WHEN token = 't3' THEN epoch_us(NOW()) ELSE epoch_us(expires_at) END AS expires_us, CASE WHEN token = 't3' THEN greatest(reclaims - 1, -1) ELSE reclaims END AS reclaims FROM claim_lease")
def _(t):
    return claims.surrendered(t.claim_lease, "t3", now()).select("consumer_group_id", "token", F.unix_micros("expires_at").alias("expires_us"), "reclaims")


_RANGE_IDS = "SELECT 'r' || CAST((id - 1) // 50 AS VARCHAR) AS token, (id - 1) // 50 * 50 AS low, id, id % 37 <> 0 AS resolved FROM message_log"


@query(
    "o07_resolved_prefix",
    f"""WITH ids AS ({_RANGE_IDS}), stops AS (SELECT token, low, min(CASE WHEN NOT resolved THEN id END) AS stop FROM ids GROUP BY 1, 2)
        SELECT s.token, s.low, coalesce(max(i.id), s.low) AS last_processed, any_value(s.stop) IS NULL AS complete FROM stops s LEFT JOIN ids i ON i.token = s.token AND (s.stop IS NULL OR i.id < s.stop) GROUP BY s.token, s.low""",
)
def _(t):
    block = F.floor((F.col("id") - 1) / 50).cast("long")
    ids = t.message_log.select(F.concat(F.lit("r"), block.cast("string")).alias("token"), (block * 50).alias("low"), "id", (F.col("id") % 37 != 0).alias("resolved"))
    return claims.resolved_prefix(ids)


def _outcomes(t):
    k = F.col("id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("success", "exception", "terminal", "deferred", "delayed", "superseded")]), (k % 6).cast("int") + 1)
    return t.message_log.select((1 + k % 3).alias("consumer_group_id"), k.alias("message_id"), kind.alias("outcome"), ((k % 90) * 1_000_000).alias("delay_us"))


_OUTCOMES = "SELECT 1 + id % 3 AS consumer_group_id, id AS message_id, CASE id % 6 WHEN 0 THEN 'success' WHEN 1 THEN 'exception' WHEN 2 THEN 'terminal' WHEN 3 THEN 'deferred' WHEN 4 THEN 'delayed' ELSE 'superseded' END AS outcome, id % 90 * 1000000 AS delay_us FROM message_log"


@query(
    "o07_commit_exceptions",
    f"""WITH o AS ({_OUTCOMES}) SELECT consumer_group_id, message_id, CASE outcome WHEN 'terminal' THEN 'dead' WHEN 'deferred' THEN 'deferred' ELSE 'ready' END AS status, 0 AS attempts, CASE WHEN outcome = 'delayed' THEN 1 ELSE 0 END AS delays,
        epoch_us(NOW()) + CASE outcome WHEN 'exception' THEN 1000000 WHEN 'delayed' THEN delay_us ELSE 0 END AS can_run_after_us FROM o WHERE outcome NOT IN ('success', 'superseded')""",
)
def _(t):
    return claims.recorded(_outcomes(t), now(), F.lit(1_000_000))


@query(
    "o07_commit_log_rows",
    f"WITH o AS ({_OUTCOMES}) SELECT consumer_group_id, message_id, 0 AS attempt, CASE WHEN outcome IN ('exception', 'terminal') THEN 'failure' ELSE outcome END AS status FROM o WHERE outcome <> 'success'",
)
def _(t):
    return claims.log_rows(_outcomes(t))


# exceptions

_CLAIMABLE = """SELECT e.* FROM exception_queue e WHERE attempts - delays < 3
  AND EXISTS (SELECT 1 FROM message_log m WHERE m.id = e.message_id AND m.schema_version = 1)
  AND ((status = 'ready' AND can_run_after <= NOW()) OR (status = 'inflight' AND lease_expires_at < NOW()) OR status = 'deferred')
  AND NOT EXISTS (SELECT 1 FROM message_key_lease k WHERE k.consumer_group_id = e.consumer_group_id AND k.message_key = e.message_key AND k.expires_at > NOW())
  AND NOT (concurrency = 'ordered' AND EXISTS (SELECT 1 FROM exception_queue x WHERE x.consumer_group_id = e.consumer_group_id AND x.message_key = e.message_key AND x.message_id < e.message_id AND x.status IN ('ready', 'inflight', 'deferred')))"""


def _claimable(t):
    return deliveries.claimable(t.exception_queue, t.message_log, t.message_key_lease, 1, 3, now())


@query("o08_claimable_exceptions", f"WITH c AS ({_CLAIMABLE}) SELECT consumer_group_id, message_id, status, message_key, concurrency, attempts, delays FROM c")
def _(t):
    return _claimable(t).select("consumer_group_id", "message_id", "status", "message_key", "concurrency", "attempts", "delays")


@query(
    "o08_claim_exceptions",
    f"""WITH c AS ({_CLAIMABLE}), r AS (SELECT *, row_number() OVER (PARTITION BY consumer_group_id ORDER BY message_id) AS rn FROM c)
        SELECT r.consumer_group_id, r.message_id, 'inflight' AS status, attempts + 1 AS attempts, epoch_us(NOW()) + 30000000 AS lease_us, m.payload FROM r JOIN message_log m ON m.id = r.message_id WHERE rn <= 10""",
)
def _(t):
    taken = deliveries.claimed(_claimable(t), 10, now(), F.expr("interval 30 seconds"))
    j = taken.join(t.message_log.select(F.col("id").alias("message_id"), "payload"), "message_id")
    return j.select("consumer_group_id", "message_id", "status", "attempts", F.unix_micros("lease_expires_at").alias("lease_us"), "payload")


@query("o08_expired_log_rows", "SELECT consumer_group_id, message_id, attempts AS attempt FROM exception_queue WHERE status = 'inflight' AND lease_expires_at < NOW()")
def _(t):
    return deliveries.overrun(t.exception_queue, now()).select("consumer_group_id", "message_id", F.col("attempts").alias("attempt"))


@query(
    "o08_kill",
    "SELECT consumer_group_id, message_id, 'dead' AS status, coalesce(last_error, '') || ' (killed: lease expired with no retries left)' AS last_error FROM exception_queue WHERE status = 'inflight' AND lease_expires_at < NOW() AND attempts - delays >= 2",
)
def _(t):
    return deliveries.killed(t.exception_queue, 2, now()).select("consumer_group_id", "message_id", "status", "last_error")


@query(
    "o09_outcome_transitions",
    """WITH ev AS (SELECT consumer_group_id, message_id, attempts, delays, CASE message_id % 6 WHEN 0 THEN 'success' WHEN 1 THEN 'failure' WHEN 2 THEN 'permanent' WHEN 3 THEN 'delayed' WHEN 4 THEN 'superseded' ELSE 'busy' END AS event, message_id % 100 * 1000 AS delay_us FROM exception_queue),
       f AS (SELECT *, attempts - delays >= 3 AS spent, event = 'delayed' AND delays < 1 AS may_delay, event = 'failure' OR (event = 'delayed' AND NOT delays < 1) AS failed FROM ev)
       SELECT consumer_group_id, message_id, event,
         CASE WHEN event = 'success' THEN NULL WHEN event = 'permanent' OR (failed AND spent) THEN 'dead' WHEN may_delay OR failed THEN 'ready' WHEN event = 'superseded' THEN 'superseded' ELSE 'deferred' END AS next_status,
         attempts - CASE WHEN event IN ('superseded', 'busy') THEN 1 ELSE 0 END AS next_attempts, delays + CASE WHEN may_delay THEN 1 ELSE 0 END AS next_delays,
         epoch_us(NOW()) + CASE WHEN may_delay THEN delay_us WHEN failed AND NOT spent THEN CAST(trunc(least(1000000 * pow(2, attempts - delays - 1), 5000000)) AS BIGINT) WHEN event = 'busy' THEN 0 END AS can_run_after_us,
         CASE WHEN event = 'success' THEN 'success' WHEN may_delay THEN 'delayed' WHEN event = 'superseded' THEN 'superseded' WHEN event = 'busy' THEN 'deferred' ELSE 'failure' END AS log_status, attempts AS log_attempt FROM f""",
)
def _(t):
    k = F.col("message_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("success", "failure", "permanent", "delayed", "superseded", "busy")]), (k % 6).cast("int") + 1)
    ev = t.exception_queue.select("consumer_group_id", "message_id", "attempts", "delays", kind.alias("event"), ((k % 100) * 1000).alias("delay_us"))
    return deliveries.transitions(ev, 3, 1, 1_000_000, 5_000_000, 2.0, now())


@query(
    "o10_key_verdicts",
    """WITH c AS (SELECT m.*, g.consumer_group_id, g.committed FROM message_log m JOIN consumer_group_cursor g ON g.consumer_group_id < 3 WHERE m.id > 6000 * (SELECT n FROM bounds) // 10000 AND m.message_key IS NOT NULL AND m.concurrency <> 'parallel')
       SELECT c.consumer_group_id, c.id, c.message_key, CASE
         WHEN compaction_rank IS NOT NULL AND c.id IS DISTINCT FROM (SELECT message_id FROM kept_head h WHERE h.compaction_key = c.message_key) THEN 'superseded'
         WHEN EXISTS (SELECT 1 FROM message_key_lease k WHERE k.consumer_group_id = c.consumer_group_id AND k.message_key = c.message_key AND k.expires_at > NOW()) THEN 'busy'
         WHEN concurrency = 'ordered' AND EXISTS (SELECT 1 FROM exception_queue e WHERE e.consumer_group_id = c.consumer_group_id AND e.message_key = c.message_key AND e.message_id < c.id AND e.status IN ('ready', 'inflight', 'deferred')) THEN 'busy'
         WHEN concurrency = 'ordered' AND EXISTS (SELECT 1 FROM message_log m WHERE m.message_key = c.message_key AND m.id > c.committed AND m.id <= 6000 * (SELECT n FROM bounds) // 10000) THEN 'busy'
         ELSE 'acquired' END AS verdict FROM c""",
)
def _(t):
    low = 6000 * t.max_id // 10000
    g = t.consumer_group_cursor.where("consumer_group_id < 3")
    m = t.message_log.where(F.col("id") > low).crossJoin(F.broadcast(g.select("consumer_group_id")))  # two groups
    return deliveries.verdicts(m, t.compaction_head, t.exception_queue, t.message_key_lease, g, t.message_log, low, now())


_CHAINS = "SELECT 'r' || CAST((id - 1) // 500 AS VARCHAR) AS token, message_key, id, CASE WHEN id % 19 = 0 THEN 'exception' WHEN id % 23 = 0 THEN 'terminal' ELSE 'success' END AS outcome FROM message_log WHERE message_key IS NOT NULL AND concurrency = 'ordered'"


@query(
    "o10_ordered_chains",
    f"""WITH o AS ({_CHAINS}) SELECT o.token, o.message_key, o.id, CASE WHEN EXISTS (SELECT 1 FROM o p WHERE p.token = o.token AND p.message_key = o.message_key AND p.outcome = 'exception' AND p.id < o.id) THEN 'deferred' ELSE o.outcome END AS outcome FROM o""",
)
def _(t):
    k = F.col("id")
    m = t.message_log.where("message_key is not null and concurrency = 'ordered'")
    o = m.select(F.concat(F.lit("r"), F.floor((k - 1) / 500).cast("string")).alias("token"), "message_key", "id", F.when(k % 19 == 0, "exception").when(k % 23 == 0, "terminal").otherwise("success").alias("outcome"))
    return deliveries.chained(o).select("token", "message_key", "id", "outcome")


@query(
    "o11_fan_out",
    f"""WITH scan AS (SELECT * FROM message_log WHERE id > (SELECT committed FROM consumer_group_cursor WHERE consumer_group_id = 1) ORDER BY id LIMIT 2000), ok AS ({_ELIGIBLE.format(group=1, version=1, high=10**12)})
        SELECT s.id AS message_id, 'ready' AS status, 0 AS attempts, s.message_key FROM scan s WHERE s.id IN (SELECT id FROM ok) AND s.id NOT IN (SELECT message_id FROM exception_queue WHERE consumer_group_id = 1)""",
)
def _(t):
    committed = t.max_id * 4 // 10
    scan = t.message_log.where(F.col("id") > committed).orderBy("id").limit(2000)
    return deliveries.fanned_out(scan, _eligible(t, 1), t.exception_queue.where("consumer_group_id = 1"))


@query("o11_fan_out_mark", "SELECT greatest(n * 4 // 10, CASE WHEN (SELECT count(*) FROM message_log WHERE id > n * 4 // 10) >= 2000 THEN n * 4 // 10 + 2000 ELSE n END) AS mark FROM bounds")
def _(t):
    return deliveries.fan_out_mark(t.message_log, t.max_id * 4 // 10, 2000)


@query(
    "o11_lifecycle_outcomes",
    "SELECT consumer_group_id, message_id, CASE WHEN message_id % 3 = 0 THEN 'done' WHEN message_id % 3 = 1 THEN 'dead' WHEN attempts >= 3 THEN 'dead' ELSE 'ready' END AS status FROM exception_queue",
)
def _(t):
    k = F.col("message_id")
    ev = t.exception_queue.withColumn("event", F.when(k % 3 == 0, "success").when(k % 3 == 1, "permanent").otherwise("failure"))
    return deliveries.lifecycle_outcome(ev, 3).select("consumer_group_id", "message_id", "status")


# options, retry, bindings


@query(
    "o12_options",
    """SELECT id, greatest(least(coalesce(nullif(id % 9, 0), 3), 5), 2) AS max_retries, least(coalesce(nullif(id % 100 * 1000, 0), 30000), 60000) AS timeout_ms, coalesce(nullif(CASE WHEN id % 4 = 0 THEN '' ELSE concurrency END, ''), 'exclusive') AS concurrency FROM message_log""",
)
def _(t):
    k = F.col("id")
    m = t.message_log.select("id", (k % 9).alias("max_retries"), (k % 100 * 1000).alias("timeout_ms"), F.when(k % 4 == 0, "").otherwise(F.col("concurrency")).alias("concurrency"))
    return control.resolved_options(m, {"max_retries": 3, "timeout_ms": 30000, "concurrency": "exclusive"}, {"max_retries": 2}, {"max_retries": 5, "timeout_ms": 60000})


@query(
    "o13_retry_curve",
    """WITH a AS (SELECT CAST(s_suppkey AS INTEGER) AS attempt FROM supplier)
       SELECT attempt, CAST(least(1000 * pow(2, attempt), 300000) AS BIGINT) AS delay_ms, CAST(coalesce((SELECT sum(least(1000 * pow(2, b.attempt), 300000)) FROM a b WHERE b.attempt <= a.attempt - 2), 0) AS BIGINT) AS total_ms FROM a""",
)
def _(t):
    a = t.source("supplier").select(F.col("s_suppkey").cast("int").alias("attempt"))
    base, top, by = F.lit(1000), F.lit(300_000), F.lit(2.0)
    return a.select("attempt", expr.retry_delay(F.col("attempt"), base, top, by).alias("delay_ms"), expr.total_delay(F.col("attempt"), base, top, by).alias("total_ms"))


@query("o15_effective_bindings", "SELECT CAST(consumer_group_id AS BIGINT) AS consumer_group_id, CAST(id AS BIGINT) AS id, array_to_string(patterns, ',') AS patterns, declared_by FROM (SELECT *, row_number() OVER (PARTITION BY consumer_group_id ORDER BY id DESC) AS rn FROM binding_config_log WHERE status = 'installed') WHERE rn = 1")
def _(t):
    return control.effective(t.binding_config_log).withColumn("patterns", F.array_join("patterns", ","))


@query(
    "o15_newest_declarations",
    "SELECT g.name AS consumer_group, CAST(d.consumer_group_id AS BIGINT) AS consumer_group_id, status, declared_by, CAST(d.id AS BIGINT) AS id, array_to_string(patterns, ',') AS patterns FROM (SELECT DISTINCT ON (consumer_group_id, status, declared_by) * FROM binding_config_log ORDER BY consumer_group_id, status, declared_by, id DESC) d JOIN consumer_group_config g ON g.id = d.consumer_group_id",
)
def _(t):
    return control.newest_declarations(t.binding_config_log, t.consumer_group_config).withColumn("patterns", F.array_join("patterns", ","))


@query(
    "o15_open_waiters",
    """WITH w AS (SELECT DISTINCT ON (consumer_group_id, declared_by) * FROM binding_config_log WHERE status = 'waiting' ORDER BY consumer_group_id, declared_by, id DESC), e AS (SELECT DISTINCT ON (consumer_group_id) * FROM binding_config_log WHERE status = 'installed' ORDER BY consumer_group_id, id DESC)
       SELECT CAST(w.consumer_group_id AS BIGINT) AS consumer_group_id, w.declared_by, CAST(w.id AS BIGINT) AS id, array_to_string(w.patterns, ',') AS patterns FROM w LEFT JOIN e ON e.consumer_group_id = w.consumer_group_id
       WHERE NOT EXISTS (SELECT 1 FROM binding_config_log i WHERE i.status = 'installed' AND i.consumer_group_id = w.consumer_group_id AND i.declared_by = w.declared_by AND i.id > w.id) AND list_sort(w.patterns) IS DISTINCT FROM list_sort(e.patterns)""",
)
def _(t):
    return control.open_waiters(t.binding_config_log).withColumn("patterns", F.array_join("patterns", ","))


@query(
    "o31_batch_rejections",
    """SELECT id, CASE WHEN id % 31 = 0 THEN 'schema version below 1' WHEN concurrency <> 'parallel' AND message_key IS NULL THEN 'concurrency without key' WHEN concurrency = 'ordered' AND compaction_rank IS NOT NULL THEN 'ordered and compacted'
         WHEN id % 37 = 0 THEN 'payload is not JSON' END AS rejected FROM message_log""",
)
def _(t):
    k = F.col("id")
    batch = t.message_log.withColumn("schema_version", F.when(k % 31 == 0, 0).otherwise(F.col("schema_version"))).withColumn("payload", F.when(k % 37 == 0, "{").otherwise(F.col("payload")))
    return log.validated(batch).select("id", "rejected")


# retention

_PARTS = f"SELECT id // {PARTITION} AS part, min(id) AS first_id, max(id) AS last_id, count(*) AS rows, arg_min(created_at, id) AS oldest_at, arg_max(created_at, id) AS newest_at FROM message_log GROUP BY 1"


@query(
    "o16_droppable_partitions",
    f"WITH p AS ({_PARTS}) SELECT part, first_id, last_id, rows FROM p WHERE part < (SELECT n FROM bounds) // {PARTITION} AND newest_at <= NOW() - INTERVAL 288 HOUR AND last_id <= (SELECT min(committed) FROM consumer_group_cursor)",
)
def _(t):
    return retention.droppable(t.message_log, PARTITION, t.max_id, hours(288), now(), retention.floor(t.consumer_group_cursor)).select("part", "first_id", "last_id", "rows")


@query("o16_droppable_past_committed", f"WITH p AS ({_PARTS}) SELECT part, first_id, last_id, rows FROM p WHERE part < (SELECT n FROM bounds) // {PARTITION} AND newest_at <= NOW() - INTERVAL 288 HOUR")
def _(t):
    return retention.droppable(t.message_log, PARTITION, t.max_id, hours(288), now(), 0, past_committed=True).select("part", "first_id", "last_id", "rows")


@query("existing_partitions", f"SELECT DISTINCT id // {PARTITION} AS part FROM message_log")
def _(t):
    return retention.partitions(t.message_log, PARTITION).select("part")


_SWEEP = f"SELECT m.* FROM message_log m JOIN ({_PARTS}) p ON p.part = m.id // {PARTITION} WHERE p.oldest_at < NOW() - INTERVAL 350 HOUR - INTERVAL 50 HOUR AND m.created_at < NOW() - INTERVAL 350 HOUR - INTERVAL 50 HOUR AND m.id <= (SELECT min(committed) FROM consumer_group_cursor)"


def _sweepable(t):
    return retention.sweepable(t.message_log, PARTITION, hours(350), now(), retention.floor(t.consumer_group_cursor), grace=hours(50))


@query("o17_sweepable_rows", f"WITH s AS ({_SWEEP}) SELECT id FROM s")
def _(t):
    return _sweepable(t).select("id")


@query("o17_sweep_batch", f"WITH s AS ({_SWEEP}) SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY id // {PARTITION} ORDER BY id) AS n FROM s) WHERE n <= 100")
def _(t):
    return retention.first_of_each(_sweepable(t).select("id", "part"), 100).select("id")


@query("o17_orphan_delivery_rows", f"WITH s AS ({_SWEEP}) SELECT consumer_group_id, message_id, attempt, status FROM delivery_log WHERE message_id IN (SELECT id FROM s)")
def _(t):
    return retention.orphans(t.delivery_log, _sweepable(t)).select("consumer_group_id", "message_id", "attempt", "status")


@query("o17_remaining_heads", f"WITH s AS ({_SWEEP}) SELECT compaction_key, message_id FROM compaction_head WHERE message_id IS NULL OR message_id NOT IN (SELECT id FROM s)")
def _(t):
    return retention.without(t.compaction_head, _sweepable(t)).select("compaction_key", "message_id")


@query("o17_expired_idempotency_keys", "SELECT idempotency_key FROM idempotency_key WHERE created_at < NOW() - INTERVAL 24 HOUR")
def _(t):
    return retention.expired_keys(t.idempotency_key, hours(24), now()).select("idempotency_key")


@query("o17_idle_heads", "SELECT compaction_key FROM compaction_head WHERE message_id IS NULL AND updated_at < NOW() - INTERVAL 24 HOUR")
def _(t):
    return retention.idle_heads(t.compaction_head, hours(24), now()).select("compaction_key")


@query("o17_expired_key_leases", "SELECT consumer_group_id, message_key FROM message_key_lease WHERE expires_at < NOW()")
def _(t):
    return retention.expired_leases(t.message_key_lease, now()).select("consumer_group_id", "message_key")


@query(
    "o17_stale_waiting_declarations",
    "SELECT CAST(id AS BIGINT) AS id FROM binding_config_log b WHERE status = 'waiting' AND declared_at < NOW() - INTERVAL 10 HOUR AND id <> (SELECT max(id) FROM binding_config_log w WHERE w.status = 'waiting' AND w.consumer_group_id = b.consumer_group_id AND w.declared_by = b.declared_by)",
)
def _(t):
    return retention.stale_waiting(t.binding_config_log, hours(10), now()).select("id")


@query("o17_expired_instances", "SELECT worker_id, token FROM worker_instance WHERE expires_at < NOW()")
def _(t):
    return retention.expired_leases(t.worker_instance, now()).select("worker_id", "token")


# snapshots

_GROUPS = """SELECT c.consumer_group_id, n AS head, claimed, committed, greatest(n - committed, 0) AS backlog, greatest(claimed - committed, 0) AS inflight,
  (SELECT count(*) FROM exception_queue e WHERE e.consumer_group_id = c.consumer_group_id AND status = 'ready') AS ready, (SELECT count(*) FROM exception_queue e WHERE e.consumer_group_id = c.consumer_group_id AND status = 'inflight') AS exceptions_inflight,
  (SELECT count(*) FROM exception_queue e WHERE e.consumer_group_id = c.consumer_group_id AND status = 'deferred') AS deferred, (SELECT count(*) FROM exception_queue e WHERE e.consumer_group_id = c.consumer_group_id AND status = 'dead') AS dead,
  (SELECT count(*) FROM claim_lease l WHERE l.consumer_group_id = c.consumer_group_id) AS open_leases,
  (SELECT epoch_us(NOW()) - epoch_us(min(created_at)) FROM exception_queue e WHERE e.consumer_group_id = c.consumer_group_id AND status IN ('ready', 'inflight', 'deferred')) AS oldest_unresolved_us
  FROM consumer_group_cursor c, bounds"""


def _groups(t):
    return snapshots.groups(t.consumer_group_cursor, t.exception_queue, t.claim_lease, t.message_log, now())


@query("o18_group_snapshot", _GROUPS)
def _(t):
    return _groups(t)


@query(
    "o19_stream_snapshot",
    f"SELECT (SELECT count(DISTINCT id // {PARTITION}) FROM message_log) AS partitions, count(*) > 0 AS compacted, count(*) FILTER (WHERE message_id IS NULL) AS headless, epoch_us(NOW()) - min(epoch_us(updated_at)) FILTER (WHERE message_id IS NULL) AS oldest_headless_us FROM compaction_head",
)
def _(t):
    return snapshots.stream(t.message_log, t.compaction_head, PARTITION, now())


_COUNTS = "SELECT m.schema_version, count(*) AS messages, count(h.message_id) AS heads FROM message_log m LEFT JOIN compaction_head h ON h.message_id = m.id GROUP BY 1"


@query("o19_version_counts", _COUNTS)
def _(t):
    return snapshots.version_counts(t.message_log, t.compaction_head)


def _lag_sql(version: int) -> str:
    return f"""SELECT c.consumer_group_id, (SELECT count(*) FROM message_log m WHERE m.schema_version = {version} AND m.id > c.committed) AS unconsumed,
      (SELECT count(*) FROM exception_queue e JOIN message_log m ON m.id = e.message_id WHERE e.consumer_group_id = c.consumer_group_id AND m.schema_version = {version} AND e.status IN ('ready', 'inflight', 'deferred')) AS unresolved FROM consumer_group_cursor c"""


@query("o19_version_lag", _lag_sql(2))
def _(t):
    return snapshots.version_lag(t.message_log, t.consumer_group_cursor, t.exception_queue, 2)


@query(
    "o19_retire_verdicts",
    f"""WITH n AS ({_COUNTS}), l AS (SELECT 1 AS v, x.* FROM ({_lag_sql(1)}) x UNION ALL SELECT 2, y.* FROM ({_lag_sql(2)}) y),
        g AS (SELECT v, string_agg(name, ',' ORDER BY name) AS names FROM l JOIN consumer_group_config c ON c.id = l.consumer_group_id WHERE unconsumed > 0 OR unresolved > 0 GROUP BY v)
        SELECT n.schema_version, messages, heads, CASE WHEN heads > 0 THEN 'unsafe: heads' WHEN names IS NOT NULL THEN 'unsafe: ' || names ELSE 'safe' END AS verdict FROM n LEFT JOIN g ON g.v = n.schema_version""",
)
def _(t):
    lags = {v: snapshots.version_lag(t.message_log, t.consumer_group_cursor, t.exception_queue, v) for v in (1, 2)}
    return snapshots.retire_verdicts(snapshots.version_counts(t.message_log, t.compaction_head), lags, t.consumer_group_config)


_WORKERS = """SELECT w.id, w.name, CASE WHEN coalesce(w.consumer_group_id, 0) <> 0 THEN 'consumer_group' WHEN coalesce(w.stream_id, 0) <> 0 THEN 'stream' WHEN coalesce(w.system_id, 0) <> 0 THEN 'system' END AS owner_kind, s.name AS stream, g.name AS consumer_group, w.target_instances,
  count(i.worker_id) FILTER (WHERE i.expires_at > NOW()) AS live, coalesce(max(i.attempts) FILTER (WHERE i.expires_at > NOW()), 0) AS attempts, coalesce(max(epoch_us(i.expires_at)), epoch_us(w.created_at)) AS last_us
  FROM worker_config w LEFT JOIN worker_instance i ON i.worker_id = w.id LEFT JOIN stream_config s ON s.id = w.stream_id LEFT JOIN consumer_group_config g ON g.id = w.consumer_group_id GROUP BY w.id, w.name, w.consumer_group_id, w.stream_id, w.system_id, s.name, g.name, w.target_instances, w.created_at"""


@query(
    "o20_worker_snapshot",
    f"""WITH w AS ({_WORKERS}), x AS (SELECT *, CASE WHEN target_instances = 0 THEN 'suspended' WHEN attempts > 0 THEN 'failing' WHEN live > 0 THEN 'claimed' ELSE 'unclaimed' END AS state FROM w)
        SELECT id, name, owner_kind, stream, consumer_group, target_instances, live, attempts, state, CASE WHEN state = 'unclaimed' THEN epoch_us(NOW()) - last_us END AS unclaimed_us FROM x""",
)
def _(t):
    return snapshots.workers(t.worker_config, t.worker_instance, t.stream_config, t.consumer_group_config, now())


@query(
    "o20_schedule_snapshot",
    "SELECT CAST(c.id AS BIGINT) AS id, c.name, s.name AS stream, suspended, (epoch_us(NOW()) - epoch_us(next_at)) // 1000000 AS overdue_s, NOT suspended AND (epoch_us(NOW()) - epoch_us(next_at)) // 1000000 > 600 AS overdue FROM schedule_config c JOIN schedule_cursor r ON r.schedule_id = c.id JOIN stream_config s ON s.id = c.stream_id",
)
def _(t):
    return snapshots.schedules(t.schedule_config, t.schedule_cursor, t.stream_config, now())


# metrics


@query(
    "o21_abandoned_routines",
    """WITH p AS (SELECT routing_key, message_id, attempt, min(at_us) FILTER (WHERE type = 'abandoned') AS a, min(at_us) FILTER (WHERE type = 'cleared') AS c FROM routine_event GROUP BY 1, 2, 3)
       SELECT routing_key, count(*) AS total, count(*) FILTER (WHERE c IS NULL) AS outstanding, CAST(trunc(CAST(coalesce(sum(c - a) FILTER (WHERE c IS NOT NULL), 0) AS BIGINT) // nullif(count(c), 0)) AS BIGINT) AS latency_us FROM p WHERE a IS NOT NULL GROUP BY 1""",
)
def _(t):
    return metrics.routine_pairs(t.routine_event)


@query(
    "o22_group_gauges",
    f"""WITH g AS ({_GROUPS}), n AS (SELECT g.*, c.name FROM g JOIN consumer_group_config c ON c.id = g.consumer_group_id),
        u AS ({" UNION ALL ".join(f"SELECT '{m}' AS name, CAST({c} AS DOUBLE) AS value, name AS grp FROM n" for c, m in metrics.GROUP_GAUGES.items())})
        SELECT name, value, name || '|group=' || grp || ',stream=orders' AS message_key FROM u WHERE value IS NOT NULL""",
)
def _(t):
    return metrics.group_gauges(_groups(t), t.consumer_group_config, "orders", now()).select("name", "value", "message_key")


_NAMED = "SELECT name, CAST(value AS DOUBLE) AS value, name || coalesce('|' || attrs, '') AS message_key FROM v WHERE value IS NOT NULL"


@query(
    "o22_session_counters",
    f"""WITH o AS ({_OUTCOMES}), v AS (SELECT 'consumer.session.' || n AS name, c AS value, 'group=billing,session=s1,stream=orders,version=1' AS attrs FROM (
        SELECT 'claimed' AS n, count(*) AS c FROM o UNION ALL SELECT 'success', count(*) FILTER (WHERE outcome = 'success') FROM o UNION ALL SELECT 'superseded', count(*) FILTER (WHERE outcome = 'superseded') FROM o
        UNION ALL SELECT 'ready', count(*) FILTER (WHERE outcome IN ('exception', 'delayed')) FROM o UNION ALL SELECT 'deferred', count(*) FILTER (WHERE outcome = 'deferred') FROM o UNION ALL SELECT 'dead', count(*) FILTER (WHERE outcome = 'terminal') FROM o)) {_NAMED}""",
)
def _(t):
    attributes = F.create_map(*[F.lit(x) for x in ("stream", "orders", "group", "billing", "version", "1", "session", "s1")])
    return metrics.session_counters(_outcomes(t), attributes, now()).select("name", "value", "message_key")


@query(
    "o22_worker_gauges",
    f"""WITH w AS ({_WORKERS}), x AS (SELECT *, CASE WHEN target_instances = 0 THEN 'suspended' WHEN attempts > 0 THEN 'failing' WHEN live > 0 THEN 'claimed' ELSE 'unclaimed' END AS state FROM w),
        v AS (SELECT 'worker.state.unclaimed_workers' AS name, count(*) FILTER (WHERE state = 'unclaimed') AS value, NULL AS attrs FROM x UNION ALL SELECT 'worker.state.oldest_unclaimed_age', (epoch_us(NOW()) - min(last_us) FILTER (WHERE state = 'unclaimed')) // 1000, NULL FROM x
          UNION ALL SELECT 'worker.state.failing_workers', count(*) FILTER (WHERE state = 'failing'), NULL FROM x) {_NAMED}""",
)
def _(t):
    w = snapshots.workers(t.worker_config, t.worker_instance, t.stream_config, t.consumer_group_config, now())
    return metrics.worker_gauges(w, now()).select("name", "value", "message_key")


@query(
    "o22_schedule_gauges",
    f"""WITH x AS (SELECT suspended, (epoch_us(NOW()) - epoch_us(next_at)) // 1000000 AS late FROM schedule_config c JOIN schedule_cursor r ON r.schedule_id = c.id),
        v AS (SELECT 'schedule.state.overdue' AS name, count(*) FILTER (WHERE NOT suspended AND late > 600) AS value, NULL AS attrs FROM x UNION ALL SELECT 'schedule.state.oldest_due_age', max(late * 1000) FILTER (WHERE NOT suspended AND late > 0), NULL FROM x
          UNION ALL SELECT 'schedule.state.suspended', count(*) FILTER (WHERE suspended), NULL FROM x) {_NAMED}""",
)
def _(t):
    s = snapshots.schedules(t.schedule_config, t.schedule_cursor, t.stream_config, now())
    return metrics.schedule_gauges(s, now()).select("name", "value", "message_key")


@query("o22_alert_gauges", f"WITH v AS (SELECT 'alert.state.' || status || '_alerts' AS name, count(*) AS value, NULL AS attrs FROM alert_head GROUP BY status) {_NAMED}")
def _(t):
    return metrics.alert_gauges(t.alert_head, now()).select("name", "value", "message_key")


@query(
    "o22_stream_gauges",
    f"""WITH v AS (SELECT 'stream.state.partitions' AS name, (SELECT count(DISTINCT id // {PARTITION}) FROM message_log) AS value, 'stream=orders' AS attrs UNION ALL SELECT 'stream.state.compacted', (SELECT CAST(count(*) > 0 AS INTEGER) FROM compaction_head), 'stream=orders'
        UNION ALL SELECT 'stream.workers.unclaimed', 7, 'stream=orders') {_NAMED}""",
)
def _(t):
    return metrics.stream_gauges(snapshots.stream(t.message_log, t.compaction_head, PARTITION, now()), "orders", 7, now()).select("name", "value", "message_key")


@query(
    "o23_latest_series",
    "SELECT message_key, name, kind, unit, value, epoch_us(seen) AS at_us FROM (SELECT *, row_number() OVER (PARTITION BY message_key ORDER BY seen DESC, id DESC) AS rn FROM measurement) WHERE rn = 1",
)
def _(t):
    return metrics.latest_series(t.measurement).select("message_key", "name", "kind", "unit", "value", F.unix_micros("at").alias("at_us"))


@query("o23_series_history", "SELECT id, value, epoch_us(seen) AS at_us FROM measurement WHERE message_key = 'app.click|area=1,user=4' AND seen BETWEEN NOW() - INTERVAL 480 HOUR AND NOW()")
def _(t):
    return metrics.series(t.measurement, "app.click|area=1,user=4", now() - hours(480), now()).select("id", "value", F.unix_micros("at").alias("at_us"))


@query(
    "o23_filtered_series",
    "WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_key ORDER BY seen DESC, id DESC) AS rn FROM measurement WHERE name = 'app.view' AND area = 2) WHERE rn = 1) SELECT message_key, value FROM l ORDER BY message_key LIMIT 5",
)
def _(t):
    return metrics.filtered_series(t.measurement, "app.view", {"area": "2"}, 5).select("message_key", "value")


@query("o23_export_families", "WITH l AS (SELECT DISTINCT message_key, name, kind FROM measurement) SELECT replace(name, '.', '_') || CASE WHEN kind = 'counter' THEN '_total' ELSE '' END AS export_name, count(*) AS series, false AS rejected FROM l GROUP BY 1")
def _(t):
    return metrics.families(metrics.latest_series(t.measurement))


@query(
    "metric_exposition",
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY message_key ORDER BY seen DESC, id DESC) AS rn FROM measurement)
       SELECT replace(name, '.', '_') || CASE WHEN kind = 'counter' THEN '_total' ELSE '' END || '{area="' || CAST(area AS VARCHAR) || '",user="' || split_part(message_key, 'user=', 2) || '"} ' || CAST(value AS VARCHAR) AS line FROM l WHERE rn = 1 UNION ALL SELECT 'otel_source_read_success 1'""",
)
def _(t):
    return metrics.exposition(metrics.latest_series(t.measurement))


# alerts

_WALK = """WITH s AS (SELECT subject, seen, arg_max(state, id) AS state FROM evaluation GROUP BY 1, 2), n AS (SELECT subject, max(seen) AS seen FROM s GROUP BY 1),
  newest AS (SELECT s.* FROM s JOIN n USING (subject, seen)),
  w AS (SELECT s.*, lag(s.seen) OVER (PARTITION BY s.subject ORDER BY s.seen DESC) - s.seen AS gap FROM s WHERE s.seen >= {now} - ({pending} + 2 * {gap}) * CAST(1000000 AS BIGINT)),
  r AS (SELECT *, sum(CASE WHEN state <> 'active' OR coalesce(gap, 0) > {gap} * CAST(1000000 AS BIGINT) THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY seen DESC) AS breaks FROM w),
  span AS (SELECT subject, max(seen) - min(seen) AS us FROM r WHERE breaks = 0 GROUP BY 1),
  result AS (SELECT c.subject, CASE WHEN newest.seen IS NULL OR newest.seen > {now} OR {now} - newest.seen > {gap} * CAST(1000000 AS BIGINT) OR newest.state = 'insufficient_evidence' THEN 'insufficient_evidence' WHEN newest.state <> 'active' THEN newest.state WHEN coalesce(span.us, 0) >= {pending} * CAST(1000000 AS BIGINT) THEN 'active' ELSE 'pending' END AS state, coalesce(span.us, 0) AS us
    FROM (SELECT DISTINCT c_custkey AS subject FROM customer) c LEFT JOIN newest USING (subject) LEFT JOIN span USING (subject))"""
_PENDING, _GAP = 36 * 3600, 30 * 3600


def _walk(body: str) -> str:
    return _WALK.format(now="epoch_us(TIMESTAMP '2024-01-31 00:00:00')", pending=_PENDING, gap=_GAP) + " " + body


def _evaluated(t):
    subjects = t.source("customer").select(F.col("c_custkey").alias("subject"))
    return alerts.evaluated(t.evaluation, subjects, now(), _PENDING, _GAP)


@query("o24_evaluated_conditions", _walk("SELECT subject, state, CASE WHEN state IN ('active', 'pending') THEN us ELSE 0 END AS observed_us FROM result"))
def _(t):
    return _evaluated(t)


@query(
    "o25_partition_evidence",
    "SELECT p_partkey AS id, CASE WHEN p_retailprice <> floor(p_retailprice) OR p_partkey % 7 = 0 THEN 'insufficient_evidence' WHEN p_retailprice >= 1200 THEN 'active' ELSE 'healthy' END AS state FROM part",
)
def _(t):
    p = t.source("part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 == 0, "other").otherwise("stream.state.partitions").alias("name"), F.lit("gauge").alias("kind"), F.lit("{partition}").alias("unit"), F.col("p_retailprice").alias("value"))
    return alerts.partition_evidence(p, 0, 2400).select("id", "state")


@query(
    "o25_liveness_evidence",
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> p_size % 4 THEN 'insufficient_evidence' WHEN p_size % 4 > 0 THEN 'active' ELSE 'healthy' END AS state FROM part",
)
def _(t):
    names = F.when(F.col("p_partkey") % 4 > 0, F.sequence(F.lit(1), (F.col("p_partkey") % 4).cast("int"))).otherwise(F.array().cast("array<int>"))
    meta = F.concat(F.lit('{"workers": ['), F.array_join(names.cast("array<string>"), ","), F.lit("]}"))
    p = t.source("part").select(F.col("p_partkey").alias("id"), F.lit("stream.workers.unclaimed").alias("name"), F.lit("gauge").alias("kind"), (F.col("p_size") % 4).cast("double").alias("value"), meta.alias("metadata"))
    return alerts.liveness_evidence(p).select("id", "state")


@query("o25_read_cost_evidence", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 AND p_size * 500 >= 10000 THEN 'active' ELSE 'healthy' END AS state FROM part")
def _(t):
    p = t.source("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 500).cast("double").alias("value"), (F.col("p_partkey") % 3 == 0).alias("compacted"))
    return alerts.read_cost_evidence(p).select("id", "state")


_COVER = """WITH o AS (SELECT *, max(expires_at) OVER (PARTITION BY worker_id ORDER BY started_at, expires_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM worker_instance_log),
  i AS (SELECT *, sum(CASE WHEN before IS NULL OR started_at > before THEN 1 ELSE 0 END) OVER (PARTITION BY worker_id ORDER BY started_at, expires_at, id ROWS UNBOUNDED PRECEDING) AS k FROM o),
  s AS (SELECT worker_id, k, min(started_at) AS a, max(expires_at) AS b FROM i GROUP BY 1, 2),
  c AS (SELECT worker_id, epoch_us(arg_max(a, k)) AS covered_from_us, epoch_us(arg_max(b, k)) AS covered_to_us, count(*) AS spans FROM s GROUP BY 1)"""


@query("o26_lease_coverage", f"{_COVER} SELECT * FROM c")
def _(t):
    return alerts.coverage(t.worker_instance_log)


@query(
    "o26_collector_progress",
    f"""{_COVER}, done AS (SELECT worker_id, max(epoch_us(started_at)) FILTER (WHERE worker_id % 4 <> 1) - worker_id * 3600000000 AS completed_us FROM worker_instance_log GROUP BY 1), j AS (SELECT * FROM done LEFT JOIN c USING (worker_id))
        SELECT worker_id, CASE WHEN completed_us > {{t}} THEN 'insufficient_evidence' WHEN {{t}} - completed_us <= 7200000000 THEN 'healthy' WHEN covered_to_us >= {{t}} AND {{t}} - greatest(completed_us, covered_from_us) > 7200000000 THEN 'active' ELSE 'insufficient_evidence' END AS state FROM j""".replace("{t}", "epoch_us(TIMESTAMP '2024-01-30 12:00:00')"),
)
def _(t):
    w = t.worker_instance_log
    done = w.groupBy("worker_id").agg(F.max(F.when(F.col("worker_id") % 4 != 1, F.unix_micros("started_at"))).alias("m")).select("worker_id", (F.col("m") - F.col("worker_id") * 3_600_000_000).alias("completed_us"))
    return alerts.progress_evidence(done, alerts.coverage(w), F.lit("2024-01-30 12:00:00").cast("timestamp"), 2400)


def _published(t):
    found = _evaluated(t).withColumn("severity", F.lit("warn"))
    return alerts.published(found, t.alert_head, now())


_PUBLISHED = """SELECT r.subject, state, CASE WHEN state = 'active' AND (h.status IS NULL OR h.status = 'resolved' OR h.severity <> 'warn' OR epoch_us(NOW()) - epoch_us(h.created_at) >= 14400000000) THEN 'active' WHEN state = 'healthy' AND h.status = 'active' THEN 'resolved' END AS published
  FROM result r LEFT JOIN alert_head h ON h.subject = r.subject"""


@query("o27_published_alerts", _walk(_PUBLISHED))
def _(t):
    return _published(t)


@query("o27_check_summary", _walk(f"SELECT count(*) AS streams_evaluated, count(*) FILTER (WHERE state = 'insufficient_evidence') AS streams_failed, count(*) FILTER (WHERE published = 'active') AS published_alerts, count(*) FILTER (WHERE published = 'resolved') AS resolved_alerts FROM ({_PUBLISHED})"))
def _(t):
    return alerts.check_summary(_published(t))


# schedules


@query(
    "o28_cron_minutes",
    """WITH fires AS (SELECT m FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-01', INTERVAL 1 MINUTE) g(m) WHERE minute(m) IN (7, 27, 47) AND hour(m) IN (3, 4) AND (day(m) IN (1, 15) OR dayofweek(m) = 1))
       SELECT u.user_id, epoch_us(m) AS scheduled_us FROM (SELECT user_id, min(ts) AS a FROM events GROUP BY 1) u JOIN fires ON m >= u.a AND m <= u.a + INTERVAL 20 DAY""",
)
def _(t):
    from ..functions import cron

    u = t.source("events").groupBy("user_id").agg(F.min(F.col("ts").cast("timestamp")).alias("a"))
    at = cron.minutes(u, cron.schedulable("7/20 3,4 1,15 * Mon"), F.col("a"), F.col("a") + F.expr("interval 20 days"))
    return at.select("user_id", F.unix_micros("scheduled_at").alias("scheduled_us"))


@query("o29_due_schedules", "SELECT CAST(c.id AS BIGINT) AS id, name, epoch_us(next_at) AS next_us FROM schedule_config c JOIN schedule_cursor r ON r.schedule_id = c.id WHERE NOT suspended AND next_at <= NOW()")
def _(t):
    return schedules.listed_due(t.schedule_config, t.schedule_cursor, now()).select("id", "name", F.unix_micros("next_at").alias("next_us"))


@query(
    "o29_produced_runs",
    """SELECT CAST(id AS BIGINT) AS schedule_id, name AS message_key, us AS scheduled_us, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-7000-8000-' || lpad(CAST(id AS VARCHAR), 12, '0') AS idempotency_key, nxt AS next_us FROM
       (SELECT *, lpad(lower(hex(us // 1000)), 12, '0') AS h FROM (VALUES (1, 'click.1', epoch_us(TIMESTAMP '2024-01-30 23:59:00'), epoch_us(TIMESTAMP '2024-01-31 00:00:00')), (2, 'error.1', 0, 0)) AS v(id, name, a, b), LATERAL (SELECT epoch_us(NOW()) AS us, CASE WHEN id = 1 THEN epoch_us(NOW()) + 300000000 ELSE epoch_us(NOW()) + 3600000000 END AS nxt))""",
)
def _(t):
    return schedules.produced(t.schedule_config, t.schedule_cursor, NOW)


@query(
    "o29_schedule_keys",
    "SELECT o_orderkey AS id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-7000-8000-' || lpad(lower(hex(o_orderkey)), 12, '0') AS key FROM (SELECT o_orderkey, lpad(lower(hex(epoch_ms(o_orderdate))), 12, '0') AS h FROM orders)",
)
def _(t):
    return t.source("orders").select(F.col("o_orderkey").alias("id"), expr.schedule_key(F.unix_millis(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey")).alias("key"))


_MATCHING = "SELECT s.name, g.id, g.name AS consumer_group FROM schedule_config s, consumer_group_config g WHERE NOT EXISTS (SELECT 1 FROM binding_config b WHERE b.consumer_group_id = g.id) OR EXISTS (SELECT 1 FROM binding_config b WHERE b.consumer_group_id = g.id AND regexp_matches(s.name, b.pattern_regex))"


@query("o30_matching_groups", f"WITH m AS ({_MATCHING}) SELECT name, CAST(id AS BIGINT) AS id, consumer_group FROM m")
def _(t):
    return schedules.matching_groups(t.consumer_group_config, t.binding_config, t.schedule_config)


_ROLLUP = "SELECT consumer_group_id, message_id, bool_or(status = 'success') AS succeeded, bool_or(status IN ('failure', 'expired', 'killed')) AS failed, bool_or(status = 'deferred') AS deferred FROM delivery_log GROUP BY 1, 2"


@query("o30_message_outcomes", _ROLLUP)
def _(t):
    return schedules.outcomes(t.delivery_log)


@query(
    "o30_schedule_messages",
    f"WITH o AS ({_ROLLUP}), m AS (SELECT *, lead(id) OVER (ORDER BY id) AS superseded_by FROM message_log WHERE message_key = 'user:7') SELECT m.id, epoch_us(m.created_at) AS created_us, coalesce(o.succeeded OR o.failed, false) AS ran, coalesce(o.succeeded, false) AS succeeded, m.superseded_by FROM m LEFT JOIN o ON o.message_id = m.id AND o.consumer_group_id = 1",
)
def _(t):
    return schedules.messages(t.message_log, schedules.outcomes(t.delivery_log), "user:7", 1)


@query(
    "o30_schedule_status",
    f"""WITH o AS ({_ROLLUP}), k AS (SELECT m.id, m.message_key, h.message_id IS NOT NULL AS is_head FROM message_log m LEFT JOIN kept_head h ON h.message_id = m.id WHERE m.message_key IN ('user:1', 'user:2', 'user:3')),
        j AS (SELECT k.*, g.id AS grp, o.succeeded, o.failed FROM k CROSS JOIN consumer_group_config g LEFT JOIN o ON o.message_id = k.id AND o.consumer_group_id = g.id)
        SELECT message_key, CAST(grp AS BIGINT) AS consumer_group_id, count(*) AS messages, count(*) FILTER (WHERE succeeded OR failed) AS ran, count(*) FILTER (WHERE succeeded) AS succeeded, count(*) FILTER (WHERE failed AND NOT succeeded) AS failed,
               count(*) FILTER (WHERE NOT is_head AND NOT coalesce(succeeded OR failed, false)) AS superseded FROM j GROUP BY 1, 2""",
)
def _(t):
    keys = t.values("message_key string", ("user:1",), ("user:2",), ("user:3",))
    return schedules.status(t.message_log, t.compaction_head, schedules.outcomes(t.delivery_log), keys, t.consumer_group_config)


# migrations and workers


@query(
    "o32_schema_state",
    """WITH l AS (SELECT owner_id, arg_max(version, id) AS current FROM migration_log WHERE scope = 'stream' AND status = 'success' GROUP BY 1)
       SELECT CAST(l.owner_id AS BIGINT) AS owner_id, l.current AS version, max(m.min_compatible) AS min_compatible, CASE WHEN l.current < 2 THEN 'older' WHEN 2 < max(m.min_compatible) THEN 'newer' ELSE 'supported' END AS support FROM l JOIN migration_log m ON m.owner_id = l.owner_id AND m.scope = 'stream' AND m.status = 'success' AND m.version <= l.current GROUP BY 1, 2""",
)
def _(t):
    s = control.schema_state(t.migration_log, "stream")
    return s.select("owner_id", "version", "min_compatible", control.support(F.col("version"), F.col("min_compatible"), 2).alias("support"))


@query("o33_worker_admission", "SELECT w.id, target_instances, count(i.worker_id) AS live, target_instances < 0 OR count(i.worker_id) < target_instances AS admits FROM worker_config w LEFT JOIN worker_instance i ON i.worker_id = w.id AND i.expires_at > NOW() GROUP BY 1, 2")
def _(t):
    return control.live_counts(t.worker_config, t.worker_instance, now())


@query(
    "o33_worker_reconcile",
    """WITH d AS (SELECT 'w' || CAST(s_suppkey AS VARCHAR) AS name, s_suppkey % 5 AS v FROM supplier WHERE s_suppkey % 3 <> 0), r AS (SELECT 'w' || CAST(s_suppkey AS VARCHAR) AS name, s_suppkey % 4 AS v FROM supplier WHERE s_suppkey % 4 <> 0)
       SELECT coalesce(d.name, r.name) AS name, CASE WHEN r.name IS NULL THEN 'start' WHEN d.name IS NULL THEN 'stop' WHEN d.v <> r.v THEN 'replace' ELSE 'keep' END AS change FROM d FULL JOIN r ON d.name = r.name""",
)
def _(t):
    s, k = t.source("supplier"), F.col("s_suppkey")
    name = F.concat(F.lit("w"), k.cast("string")).alias("name")
    desired = s.where(k % 3 != 0).select(name, F.concat(F.lit('{"b": 1.0, "a": '), (k % 5).cast("string"), F.lit("}")).alias("metadata"))
    running = s.where(k % 4 != 0).select(name, F.concat(F.lit('{"a": '), (k % 4).cast("string"), F.lit(', "b": 1}')).alias("metadata"))
    return control.reconciled(desired, running)


@query(
    "workers_on_stream",
    "SELECT w.id, w.name FROM worker_config w LEFT JOIN consumer_group_config g ON g.id = w.consumer_group_id WHERE w.stream_id = 2 OR g.stream_id = 2",
)
def _(t):
    return control.on_owner(t.worker_config, t.stream_config, t.consumer_group_config, 2).select("id", "name")


@query("worker_instance_history", "SELECT id, worker_id, epoch_us(started_at) AS started_us FROM worker_instance_log WHERE started_at <= TIMESTAMP '2024-01-20' AND expires_at >= TIMESTAMP '2024-01-18'")
def _(t):
    w = control.overlapping(t.worker_instance_log, F.lit("2024-01-18").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))
    return w.select("id", "worker_id", F.unix_micros("started_at").alias("started_us"))


for _name, (_query, _oracle) in diagnostics.REGISTERED.items():
    query(_name, _oracle)(_query)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
