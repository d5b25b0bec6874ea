"""Handles over a store: streams, keys, consumers, schedules, metrics and alerts.

Reads return DataFrames; control verbs write control tables.  One driver is the writer of
a store, so what a database would guard by row locks is guarded by that.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import handles
from .functions import cron, expr
from .functions.codes import Condition
from .operators import alerts, control, heads, log, metrics, retention, schedules, snapshots
from .sources.schema import PARTITION_SIZE, schema
from .sources.store import Store
from .streaming.consume import Group, Handler

DAY = 86400 * 10**9
#: How much longer than its retention a message stays where its partition isn't dropped whole.
SWEEP_GRACE = timedelta(minutes=10)
#: Retention and logging of the system's own streams (fixed values).
SYSTEM_STREAMS = {"__system.metrics": (DAY, "off", True), "__system.alerts": (7 * DAY, "failures", False), "__system.schedules": (35 * DAY, "all", False)}


@dataclass(frozen=True)
class StreamConfig:
    partition_size: int = PARTITION_SIZE
    retention: timedelta | None = None
    key_ttl: timedelta = timedelta(hours=24)
    delivery_log_mode: str = "failures"
    allow_drop_past_committed: bool = False


def _ns(d: timedelta | None) -> int:
    return 0 if d is None else int(d.total_seconds() * 10**9)


class Client:
    def __init__(self, spark: SparkSession, base: str, clock=lambda: datetime.now(UTC)):
        self.spark, self.store, self.now = spark, Store(spark, base), clock

    def table(self, name: str) -> DataFrame:
        return self.store.table(f"control/{name}")

    def rows(self, name: str, *made: dict) -> DataFrame:
        s = schema(name)
        return self.spark.createDataFrame([tuple(m.get(f.name) for f in s) for m in made], s)

    def put(self, name: str, *made: dict) -> None:
        self.store.append(f"control/{name}", self.rows(name, *made))

    def next_id(self, name: str) -> int:
        return (self.table(name).agg(F.max("id")).first()[0] or 0) + 1

    def streams(self) -> DataFrame:
        return self.table("stream_config").orderBy("name")

    def stream(self, name: str) -> Stream:
        return Stream(self, name)

    def schedulers(self) -> DataFrame:
        return self.table("schedule_config").orderBy("name")

    def scheduler(self, name: str) -> Scheduler:
        return Scheduler(self, name)

    @property
    def system(self) -> System:
        return System(self)

    def transaction(self):
        """Messages of several streams, appended when the block ends well (``handles.transaction``)."""
        return handles.transaction(self)

    def manager(self, kinds: dict | None = None, **options) -> handles.Manager:
        """A manager of the declared workers; without functions of its own it runs janitors, the collector and alert checks."""
        own = {
            "janitor": lambda w: Stream(self, self.table("stream_config").where(F.col("id") == w["stream_id"]).first()["name"]).janitor(),
            "collector": lambda w: self.system.collect(),
            "alerts": lambda w: self.system.check_alerts(),
        }
        return handles.Manager(self, own if kinds is None else kinds, **options)

    def workers(self) -> DataFrame:
        """Declared workers with their owners, live instances and states."""
        return snapshots.workers(self.table("worker_config"), self.table("worker_instance"), self.table("stream_config"), self.table("consumer_group_config"), F.lit(self.now()))


class System:
    """The system's own streams, migrations, metrics and alerts."""

    def __init__(self, client: Client):
        self.client = client

    def register(self) -> None:
        for name, (keep, mode, lossy) in SYSTEM_STREAMS.items():
            s = Stream(self.client, name)
            if s.find() is None:
                s.register(StreamConfig(retention=timedelta(seconds=keep / 10**9), delivery_log_mode=mode, allow_drop_past_committed=lossy), system=True)
        self.migrate()

    def migrate(self) -> bool:
        """Bring the store to this build's layout; whether anything was to be done."""
        return handles.migrate(self.client, "system", 1)

    def migrate_streams(self) -> int:
        """Bring every stream to this build's layout; how many were not."""
        return sum(handles.migrate(self.client, "stream", r["id"]) for r in self.client.table("stream_config").select("id").collect())

    def get(self) -> dict:
        """What is registered, and whether this build may run on it."""
        handles.supported(self.client)
        version, floor = self.migration_version()
        return {"version": version, "min_compatible": floor, "streams": self.client.table("stream_config").count()}

    def readings(self) -> handles.Readings:
        return handles.Readings(self.client, "system", {}, self.metrics().latest)

    def migration_version(self) -> tuple[int, int]:
        r = control.schema_state(self.client.table("migration_log"), "system").first()
        if r is None:
            raise Condition("SQL0017")
        return r["version"], r["min_compatible"]

    def bindings(self) -> DataFrame:
        return control.newest_declarations(self.client.table("binding_config_log"), self.client.table("consumer_group_config"))

    def destroy(self) -> None:
        if self.client.streams().where("name not like '__system.%'").limit(1).collect():
            raise Condition("SQL0011")
        self.client.store.files.delete("control")

    def measurements(self) -> DataFrame:
        """All retained measurements, from their JSON payloads."""
        found = Stream(self.client, "__system.metrics")
        kind = "name string, kind string, value double, unit string, attributes map<string,string>, at timestamp, metadata string"
        rows = found.log().where("schema_version = 1").select("id", F.from_json("payload", kind).alias("m"))
        return rows.select("id", "m.*")

    def produce_measurements(self, rows: list[dict]) -> None:
        """Append measurements; names, units and the reserved prefix are checked."""
        for r in rows:
            if not r.get("name") or r.get("kind") not in ("gauge", "counter"):
                raise ValueError("a measurement needs a name and a kind of gauge or counter")
            expr.validate_unit(r.get("unit", ""))
        at = self.client.now()
        items = [{"payload": json.dumps({**r, "at": (r.get("at") or at).isoformat()}), "message_key": expr.measurement_key_of(r["name"], r.get("attributes")), "compaction_rank": 0} for r in rows]
        Stream(self.client, "__system.metrics").produce(items)

    def metrics(self) -> Metrics:
        return Metrics(self.measurements(), self.client)

    def collect(self) -> int:
        """One collection pass: gauges of workers, schedules, streams and groups, then the completion time; the number written.

        Groups of the metrics stream itself are left out.  A pass has a value per metric and
        owner, so it is gathered and appended as one batch.
        """
        c, at = self.client, F.lit(self.client.now())
        streams, groups = c.table("stream_config"), c.table("consumer_group_config")
        workers = snapshots.workers(c.table("worker_config"), c.table("worker_instance"), streams, groups, at)
        idle = {r["stream"]: r["names"] for r in workers.where("stream is not null and state = 'unclaimed'").groupBy("stream").agg(F.sort_array(F.collect_list("name")).alias("names")).collect()}
        members: dict = {}
        for g in groups.select("stream_id", "name").collect():
            members.setdefault(g["stream_id"], []).append(g["name"])
        every = metrics.worker_gauges(workers, at).unionByName(metrics.schedule_gauges(snapshots.schedules(c.table("schedule_config"), c.table("schedule_cursor"), streams, at), at))
        for r in streams.select("id", "name").collect():
            s = c.stream(r["name"])
            every = every.unionByName(metrics.stream_gauges(s.metrics(), s.name, len(idle.get(s.name, ())), at))
            for name in members.get(r["id"], []) if s.name != "__system.metrics" else []:
                every = every.unionByName(metrics.group_gauges(s.consumer(name).metrics(), groups, s.name, at))
        known, rows = {name: (kind, unit) for name, kind, unit, _ in metrics.definitions()}, []
        for m in every.collect():  # one job for all streams and groups
            row = {"name": m["name"], "kind": known[m["name"]][0], "unit": known[m["name"]][1], "value": m["value"], "attributes": dict(m["attributes"] or {})}
            if m["name"] == "stream.workers.unclaimed":
                row["metadata"] = json.dumps({"workers": idle.get(row["attributes"]["stream"], [])})
            rows.append(row)
        done = {"name": "metrics.collector.completed_timestamp", "kind": "gauge", "unit": "s", "value": c.now().timestamp(), "attributes": {}}
        self.produce_measurements([*rows, done])
        return len(rows) + 1

    def alerts(self) -> DataFrame:
        """The latest alert of each name and owner."""
        s = Stream(self.client, "__system.alerts")
        return heads.listed(s.heads(), s.log())

    def alert(self, name: str) -> Alert:
        return Alert(self.client, name)

    def check_alerts(self, partition_threshold: int = 1000, poll_s: int = 30) -> dict[str, int]:
        """Evaluate every alert over the retained measurements and publish what changed; counts of the run.

        Alerts have a row for each stream, so what is published is gathered and appended as one batch.
        """
        c, at = self.client, F.lit(self.client.now())
        subjects = c.table("stream_config").select(F.col("name").alias("subject"))
        m = self.measurements().withColumn("subject", F.element_at("attributes", "stream")).withColumn("created_at", F.col("at"))
        partitions = m.where("name = 'stream.state.partitions'")
        compacted = m.where("name = 'stream.state.compacted'").groupBy("subject").agg((F.max_by("value", "id") > 0).alias("compacted"))
        samples = {
            "partition_count": alerts.partition_evidence(partitions, partition_threshold, 0),
            "compaction_read_cost": alerts.read_cost_evidence(partitions.join(compacted, "subject", "left")),
            "worker_liveness": alerts.liveness_evidence(m.where("name = 'stream.workers.unclaimed'")),
        }
        found = [alerts.evaluated(s.select("subject", "id", "created_at", "state"), subjects, at).withColumn("alert", F.lit(name)) for name, s in samples.items()]
        done = m.where("name = 'metrics.collector.completed_timestamp'").agg(F.max("value")).first()[0]
        age = None if done is None else c.now().timestamp() - done
        state = "insufficient_evidence" if age is None or age < 0 else "active" if age > max(120, 3 * poll_s) else "healthy"
        found.append(c.spark.createDataFrame([("system", state, 0, "metrics_collector_progress")], "subject string, state string, observed_us long, alert string"))
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        last = self.alerts().select(F.from_json("payload", ALERT_PAYLOAD).alias("p"), "created_at").select(F.concat_ws("|", "p.name", "p.owner").alias("subject"), "p.status", "p.severity", "created_at")
        findings = every.select(F.concat_ws("|", "alert", "subject").alias("subject"), "state", F.lit("warn").alias("severity"))
        results = alerts.published(findings, last, at).cache()
        try:
            news = results.where("published is not null").select("subject", "published").collect()
            summary = alerts.check_summary(results).first().asDict()
        finally:
            results.unpersist()
        conditions = {name: text for name, _, text in alerts.ALERTS}
        items = []
        for r in news:
            name, owner = r["subject"].split("|", 1)
            payload = {"name": name, "owner": owner, "status": r["published"], "severity": "warn", "message": conditions[name]}
            items.append({"payload": json.dumps(payload), "routing_key": f"{name}.{r['published']}", "message_key": r["subject"], "compaction_rank": 0})
        if items:
            Stream(c, "__system.alerts").produce(items)
        return summary

    def janitor(self, waiting_ttl: timedelta = timedelta(days=7), log_ttl: timedelta = timedelta(days=30)) -> dict[str, int]:
        """One pass over the control tables: expired worker instances, their old log, and old waiting declarations."""
        c, at = self.client, F.lit(self.client.now())
        ttl = lambda d: F.make_dt_interval(secs=F.lit(d.total_seconds()))
        old = {
            "worker_instance": (retention.expired_leases(c.table("worker_instance"), at), "token"),
            "worker_instance_log": (retention.expired_leases(c.table("worker_instance_log"), at - ttl(log_ttl)), "id"),
            "binding_config_log": (retention.stale_waiting(c.table("binding_config_log"), ttl(waiting_ttl), at), "id"),
        }
        done = {}
        for name, (gone, key) in old.items():
            done[name] = gone.count()
            if done[name]:
                t = c.table(name)
                c.store.replace(f"control/{name}", t.join(gone.select(key), key, "left_anti").select(t.columns))
        return done


ALERT_PAYLOAD = "name string, owner string, status string, severity string, message string"


class Alert:
    """What was published about one alert."""

    def __init__(self, client: Client, name: str):
        if name not in {a[0] for a in alerts.ALERTS}:
            raise ValueError(f"no alert is named {name}")
        self.client, self.name = client, name

    def _payloads(self, rows: DataFrame) -> DataFrame:
        read = rows.select("id", "created_at", F.from_json("payload", ALERT_PAYLOAD).alias("p")).select("id", "created_at", "p.*")
        return read.where(F.col("name") == self.name)

    def current(self) -> DataFrame:
        """The latest state for each owner."""
        return self._payloads(self.client.system.alerts())

    def history(self, owner: str | None = None) -> DataFrame:
        """All retained changes, newest first."""
        rows = self._payloads(Stream(self.client, "__system.alerts").log())
        return (rows if owner is None else rows.where(F.col("owner") == owner)).orderBy(F.desc("id"))


class Metrics:
    """Retained series."""

    def __init__(self, rows: DataFrame, client: Client):
        self.rows, self.client = rows, client

    def definitions(self, scope: str | None = None) -> list[tuple[str, str, str, str]]:
        return metrics.definitions(scope)

    def latest(self, name: str | None = None, attributes: dict[str, str] | None = None, limit: int = 1000) -> DataFrame:
        return metrics.latest_series(self.rows) if name is None else metrics.filtered_series(self.rows, name, attributes or {}, limit)

    def history(self, name: str, attributes: dict[str, str] | None, window: timedelta) -> DataFrame:
        if window >= timedelta(seconds=SYSTEM_STREAMS["__system.metrics"][0] / 10**9):
            raise ValueError("the window must be shorter than the metrics' retention")
        end = F.lit(self.client.now())
        return metrics.series(self.rows, expr.measurement_key_of(name, attributes), end - F.make_dt_interval(secs=F.lit(window.total_seconds())), end)

    def exposition(self) -> str:
        """The text format; a failed read still says so."""
        try:
            lines = sorted(r["line"] for r in metrics.exposition(self.latest()).toLocalIterator())
        except Exception:  # noqa: BLE001
            lines = ["otel_source_read_success 0"]
        return "\n".join(lines) + "\n"


class Stream:
    def __init__(self, client: Client, name: str):
        self.client, self.name, self.store = client, name, client.store

    def find(self):
        return self.client.table("stream_config").where(F.col("name") == self.name).first()

    def get(self):
        found = self.find()
        if found is None:
            raise Condition("SQL0005", self.name)
        return found

    @property
    def base(self) -> str:
        return f"stream_id={self.get()['id']}"

    def register(self, config: StreamConfig = StreamConfig(), system: bool = False):
        """Create the stream, or replace its mutable settings; the partition size never changes."""
        expr.validate_stream_name(self.name, system)
        now, found = self.client.now(), self.find()
        values = {"name": self.name, "partition_size": config.partition_size, "retention_ns": _ns(config.retention), "key_ttl_ns": _ns(config.key_ttl), "delivery_log_mode": config.delivery_log_mode, "allow_drop_past_committed": config.allow_drop_past_committed}
        if found is not None and found["partition_size"] != config.partition_size:
            raise Condition("SQL0004", self.name)
        stream_id = found["id"] if found else self.client.next_id("stream_config")
        row = {**values, "id": stream_id, "created_at": found["created_at"] if found else now, "updated_at": now}
        if found is None or any(found[k] != v for k, v in values.items()):
            kept = self.client.table("stream_config").where(F.col("id") != stream_id)
            self.store.replace("control/stream_config", kept.unionByName(self.client.rows("stream_config", row)))
            self.client.put("stream_config_log", {**values, "id": self.client.next_id("stream_config_log"), "stream_id": stream_id, "declared_at": now})
        return self.get()

    def rename(self, name: str) -> Stream:
        expr.validate_stream_name(name)
        if Stream(self.client, name).find() is not None:
            raise Condition("SQL0007", name)
        me = self.get()["id"]
        t = self.client.table("stream_config")
        self.store.replace("control/stream_config", t.withColumn("name", F.when(F.col("id") == me, name).otherwise(F.col("name"))))
        return Stream(self.client, name)

    def destroy(self, force: bool = False) -> None:
        if not force and not self.log().isEmpty():
            raise Condition("SQL0006", self.name)
        base, me = self.base, self.get()["id"]
        self.store.files.delete(base)
        self.store.replace("control/stream_config", self.client.table("stream_config").where(F.col("id") != me))

    def log(self, low: int | None = None, high: int | None = None) -> DataFrame:
        s = self.get()
        return self.store.log(s["id"], low, high, s["partition_size"])

    def heads(self) -> DataFrame:
        return self.store.table(f"{self.base}/compaction_head")

    def produce(self, items: list[dict], batch_id: str | None = None) -> list:
        """Append messages given as dicts; options are checked, the whole list is one unit.  For DataFrames use ``Store.produce``."""
        for m in items:
            if m.get("schema_version", 1) < 1:
                raise ValueError("schema_version must be at least 1")
            rank = m.get("compaction_rank")
            expr.validate_options(m.get("message_key"), m.get("concurrency", "parallel"), rank is not None, rank)
        s = self.get()
        return self.store.produce(s["id"], self._batch(items), batch_id, s["partition_size"]).orderBy("seq").collect()

    def _batch(self, items: list[dict]) -> DataFrame:
        """Messages given as dicts, in order, as a batch; those without an idempotency key get one."""
        now, made = self.client.now(), []
        for i, m in enumerate(items):
            key = m.get("idempotency_key") or str(uuid.uuid4())
            made.append((i, key, m.get("schema_version", 1), m.get("routing_key"), m.get("message_key"), m.get("compaction_rank"), m.get("payload"), m.get("concurrency", "parallel"), m.get("created_at", now)))
        kind = "seq long, idempotency_key string, schema_version int, routing_key string, message_key string, compaction_rank long, payload string, concurrency string, created_at timestamp"
        return self.client.spark.createDataFrame(made, kind).withColumn("idempotency_key", expr.resolve_key(F.col("idempotency_key")))

    def key(self, key: str) -> Key:
        return Key(self, key)

    def producer(self) -> handles.Producer:
        return handles.Producer(self)

    def maintenance(self, name: str = "janitor") -> handles.Maintenance:
        return handles.Maintenance(self, name)

    def readings(self) -> handles.Readings:
        return handles.Readings(self.client, "stream", {"stream": self.name}, self.metrics)

    def workers(self) -> DataFrame:
        return self.client.workers().where(F.col("stream") == self.name)

    def consumers(self) -> DataFrame:
        return self.client.table("consumer_group_config").where(F.col("stream_id") == self.get()["id"]).orderBy("name")

    def consumer(self, name: str) -> Consumer:
        return Consumer(self, name)

    def cursors(self) -> DataFrame:
        rows = [(g["id"], *(Consumer(self, g["name"]).positions())) for g in self.consumers().toLocalIterator()]
        return self.client.spark.createDataFrame(rows, "consumer_group_id long, claimed long, committed long")

    def exceptions(self) -> DataFrame:
        out = self.client.spark.createDataFrame([], schema("exception_queue"))
        for g in self.consumers().toLocalIterator():
            out = out.unionByName(self.store.table(f"{self.base}/group={g['id']}/exception_queue"))
        return out

    def metrics(self) -> DataFrame:
        return snapshots.stream(self.log(), self.heads(), self.get()["partition_size"], F.lit(self.client.now()))

    def health(self) -> DataFrame:
        """Whether each payload version can be retired."""
        counts = snapshots.version_counts(self.log(), self.heads())
        versions = [r[0] for r in counts.select("schema_version").toLocalIterator()]
        lags = {v: snapshots.version_lag(self.log(), self.cursors(), self.exceptions(), v) for v in versions}
        return snapshots.retire_verdicts(counts, lags, self.consumers()) if versions else counts.selectExpr("*", "'' as verdict")

    def alert_definitions(self) -> list[tuple[str, str, str]]:
        return [a for a in alerts.ALERTS if a[1] == "stream"]

    def produce_each(self, items: list[dict]) -> list[dict]:
        """Append the messages that may be appended; the others are reported and hold up nothing.

        One dict for each item, in order: id, duplicate, and ``rejected``, the reason or None.
        """
        batch = log.validated(self._batch(items)).cache()
        try:
            bad = {r["seq"]: r["rejected"] for r in batch.where("rejected is not null").select("seq", "rejected").collect()}
            s = self.get()
            done = {r["seq"]: r for r in self.store.produce(s["id"], batch.where("rejected is null").drop("rejected"), None, s["partition_size"]).collect()}
        finally:
            batch.unpersist()
        return [{"id": done[i]["id"] if i in done else 0, "duplicate": i in done and done[i]["duplicate"], "rejected": bad.get(i)} for i in range(len(items))]

    def janitor(self, now: datetime | None = None) -> dict[str, int]:
        """One retention pass: whole partitions, expired rows of the others, then idempotency keys and idle heads."""
        s, at = self.get(), now or self.client.now()
        done = {"partitions": 0, "rows": 0, "keys": 0, "heads": 0}
        when, size = F.lit(at), s["partition_size"]
        if s["retention_ns"] > 0:
            ttl = F.make_dt_interval(secs=F.lit(s["retention_ns"] / 10**9))
            floor = retention.floor(self.cursors())
            old = retention.droppable(self.log(), size, self.store.head_id(s["id"]), ttl, when, floor, s["allow_drop_past_committed"])
            parts = [r["part"] for r in old.select("part").toLocalIterator()]
            self.store.drop_parts(s["id"], parts)
            done["partitions"] = len(parts)
            done["rows"] = self.store.sweep(s["id"], retention.sweepable(self.log(), size, ttl, when, floor, s["allow_drop_past_committed"], F.make_dt_interval(secs=F.lit(SWEEP_GRACE.total_seconds()))))
        ttl = F.make_dt_interval(secs=F.lit(s["key_ttl_ns"] / 10**9))
        for what, name, gone in (("keys", "idempotency_key", retention.expired_keys), ("heads", "compaction_head", retention.idle_heads)):
            t = self.store.table(f"{self.base}/{name}")
            key = t.columns[0]
            dead = gone(t, ttl, when)
            done[what] = dead.count()
            if done[what]:
                self.store.replace(f"{self.base}/{name}", t.join(dead.select(key), key, "left_anti").select(t.columns))
        return done

    def vacuum(self) -> None:
        """Rewrite the key table into few files, and delete what failed attempts left behind."""
        self.store.replace(f"{self.base}/idempotency_key", self.store.table(f"{self.base}/idempotency_key").repartition("idempotency_key"))
        self.store.stream(self.get()["id"]).swept()


class Key:
    def __init__(self, stream: Stream, key: str):
        self.stream, self.key = stream, key

    def compaction_head(self):
        found = heads.head_of(self.stream.heads(), self.stream.log(), self.key).first()
        if found is None:
            raise Condition("SQL0066", self.key)
        return found

    def lock_compaction_head(self):
        """Make sure that the key has a head, empty if need be, and return its row."""
        store, name, at = self.stream.store, f"{self.stream.base}/compaction_head", F.lit(self.stream.client.now())
        rows = heads.lockable(store.table(name), self.key, at).where(F.col("compaction_key") == self.key)
        store.append(name, rows)
        return store.table(name).where(F.col("compaction_key") == self.key).first()

    def messages(self, limit: int = 100) -> DataFrame:
        return log.key_history(self.stream.log(), self.key, limit)

    def window(self, start: datetime, end: datetime) -> DataFrame:
        return log.key_window(self.stream.log(), self.key, F.lit(start), F.lit(end))


class Consumer:
    def __init__(self, stream: Stream, name: str):
        self.stream, self.name, self.client = stream, name, stream.client

    def find(self):
        return self.stream.consumers().where(F.col("name") == self.name).first()

    def get(self):
        found = self.find()
        if found is None:
            raise Condition("SQL0014", self.name)
        return found

    def register(self, patterns: list[str] = (), position: str = "beginning", declared_by: str = ""):
        """Create the group at the beginning or the head, and declare its bindings."""
        found, now = self.find(), self.client.now()
        if found is None:
            self.client.put("consumer_group_config", {"id": self.client.next_id("consumer_group_config"), "stream_id": self.stream.get()["id"], "name": self.name, "created_at": now})
            if position == "head":
                g, at = self.group(), self.stream.store.head_id(self.stream.get()["id"])
                g._commit({"claimed": at, "committed": at, "reclaims": 0})
        me, stored = self.get(), self.binding()
        wanted = sorted(set(patterns))
        outcome = control.declaration_outcome(found is not None, stored, wanted, found is not None and self.live())
        if outcome != "joined":
            self.client.put("binding_config_log", {"id": self.client.next_id("binding_config_log"), "consumer_group_id": me["id"], "status": outcome, "patterns": wanted, "declared_by": declared_by, "declared_at": now, "attempted_at": now})
        return me

    def live(self) -> bool:
        """Whether an instance holds one of the group's workers: its bindings then wait for the instance to go."""
        mine = self.client.table("worker_config").where(F.col("consumer_group_id") == self.get()["id"]).select(F.col("id").alias("worker_id"))
        held = self.client.table("worker_instance").where(F.col("expires_at") > F.lit(self.client.now()))
        return not held.join(mine, "worker_id", "left_semi").isEmpty()

    def binding(self) -> list[str]:
        found = control.effective(self.client.table("binding_config_log").where(F.col("consumer_group_id") == self.get()["id"])).first()
        return list(found["patterns"]) if found else []

    def group(self, version: int = 1, **options) -> Group:
        s = self.stream.get()
        return Group(self.stream.store, s["id"], self.get()["id"], version, self.binding() if options.pop("bound", True) else [], s["partition_size"], mode=s["delivery_log_mode"], **options)

    def readings(self) -> handles.Readings:
        return handles.Readings(self.client, "consumer_group", {"group": self.name, "stream": self.stream.name}, self.metrics)

    def workers(self) -> DataFrame:
        return self.client.workers().where((F.col("consumer_group") == self.name) & F.col("stream").isNull())

    def positions(self) -> tuple[int, int]:
        s = self.group(bound=False)._state()
        return s["claimed"], s["committed"]

    def consume(self, handler: Handler, version: int = 1, limit: int = 1000, **options) -> None:
        self.group(version, **options).run(handler, limit, self.client.now())

    def retry(self, handler: Handler, version: int = 1, limit: int = 1000, **options) -> int:
        return self.group(version, **options).retry(handler, limit, self.client.now())

    def metrics(self) -> DataFrame:
        g = self.group(bound=False)
        claimed, committed = self.positions()
        cursor = self.client.spark.createDataFrame([(self.get()["id"], claimed, committed)], "consumer_group_id long, claimed long, committed long")
        return snapshots.groups(cursor, g.exceptions(), self.client.spark.createDataFrame([], schema("claim_lease")), self.stream.log(), F.lit(self.client.now()))

    def destroy(self, force: bool = False) -> None:
        g, me = self.group(bound=False), self.get()["id"]
        if not force and not g.exceptions().isEmpty():
            raise Condition("SQL0016", self.name)
        self.stream.store.files.delete(f"{self.stream.base}/group={me}")
        for t, column in (("consumer_group_config", "id"), ("binding_config_log", "consumer_group_id")):
            self.stream.store.replace(f"control/{t}", self.client.table(t).where(F.col(column) != me))


class Scheduler:
    """A cron schedule that produces a compacted message under its own name."""

    def __init__(self, client: Client, name: str):
        self.client, self.name = client, name

    def find(self):
        return self.client.table("schedule_config").where(F.col("name") == self.name).first()

    def get(self):
        found = self.find()
        if found is None:
            raise Condition("SQL0013", self.name)
        return found

    def _cursor(self, schedule_id: int, next_at: datetime | None, last: datetime | None) -> None:
        t = self.client.table("schedule_cursor").where(F.col("schedule_id") != schedule_id)
        self.client.store.replace("control/schedule_cursor", t.unionByName(self.client.rows("schedule_cursor", {"schedule_id": schedule_id, "next_at": next_at, "last_scheduled_at": last})))

    def _config(self, row: dict) -> None:
        t = self.client.table("schedule_config").where(F.col("id") != row["id"])
        self.client.store.replace("control/schedule_config", t.unionByName(self.client.rows("schedule_config", row)))

    def register(self, stream: str, expression: str, payload: str = "{}", schema_version: int = 1):
        """Create or replace; a changed expression reseeds the next time."""
        spec, found, now = cron.schedulable(expression), self.find(), self.client.now()
        me = found["id"] if found else self.client.next_id("schedule_config")
        self._config({"id": me, "name": self.name, "stream_id": self.client.stream(stream).get()["id"], "cron": expression, "payload": payload, "schema_version": schema_version, "suspended": bool(found and found["suspended"]), "created_at": found["created_at"] if found else now})
        if found is None or found["cron"] != expression:
            self._cursor(me, spec.next_after(now), None)
        return self.get()

    def suspend(self) -> None:
        self._config({**self.get().asDict(), "suspended": True})

    def unsuspend(self) -> None:
        """Missed times are dropped: the next time is after now."""
        me = self.get().asDict()
        self._config({**me, "suspended": False})
        self._cursor(me["id"], cron.schedulable(me["cron"]).next_after(self.client.now()), None)

    def _stream(self) -> Stream:
        return self.client.stream(self.client.table("stream_config").where(F.col("id") == self.get()["stream_id"]).first()["name"])

    def _produce(self, key: str) -> list:
        me = self.get()
        return self._stream().produce([{"payload": me["payload"], "schema_version": me["schema_version"], "routing_key": self.name, "message_key": self.name, "compaction_rank": 0, "idempotency_key": key}])

    def run(self) -> list:
        """A run by hand; the cursor stays."""
        return self._produce("")

    def tick(self) -> int:
        """Produce if due (the newest due time only) and move the cursor; the number produced."""
        me, now = self.get(), self.client.now()
        at = self.client.table("schedule_cursor").where(F.col("schedule_id") == me["id"]).select(F.unix_micros("next_at")).first()[0]
        due, after = cron.due(cron.schedulable(me["cron"]), datetime.fromtimestamp(at / 1e6, UTC), now)
        if me["suspended"] or due is None:
            return 0
        self._produce(str(expr.schedule_key_of(int(due.timestamp() * 1000), me["id"])))
        self._cursor(me["id"], after, due)
        if after is None:
            self.suspend()
        return 1

    def messages(self, group_id: int) -> DataFrame:
        s = self._stream()
        deliveries = self.client.store.table(f"{s.base}/group={group_id}/delivery_log")
        return schedules.messages(s.log(), schedules.outcomes(deliveries), self.name, group_id)

    def status(self) -> DataFrame:
        s, all_of = self._stream(), None
        for g in s.consumers().toLocalIterator():
            d = self.client.store.table(f"{s.base}/group={g['id']}/delivery_log")
            all_of = d if all_of is None else all_of.unionByName(d)
        all_of = all_of if all_of is not None else self.client.spark.createDataFrame([], schema("delivery_log"))
        keys = self.client.spark.createDataFrame([(self.name,)], "message_key string")
        return schedules.status(s.log(), s.heads(), schedules.outcomes(all_of), keys, s.consumers())

    def destroy(self) -> None:
        me = self.get()["id"]
        for t, column in (("schedule_config", "id"), ("schedule_cursor", "schedule_id")):
            self.client.store.replace(f"control/{t}", self.client.table(t).where(F.col(column) != me))
