"""Log and control tables derived from the synthetic star schema, as in FIXTURES.md.

Every table is a deterministic rule over the source tables, so the same table can be
written down in another SQL dialect for comparison (``plans.oracle``).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The instant at which all time-dependent queries are asked.
NOW = "2024-01-31 00:00:00"
#: Partition size that gives the small tables several partitions.
PARTITION = 1000


def text(c: Column) -> Column:
    return c.cast("string")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def micros(c: Column | str) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def pick(on: Column, choices: dict[int, str], default: str | None = None) -> Column:
    out = None
    for k, v in choices.items():
        out = F.when(on == k, v) if out is None else out.when(on == k, v)
    return out.otherwise(F.lit(default))


class Tables:
    """The derived tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def message_log(self) -> DataFrame:
        e = self.source("events")
        k = F.col("event_id")
        return e.select(
            (k + 1).alias("id"),
            F.when(k % 10 == 0, 2).otherwise(1).alias("schema_version"),
            F.when(k % 17 != 0, F.concat("event_type", F.lit("."), text(F.col("user_id") % 4))).alias("routing_key"),
            F.when(k % 5 != 0, F.concat(F.lit("user:"), text(F.col("user_id")))).alias("message_key"),
            F.when((k % 5 != 0) & (k % 2 == 0), F.floor("value").cast("long")).alias("compaction_rank"),
            F.col("props").alias("payload"),
            pick(k % 7, {0: "exclusive", 1: "ordered"}, "parallel").alias("concurrency"),
            F.col("ts").cast("timestamp").alias("created_at"),
        )

    @cached_property
    def max_id(self) -> int:
        return self.message_log.agg(F.max("id")).first()[0] or 0

    @cached_property
    def compaction_head(self) -> DataFrame:
        m = self.message_log.where("compaction_rank is not null and message_key is not null")
        h = m.groupBy(F.col("message_key").alias("compaction_key")).agg(F.max(F.struct("schema_version", "compaction_rank", "id", "created_at")).alias("h"))
        kept = h.select("compaction_key", F.col("h.id").alias("message_id"), "h.schema_version", "h.compaction_rank", "h.created_at", F.col("h.created_at").alias("updated_at"))
        empty = self.source("supplier").select(
            F.concat(F.lit("idle:"), text(F.col("s_suppkey"))).alias("compaction_key"),
            F.lit(None).cast("long").alias("message_id"), F.lit(None).cast("int").alias("schema_version"), F.lit(None).cast("long").alias("compaction_rank"),
            (now() - F.make_dt_interval(hours=F.col("s_suppkey").cast("int") % 100)).alias("created_at"),
            (now() - F.make_dt_interval(hours=F.col("s_suppkey").cast("int") % 100)).alias("updated_at"),
        )
        return kept.union(empty)

    def values(self, ddl: str, *rows: tuple) -> DataFrame:
        """A few literal rows, inlined so that the planner knows how few they are."""
        fields = StructType.fromDDL(ddl)
        made = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(fields, row, strict=True)]) for row in rows]
        return self.spark.range(1).select(F.inline(F.array(*made)))

    @cached_property
    def binding_config(self) -> DataFrame:
        from ..functions.expr import pattern_regex

        rows = [(1, "click.*"), (1, "error.1"), (2, "*.2")]
        return self.values("consumer_group_id long, pattern string, pattern_regex string", *[(g, p, pattern_regex(p)) for g, p in rows])

    @cached_property
    def consumer_group_config(self) -> DataFrame:
        return self.values("id long, stream_id long, name string", (1, 1, "billing"), (2, 1, "audit"), (3, 1, "search"), (4, 2, "idle"))

    @cached_property
    def consumer_group_cursor(self) -> DataFrame:
        n = self.max_id
        return self.values("consumer_group_id long, claimed long, committed long", (1, n * 9 // 10, n * 4 // 10), (2, n, n * 95 // 100), (3, n * 6 // 10, n * 6 // 10))

    @cached_property
    def exception_queue(self) -> DataFrame:
        c = self.consumer_group_cursor
        m, k, g = self.message_log, F.col("id"), F.col("consumer_group_id")
        x = m.join(F.broadcast(c), ((k + g) % 23 == 0) & (k > F.col("committed")) & (k <= F.col("claimed")))
        return x.select(
            g, k.alias("message_id"),
            pick(k % 11, {0: "dead", 1: "inflight", 2: "deferred", 3: "superseded"}, "ready").alias("status"),
            "message_key", "concurrency", (k % 5).cast("int").alias("attempts"), F.when(k % 13 == 0, 1).otherwise(0).alias("delays"),
            F.when(k % 3 == 0, now() + F.expr("interval 1 hour")).otherwise(now() - F.expr("interval 1 hour")).alias("can_run_after"),
            F.when(k % 5 != 0, F.concat(F.lit("error "), text(k % 4))).alias("last_error"),
            F.when(k % 11 == 1, F.when(k % 2 == 0, now() - F.expr("interval 10 minutes")).otherwise(now() + F.expr("interval 10 minutes"))).alias("lease_expires_at"),
            "created_at", F.col("created_at").alias("updated_at"),
        )

    @cached_property
    def claim_lease(self) -> DataFrame:
        n = self.max_id
        a, b, c = n * 80 // 100, n * 85 // 100, n * 99 // 100
        rows = [(1, "t1", a, a + n // 100, 1, -5), (1, "t2", b, b + n // 100, 3, -1), (2, "t3", c, n, 0, 5)]
        made = self.values("consumer_group_id long, token string, low long, high long, reclaims int, minutes int", *rows)
        return made.select("consumer_group_id", "token", "low", "high", (now() + F.make_dt_interval(mins=F.col("minutes"))).alias("expires_at"), "reclaims")

    @cached_property
    def message_key_lease(self) -> DataFrame:
        u = F.col("c_custkey")
        return self.source("customer").select(
            (1 + u % 2).alias("consumer_group_id"), F.concat(F.lit("user:"), text(u)).alias("message_key"),
            F.when(u % 11 == 0, now() + F.expr("interval 1 minute")).otherwise(now() - F.expr("interval 1 minute")).alias("expires_at"),
        )

    @cached_property
    def delivery_log(self) -> DataFrame:
        k = F.col("id")
        m = self.message_log.where(k % 9 == 0).select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("attempt"))
        return m.select(
            (1 + k % 2).alias("consumer_group_id"), k.alias("message_id"), "attempt",
            pick((k + F.col("attempt")) % 6, {0: "success", 1: "expired", 2: "deferred", 3: "killed"}, "failure").alias("status"),
            F.concat(F.lit("error "), text(k % 4)).alias("error"),
            (F.col("created_at") + F.make_dt_interval(mins=F.col("attempt"))).alias("attempted_at"),
        )

    @cached_property
    def idempotency_key(self) -> DataFrame:
        o = self.source("orders")
        return o.select(F.concat(F.lit("order-"), text(F.col("o_orderkey"))).alias("idempotency_key"), (now() - F.make_dt_interval(hours=F.col("o_orderkey").cast("int") % 50)).alias("created_at"))

    @cached_property
    def produced(self) -> DataFrame:
        """A batch to append: rows with caller keys, some known, some repeated in the batch."""
        li = self.source("lineitem")
        seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
        key = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("order-"), text(F.col("l_orderkey")))).otherwise(F.concat(F.lit("line-"), text(F.col("l_orderkey"))))
        return li.groupBy(seq.alias("seq"), key.alias("idempotency_key")).agg(F.max(F.concat(F.lit("part:"), text(F.col("l_partkey") % 40))).alias("message_key"), F.max(F.col("l_partkey")).alias("compaction_rank"))

    @cached_property
    def binding_config_log(self) -> DataFrame:
        rows = [
            (1, 1, "installed", ["click.*"], "a"), (2, 1, "waiting", ["click.*", "error.1"], "b"), (3, 1, "waiting", ["error.1"], "c"), (4, 1, "installed", ["click.*", "error.1"], "b"),
            (5, 2, "installed", ["*.2"], "a"), (6, 2, "waiting", ["*.3"], "d"), (7, 2, "waiting", ["*.2"], "e"), (8, 2, "waiting", ["*.4"], "d"), (9, 1, "waiting", ["view.*"], "c"),
        ]
        made = self.values("id long, consumer_group_id long, status string, patterns array<string>, declared_by string", *rows)
        return made.select("*", (now() - F.make_dt_interval(hours=(20 - F.col("id")).cast("int"))).alias("declared_at"))

    @cached_property
    def stream_config(self) -> DataFrame:
        day = 86400 * 10**9
        return self.values(
            "id long, name string, partition_size long, retention_ns long, allow_drop_past_committed boolean",
            (1, "orders", PARTITION, 12 * day, False), (2, "__system.metrics", PARTITION, day, True), (3, "__system.alerts", PARTITION, 7 * day, False),
        )

    @cached_property
    def worker_config(self) -> DataFrame:
        s, k = self.source("supplier"), F.col("s_suppkey")
        return s.select(
            k.alias("id"), F.concat(F.lit("worker"), text(F.col("s_nationkey") % 5)).alias("name"),
            F.when(k % 3 == 2, F.lit(1)).cast("long").alias("system_id"), F.when(k % 3 == 1, 1 + k % 3).cast("long").alias("stream_id"), F.when(k % 3 == 0, 1 + k % 4).cast("long").alias("consumer_group_id"),
            (k % 4 - 1).cast("int").alias("target_instances"), F.concat(F.lit('{"rate": '), text(k % 7), F.lit("}")).alias("metadata"),
            (now() - F.make_dt_interval(hours=k.cast("int"))).alias("created_at"),
        )

    @cached_property
    def worker_instance(self) -> DataFrame:
        c, k = self.source("customer"), F.col("c_custkey")
        return c.select(
            k.alias("n"), (k % 97).alias("worker_id"), F.concat(F.lit("i"), text(k)).alias("token"),
            F.when(k % 4 == 0, now() + F.expr("interval 30 seconds")).otherwise(now() - F.make_dt_interval(mins=k.cast("int") % 60 + 1)).alias("expires_at"),
            (k % 3).cast("int").alias("attempts"), (now() - F.make_dt_interval(hours=k.cast("int") % 200)).alias("created_at"),
        )

    @cached_property
    def worker_instance_log(self) -> DataFrame:
        """Lease intervals of the collector: from each event of a user, for 1 to 30 minutes."""
        e = self.source("events")
        start = F.col("ts").cast("timestamp")
        return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("worker_id"), start.alias("started_at"), (start + F.make_dt_interval(mins=(1 + F.col("event_id") % 30).cast("int"))).alias("expires_at"))

    @cached_property
    def schedule_config(self) -> DataFrame:
        rows = [(1, "click.1", 1, "*/5 * * * *", False), (2, "error.1", 1, "0 * * * *", False), (3, "view.2", 1, "0 0 * * *", True), (4, "signup.3", 1, "30 2 * * 1", False)]
        return self.values("id long, name string, stream_id long, cron string, suspended boolean", *rows)

    @cached_property
    def schedule_cursor(self) -> DataFrame:
        rows = [(1, -31), (2, -5), (3, -500), (4, 60)]
        made = self.values("schedule_id long, minutes int", *rows)
        return made.select("schedule_id", (now() + F.make_dt_interval(mins=F.col("minutes"))).alias("next_at"))

    @cached_property
    def migration_log(self) -> DataFrame:
        rows = [(1, "system", 1, 1, 1, "success"), (2, "stream", 1, 1, 1, "success"), (3, "system", 1, 2, 1, "failure"), (4, "system", 1, 2, 1, "success"), (5, "stream", 1, 2, 2, "success"), (6, "stream", 2, 1, 1, "success"), (7, "stream", 1, 3, 2, "failure")]
        return self.values("id long, scope string, owner_id long, version int, min_compatible int, status string", *rows)

    @cached_property
    def measurement(self) -> DataFrame:
        """Hourly counts of a user's events of one type, and their values, as gauges and counters."""
        e = self.source("events")
        g = e.groupBy("event_type", "user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("at")).agg(F.count("*").alias("n"), F.min("event_id").alias("id"))
        return g.select(
            "id", F.concat(F.lit("app."), "event_type").alias("name"), F.when(F.col("event_type") == "error", "counter").otherwise("gauge").alias("kind"), F.lit("{event}").alias("unit"),
            F.col("n").cast("double").alias("value"), F.create_map(F.lit("user"), text(F.col("user_id")), F.lit("area"), text(F.col("user_id") % 3)).alias("attributes"), "at",
        )

    @cached_property
    def routine_event(self) -> DataFrame:
        """Abandoned and cleared events of handler routines, as JSON payloads on the metrics stream."""
        e, k = self.source("events").where("event_type in ('error', 'view')"), F.col("event_id")
        kind = F.when(F.col("event_type") == "error", "abandoned").otherwise("cleared")
        return e.select(
            F.concat(F.lit('{"type": "'), kind, F.lit('", "message_id": '), text(k % 400), F.lit(', "attempt": '), text(k % 3), F.lit(', "at_us": '), text(F.unix_micros(F.col("ts").cast("timestamp"))), F.lit("}")).alias("payload"),
            F.concat(F.lit("group."), text(k % 2)).alias("routing_key"),
        )

    @cached_property
    def evaluation(self) -> DataFrame:
        """Condition samples of all users: active unless the value is low, insufficient now and then."""
        e, k = self.source("events"), F.col("event_id")
        state = F.when(k % 29 == 0, "insufficient_evidence").when(F.col("value") < 2, "healthy").otherwise("active")
        return e.select(F.col("user_id").alias("subject"), k.alias("id"), F.col("ts").cast("timestamp").alias("created_at"), state.alias("state"))

    @cached_property
    def alert_head(self) -> DataFrame:
        """What was last published for the subjects of orders; a customer without orders has nothing."""
        c, k = self.source("orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), F.col("c_custkey")
        return c.select(k.alias("subject"), F.when(k % 3 == 0, "resolved").otherwise("active").alias("status"), F.when(k % 5 == 0, "critical").otherwise("warn").alias("severity"), (now() - F.make_dt_interval(hours=k.cast("int") % 9)).alias("created_at"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
