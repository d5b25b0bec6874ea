"""Streams as partitioned Parquet tables under commit logs, with control tables beside them.

A stream is a ledger (``ledger``) of its log by id range (``part``), its idempotency keys and its
heads; a consumer group is one of its exceptions and delivery log, with its positions as the
state; the control tables are one.  One driver writes a stream; readers see whole batches.

Nothing is rewritten by a batch: keys and heads grow by the batch's own rows, exceptions by the
rows that changed, and what a key's rows add up to is settled by readers and by merges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import heads as head_ops
from ..operators import log as log_ops
from .ledger import Files, Ledger, Table
from .schema import PARTITION_SIZE, SCHEMAS, part
from .shared import written


def _heads(rows: DataFrame) -> DataFrame:
    """The winner of each key over its rows: the greatest version, rank and id; an empty head gives way."""
    order = F.struct("schema_version", "compaction_rank", "message_id")
    best = rows.groupBy("compaction_key").agg(F.max(F.when(F.col("message_id").isNotNull(), order)).alias("h"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))
    return best.select("compaction_key", "h.message_id", "h.schema_version", "h.compaction_rank", "created_at", "updated_at")


def _newest(rows: DataFrame) -> DataFrame:
    """The newest row of each message, by the commit that wrote it."""
    columns = [c for c in rows.columns if c != "message_id"]
    newest = rows.groupBy("message_id").agg(F.max_by(F.struct(*columns), "commit_number").alias("r"))
    return newest.select(*[F.col("message_id") if c == "message_id" else F.col(f"r.{c}") for c in rows.columns])


#: Exceptions are kept as changes: the commit that made the row, and whether it is gone since.
EXCEPTION_CHANGES = f"{SCHEMAS['exception_queue']}, commit_number long, gone boolean"
STREAM = {
    "message_log": Table(SCHEMAS["message_log"], "part"),
    "idempotency_key": Table(SCHEMAS["idempotency_key"]),
    "compaction_head": Table(SCHEMAS["compaction_head"], merge=_heads),
}
GROUP = {"exception_queue": Table(EXCEPTION_CHANGES, merge=_newest, settle=lambda rows: rows.where("not gone")), "delivery_log": Table(SCHEMAS["delivery_log"])}
CONTROL = {name: Table(ddl) for name, ddl in SCHEMAS.items()}


class Store:
    """All streams under one base path."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base, self.files = spark, base.rstrip("/"), Files(spark, base)

    def stream(self, stream_id: int) -> Ledger:
        return Ledger(self.files, f"stream_id={stream_id}", STREAM)

    def group(self, stream_id: int, group_id: int) -> Ledger:
        return Ledger(self.files, f"stream_id={stream_id}/group={group_id}", GROUP)

    def groups(self, stream_id: int) -> list[int]:
        return [int(n[6:]) for n in self.files.names(f"stream_id={stream_id}") if n.startswith("group=")]

    # tables by name: control/<table>, stream_id=<n>/<table>, stream_id=<n>/group=<n>/<table>

    def _ledger(self, name: str) -> tuple[Ledger, str]:
        base, kind = name.rsplit("/", 1)
        tables = GROUP if "/group=" in base else STREAM if base.startswith("stream_id=") else CONTROL
        return Ledger(self.files, base, tables), kind

    def table(self, name: str) -> DataFrame:
        """Current rows of a table; empty before the first write."""
        ledger, kind = self._ledger(name)
        rows = ledger.view(ledger.current(), kind)
        return rows.where("not gone").drop("gone", "commit_number") if kind == "exception_queue" else rows

    def replace(self, name: str, df: DataFrame) -> None:
        ledger, kind = self._ledger(name)
        draft = ledger.draft()
        if kind == "exception_queue":
            df = df.withColumns({"commit_number": F.lit(draft["number"]), "gone": F.lit(False)})
        ledger.replace(draft, kind, df)
        ledger.publish(draft)

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows to a table."""
        ledger, kind = self._ledger(name)
        draft = ledger.draft()
        ledger.add(draft, kind, df)
        ledger.publish(draft)

    # logs

    def log(self, stream_id: int, low: int | None = None, high: int | None = None, size: int = PARTITION_SIZE) -> DataFrame:
        """The stream's messages, only those partitions that ``(low, high]`` can lie in."""
        ledger = self.stream(stream_id)
        df = ledger.view(ledger.current(), "message_log")
        if low is not None:
            df = df.where((F.col("part") >= (low + 1) // size) & (F.col("id") > low))
        if high is not None:
            df = df.where((F.col("part") <= high // size) & (F.col("id") <= high))
        return df

    def log_path(self, stream_id: int) -> str:
        """Where batches appear, for file streams.  Files of a failed attempt may be among them, and merged ones go after some commits."""
        return f"{self.base}/stream_id={stream_id}/message_log"

    def head_id(self, stream_id: int) -> int:
        """Highest id ever given out: ids are not used again, even if their rows were swept."""
        return int(self.stream(stream_id).current()["state"].get("head", 0))

    def produce(self, stream_id: int, batch: DataFrame, batch_id: str | None = None, size: int = PARTITION_SIZE) -> DataFrame:
        """Append a batch idempotently and return its plan (seq, id, duplicate).

        ``batch`` has seq, idempotency_key, schema_version, routing_key, message_key,
        compaction_rank, payload, concurrency and created_at.  A batch id that was committed
        is a no-op.  Log, keys, heads, the highest id and the batch id become visible by one
        commit, so an attempt that failed anywhere has done nothing, and its ids are given to the next.
        """
        ledger = self.stream(stream_id)
        if batch_id is not None and ledger.labelled(batch_id):
            return self.spark.createDataFrame([], "seq long, id long, duplicate boolean")
        draft = ledger.draft(batch_id)
        plan = log_ops.append_plan(batch, ledger.view(draft, "idempotency_key"), int(draft["state"].get("head", 0)))
        new = plan.where("not duplicate").withColumn("part", part(F.col("id"), size))
        ledger.add(draft, "message_log", new.withColumns({c: F.expr(f"nullif({c}, '')") for c in ("routing_key", "message_key")}))
        told = written(plan.select("seq", "id", "duplicate"), "plan")
        last = told.agg(F.max("id")).first()[0]
        if last:
            draft["state"]["head"] = last
            ledger.add(draft, "idempotency_key", new.select("idempotency_key", "created_at"))
            times = new.where("compaction_rank is not null and message_key is not null").groupBy(F.col("message_key").alias("compaction_key")).agg(F.max("created_at").alias("created_at"))
            ledger.add(draft, "compaction_head", head_ops.heads(new).join(times, "compaction_key").withColumn("updated_at", F.col("created_at")))
        else:
            draft["tables"]["message_log"].pop()
        if last or batch_id is not None:
            ledger.publish(draft)
        return told

    # removing

    def _forget(self, stream_id: int, gone: DataFrame) -> None:
        """Take the exceptions, deliveries and heads of deleted messages (id) out; older rows are not promoted."""
        for group_id in self.groups(stream_id):
            ledger = self.group(stream_id, group_id)
            draft = ledger.draft()
            for kind in GROUP:
                if draft["tables"].get(kind):
                    rows = ledger.view(draft, kind)
                    ledger.replace(draft, kind, rows.join(gone.select(F.col("id").alias("message_id")), "message_id", "left_anti").select(rows.columns))
            ledger.publish(draft)

    def _without_heads(self, ledger: Ledger, draft: dict, gone: DataFrame) -> None:
        if draft["tables"].get("compaction_head"):
            rows = ledger.view(draft, "compaction_head")
            ledger.replace(draft, "compaction_head", rows.join(gone.select(F.col("id").alias("message_id")), "message_id", "left_anti").select(rows.columns))

    def drop_parts(self, stream_id: int, parts: list[int]) -> None:
        """Delete whole id ranges and what depends on them, all ranges in one pass."""
        if not parts:
            return
        ledger = self.stream(stream_id)
        draft = ledger.draft()
        gone = written(ledger.view(draft, "message_log").where(F.col("part").isin(*parts)).select("id"), "gone")
        self._forget(stream_id, gone)  # dependants first: a failure in between leaves messages, never orphans
        self._without_heads(ledger, draft, gone)
        ledger.without(draft, "message_log", parts)
        ledger.publish(draft)
        ledger.swept()

    def sweep(self, stream_id: int, swept: DataFrame) -> int:
        """Delete single messages (id, part) and what depends on them; the number of them.  Their partitions are rewritten."""
        gone = written(swept.select("id", "part"), "gone")
        parts = [r["part"] for r in gone.select("part").distinct().toLocalIterator()]
        if not parts:
            return 0
        ledger = self.stream(stream_id)
        self._forget(stream_id, gone)
        draft = ledger.draft()
        rest = ledger.view(draft, "message_log").where(F.col("part").isin(*parts)).join(gone, ["id", "part"], "left_anti")
        entry = ledger.entry("message_log", rest, level=64)
        self._without_heads(ledger, draft, gone)
        ledger.without(draft, "message_log", parts)
        draft["tables"]["message_log"].insert(0, entry)
        ledger.publish(draft)
        ledger.swept()
        return gone.count()
