"""Consumer groups over a store: claim a range, hand messages to a function, record the outcomes.

A step is one commit of a group: positions, exceptions and delivery log become visible
together.  A failure before that leaves all of them, and the next step reads the range again
(handlers run at least once); after ``max_reclaims`` failures of a range, its messages go to
the exception table one by one, so a message that kills the handler can't hold up the others.

A handler that is still running when its time and the grace are over is given up: the message
failed, and its thread is left behind.
"""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import claims, deliveries, reads
from ..sources.schema import PARTITION_SIZE, schema
from ..sources.shared import written
from ..sources.store import Store


class Permanent(Exception):
    """The message can't ever succeed."""


class Later(Exception):
    """Run the message again after a delay."""

    def __init__(self, seconds: float):
        super().__init__(f"run again in {seconds} s")
        self.seconds = seconds


def classified(error: BaseException) -> tuple[str, int]:
    """Outcome and delay (microseconds): a delay anywhere in the chain, then a permanent failure, else an exception."""
    chain: list[BaseException] = []
    e: BaseException | None = error
    while e is not None and e not in chain:
        chain.append(e)
        e = e.__cause__ or e.__context__
    for x in chain:
        if isinstance(x, Later):
            return "delayed", int(x.seconds * 1_000_000)
    return ("terminal", 0) if any(isinstance(x, Permanent) for x in chain) else ("exception", 0)


Handler = Callable[[dict], None]


def called(handler: Handler, message: dict, timeout_s: float | None, grace_s: float) -> None:
    """Run a handler, for ``timeout_s`` and ``grace_s`` at most."""
    if timeout_s is None:
        handler(message)
        return
    done: queue.Queue = queue.Queue(1)

    def run() -> None:
        try:
            handler(message)
            done.put(None)
        except BaseException as e:  # noqa: BLE001
            done.put(e)

    threading.Thread(target=run, daemon=True).start()
    try:
        error = done.get(timeout=timeout_s + grace_s)
    except queue.Empty:
        raise TimeoutError(f"hard timeout after {timeout_s + grace_s:g} s, handler abandoned for message {message['id']}") from None
    if error is not None:
        raise error


def handled(messages: DataFrame, handler: Handler, timeout_s: float | None = None, grace_s: float = 0.0) -> DataFrame:
    """Outcome of each message.  Messages of an exclusive or ordered key run one by one, by id, in one task.

    Rows are dealt out by key, or by id where order doesn't matter, so a hot key without a
    policy is spread.  An ordered key's messages after a failure that isn't terminal are deferred.
    """
    keyed = F.col("message_key").isNotNull() & (F.col("concurrency") != "parallel")
    dealt = messages.withColumn("_chain", F.when(keyed, F.concat(F.lit("k"), "message_key")).otherwise(F.concat(F.lit("i"), F.col("id").cast("string"))))
    dealt = dealt.repartition("_chain").sortWithinPartitions("_chain", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped = None
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                outcome, wait, error = "success", 0, None
                if stopped == r["_chain"] and r["concurrency"] == "ordered":
                    outcome = "deferred"
                else:
                    try:
                        called(handler, {k: v for k, v in r.items() if k != "_chain"}, timeout_s, grace_s)
                    except Exception as e:  # noqa: BLE001
                        (outcome, wait), error = classified(e), f"{type(e).__name__}: {e}"
                        if outcome != "terminal":
                            stopped = r["_chain"]
                out.append((r["id"], r["message_key"], r["concurrency"], outcome, wait, error))
            yield pd.DataFrame(out, columns=["id", "message_key", "concurrency", "outcome", "delay_us", "error"])

    return dealt.mapInPandas(run, "id long, message_key string, concurrency string, outcome string, delay_us long, error string")


NONE_HELD = "consumer_group_id long, message_key string, expires_at timestamp"


class Group:
    """One consumer group of one stream."""

    def __init__(self, store: Store, stream_id: int, group_id: int, version: int, patterns: list[str] = (), size: int = PARTITION_SIZE, max_retries: int = 3, max_delays: int = 0, max_reclaims: int = claims.MAX_RECLAIMS, backoff: tuple[int, int, float] = (1_000_000, 300_000_000, 2.0), mode: str = "failures", timeout_s: float | None = 30.0, grace_s: float = 5.0):
        from ..functions.expr import pattern_regex

        self.store, self.stream_id, self.group_id, self.version, self.size = store, stream_id, group_id, version, size
        self.max_retries, self.max_delays, self.max_reclaims, self.backoff, self.mode = max_retries, max_delays, max_reclaims, backoff, mode
        self.timeout_s, self.grace_s = timeout_s, grace_s
        self.base, self.spark, self.ledger = f"stream_id={stream_id}", store.spark, store.group(stream_id, group_id)
        self.bindings = self.spark.createDataFrame([(group_id, p, pattern_regex(p)) for p in patterns], "consumer_group_id long, pattern string, pattern_regex string")

    def _state(self) -> dict:
        """The group's positions, and the failures of the open range."""
        return {"claimed": 0, "committed": 0, "reclaims": 0} | self.ledger.current()["state"]

    def exceptions(self) -> DataFrame:
        return self.store.table(f"{self.base}/group={self.group_id}/exception_queue")

    def deliveries(self) -> DataFrame:
        return self.store.table(f"{self.base}/group={self.group_id}/delivery_log")

    def _commit(self, state: dict, changed: DataFrame | None = None, logged: DataFrame | None = None) -> None:
        """One commit of positions, changed exceptions (with ``gone``) and deliveries."""
        draft = self.ledger.draft()
        if changed is not None:
            self.ledger.add(draft, "exception_queue", changed.withColumn("commit_number", F.lit(draft["number"])))
        if logged is not None:
            self.ledger.add(draft, "delivery_log", logged)
        open_rows = self.ledger.view(draft, "exception_queue").where(~F.col("gone") & F.col("status").isin(*claims.UNRESOLVED))
        first = open_rows.agg(F.min("message_id")).first()[0]
        state["committed"] = max(state["committed"], min(state["claimed"], first - 1 if first is not None else state["claimed"]))
        draft["state"] = state
        self.ledger.publish(draft)

    def _verdicts(self, messages: DataFrame, low: int, at) -> DataFrame:
        """``messages`` with ``verdict``: busy behind an earlier exception of an ordered key, superseded by a newer message, or acquired.

        Ranges before ``low`` are done with but for their exceptions, so ``low`` counts as committed.
        """
        me = F.lit(self.group_id).cast("long")
        asked = messages.select(me.alias("consumer_group_id"), "id", "message_key", "concurrency", "compaction_rank")
        committed = self.spark.createDataFrame([(self.group_id, low)], "consumer_group_id long, committed long")
        heads, log = self.store.table(f"{self.base}/compaction_head"), self.store.log(self.stream_id, low, low, self.size)
        found = deliveries.verdicts(asked, heads, self.exceptions(), self.spark.createDataFrame([], NONE_HELD), committed, log, low, at)
        return messages.join(found.select("id", "verdict"), "id", "left")

    def _unrun(self, messages: DataFrame, outcome: str, error: str | None = None) -> DataFrame:
        return messages.select("id", "message_key", "concurrency", F.lit(outcome).alias("outcome"), F.lit(0).cast("long").alias("delay_us"), F.lit(error).cast("string").alias("error"))

    def step(self, handler: Handler, limit: int, now: datetime | None = None) -> int:
        """Claim the next range and handle its eligible messages; the number of ids claimed."""
        now, state = now or datetime.now(UTC), self._state()
        low, head = state["claimed"], self.store.head_id(self.stream_id)
        high = min(low + limit, head)
        if high <= low:
            return 0
        log, at = self.store.log(self.stream_id, low, high, self.size), F.lit(now)
        if state["reclaims"] >= self.max_reclaims:
            rows = self._unrun(log, "quarantined", "range failed too often")
        else:
            draft = self.ledger.draft()
            draft["state"] = state | {"reclaims": state["reclaims"] + 1}
            self.ledger.publish(draft)
            heads = self.store.table(f"{self.base}/compaction_head")
            # fixed before it is asked and run: verdicts and handlers see the same messages
            messages = written(self._verdicts(reads.eligible(log, heads, self.bindings, self.group_id, self.version, low, high), low, at), "claimed")
            verdict = F.coalesce("verdict", F.lit("acquired"))
            rows = handled(messages.where(verdict == "acquired").drop("verdict"), handler, self.timeout_s, self.grace_s)
            rows = rows.unionByName(self._unrun(messages.where(verdict == "busy"), "deferred")).unionByName(self._unrun(messages.where(verdict == "superseded"), "superseded"))
        rows = written(rows, "outcomes")  # the handler runs once for this step
        o = F.col("outcome")
        status = F.when(o == "terminal", "dead").when(o == "deferred", "deferred").otherwise("ready")
        wait = F.when(o == "exception", F.lit(self.backoff[0])).otherwise(F.col("delay_us"))
        bad = rows.where(~o.isin("success", "superseded")).select(
            F.lit(self.group_id).cast("long").alias("consumer_group_id"), F.col("id").alias("message_id"), status.alias("status"), "message_key", "concurrency", F.lit(0).alias("attempts"),
            F.when(o == "delayed", 1).otherwise(0).alias("delays"), F.timestamp_micros(F.unix_micros(at) + wait).alias("can_run_after"), F.col("error").alias("last_error"),
            F.lit(None).cast("string").alias("lease_token"), F.lit(None).cast("timestamp").alias("lease_expires_at"), at.alias("created_at"), at.alias("updated_at"), F.lit(False).alias("gone"),
        )
        logged = self._log(rows.select(F.col("id").alias("message_id"), F.lit(0).alias("attempt"), F.when(o.isin("exception", "terminal"), "failure").otherwise(o).alias("status"), "error"), at)
        self._commit({"claimed": high, "committed": state["committed"], "reclaims": 0}, bad, logged)
        return high - low

    def _log(self, rows: DataFrame, at) -> DataFrame | None:
        if self.mode == "off":
            return None
        rows = rows if self.mode == "all" else rows.where("status <> 'success'")
        return rows.select(F.lit(self.group_id).cast("long").alias("consumer_group_id"), "message_id", "attempt", "status", F.coalesce("error", F.lit("")).alias("error"), at.alias("attempted_at"))

    def retry(self, handler: Handler, limit: int, now: datetime | None = None) -> int:
        """Run exceptions that may run; the number taken.  A message that a newer one of its key replaced isn't run again."""
        now, state = now or datetime.now(UTC), self._state()
        at, waiting = F.lit(now), self.exceptions()
        log = self.store.log(self.stream_id, size=self.size)
        none = self.spark.createDataFrame([], NONE_HELD)
        taken = deliveries.claimed(deliveries.claimable(waiting, log, none, self.version, self.max_retries + 1, at), limit, at, F.expr("interval 30 seconds"))
        taken = written(taken, "taken")
        n = taken.count()
        if not n:
            return 0
        payloads = log.join(taken.select(F.col("message_id").alias("id"), F.col("concurrency").alias("_policy")), "id").withColumn("concurrency", F.col("_policy")).drop("_policy")
        heads = self.store.table(f"{self.base}/compaction_head").select(F.col("message_id").alias("id"), F.lit(True).alias("_head"))
        payloads = written(payloads.join(heads, "id", "left").withColumn("_late", F.col("compaction_rank").isNotNull() & F.col("_head").isNull()).drop("_head"), "retried")
        rows = handled(payloads.where("not _late").drop("_late"), handler, self.timeout_s, self.grace_s).unionByName(self._unrun(payloads.where("_late"), "superseded"))
        rows = written(rows, "outcomes")
        event = F.when(F.col("outcome") == "exception", "failure").when(F.col("outcome") == "terminal", "permanent").when(F.col("outcome") == "deferred", "busy").otherwise(F.col("outcome"))
        ev = taken.join(rows.select(F.col("id").alias("message_id"), event.alias("event"), "delay_us", "error"), "message_id")
        step = deliveries.transitions(ev, self.max_retries, self.max_delays, *self.backoff[:2], self.backoff[2], at).join(rows.select(F.col("id").alias("message_id"), "error"), "message_id")
        after = taken.drop("status", "attempts", "delays", "can_run_after", "last_error", "lease_expires_at", "updated_at").join(step, ["consumer_group_id", "message_id"])
        made = {
            "status": F.coalesce("next_status", F.lit("success")), "attempts": F.col("next_attempts"), "delays": F.col("next_delays"), "can_run_after": F.timestamp_micros("can_run_after_us"),
            "last_error": F.col("error"), "lease_expires_at": F.lit(None).cast("timestamp"), "updated_at": at,
        }
        changed = after.select(*[made.get(c, F.col(c)).alias(c) for c in schema("exception_queue").names], F.col("next_status").isNull().alias("gone"))
        logged = self._log(step.select("message_id", F.col("log_attempt").alias("attempt"), F.col("log_status").alias("status"), "error"), at)
        self._commit(state, changed, logged)
        return n

    def run(self, handler: Handler, limit: int = 1000, now: datetime | None = None) -> None:
        """Step until the head."""
        while self.step(handler, limit, now):
            pass
