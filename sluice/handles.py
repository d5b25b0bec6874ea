"""Further handles of the client: producers, readings, maintenance, and the manager that runs workers.

A worker is a row of ``worker_config`` (a name, an owner, how many instances it may have); an
instance is a lease on it.  The manager claims what may run, runs it once, and writes down how
it went: a worker that failed is left alone for a while that doubles with each failure.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.codes import Condition
from .operators import control, metrics

if TYPE_CHECKING:
    from .client import Client, Stream

#: Version of the layout that this build writes, and the oldest build that may read it.
BUILD, MIN_COMPATIBLE = 1, 1


class Producer:
    """Appends to a stream."""

    def __init__(self, stream: Stream):
        self.stream = stream

    def register(self) -> Producer:
        """Make sure that the stream is there."""
        self.stream.get()
        return self

    def produce(self, payload: str | None, **options) -> int:
        """Append one message; its id, or 0 where its idempotency key is known."""
        return self.stream.produce([{"payload": payload, **options}])[0]["id"]

    def produce_batch(self, items: list[dict], batch_id: str | None = None) -> list:
        """Append all messages or none."""
        return self.stream.produce(items, batch_id)

    def produce_func(self, make: Callable[[Callable[..., None]], None]) -> list:
        """Append what ``make`` hands to the function it is given, as one unit; nothing if it raises."""
        items: list[dict] = []
        make(lambda payload, **options: items.append({"payload": payload, **options}))
        return self.stream.produce(items) if items else []


@contextmanager
def transaction(client: Client) -> Iterator[Callable[..., None]]:
    """Collect messages for any streams, and append them when the block ends well: ``write(stream, payload, **options)``.

    Each stream's messages become visible at once.  The streams follow each other; a failure
    in between is mended by running the block's batches again under the same id, which does
    nothing for streams that have theirs.
    """
    made: dict[str, list[dict]] = {}
    yield lambda stream, payload, **options: made.setdefault(stream, []).append({"payload": payload, **options})
    batch = uuid.uuid4().hex
    for name, items in made.items():
        for attempt in (1, 2, 3):
            try:
                client.stream(name).produce(items, batch)
                break
            except (ValueError, Condition):
                raise
            except Exception:  # noqa: BLE001
                if attempt == 3:
                    raise


class Metric:
    """One retained series."""

    def __init__(self, client: Client, name: str, attributes: dict[str, str]):
        self.client, self.name, self.attributes = client, name, attributes

    def latest(self) -> float | None:
        found = self.client.system.metrics().latest(self.name, self.attributes, 1).first()
        return None if found is None else found["value"]

    def history(self, window: timedelta) -> DataFrame:
        return self.client.system.metrics().history(self.name, self.attributes, window)


class Readings:
    """The metrics of an owner, each also as an attribute: ``consumer.readings().cursor_head``."""

    def __init__(self, client: Client, scope: str, attributes: dict[str, str], snapshot: Callable[[], DataFrame]):
        self.client, self.scope, self.attributes, self.snapshot = client, scope, attributes, snapshot

    def definitions(self) -> list[tuple[str, str, str, str]]:
        return metrics.definitions(self.scope)

    def metric(self, name: str) -> Metric:
        if name not in {d[0] for d in self.definitions()}:
            raise ValueError(f"no {self.scope} metric is named {name}")
        return Metric(self.client, name, self.attributes)

    def __getattr__(self, short: str) -> Metric:
        for name, *_ in metrics.definitions(self.__dict__["scope"]):
            if name.split(".", 1)[1].replace(".", "_") == short:
                return self.metric(name)
        raise AttributeError(short)


class Maintenance:
    """Whether one of a stream's maintenance workers may run."""

    def __init__(self, stream: Stream, name: str):
        self.stream, self.client, self.name = stream, stream.client, name

    def _row(self):
        return self.client.table("worker_config").where((F.col("name") == self.name) & (F.col("stream_id") == self.stream.get()["id"])).first()

    def _put(self, target: int) -> None:
        found, me = self._row(), self.stream.get()["id"]
        made = {"id": found["id"] if found else self.client.next_id("worker_config"), "name": self.name, "stream_id": me, "target_instances": target, "metadata": "{}", "created_at": found["created_at"] if found else self.client.now()}
        rest = self.client.table("worker_config").where(F.col("id") != made["id"])
        self.client.store.replace("control/worker_config", rest.unionByName(self.client.rows("worker_config", made)))

    def suspend(self) -> None:
        self._put(0)

    def unsuspend(self) -> None:
        self._put(1)

    def status(self) -> str:
        """suspended, or enabled."""
        found = self._row()
        return "suspended" if found is not None and found["target_instances"] == 0 else "enabled"


class Manager:
    """Runs the workers that are declared in a store, by the functions given for their names."""

    def __init__(self, client: Client, kinds: dict[str, Callable], lease: timedelta = timedelta(seconds=30), base: timedelta = timedelta(seconds=1), most: timedelta = timedelta(minutes=5)):
        self.client, self.kinds, self.lease, self.base, self.most = client, kinds, lease, base, most

    def declare(self, name: str, target: int = 1, metadata: str = "{}", **owner: int) -> int:
        """Declare a worker of the system, a stream (``stream_id``) or a group (``consumer_group_id``); its id."""
        me = self.client.next_id("worker_config")
        self.client.put("worker_config", {"id": me, "name": name, "target_instances": target, "metadata": metadata, "created_at": self.client.now(), **(owner or {"system_id": 1})})
        return me

    def _instance(self, worker_id: int, token: str, expires_at: datetime, attempts: int, started: datetime) -> None:
        c = self.client
        rest = c.table("worker_instance").where(F.col("worker_id") != worker_id)
        c.store.replace("control/worker_instance", rest.unionByName(c.rows("worker_instance", {"worker_id": worker_id, "token": token, "expires_at": expires_at, "attempts": attempts, "created_at": started})))

    def claimable(self) -> list:
        """Workers that may run now: not suspended, no live instance or backoff, and known to this manager."""
        c = self.client
        admitted = control.live_counts(c.table("worker_config"), c.table("worker_instance"), F.lit(c.now())).where("admits").select("id")
        return [r for r in c.table("worker_config").join(admitted, "id", "left_semi").orderBy("id").collect() if r["name"] in self.kinds]

    def run_once(self) -> dict[int, str | None]:
        """Claim and run what may run; the error of each worker that ran, or None."""
        c, done = self.client, {}
        for worker in self.claimable():
            found = c.table("worker_instance").where(F.col("worker_id") == worker["id"]).first()
            failed, token, started = found["attempts"] if found else 0, uuid.uuid4().hex, c.now()
            self._instance(worker["id"], token, started + self.lease, failed, started)
            try:
                self.kinds[worker["name"]](worker)
                done[worker["id"]] = None
                self._instance(worker["id"], token, c.now(), 0, started)
            except Exception as e:  # noqa: BLE001
                done[worker["id"]] = f"{type(e).__name__}: {e}"
                wait = min(self.most, self.base * 2**failed)
                self._instance(worker["id"], token, c.now() + wait, failed + 1, started)
            c.put("worker_instance_log", {"id": c.next_id("worker_instance_log"), "worker_id": worker["id"], "token": token, "started_at": started, "expires_at": started + self.lease, "released_at": c.now()})
        return done


def supported(client: Client) -> None:
    """Raise where this build may not run on the store."""
    version, floor = client.system.migration_version()
    if version < BUILD:
        raise Condition("SQL0022", f"version {version}")
    if floor > BUILD:
        raise Condition("SQL0023", f"version {version} asks for builds from {floor} on")


def migrate(client: Client, scope: str, owner_id: int) -> bool:
    """Write down that an owner has this build's layout; whether that is news."""
    at = control.schema_state(client.table("migration_log"), scope).where(F.col("owner_id") == owner_id).first()
    if at is not None and at["version"] >= BUILD:
        return False
    client.put("migration_log", {"id": client.next_id("migration_log"), "scope": scope, "owner_id": owner_id, "version": BUILD, "min_compatible": MIN_COMPATIBLE, "status": "success", "applied_at": client.now()})
    return True
