"""Faults after every write, growth over many batches, and the janitor's row sweep."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluice.sources import ledger as ledgers
from sluice.sources.store import Store
from sluice.streaming import consume
from tests.test_store import START, batch


class Crash(Exception):
    pass


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}")


def crashing(monkeypatch, after: int):
    """Let the ``after``-th write of a ledger (a directory or a commit) be done, and then fail."""
    done = [0]

    def counted(f):
        def run(*a, **k):
            out = f(*a, **k)
            done[0] += 1
            if done[0] == after:
                raise Crash
            return out

        return run

    monkeypatch.setattr(ledgers.Ledger, "entry", counted(ledgers.Ledger.entry))
    monkeypatch.setattr(ledgers.Ledger, "_publish", counted(ledgers.Ledger._publish))


def test_a_batch_is_there_once_wherever_an_attempt_failed(spark, store, monkeypatch):
    want = 0
    for after in range(1, 6):
        rows = [{"key": f"{after}-{i}", "mkey": f"m{i}", "rank": after, "payload": str(after)} for i in range(2)]
        with monkeypatch.context() as m:
            crashing(m, after)
            try:
                store.produce(1, batch(spark, rows), f"b{after}", size=100)
            except Crash:
                pass
        store.produce(1, batch(spark, rows), f"b{after}", size=100)
        store.produce(1, batch(spark, rows), size=100)  # without a batch id, the keys are known
        want += 2
        assert sorted(r.id for r in store.log(1).collect()) == list(range(1, want + 1)), after
        assert store.table("stream_id=1/idempotency_key").count() == want
        assert sorted(r.message_id for r in store.table("stream_id=1/compaction_head").collect()) == [want - 1, want]


def test_a_step_is_done_once_wherever_an_attempt_failed(spark, store, monkeypatch):
    store.produce(1, batch(spark, [{"payload": str(i)} for i in range(6)]), size=100)

    def handler(m):
        if m["payload"] == "2":
            raise RuntimeError("again")

    for after in range(1, 5):
        g = consume.Group(store, 1, after, 1, mode="all", max_reclaims=9)
        with monkeypatch.context() as m:
            crashing(m, after)
            try:
                g.run(handler, 10, START)
            except Crash:
                pass
        g.run(handler, 10, START)
        assert [(r.message_id, r.status, r.attempts) for r in g.exceptions().collect()] == [(3, "ready", 0)], after
        assert sorted((r.message_id, r.attempt) for r in g.deliveries().collect()) == [(i, 0) for i in range(1, 7)]
        for after_retry in (1, 2, 3):
            with monkeypatch.context() as m:
                crashing(m, after_retry)
                try:
                    g.retry(lambda m: None, 10, START + timedelta(hours=1))
                except Crash:
                    pass
        g.retry(lambda m: None, 10, START + timedelta(hours=1))
        assert g.exceptions().count() == 0 and g._state()["committed"] == 6
        assert g.deliveries().where("message_id = 3 and attempt > 0").count() == 1


def test_batches_stay_as_fast_and_files_as_few(spark, store, monkeypatch):
    import time

    monkeypatch.setattr(ledgers, "FANOUT", 3)
    took = []
    for i in range(24):
        began = time.perf_counter()
        store.produce(1, batch(spark, [{"key": f"{i}", "mkey": "a", "rank": i}]), f"b{i}", size=10)
        took.append(time.perf_counter() - began)
    ledger = store.stream(1)
    now = ledger.current()
    assert all(len(e) <= 3 * 4 for e in now["tables"].values())
    assert len(store.files.names("stream_id=1/commits")) <= ledgers.KEPT_COMMITS
    assert sorted(r.id for r in store.log(1).collect()) == list(range(1, 25))
    assert [r.message_id for r in store.table("stream_id=1/compaction_head").collect()] == [24]
    assert store.produce(1, batch(spark, [{"key": "other"}]), "b0", size=10).count() == 0  # long ago, and still known
    assert sorted(took[-8:])[4] < 3 * sorted(took[3:11])[4]


def test_rows_are_swept_with_what_depends_on_them(spark, store):
    store.produce(1, batch(spark, [{"payload": str(i), "mkey": f"k{i}", "rank": 0} for i in range(10)]), size=4)
    g = consume.Group(store, 1, 1, 1, size=4)
    g.run(lambda m: (_ for _ in ()).throw(consume.Permanent("no")), 100, START)
    assert g.exceptions().count() == 10
    assert store.sweep(1, store.log(1).where("id in (1, 2, 4, 9)")) == 4
    left = [3, 5, 6, 7, 8, 10]
    assert sorted(r.id for r in store.log(1).collect()) == left
    assert sorted(r.id for r in store.log(1, 4, 6, size=4).collect()) == [5, 6]
    assert sorted(r.message_id for r in store.table("stream_id=1/compaction_head").collect()) == left
    assert sorted(r.message_id for r in g.exceptions().collect()) == left and store.sweep(1, store.log(1).where("false")) == 0
    store.produce(1, batch(spark, [{"key": "new"}]), size=4)
    assert sorted(r.id for r in store.log(1).collect()) == [*left, 11]


def test_a_stuck_handler_is_given_up(spark, store):
    store.produce(1, batch(spark, [{"payload": str(i)} for i in range(3)]), size=100)
    g = consume.Group(store, 1, 1, 1, mode="all", timeout_s=0.2, grace_s=0.1)

    def handler(m):
        if m["payload"] == "1":
            import time

            time.sleep(30)

    began = datetime.now(UTC)
    g.run(handler, 10, START)
    assert (datetime.now(UTC) - began).total_seconds() < 25
    r = g.exceptions().first()
    assert r.message_id == 2 and "hard timeout after 0.3 s" in r.last_error


def test_superseded_messages_are_not_run_again(spark, store):
    store.produce(1, batch(spark, [{"payload": "old", "mkey": "k", "rank": 1}]), size=100)
    g = consume.Group(store, 1, 1, 1, mode="all")
    g.run(lambda m: (_ for _ in ()).throw(RuntimeError("no")), 10, START)
    store.produce(1, batch(spark, [{"payload": "new", "mkey": "k", "rank": 2}]), size=100)

    def never(m):
        raise AssertionError("a superseded message was run")

    assert g.retry(never, 10, START + timedelta(hours=1)) == 1
    assert [(r.message_id, r.status) for r in g.exceptions().collect()] == [(1, "superseded")]
    assert g.deliveries().where("status = 'superseded'").count() == 1 and g._state()["committed"] == 1
    assert F is not None
