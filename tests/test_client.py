"""The handles end to end, on a clock that the tests set."""

from datetime import UTC, datetime, timedelta

import pytest

from sluice.client import Client, StreamConfig
from sluice.functions.codes import CODES, Condition, explain


class Clock:
    def __init__(self):
        self.t = datetime(2026, 1, 1, tzinfo=UTC)

    def __call__(self):
        return self.t


@pytest.fixture
def clock():
    return Clock()


@pytest.fixture
def client(spark, tmp_path, clock):
    return Client(spark, f"file://{tmp_path}", clock)


def code(f, *a, **k):
    with pytest.raises(Condition) as e:
        f(*a, **k)
    return e.value.code


def test_streams_keys_and_consumers(client, clock):
    orders = client.stream("orders")
    assert code(orders.get) == "SQL0005"
    orders.register(StreamConfig(partition_size=2, retention=timedelta(days=1), delivery_log_mode="all"))
    assert code(orders.register, StreamConfig(partition_size=3)) == "SQL0004"
    with pytest.raises(ValueError):
        client.stream("Bad*Name").register()
    got = orders.produce([{"payload": "1", "message_key": "a", "compaction_rank": 1, "routing_key": "x.1"}, {"payload": "2", "message_key": "a", "compaction_rank": 3}, {"payload": "3", "idempotency_key": "once"}, {"payload": "4", "idempotency_key": "once"}])
    assert [(r.id, r.duplicate) for r in got] == [(1, False), (2, False), (3, False), (0, True)]
    assert orders.key("a").compaction_head()["id"] == 2 and code(orders.key("zz").compaction_head) == "SQL0066"
    assert [r.id for r in orders.key("a").messages().collect()] == [2, 1]

    billing = orders.consumer("billing")
    assert code(billing.get) == "SQL0014"
    billing.register(["x.*"])
    orders.consumer("all").register()
    late = orders.consumer("late")
    late.register(position="head")
    assert billing.binding() == ["x.*"] and late.positions() == (3, 3)
    seen = client.spark.sparkContext.accumulator(0)
    orders.consumer("all").consume(lambda m: seen.add(m["id"]))
    assert seen.value == 2 + 3  # message 1 is superseded
    m = orders.consumer("all").metrics().first()
    assert (m["head"], m["committed"], m["backlog"]) == (3, 3, 0)
    health = orders.health().first()
    assert health["verdict"] == "unsafe: heads"
    assert orders.metrics().first()["partitions"] == 2

    billing.consume(lambda m: None)
    clock.t += timedelta(days=3)
    assert orders.janitor() == {"partitions": 1, "rows": 2, "keys": 3, "heads": 0}
    assert orders.log().count() == 0 and orders.heads().count() == 0
    assert [r.id for r in orders.produce([{"payload": "5"}, {"payload": "6"}])] == [4, 5]  # ids are not used again
    orders.vacuum()
    renamed = orders.rename("sales")
    assert code(renamed.destroy) == "SQL0006"
    assert sorted(r.id for r in renamed.log().collect()) == [4, 5]
    late.stream = renamed
    late.destroy()
    renamed.destroy(force=True)
    assert client.streams().count() == 0


def test_schedules(client, clock):
    client.stream("jobs").register(StreamConfig(delivery_log_mode="all"))
    s = client.scheduler("nightly")
    assert code(s.get) == "SQL0013"
    s.register("jobs", "*/10 * * * *", '{"job": 1}')
    assert s.tick() == 0
    clock.t += timedelta(minutes=35)
    assert s.tick() == 1 and s.tick() == 0  # the newest due time, once
    s.suspend()
    clock.t += timedelta(minutes=35)
    assert s.tick() == 0
    s.unsuspend()
    assert s.tick() == 0  # missed times are dropped
    s.run()
    rows = client.stream("jobs").log().orderBy("id").collect()
    assert [r.message_key for r in rows] == ["nightly", "nightly"] and client.stream("jobs").key("nightly").compaction_head()["id"] == 2
    c = client.stream("jobs").consumer("workers")
    c.register(["night*"])
    c.consume(lambda m: None)
    st = s.status().first()
    assert (st["messages"], st["ran"], st["succeeded"], st["superseded"]) == (2, 1, 1, 1)
    got = {r.id: (r.ran, r.superseded_by) for r in s.messages(c.get()["id"]).collect()}
    assert got == {1: (False, 2), 2: (True, None)}
    s.destroy()
    assert client.schedulers().count() == 0


def test_system_metrics(client):
    client.system.register()
    client.system.register()
    assert client.system.migration_version() == (1, 1)
    client.system.produce_measurements([{"name": "app.lag", "kind": "gauge", "value": v, "unit": "{message}", "attributes": {"group": g}} for g, v in (("a", 1.0), ("b", 2.0), ("a", 5.0))])
    m = client.system.metrics()
    assert {r.message_key: r.value for r in m.latest().collect()} == {"app.lag|group=a": 5.0, "app.lag|group=b": 2.0}
    assert [r.value for r in m.history("app.lag", {"group": "a"}, timedelta(hours=1)).collect()] == [5.0, 1.0]
    assert 'app_lag{group="a"} 5.0' in m.exposition()
    with pytest.raises(ValueError):
        client.system.produce_measurements([{"name": "x", "kind": "gauge", "value": 1.0, "unit": "{a"}])
    client.stream("orders").register(StreamConfig(partition_size=10))
    client.stream("orders").consumer("billing").register()
    client.stream("orders").produce([{"payload": "1"}])
    n = client.system.collect()
    now = {r.message_key: r.value for r in client.system.metrics().latest().collect()}
    assert n == len(now) - 2 and now["consumer.cursor.backlog|group=billing,stream=orders"] == 1 and now["stream.state.partitions|stream=orders"] == 1
    assert now["metrics.collector.completed_timestamp"] == client.now().timestamp() and now["worker.state.unclaimed_workers"] == 0
    assert code(client.system.destroy) == "SQL0011"
    client.stream("orders").destroy(force=True)
    client.system.destroy()


def test_codes():
    assert len(CODES) == 62
    assert explain("SQL0028") == {"code": "SQL0028", "kind": "event", "condition": "messages dead-lettered", "queries": ["diag_sql0028_dead_newest_first", "diag_sql0028_errors_of_dead"]}
    with pytest.raises(ValueError):
        Condition("SQL0028")


def test_alerts_are_evaluated_and_published_once(client, clock):
    client.system.register()
    client.stream("orders").register(StreamConfig(partition_size=1))
    client.stream("orders").produce([{"payload": str(i)} for i in range(4)])
    for _ in range(4):
        client.system.collect()
        clock.t += timedelta(seconds=60)
    clock.t -= timedelta(seconds=30)
    first = client.system.check_alerts(partition_threshold=3)
    assert first["published_alerts"] == 1 and first["resolved_alerts"] == 0
    assert [(r.owner, r.status) for r in client.system.alert("partition_count").current().collect()] == [("orders", "active")]
    assert client.system.check_alerts(partition_threshold=3)["published_alerts"] == 0  # within the repeat time
    assert client.system.check_alerts(partition_threshold=300)["resolved_alerts"] == 1
    assert [r.status for r in client.system.alert("partition_count").history("orders").collect()] == ["resolved", "active"]
    with pytest.raises(ValueError):
        client.system.alert("none")
    assert client.system.janitor() == {"worker_instance": 0, "worker_instance_log": 0, "binding_config_log": 0}


def test_bad_messages_hold_up_no_others(client):
    client.stream("orders").register()
    got = client.stream("orders").produce_each([{"payload": "{}"}, {"payload": "{"}, {"payload": "{}", "concurrency": "ordered"}, {"payload": "{}", "message_key": "a", "compaction_rank": 1}])
    assert [(r["id"], r["rejected"]) for r in got] == [(1, None), (0, "payload is not JSON"), (0, "concurrency without key"), (2, None)]


def test_expired_rows_are_swept_after_the_grace_period(client, clock):
    s = client.stream("orders")
    s.register(StreamConfig(partition_size=100, retention=timedelta(days=1)))
    s.produce([{"payload": "1"}, {"payload": "2"}])
    clock.t += timedelta(days=1, minutes=5)
    s.produce([{"payload": "3"}])
    assert s.janitor()["rows"] == 0
    clock.t += timedelta(minutes=6)
    assert s.janitor()["rows"] == 2
    assert [r.id for r in s.log().collect()] == [3]


def test_producers_transactions_and_readings(client, clock):
    client.system.register()
    orders, audit = client.stream("orders"), client.stream("audit")
    assert code(orders.producer().register) == "SQL0005"
    orders.register()
    audit.register()
    p = orders.producer().register()
    assert p.produce("{}", idempotency_key="a") == 1 and p.produce("{}", idempotency_key="a") == 0
    with pytest.raises(ValueError):
        p.produce_batch([{"payload": "1"}, {"payload": "2", "concurrency": "ordered"}])
    with pytest.raises(KeyError):
        p.produce_func(lambda write: (write("1"), {}["none"]))
    assert orders.log().count() == 1  # all or nothing
    assert len(p.produce_func(lambda write: [write(str(i)) for i in range(3)])) == 3
    with client.transaction() as write:
        write("orders", "5", routing_key="x")
        write("audit", "6")
    with pytest.raises(KeyError), client.transaction() as write:
        write("orders", "never")
        raise KeyError
    assert (orders.log().count(), audit.log().count()) == (5, 1)
    head = orders.key("k").lock_compaction_head()
    assert head["message_id"] is None and orders.key("k").lock_compaction_head()["compaction_key"] == "k" and orders.heads().count() == 1
    orders.consumer("billing").register()
    client.system.collect()
    assert orders.readings().state_partitions.latest() == 1 and orders.consumer("billing").readings().cursor_head.latest() == 5
    assert [r.value for r in orders.readings().metric("stream.state.partitions").history(timedelta(hours=1)).collect()] == [1]
    with pytest.raises(ValueError):
        orders.readings().metric("consumer.cursor.head")
    with pytest.raises(AttributeError):
        orders.readings().nothing  # noqa: B018


def test_the_manager_runs_backs_off_and_respects_suspension(client, clock):
    client.system.register()
    orders = client.stream("orders")
    orders.register(StreamConfig(retention=timedelta(days=1)))
    ran = []

    def flaky(worker):
        ran.append(clock.t)
        if len(ran) < 3:
            raise RuntimeError("not yet")

    m = client.manager({"flaky": flaky})
    me = m.declare("flaky")
    m.declare("unknown")
    assert m.run_once() == {me: "RuntimeError: not yet"} and m.run_once() == {}  # backs off for a second
    clock.t += timedelta(seconds=1)
    assert m.run_once() == {me: "RuntimeError: not yet"}
    clock.t += timedelta(seconds=1)
    assert m.run_once() == {}  # two by now
    clock.t += timedelta(seconds=1)
    assert m.run_once() == {me: None} and len(ran) == 3
    assert client.table("worker_instance_log").count() == 3
    j = orders.maintenance()
    assert j.status() == "enabled"
    j.suspend()
    assert j.status() == "suspended" and orders.workers().first()["state"] == "suspended"
    assert client.manager().run_once() == {}
    j.unsuspend()
    assert list(client.manager().run_once().values()) == [None]
    assert client.system.get()["version"] == 1 and client.system.migrate_streams() == 4 and client.system.migrate_streams() == 0


def test_bindings_wait_for_live_consumers(client, clock):
    orders = client.stream("orders")
    orders.register()
    g = orders.consumer("billing")
    g.register(["a.*"])
    me = client.manager({}).declare("consumer", consumer_group_id=g.get()["id"])
    client.put("worker_instance", {"worker_id": me, "token": "t", "expires_at": clock.t + timedelta(seconds=30), "attempts": 0, "created_at": clock.t})
    g.register(["b.*"])
    assert g.live() and g.binding() == ["a.*"]
    assert [r.status for r in client.table("binding_config_log").orderBy("id").collect()] == ["installed", "waiting"]
    clock.t += timedelta(minutes=1)
    g.register(["b.*"])
    assert not g.live() and g.binding() == ["b.*"]
