"""Invariants of the store: no loss, no duplicates, monotone commits, order per key."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluice.sources.store import Store
from sluice.streaming import consume, produce

START = datetime(2026, 1, 1, tzinfo=UTC)
SCHEMA = "seq long, idempotency_key string, schema_version int, routing_key string, message_key string, compaction_rank long, payload string, concurrency string, created_at timestamp"


def batch(spark, rows):
    made = [(i, r.get("key") or f"k{i}-{r.get('payload', '')}", r.get("version", 1), r.get("route"), r.get("mkey"), r.get("rank"), r.get("payload", "{}"), r.get("policy", "parallel"), START) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}")


def test_produce_is_idempotent_and_dense(spark, store):
    first = store.produce(1, batch(spark, [{"key": "a"}, {"key": "b"}, {"key": "a"}]), "b1", size=2)
    assert sorted((r.seq, r.id, r.duplicate) for r in first.collect()) == [(0, 1, False), (1, 2, False), (2, 0, True)]
    assert store.produce(1, batch(spark, [{"key": "zzz"}]), "b1", size=2).count() == 0  # the batch id was committed
    second = store.produce(1, batch(spark, [{"key": "b"}, {"key": "c"}]), "b2", size=2)
    assert sorted((r.seq, r.id, r.duplicate) for r in second.collect()) == [(0, 0, True), (1, 3, False)]
    assert [r.id for r in store.log(1).orderBy("id").collect()] == [1, 2, 3]
    assert [r.id for r in store.log(1, 1, 2, size=2).collect()] == [2]


def test_log_scan_skips_partitions(spark, store):
    store.produce(1, batch(spark, [{} for _ in range(10)]), size=3)
    plan = store.log(1, 7, 9, size=3)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "part" in plan.split("PartitionFilters")[1][:120]
    assert sorted(r.id for r in store.log(1, 7, 9, size=3).collect()) == [8, 9]


def test_heads_follow_version_rank_id_and_are_not_promoted(spark, store):
    rows = [{"mkey": "x", "rank": 5, "payload": "1"}, {"mkey": "x", "rank": 9, "payload": "2"}, {"mkey": "x", "rank": 7, "payload": "3"}, {"mkey": "y", "rank": 0, "payload": "4"}]
    store.produce(1, batch(spark, rows), size=2)
    heads = {r.compaction_key: r.message_id for r in store.table("stream_id=1/compaction_head").collect()}
    assert heads == {"x": 2, "y": 4}
    store.produce(1, batch(spark, [{"mkey": "x", "rank": 0, "version": 2, "payload": "5"}]), size=2)
    assert {r.compaction_key: r.message_id for r in store.table("stream_id=1/compaction_head").collect()} == {"x": 5, "y": 4}
    store.drop_parts(1, [2])  # ids 4 and 5
    assert store.table("stream_id=1/compaction_head").count() == 0
    assert sorted(r.id for r in store.log(1).collect()) == [1, 2, 3]


def test_consume_retry_and_dead_letter(spark, store):
    store.produce(1, batch(spark, [{"payload": str(i), "route": "a.1" if i % 2 else "b.1"} for i in range(10)]), size=100)
    g = consume.Group(store, 1, 7, 1, patterns=["a.*"], max_retries=2)

    def handler(m):
        if m["payload"] == "3":
            raise consume.Permanent("no")
        if m["payload"] == "5":
            raise RuntimeError("try again")
        assert m["routing_key"] == "a.1"

    g.run(handler, limit=4, now=START)
    assert g._state()["claimed"] == 10 and g._state()["committed"] == 5  # message 6 (payload 5) pins
    states = {r.message_id: r.status for r in g.exceptions().collect()}
    assert states == {4: "dead", 6: "ready"}
    at = START
    for _ in range(6):
        at += timedelta(minutes=10)
        g.retry(handler, 10, at)
    states = {r.message_id: (r.status, r.attempts) for r in g.exceptions().collect()}
    assert states == {4: ("dead", 0), 6: ("dead", 2)}
    assert g._state()["committed"] == 10
    assert sorted((r.message_id, r.attempt, r.status) for r in g.deliveries().collect()) == [(4, 0, "failure"), (6, 0, "failure"), (6, 1, "failure"), (6, 2, "failure")]


def test_ordered_keys_wait_and_then_go_on(spark, store):
    store.produce(1, batch(spark, [{"payload": str(i), "mkey": "k" if i != 3 else "other", "policy": "ordered"} for i in range(6)]), size=100)
    g = consume.Group(store, 1, 1, 1, mode="all")

    def failing(m):
        if m["payload"] == "1":
            raise RuntimeError("not yet")

    g.run(failing, limit=3, now=START)
    states = {r.message_id: r.status for r in g.exceptions().collect()}
    assert states == {2: "ready", 3: "deferred", 5: "deferred", 6: "deferred"}
    at = START
    for _ in range(6):
        at += timedelta(minutes=10)
        g.retry(lambda m: None, 10, at)
    assert g.exceptions().count() == 0 and g._state()["committed"] == 6
    done = [r.message_id for r in g.deliveries().where("status = 'success' and message_id <> 4").orderBy("attempted_at", "message_id").collect()]
    assert done == sorted(done)


def test_a_range_that_keeps_failing_is_quarantined(spark, store, monkeypatch):
    store.produce(1, batch(spark, [{} for _ in range(4)]), size=100)
    g = consume.Group(store, 1, 1, 1, max_reclaims=2)

    def crash(*a, **k):
        raise MemoryError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(consume, "handled", crash)
        for _ in range(2):
            with pytest.raises(MemoryError):
                g.step(lambda x: None, 10, START)
    assert g._state()["claimed"] == 0
    assert g.step(lambda x: None, 10, START) == 4
    assert {r.message_id: (r.status, r.attempts) for r in g.exceptions().collect()} == {i: ("ready", 0) for i in (1, 2, 3, 4)}
    assert g._state()["committed"] == 0
    assert g.retry(lambda x: None, 10, START + timedelta(minutes=1)) == 4
    assert g._state()["committed"] == 4


def test_classified_errors():
    try:
        try:
            raise consume.Later(5)
        except consume.Later as e:
            raise RuntimeError("outer") from e
    except RuntimeError as e:
        assert consume.classified(e) == ("delayed", 5_000_000)
    assert consume.classified(consume.Permanent()) == ("terminal", 0)
    assert consume.classified(ValueError()) == ("exception", 0)


def test_streaming_produce_survives_a_restart(spark, store, tmp_path):
    source = str(tmp_path / "in")
    batch(spark, [{"key": f"a{i}"} for i in range(5)]).write.parquet(source)
    read = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    produce.start(read(), store, 1, str(tmp_path / "cp"), 100).awaitTermination()
    batch(spark, [{"key": f"a{i}"} for i in range(3, 8)]).write.mode("append").parquet(source)
    produce.start(read(), store, 1, str(tmp_path / "cp"), 100).awaitTermination()
    assert [r.id for r in store.log(1).orderBy("id").collect()] == list(range(1, 9))
    # without its checkpoint, the same input is produced again: keys make it a no-op
    produce.start(read(), store, 1, str(tmp_path / "cp2"), 100).awaitTermination()
    assert store.log(1).count() == 8


def test_streaming_heads_agree_with_batch(spark, store, tmp_path):
    from sluice.operators import heads

    store.produce(1, batch(spark, [{"mkey": f"u{i % 3}", "rank": i * 7 % 5, "payload": str(i)} for i in range(20)]), size=6)
    path = store.log_path(1)
    s = spark.readStream.schema(store.log(1).schema).parquet(path)
    q = produce.heads_stream(s).writeStream.format("memory").queryName("heads_now").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("heads_now").collect()))
    assert got == sorted(map(tuple, heads.heads(store.log(1)).collect()))


def test_stateful_ordered_retries(spark, tmp_path):
    from sluice.streaming import stateful

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.PROVIDER)
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "message_key string, id long").coalesce(1).write.parquet(source)
    s = spark.readStream.schema("message_key string, id long").parquet(source)
    out = stateful.ordered_retries(s, lambda i, attempt: i == 2, max_retries=1, base_ms=1)
    q = out.writeStream.format("memory").queryName("tries").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        import time

        for _ in range(60):
            rows = [tuple(r) for r in spark.table("tries").collect()]
            if ("a", 3, 0, "success") in rows:
                break
            time.sleep(0.5)
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert [r for r in rows if r[0] == "a"] == [("a", 1, 0, "success"), ("a", 2, 0, "failure"), ("a", 2, 1, "dead"), ("a", 3, 0, "success")]
    assert ("b", 4, 0, "success") in rows


def test_pointer_files_are_replaced(store):
    store.files.write("x/y", "one")
    store.files.write("x/y", "two")
    assert store.files.read("x/y") == "two" and store.files.read("x/none") is None
    assert F is not None
