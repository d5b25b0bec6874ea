"""Closed sets for the scalar rules, alerts and exports."""

import uuid
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluice.functions import expr
from sluice.operators import alerts, control, metrics

NOW = datetime(2026, 9, 7, 10, 2, tzinfo=UTC)
A, H, I = "active", "healthy", "insufficient_evidence"


# fixed values: states and ages (seconds) of samples, newest first; what they add up to
HISTORY = [
    ("no samples", [], [], False, I, 0),
    ("spike", [A], [0], False, "pending", 0),
    ("sustained", [A, A], [0, 120], False, A, 120),
    ("recovery", [H, A], [0, 60], False, H, 0),
    ("stale recovery", [H], [180], False, I, 0),
    ("restart gap", [A, A], [0, 86400], False, "pending", 0),
    ("gap inside window", [A, A], [0, 180], False, "pending", 0),
    ("insufficient sample breaks span", [A, I, A], [0, 60, 120], False, "pending", 0),
    ("healthy sample breaks span", [A, H, A], [0, 60, 120], False, "pending", 0),
    ("same instant highest id wins", [A, H, A], [0, 0, 120], False, A, 120),
    ("waiting adds no duration", [A], [120], False, "pending", 0),
    ("future storage time", [A], [-60], False, I, 0),
    ("pending disabled", [A], [0], True, A, 0),
    ("pending disabled still needs fresh evidence", [A], [180], True, I, 0),
]


@pytest.mark.parametrize("disabled", [False, True])
def test_condition_history(spark, disabled):
    cases = [c for c in HISTORY if c[3] is disabled]
    rows = [(n, 100 - k, NOW - timedelta(seconds=age), s) for n, states, ages, *_ in cases for k, (s, age) in enumerate(zip(states, ages, strict=True))]
    samples = spark.createDataFrame(rows, "subject string, id long, created_at timestamp, state string")
    subjects = spark.createDataFrame([(c[0],) for c in cases], "subject string")
    got = {r.subject: (r.state, r.observed_us // 1_000_000) for r in alerts.evaluated(samples, subjects, F.lit(NOW), disable_pending=disabled).collect()}
    assert got == {c[0]: (c[4], c[5]) for c in cases}


def test_partition_evidence(spark):
    name, kind, unit = "stream.state.partitions", "gauge", "{partition}"
    values = [(95.0, H), (100.0, A), (110.0, A), (float("nan"), I), (-1.0, I), (100.5, I), (float("inf"), I), (2.0**63, I)]
    rows = [(i, name, kind, unit, v) for i, (v, _) in enumerate(values)] + [(90, "", "", "", 0.0), (91, "stream.state.compacted", kind, "", 110.0)]
    df = spark.createDataFrame(rows, "i int, name string, kind string, unit string, value double")
    got = {r.i: r.state for r in alerts.partition_evidence(df, 100, 200).collect()}
    assert got == {i: s for i, (_, s) in enumerate(values)} | {90: I, 91: I}
    zero = {r.i: r.state for r in alerts.partition_evidence(df, 0, 200).collect()}
    assert (zero[0], zero[1]) == (H, A)


def test_publication(spark):
    cases = [
        ("no head", A, None, None, 0, A),
        ("resolved head", A, "resolved", "warn", 0, A),
        ("inside the repeat", A, A, "warn", 1800, None),
        ("past the repeat", A, A, "warn", 3600, A),
        ("another severity", A, A, "critical", 1800, A),
        ("nothing, no head", H, None, None, 0, None),
        ("nothing, resolved head", H, "resolved", "warn", 0, None),
        ("nothing, active head", H, A, "warn", 0, "resolved"),
        ("pending publishes nothing", "pending", A, "warn", 7200, None),
    ]
    found = spark.createDataFrame([(c[0], c[1], "warn") for c in cases], "subject string, state string, severity string")
    heads = spark.createDataFrame([(c[0], c[2], c[3], NOW - timedelta(seconds=c[4])) for c in cases if c[2]], "subject string, status string, severity string, created_at timestamp")
    got = {r.subject: r.published for r in alerts.published(found, heads, F.lit(NOW), 3600).collect()}
    assert got == {c[0]: c[5] for c in cases}


def test_keys(spark):
    names = ["order-1", "", "B6F6C193-4E2B-45C1-9D3F-6A821E0C7A54", "ünïcode"]
    df = spark.createDataFrame([(n,) for n in names], "k string").select("k", expr.resolve_key(F.col("k")).alias("r"))
    got = {r.k: r.r for r in df.collect()}
    assert got["order-1"] == str(uuid.uuid5(expr.KEY_NAMESPACE, "order-1")) and got["ünïcode"] == str(uuid.uuid5(expr.KEY_NAMESPACE, "ünïcode"))
    assert got[names[2]] == names[2].lower() and uuid.UUID(got[""])
    ids = [(ms, i) for ms in (0, 1_770_000_000_123) for i in (0, 1, 41, 1 << 55, (1 << 63) - 1)]
    rows = spark.createDataFrame(ids, "ms long, i long").select("ms", "i", expr.schedule_key(F.col("ms"), F.col("i")).alias("k")).collect()
    assert all(r.k == str(expr.schedule_key_of(r.ms, r.i)) for r in rows) and len({r.k for r in rows}) == len(ids)
    assert all(uuid.UUID(r.k).version == 7 for r in rows)
    assert [r.k[:13] for r in rows] == sorted(r.k[:13] for r in rows)


def test_retry_curve(spark):
    c = lambda n: expr.retry_delay(F.lit(n), F.lit(1), F.lit(5), F.lit(2.0))
    row = spark.range(1).select(*[c(n).alias(str(n)) for n in range(5)], expr.total_delay(F.lit(4), F.lit(1), F.lit(5), F.lit(2.0)).alias("total")).first()
    assert list(row) == [1, 2, 4, 5, 5, 7]


def test_patterns(spark):
    rows = [("click.*", "click.1.2", True), ("click.*", "clickx1", False), ("*.2", "a.b.2", True), ("*.2", "a.b.2\n", False), ("*", "x\ny", True), ("a.b", "a.b", True), ("a.b", "aXb", False), ("a-b_c", "a-b_c", True)]
    df = spark.createDataFrame([(i, p, expr.pattern_regex(p), k) for i, (p, k, _) in enumerate(rows)], "i int, p string, r string, k string")
    got = df.select("i", F.rlike("k", "r").alias("a"), F.rlike("k", expr.pattern_regex_column(F.col("p"))).alias("b")).orderBy("i").collect()
    assert [(r.a, r.b) for r in got] == [(m, m) for *_, m in rows]
    assert all(expr.matches(p, k) is m for p, k, m in rows) and not expr.matches("*", None)


def test_units_names_and_options():
    for good in ("", "ms", "{message}", "By/s"):
        expr.validate_unit(good)
    for bad in ("a b", "{a", "a}", "{a{b}}", "{}"):
        with pytest.raises(ValueError):
            expr.validate_unit(bad)
    expr.validate_stream_name("orders.v1")
    for bad in ("Orders", "a*b", "", "__system.x"):
        with pytest.raises(ValueError):
            expr.validate_stream_name(bad)
    expr.validate_options("k", "exclusive", True, 3)
    for bad in ((None, "exclusive", False, None), ("k", "ordered", True, None), (None, "parallel", True, None), ("k", "parallel", False, 1), ("k", "other", False, None)):
        with pytest.raises(ValueError):
            expr.validate_options(*bad)


def test_measurement_keys(spark):
    df = spark.sql("select 'lag' n, map('stream', 'orders', 'group', 'billing') a union all select 'lag', cast(null as map<string, string>)")
    assert sorted(r[0] for r in df.select(expr.measurement_key(F.col("n"), F.col("a"))).collect()) == ["lag", "lag|group=billing,stream=orders"]
    assert expr.measurement_key_of("lag", {"stream": "orders", "group": "billing"}) == "lag|group=billing,stream=orders"


def test_catalogue_is_complete():
    assert len(metrics.definitions()) == 42 and len({d[0] for d in metrics.definitions()}) == 42
    assert len(alerts.ALERTS) == 4
    assert [len(metrics.definitions(s)) for s in ("consumer_session", "consumer_group", "stream", "system", "exporter")] == [10, 14, 3, 13, 2]


@pytest.mark.parametrize("turn", [1, -1])
def test_export_collisions_reject_the_family(spark, turn):
    rows = [("a.b", "gauge", "", "a.b", 1.0), ("a_b", "gauge", "", "a_b", 2.0), ("c", "counter", "", "c|x=1", 3.0), ("c", "counter", "", "c|x=2", 4.0), ("d", "gauge", "ms", "d", 5.0)][::turn]
    df = spark.createDataFrame(rows, "name string, kind string, unit string, message_key string, value double")
    assert {r.export_name: r.rejected for r in metrics.families(df).collect()} == {"a_b": True, "c_total": False, "d_milliseconds": False}
    assert sorted(r.line for r in metrics.exposition(df, False).collect()) == ['c_total{x="1"} 3.0', 'c_total{x="2"} 4.0', "d_milliseconds 5.0", "otel_source_read_success 0"]


def test_declarations_and_support(spark):
    assert control.declaration_outcome(False, [], ["a"], True) == "installed"
    assert control.declaration_outcome(True, ["b", "a"], ["a", "b", "a"], True) == "joined"
    assert control.declaration_outcome(True, ["a"], ["b"], True) == "waiting"
    assert control.declaration_outcome(True, ["a"], ["b"], False) == "installed"
    rows = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (3, 3)], "v int, m int").select(control.support(F.col("v"), F.col("m"), 2)).collect()
    assert [r[0] for r in rows] == ["older", "supported", "supported", "newer"]


def test_many_groups_and_patterns_take_the_shuffled_ways(spark, monkeypatch):
    from sluice.operators import reads, snapshots

    log = spark.range(1, 5001).selectExpr("id * 997 as id", "1 as schema_version", "concat('k.', id % 50) as routing_key")
    cursors = spark.range(40).selectExpr("id as consumer_group_id", "id * 150000 as committed")
    none = spark.createDataFrame([], "consumer_group_id long, message_id long, status string")
    few = sorted(map(tuple, snapshots.version_lag(log, cursors, none, 1).collect()))
    monkeypatch.setattr(snapshots, "COUNTED_GROUPS", 3)
    assert sorted(map(tuple, snapshots.version_lag(log, cursors, none, 1).collect())) == few and few[0][1] == 5000
    bindings = spark.createDataFrame([(1, f"^k[.]{i}$") for i in range(5)], "consumer_group_id long, pattern_regex string")
    want = sorted(r.id for r in reads.bound(log, bindings, 1).collect())
    monkeypatch.setattr(reads, "INLINE_BINDINGS", 2)
    assert sorted(r.id for r in reads.bound(log, bindings, 1).collect()) == want and len(want) == 500
