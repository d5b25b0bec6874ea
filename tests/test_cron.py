"""Closed sets of cron vectors."""

from datetime import UTC, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from sluice.functions import cron


def at(text):
    zone = UTC
    if text.startswith("TZ="):
        name, text = text.split(" ", 1)
        zone = ZoneInfo(name[3:])
    for layout in ("%a %b %d %H:%M %Y", "%a %b %d %H:%M:%S %Y", "%Y-%m-%dT%H:%M:%S%z"):
        try:
            t = datetime.strptime(text, layout)
        except ValueError:
            continue
        return t if t.tzinfo and zone is UTC else (t if t.tzinfo else t.replace(tzinfo=zone)).astimezone(zone)
    raise AssertionError(text)


# fixed values: times at which an expression fires, or doesn't
ACTIVATION = [
    ("Mon Jul 9 15:00 2012", "0/15 * * * *", True),
    ("Mon Jul 9 15:45 2012", "0/15 * * * *", True),
    ("Mon Jul 9 15:40 2012", "0/15 * * * *", False),
    ("Mon Jul 9 15:05 2012", "5/15 * * * *", True),
    ("Mon Jul 9 15:20 2012", "5/15 * * * *", True),
    ("Mon Jul 9 15:50 2012", "5/15 * * * *", True),
    ("Sun Jul 15 15:00 2012", "0/15 * * Jul *", True),
    ("Sun Jul 15 15:00 2012", "0/15 * * Jun *", False),
    ("Sun Jul 15 08:30 2012", "30 08 ? Jul Sun", True),
    ("Sun Jul 15 08:30 2012", "30 08 15 Jul ?", True),
    ("Mon Jul 16 08:30 2012", "30 08 ? Jul Sun", False),
    ("Mon Jul 16 08:30 2012", "30 08 15 Jul ?", False),
    ("Mon Jul 9 15:00 2012", "@hourly", True),
    ("Mon Jul 9 15:04 2012", "@hourly", False),
    ("Mon Jul 9 15:00 2012", "@daily", False),
    ("Mon Jul 9 00:00 2012", "@daily", True),
    ("Mon Jul 9 00:00 2012", "@weekly", False),
    ("Sun Jul 8 00:00 2012", "@weekly", True),
    ("Sun Jul 8 01:00 2012", "@weekly", False),
    ("Sun Jul 8 00:00 2012", "@monthly", False),
    ("Sun Jul 1 00:00 2012", "@monthly", True),
    ("Sun Jul 15 00:00 2012", "* * 1,15 * Sun", True),
    ("Fri Jun 15 00:00 2012", "* * 1,15 * Sun", True),
    ("Wed Aug 1 00:00 2012", "* * 1,15 * Sun", True),
    ("Sun Jul 15 00:00 2012", "* * */10 * Sun", True),
    ("Sun Jul 15 00:00 2012", "* * * * Mon", False),
    ("Mon Jul 9 00:00 2012", "* * 1,15 * *", False),
    ("Sun Jul 15 00:00 2012", "* * 1,15 * *", True),
    ("Sun Jul 15 00:00 2012", "* * */2 * Sun", True),
]

NY = "TZ=America/New_York "
# fixed values: time, expression with seconds, next time (None: never)
NEXT = [
    ("Mon Jul 9 14:45 2012", "0 0/15 * * * *", "Mon Jul 9 15:00 2012"),
    ("Mon Jul 9 14:59 2012", "0 0/15 * * * *", "Mon Jul 9 15:00 2012"),
    ("Mon Jul 9 14:59:59 2012", "0 0/15 * * * *", "Mon Jul 9 15:00 2012"),
    ("Mon Jul 9 15:45 2012", "0 20-35/15 * * * *", "Mon Jul 9 16:20 2012"),
    ("Mon Jul 9 23:46 2012", "0 */15 * * * *", "Tue Jul 10 00:00 2012"),
    ("Mon Jul 9 23:45 2012", "0 20-35/15 * * * *", "Tue Jul 10 00:20 2012"),
    ("Mon Jul 9 23:35:51 2012", "15/35 20-35/15 * * * *", "Tue Jul 10 00:20:15 2012"),
    ("Mon Jul 9 23:35:51 2012", "15/35 20-35/15 1/2 * * *", "Tue Jul 10 01:20:15 2012"),
    ("Mon Jul 9 23:35:51 2012", "15/35 20-35/15 10-12 * * *", "Tue Jul 10 10:20:15 2012"),
    ("Mon Jul 9 23:35:51 2012", "15/35 20-35/15 1/2 */2 * *", "Wed Jul 11 01:20:15 2012"),
    ("Mon Jul 9 23:35:51 2012", "15/35 20-35/15 * 9-20 * *", "Tue Jul 10 00:20:15 2012"),
    ("Mon Jul 9 23:35:51 2012", "15/35 20-35/15 * 9-20 Jul *", "Tue Jul 10 00:20:15 2012"),
    ("Mon Jul 9 23:35 2012", "0 0 0 9 Apr-Oct ?", "Thu Aug 9 00:00 2012"),
    ("Mon Jul 9 23:35 2012", "0 0 0 */5 Apr,Aug,Oct Mon", "Wed Aug 1 00:00 2012"),
    ("Mon Jul 9 23:35 2012", "0 0 0 */5 Oct Mon", "Mon Oct 1 00:00 2012"),
    ("Mon Jul 9 23:35 2012", "0 0 0 * Feb Mon", "Mon Feb 4 00:00 2013"),
    ("Mon Jul 9 23:35 2012", "0 0 0 * Feb Mon/2", "Fri Feb 1 00:00 2013"),
    ("Mon Dec 31 23:59:45 2012", "0 * * * * *", "Tue Jan 1 00:00:00 2013"),
    ("Mon Jul 9 23:35 2012", "0 0 0 29 Feb ?", "Mon Feb 29 00:00 2016"),
    ("2012-03-11T00:00:00-0500", NY + "0 30 2 11 Mar ?", "2013-03-11T02:30:00-0400"),
    ("2012-03-11T00:00:00-0500", NY + "0 0 * * * ?", "2012-03-11T01:00:00-0500"),
    ("2012-03-11T01:00:00-0500", NY + "0 0 * * * ?", "2012-03-11T03:00:00-0400"),
    ("2012-03-11T03:00:00-0400", NY + "0 0 * * * ?", "2012-03-11T04:00:00-0400"),
    ("2012-03-11T01:00:00-0500", "CRON_" + NY + "0 0 * * * ?", "2012-03-11T03:00:00-0400"),
    ("2012-03-11T00:00:00-0500", NY + "0 0 1 * * ?", "2012-03-11T01:00:00-0500"),
    ("2012-03-11T01:00:00-0500", NY + "0 0 1 * * ?", "2012-03-12T01:00:00-0400"),
    ("2012-03-11T00:00:00-0500", NY + "0 0 2 * * ?", "2012-03-12T02:00:00-0400"),
    ("2012-11-04T00:00:00-0400", NY + "0 30 2 04 Nov ?", "2012-11-04T02:30:00-0500"),
    ("2012-11-04T01:45:00-0400", NY + "0 30 1 04 Nov ?", "2012-11-04T01:30:00-0500"),
    ("2012-11-04T00:00:00-0400", NY + "0 0 * * * ?", "2012-11-04T01:00:00-0400"),
    ("2012-11-04T01:00:00-0400", NY + "0 0 * * * ?", "2012-11-04T01:00:00-0500"),
    ("2012-11-04T01:00:00-0500", NY + "0 0 * * * ?", "2012-11-04T02:00:00-0500"),
    ("2012-11-04T00:00:00-0400", NY + "0 0 1 * * ?", "2012-11-04T01:00:00-0400"),
    ("2012-11-04T01:00:00-0400", NY + "0 0 1 * * ?", "2012-11-04T01:00:00-0500"),
    ("2012-11-04T01:00:00-0500", NY + "0 0 1 * * ?", "2012-11-05T01:00:00-0500"),
    ("2012-11-04T00:00:00-0400", NY + "0 0 2 * * ?", "2012-11-04T02:00:00-0500"),
    ("2012-11-04T02:00:00-0500", NY + "0 0 2 * * ?", "2012-11-05T02:00:00-0500"),
    ("2012-11-04T00:00:00-0400", NY + "0 0 3 * * ?", "2012-11-04T03:00:00-0500"),
    ("2012-11-04T03:00:00-0500", NY + "0 0 3 * * ?", "2012-11-05T03:00:00-0500"),
    ("TZ=America/New_York 2012-11-04T01:00:00-0400", NY + "0 0 * * * ?", "2012-11-04T01:00:00-0500"),
    ("TZ=America/New_York 2012-11-04T00:00:00-0400", NY + "0 0 3 3 * ?", "2012-12-03T03:00:00-0500"),
    ("Mon Jul 9 23:35 2012", "0 0 0 30 Feb ?", None),
    ("Mon Jul 9 23:35 2012", "0 0 0 31 Apr ?", None),
    ("2018-10-17T05:00:00-0400", "TZ=America/Sao_Paulo 0 0 9 10 * ?", "2018-11-10T06:00:00-0500"),
    ("2018-02-14T05:00:00-0500", "TZ=America/Sao_Paulo 0 0 9 22 * ?", "2018-02-22T07:00:00-0500"),
]


@pytest.mark.parametrize(("time", "spec", "fires"), ACTIVATION)
def test_activation(time, spec, fires):
    assert (cron.parse(spec).next_after(at(time) - timedelta(seconds=1)) == at(time)) is fires


@pytest.mark.parametrize(("time", "spec", "expected"), NEXT)
def test_next(time, spec, expected):
    found = cron.parse(spec, seconds=True).next_after(at(time))
    assert (found and found.timestamp()) == (at(expected).timestamp() if expected else None)


@pytest.mark.parametrize("time", ["2016-01-03T13:09:03+0530", "2016-01-03T04:09:03+0530", "2016-01-03T14:00:00+0530"])
def test_next_in_another_zone(time):
    assert cron.parse("TZ=Asia/Kolkata 14 14 * * *").next_after(at(time)).timestamp() == at("2016-01-03T14:14:00+0530").timestamp()


@pytest.mark.parametrize("spec", ["xyz", "60 0 * * *", "0 60 * * *", "0 0 * * XYZ", "TZ=", "TZ=UTC", "TZ=Nowhere/None * * * * *", "@never", "* * * *", "*/0 * * * *", "5-1 * * * *", "@every x"])
def test_errors(spec):
    with pytest.raises(ValueError):
        cron.parse(spec)


@pytest.mark.parametrize("spec", ["not a cron expr", "@every 30s", "0 0 30 2 *"])
def test_not_schedulable(spec):
    with pytest.raises(ValueError):
        cron.schedulable(spec)


@pytest.mark.parametrize(
    ("spec", "rate"),
    [
        ("* * * * *", timedelta(minutes=1)),
        ("*/5 * * * *", timedelta(minutes=5)),
        ("@hourly", timedelta(hours=1)),
        ("0 0 * * *", timedelta(days=1)),
        ("@every 90s", timedelta(seconds=90)),
        ("TZ=America/New_York 0 0 * * *", timedelta(hours=23)),
        ("0 0 29 2 *", cron.NEVER),
    ],
)
def test_min_rate(spec, rate):
    assert cron.min_rate(cron.schedulable(spec), datetime(2026, 1, 1, tzinfo=UTC)) == rate


def test_unzoned_is_utc():
    after = datetime(2026, 3, 2, 13, 30, tzinfo=timezone(timedelta(hours=5, minutes=30)))
    assert cron.schedulable("0 9 * * *").next_after(after) == datetime(2026, 3, 2, 9, tzinfo=UTC)


def test_only_the_newest_due_time_is_produced():
    s = cron.schedulable("*/10 * * * *")
    start, now = datetime(2026, 1, 1, 0, 0, tzinfo=UTC), datetime(2026, 1, 1, 1, 5, tzinfo=UTC)
    assert cron.due(s, start, now) == (datetime(2026, 1, 1, 1, 0, tzinfo=UTC), datetime(2026, 1, 1, 1, 10, tzinfo=UTC))
    assert cron.due(s, now + timedelta(minutes=5), now) == (None, now + timedelta(minutes=5))


def test_set_based_minutes_agree_with_search(spark):
    from pyspark.sql import functions as F

    s = cron.schedulable("7/20 3,4 1,15 * Mon")
    start, end = datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 3, 1, tzinfo=UTC)
    rows = cron.minutes(spark.range(1), s, F.lit(start), F.lit(end)).select(F.unix_seconds("scheduled_at").alias("s")).collect()
    want, t = [], start - timedelta(seconds=1)
    while (t := s.next_after(t)) and t <= end:
        want.append(int(t.timestamp()))
    assert sorted(r.s for r in rows) == want
