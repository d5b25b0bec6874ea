"""Cron expressions: five fields (six with seconds), descriptors, ``@every`` and time zones.

A schedule is a set of allowed values per field.  The next time is found by enumerating
days from the start, in the schedule's zone, and within a matching day the allowed wall
times in order of the instants they denote.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEEKDAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
DESCRIPTORS = {
    "@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0",
    "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *",
}
#: Name, least and greatest value, names of values (from the least on).
FIELDS = (("second", 0, 59, ()), ("minute", 0, 59, ()), ("hour", 0, 23, ()), ("day", 1, 31, ()), ("month", 1, 12, MONTHS), ("weekday", 0, 6, WEEKDAYS))
MIN_RATE = timedelta(minutes=1)
NEVER = timedelta.max
SEARCH_YEARS = 5


@dataclass(frozen=True)
class Every:
    """A constant delay in whole seconds, at least one."""

    delay: timedelta

    def next_after(self, t: datetime) -> datetime:
        return (t + self.delay).replace(microsecond=0)


@dataclass(frozen=True)
class Spec:
    """Allowed values per field; a starred day field leaves the choice of the day to the other."""

    second: frozenset
    minute: frozenset
    hour: frozenset
    day: frozenset
    month: frozenset
    weekday: frozenset
    day_star: bool
    weekday_star: bool
    zone: ZoneInfo | None

    def on(self, d: date) -> bool:
        if d.month not in self.month:
            return False
        by_day, by_weekday = d.day in self.day, (d.weekday() + 1) % 7 in self.weekday
        return by_day and by_weekday if self.day_star or self.weekday_star else by_day or by_weekday

    def next_after(self, t: datetime) -> datetime | None:
        """First time after ``t``, in its zone; None when there is none within five years."""
        zone = self.zone or t.tzinfo or UTC
        local = t.astimezone(zone)
        instant = local.timestamp()
        day, last = local.date(), date(local.year + SEARCH_YEARS, 12, 31)
        while day <= last:
            if self.on(day):
                found = min((s for s in self._instants(day, zone) if s > instant), default=None)
                if found is not None:
                    return datetime.fromtimestamp(found, UTC).astimezone(t.tzinfo or UTC)
            if day.month not in self.month:
                day = date(day.year + (day.month == 12), day.month % 12 + 1, 1)
            else:
                day += timedelta(days=1)
        return None

    def _instants(self, day: date, zone) -> list[float]:
        """Instants of the day's allowed wall times: none for times that a forward change skips, two for repeated ones."""
        out = []
        for h in sorted(self.hour):
            for fold in (0, 1):
                start = datetime(day.year, day.month, day.day, h, tzinfo=zone, fold=fold)
                if fold and start.utcoffset() == start.replace(fold=0).utcoffset() and start.replace(minute=59).utcoffset() == start.replace(minute=59, fold=0).utcoffset():
                    continue
                for m in sorted(self.minute):
                    for s in sorted(self.second):
                        wall = start.replace(minute=m, second=s)
                        at = wall.timestamp()
                        back = datetime.fromtimestamp(at, zone)
                        if (back.hour, back.minute, back.date()) == (h, m, day):
                            out.append(at)
        return out


def _value(text: str, names: tuple, low: int) -> int:
    if text.lower() in names:
        return low + names.index(text.lower())
    if not text.isdigit():
        raise ValueError(f"bad value {text!r}")
    return int(text)


def _field(text: str, name: str, low: int, high: int, names: tuple) -> tuple[frozenset, bool]:
    """Allowed values, and whether the field is a star of step one."""
    allowed, star = set(), False
    for part in text.split(","):
        span, slash, step = part.partition("/")
        if part.count("/") > 1 or span.count("-") > 1:
            raise ValueError(f"{name}: bad range {part!r}")
        n = int(step) if slash and step.isdigit() else 1
        if slash and (not step.isdigit() or n == 0):
            raise ValueError(f"{name}: bad step {part!r}")
        if span in ("*", "?"):
            first, last = low, high
            star = star or n == 1
        elif "-" in span:
            a, b = span.split("-")
            first, last = _value(a, names, low), _value(b, names, low)
        else:
            first = _value(span, names, low)
            last = high if slash else first
        if first < low or last > high or first > last:
            raise ValueError(f"{name}: {part!r} is out of {low}-{high}")
        allowed.update(range(first, last + 1, n))
    return frozenset(allowed), star


def _duration(text: str) -> timedelta:
    units = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}
    if not re.fullmatch(r"(?:\d+(?:\.\d+)?(?:ns|us|µs|ms|s|m|h))+", text):
        raise ValueError(f"bad duration {text!r}")
    seconds = sum(float(n) * units[u] for n, u in re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", text))
    return timedelta(seconds=max(1, int(seconds)))


def parse(text: str, seconds: bool = False) -> Spec | Every:
    """Parse an expression; ``seconds`` for six fields, seconds first.  Raises ValueError."""
    text, zone = text.strip(), None
    named = re.match(r"(?:CRON_)?TZ=(\S*)(\s+)?", text)
    if named:
        if not named[1] or not named[2]:
            raise ValueError("a time zone must be followed by an expression")
        try:
            zone = ZoneInfo(named[1])
        except (KeyError, ValueError, OSError) as e:
            raise ValueError(f"unknown time zone {named[1]!r}") from e
        text = text[named.end() :].strip()
    if text.startswith("@every "):
        return Every(_duration(text[7:].strip()))
    if text.startswith("@"):
        if text not in DESCRIPTORS:
            raise ValueError(f"unknown descriptor {text!r}")
        text, seconds = DESCRIPTORS[text], False
    fields = text.split()
    if len(fields) != (6 if seconds else 5):
        raise ValueError(f"{text!r} has {len(fields)} fields")
    parsed = [_field(f, *spec) for f, spec in zip(fields if seconds else ["0", *fields], FIELDS, strict=True)]
    return Spec(*[p for p, _ in parsed], parsed[3][1], parsed[5][1], zone)


def min_rate(schedule: Spec | Every, start: datetime, occurrences: int = 1000, days: int = 400) -> timedelta:
    """Shortest gap between occurrences from ``start``; ``NEVER`` where two are not seen in the window."""
    if isinstance(schedule, Every):
        return schedule.delay
    shortest, at = NEVER, schedule.next_after(start)
    for _ in range(occurrences):
        after = schedule.next_after(at) if at is not None else None
        if after is None or after - start > timedelta(days=days):
            break
        shortest, at = min(shortest, after - at), after
    return shortest


def schedulable(text: str, start: datetime | None = None) -> Spec | Every:
    """A parsed expression in UTC unless zoned, not faster than once a minute, and due some time."""
    schedule, start = parse(text), start or datetime(2026, 1, 1, tzinfo=UTC)
    if isinstance(schedule, Spec) and schedule.zone is None:
        schedule = Spec(**{**schedule.__dict__, "zone": ZoneInfo("UTC")})
    if schedule.next_after(start) is None:
        raise ValueError(f"{text!r} is never due")
    if min_rate(schedule, start) < MIN_RATE:
        raise ValueError(f"{text!r} is due more often than once a minute")
    return schedule


def due(schedule: Spec | Every, since: datetime, now: datetime) -> tuple[datetime | None, datetime | None]:
    """Newest time due by ``now`` from ``since`` on (itself due), and the one after it: missed times are not made up."""
    newest, after = (since, schedule.next_after(since)) if since <= now else (None, since)
    while after is not None and after <= now:
        newest, after = after, schedule.next_after(after)
    return newest, after


def minutes(df: DataFrame, spec: Column | Spec, start: Column, end: Column) -> DataFrame:
    """Rows of ``df`` times the minutes of ``[start, end]`` that a UTC schedule without seconds allows, as ``scheduled_at``.

    The set-based form: minutes are generated a day at a time and tested on the field sets.
    """
    days = df.withColumn("_day", F.explode(F.sequence(F.date_trunc("day", start), F.date_trunc("day", end), F.expr("interval 1 day"))))
    by_day, by_weekday = F.dayofmonth("_day").isin(*sorted(spec.day)), (F.dayofweek("_day") - 1).isin(*sorted(spec.weekday))
    days = days.where(F.month("_day").isin(*sorted(spec.month)) & ((by_day & by_weekday) if spec.day_star or spec.weekday_star else (by_day | by_weekday)))
    times = F.array(*[F.lit(60 * h + m) for h in sorted(spec.hour) for m in sorted(spec.minute)])
    at = days.withColumn("_minute", F.explode(times)).withColumn("scheduled_at", F.timestamp_add("MINUTE", F.col("_minute"), F.col("_day")))
    return at.where((F.col("scheduled_at") >= start) & (F.col("scheduled_at") <= end)).drop("_day", "_minute")
