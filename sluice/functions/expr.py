"""Scalar rules of the message log as column expressions, with plain-Python twins where the driver needs them."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the namespace that caller-given idempotency keys are hashed under.
KEY_NAMESPACE = uuid.UUID("b6f6c193-4e2b-45c1-9d3f-6a821e0c7a54")

NANO = 1
MILLI = 1_000_000
SECOND = 1_000_000_000

#: System defaults of message options, in nanoseconds where they are durations.
RETRY_DEFAULTS = {"max_retries": 6, "base_delay": SECOND, "max_delay": 300 * SECOND, "exponent": 2.0}
MESSAGE_DEFAULTS = {"max_retries": 3, "timeout": 30 * SECOND, "concurrency": "parallel"}
POLICIES = ("parallel", "exclusive", "ordered")

_UUID = r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def pattern_regex(pattern: str) -> str:
    """A routing pattern as an anchored Java regex: ``*`` is any run of characters, dots included; all else is literal."""
    literal = "".join(".*" if c == "*" else (c if c.isalnum() or c == "_" else f"[{c}]" if c not in "^\\[]" else "\\" + c) for c in pattern)
    return f"(?s)^{literal}\\z"


def pattern_regex_column(pattern: Column) -> Column:
    """``pattern_regex`` for a column of patterns over the characters of stream names and ``*``."""
    return F.concat(F.lit("(?s)^"), F.replace(F.regexp_replace(pattern, r"([^A-Za-z0-9_*])", r"[$1]"), F.lit("*"), F.lit(".*")), F.lit("\\z"))


def matches(pattern: str, key: str | None) -> bool:
    """Whether a routing key matches; a null key matches nothing."""
    return key is not None and re.fullmatch("".join(".*" if c == "*" else re.escape(c) for c in pattern), key, re.DOTALL) is not None


def uuid5(name: Column, namespace: uuid.UUID = KEY_NAMESPACE) -> Column:
    """Version 5 UUID of UTF-8 text: SHA-1 of namespace and name with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def resolve_key(key: Column, fresh: Column | None = None) -> Column:
    """Idempotency key: a fresh UUID for the empty string (or null), a UUID as it is, else its version 5 hash."""
    new = F.expr("uuid()") if fresh is None else fresh
    return F.when(key.isNull() | (key == ""), new).when(key.rlike(_UUID), F.lower(key)).otherwise(uuid5(key))


def retry_delay(attempt: Column, base: Column, maximum: Column, exponent: Column) -> Column:
    """``base * exponent ** attempt``, at most ``maximum`` (all in the unit of ``base``)."""
    return F.least(base * F.pow(exponent, attempt), maximum.cast("double")).cast("long")


def total_delay(max_retries: Column, base: Column, maximum: Column, exponent: Column) -> Column:
    """Sum of the delays of all retries but the last."""
    steps = F.when(max_retries > 1, F.sequence(F.lit(0), max_retries - 2)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, i: acc + retry_delay(i, base, maximum, exponent))


def filled(value: Column, *defaults: Column) -> Column:
    """First value that is set: zero and the empty string mean unset."""
    return F.coalesce(F.nullif(value, F.lit(0)), *defaults)


def clamped(value: Column, low: Column | None, high: Column | None) -> Column:
    """Within bounds; an unset (zero or null) bound doesn't bind."""
    low = F.nullif(low, F.lit(0)) if low is not None else F.lit(None).cast("long")
    high = F.nullif(high, F.lit(0)) if high is not None else F.lit(None).cast("long")
    return F.least(F.greatest(value, low), high)


def resolved_concurrency(stored: Column, default: Column, override: Column) -> Column:
    """Consumer override before the message's policy before the consumer's default before parallel."""
    empty = F.lit("")
    return F.coalesce(F.nullif(override, empty), F.nullif(stored, empty), F.nullif(default, empty), F.lit("parallel"))


def measurement_key(name: Column, attributes: Column) -> Column:
    """Series key: the name, then sorted ``key=value`` attributes."""
    pairs = F.transform(F.array_sort(F.map_keys(attributes)), lambda k: F.concat(k, F.lit("="), F.element_at(attributes, k)))
    return F.when(attributes.isNull() | (F.size(attributes) == 0), name).otherwise(F.concat(name, F.lit("|"), F.array_join(pairs, ",")))


def measurement_key_of(name: str, attributes: dict[str, str] | None) -> str:
    return name if not attributes else f"{name}|{','.join(f'{k}={attributes[k]}' for k in sorted(attributes))}"


def owner_kind(system_id: Column, stream_id: Column, group_id: Column) -> Column:
    """Kind of a polymorphic owner, from its deepest set id."""
    has = lambda c: F.coalesce(c, F.lit(0)) != 0
    return F.when(has(group_id), "consumer_group").when(has(stream_id), "stream").when(has(system_id), "system")


def alert_message_key(name: Column, kind: Column, owner_id: Column) -> Column:
    return F.concat(name, F.lit("/"), kind, F.lit("/"), owner_id.cast("string"))


def alert_routing_key(name: Column, kind: Column, severity: Column, owner_name: Column) -> Column:
    """The owner's name may hold dots, so it is last."""
    return F.concat(F.lit("alert."), F.concat_ws(".", name, kind, severity, owner_name))


def schedule_key(scheduled_ms: Column, schedule_id: Column) -> Column:
    """Idempotency key of a schedule's run: UUID version 7 layout of the time's milliseconds with the id in the other bits."""
    ms = F.lpad(F.lower(F.hex(scheduled_ms)), 12, "0")
    bits = lambda shift, mask: F.shiftrightunsigned(schedule_id, shift).bitwiseAND(F.lit(mask).cast("long"))
    hexed = lambda v, n: F.lpad(F.lower(F.hex(v)), n, "0")
    return F.concat_ws(
        "-", F.substring(ms, 1, 8), F.substring(ms, 9, 4), F.concat(F.lit("7"), hexed(bits(52, 0xFFF), 3)), F.concat(F.lit("80"), hexed(bits(48, 0xF), 2)), hexed(bits(0, (1 << 48) - 1), 12)
    )


def schedule_key_of(scheduled_ms: int, schedule_id: int) -> uuid.UUID:
    return uuid.UUID(int=scheduled_ms << 80 | 7 << 76 | (schedule_id >> 52 & 0xFFF) << 64 | 2 << 62 | schedule_id & ((1 << 52) - 1))


def normal_json(text: Column) -> Column:
    """JSON in normal form (keys sorted, numbers canonical): equal documents have equal text."""
    return F.to_json(F.parse_json(text))


def part_of(message_id: Column, partition_size: int) -> Column:
    return F.floor(message_id / partition_size).cast("long") if partition_size <= 0 else F.expr(f"({message_id._jc.toString()}) div {partition_size}")


def validate_unit(unit: str) -> None:
    """Shape of a UCUM unit: no white space, no nested, open, unopened or empty annotation."""
    depth = 0
    for c in unit:
        if c.isspace():
            raise ValueError(f"unit {unit!r} has white space")
        depth += (c == "{") - (c == "}")
        if depth not in (0, 1):
            raise ValueError(f"unit {unit!r} has unbalanced annotations")
    if depth or "{}" in unit:
        raise ValueError(f"unit {unit!r} has an open or empty annotation")


def validate_stream_name(name: str, system: bool = False) -> None:
    if not re.fullmatch(r"[a-z0-9._-]+", name):
        raise ValueError(f"stream name {name!r} must be lower-case letters, digits, dots, hyphens and underscores")
    if name.startswith("__system.") and not system:
        raise ValueError(f"stream name {name!r} uses the reserved prefix")


def validate_options(message_key: str | None, concurrency: str, compact: bool, rank: int | None) -> None:
    """Combinations that produce refuses."""
    if concurrency not in POLICIES:
        raise ValueError(f"unknown concurrency policy {concurrency!r}")
    if concurrency != "parallel" and not message_key:
        raise ValueError(f"{concurrency} needs a message key")
    if compact and concurrency == "ordered":
        raise ValueError("ordered messages can't be compacted")
    if compact and not message_key:
        raise ValueError("compaction needs a message key")
    if rank is not None and not compact:
        raise ValueError("a rank needs compaction")
