"""The eligible read: what a consumer group is given of an id range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bindings of a group are declared by hand; more than this are not inlined into a predicate.
INLINE_BINDINGS = 1000


def bound(log: DataFrame, bindings: DataFrame, group: int) -> DataFrame:
    """Rows whose routing key matches any of the group's patterns; all rows for a group without patterns.

    The patterns (a checked, small number) become one regular expression in the scan's
    filter; beyond the check, the log's distinct routing keys are matched with them, and rows are
    joined by routing key.  A null key matches nothing.
    """
    mine = bindings.where(F.col("consumer_group_id") == group).select("pattern_regex")
    patterns = [r[0] for r in mine.limit(INLINE_BINDINGS + 1).collect()]
    if not patterns:
        return log
    if len(patterns) <= INLINE_BINDINGS:
        return log.where(F.col("routing_key").rlike("|".join(f"(?:{p})" for p in patterns)))
    keys = log.where("routing_key is not null").select("routing_key").distinct()
    return log.join(keys.join(mine, F.rlike("routing_key", "pattern_regex"), "left_semi"), "routing_key", "left_semi").select(log.columns)


def winners(log: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows that never opted into compaction, and those that are their key's head."""
    plain = log.where("compaction_rank is null")
    kept = log.where("compaction_rank is not null").join(heads.select(F.col("message_id").alias("id")), "id", "left_semi")
    return plain.unionByName(kept.select(log.columns))


def eligible(log: DataFrame, heads: DataFrame, bindings: DataFrame, group: int, version: int, low: int, high: int, within: Column | None = None) -> DataFrame:
    """Messages of ``(low, high]`` at a payload version that the group's bindings match and no newer message supersedes.

    ``within`` is a further range predicate for partition pruning (``sources.schema.in_range``).
    Readers order by id; rows come unordered here so that no global sort is forced.
    """
    rows = log.where((F.col("id") > low) & (F.col("id") <= high) & (F.col("schema_version") == version))
    if within is not None:
        rows = rows.where(within)
    return winners(bound(rows, bindings, group), heads)
