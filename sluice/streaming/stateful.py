"""Keyed state over message streams with ``transformWithStateInPandas``.

Messages of a key are delivered by id; once one fails, later ones of the key wait, until the
failed one succeeds on a retry timer or is given up (a dead message holds nothing).
Needs the RocksDB state store provider.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = StructType([StructField("message_key", StringType()), StructField("id", LongType()), StructField("attempt", IntegerType()), StructField("status", StringType())])


class OrderedRetries(StatefulProcessor):
    """Order, retry and dead-letter per key; ``fails(id, attempt)`` stands for the handler."""

    def __init__(self, fails, max_retries: int, base_ms: int):
        self.fails, self.max_retries, self.base_ms = fails, max_retries, base_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([StructField("id", LongType())]))
        self.attempt = handle.getValueState("attempt", StructType([StructField("n", IntegerType())]))

    def _advance(self, key: str, ids: list[int], attempt: int, now_ms: int) -> Iterator[pd.DataFrame]:
        out = []
        while ids:
            failed = self.fails(ids[0], attempt)
            if not failed:
                out.append((key, ids.pop(0), attempt, "success"))
                attempt = 0
            elif attempt >= self.max_retries:
                out.append((key, ids.pop(0), attempt, "dead"))
                attempt = 0
            else:
                out.append((key, ids[0], attempt, "failure"))
                self.handle.registerTimer(now_ms + self.base_ms * 2**attempt)
                attempt += 1
                break
        self.waiting.put([(i,) for i in ids]) if ids else self.waiting.clear()
        self.attempt.update((attempt,))
        yield pd.DataFrame(out, columns=[f.name for f in OUTPUT])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ids = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        blocked = bool(ids)
        for b in rows:
            ids += b["id"].tolist()
        ids = sorted(set(ids))
        attempt = self.attempt.get()[0] if self.attempt.exists() else 0
        if blocked:
            self.waiting.put([(i,) for i in ids])
            yield pd.DataFrame([], columns=[f.name for f in OUTPUT])
        else:
            yield from self._advance(key[0], ids, attempt, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ids = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        attempt = self.attempt.get()[0] if self.attempt.exists() else 0
        yield from self._advance(key[0], ids, attempt, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def ordered_retries(source: DataFrame, fails, max_retries: int = 3, base_ms: int = 1000) -> DataFrame:
    """Delivery attempts of a stream of (message_key, id)."""
    return source.groupBy("message_key").transformWithStateInPandas(OrderedRetries(fails, max_retries, base_ms), OUTPUT, "Append", "ProcessingTime")
