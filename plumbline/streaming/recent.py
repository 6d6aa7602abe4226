"""The newest entries of each key of a stream, in state that has a bound and goes when a key falls silent."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType


class _Newest(StatefulProcessor):
    """Holds at most `most` entries (micros, id) of a key; a timer at the newest one's time plus `idle` clears it."""

    def __init__(self, most: int, idle_ms: int) -> None:
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", "micros long, id string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = set(map(tuple, self.entries.get()))
        for batch in rows:
            held.update(zip(batch["micros"].tolist(), batch["id"].tolist(), strict=True))
            held = set(heapq.nlargest(self.most, held))  # a key's batches may be many, what is held of them is not
        kept = sorted(held, reverse=True)
        self.entries.put(kept)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(kept[0][0] // 1000 + self.idle_ms)
        yield self._told(key, kept)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.entries.clear()
        yield self._told(key, [])

    def close(self) -> None:
        pass

    @staticmethod
    def _told(key: tuple, kept: list[tuple[int, str]]) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "ids": [[i for _, i in kept]], "silent": [not kept]})


def newest_by_key(stream: DataFrame, key: str, time: str, entry: str, most: int, idle_ms: int, late: str) -> DataFrame:
    """(key, ids, silent) of each key that a batch touches: its `most` newest entries, newest first; for output mode update.

    Entries are told apart by time and id, equal ones are one, and ties go to the larger id, so that what is held depends
    neither on the order of arrival nor on how rows fall into batches. Once the watermark, `late` behind the newest row of
    all, is `idle_ms` past a key's newest entry, its state goes and it is told once more, silent and without entries. Rows
    without key, time or entry are left out, rows behind the watermark as well.

    A key has one list of `most` entries, however many rows it has. The state store must be the RocksDB one
    (spark.sql.streaming.stateStore.providerClass), as for all state with timers.
    """
    if most < 1:
        raise ValueError("at least one entry is held")
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(entry).isNotNull())
    rows = timed.withWatermark(time, late).select(F.col(key).alias("key"), F.col(time).alias("at"), F.unix_micros(time).alias("micros"), F.col(entry).cast("string").alias("id"))
    out = StructType().add("key", stream.schema[key].dataType).add("ids", ArrayType(StringType())).add("silent", BooleanType())
    return rows.groupBy("key").transformWithStateInPandas(_Newest(most, idle_ms), out, "Update", "EventTime")
