"""Sessions that end when nothing was said for a while: over a table, and over a stream as keyed state with timers."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.dialogue import KEPT

SESSIONS = "session_id string, started long, ended long, n_messages long, last array<string>"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _messages(messages: DataFrame) -> DataFrame:
    """session_id, at (microseconds since 1970), id and content of messages with a session and a time; null contents are empty."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return messages.filter("session_id is not null and ts is not null").select(F.col("session_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), at.alias("at"), F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), F.coalesce("content", F.lit("")).alias("content"))


def sessions(messages: DataFrame, ttl: int = 1800, kept: int = KEPT) -> DataFrame:
    """session_id, started, ended (microseconds since 1970), n_messages and the ``kept`` last contents, by time and id, of each session.

    ``messages`` has session_id, ts, id and content; other columns are ignored. A message more than ``ttl`` seconds after the one
    before begins a new session. Repeated rows count each; rows without a session or time are left out. Empty in, empty out.
    """
    by_time = Window.partitionBy("session_id").orderBy("at", "id", "content")
    begins = F.coalesce(F.col("at") - F.lag("at").over(by_time) > ttl * 1_000_000, F.lit(False)).cast("int")
    numbered = _messages(messages).withColumn("begins", begins).withColumn("nth", F.sum("begins").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    late_first = Window.partitionBy("session_id", "nth").orderBy(F.desc("at"), F.desc("id"), F.desc("content"))
    some = numbered.withColumn("place", F.row_number().over(late_first))
    held = F.collect_list(F.when(F.col("place") <= kept, F.struct("at", "id", "content")))
    found = some.groupBy("session_id", "nth").agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.count("*").alias("n_messages"), F.array_sort(held).alias("held"))
    return found.select("session_id", "started", "ended", "n_messages", F.transform("held", lambda x: x["content"]).alias("last"))


def merged(spans: list[list], ttl: int, kept: int) -> list[list]:
    """Spans (started, ended, n, last messages) joined where less than the time to live lies between; the order does not matter."""
    out: list[list] = []
    for start, end, n, last in sorted(spans, key=lambda s: s[:2]):
        if out and start - out[-1][1] <= ttl * 1_000_000:
            open_ = out[-1]
            out[-1] = [open_[0], max(open_[1], end), open_[2] + n, sorted([*map(tuple, open_[3]), *map(tuple, last)])[-kept:]]
        else:
            out.append([start, end, n, sorted(map(tuple, last))[-kept:]])
    return out


class _Sessions(StatefulProcessor):
    """A key's open spans as state; a timer for when the first of them ends."""

    def __init__(self, ttl: int, kept: int):
        self.ttl, self.kept = ttl, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "spans string")

    def _ends(self, span: list) -> int:
        """The first millisecond of the watermark from which nothing can join the span."""
        return (span[1] + self.ttl * 1_000_000) // 1000 + 1

    def _held(self) -> list[list]:
        return json.loads(self.open.get()[0]) if self.open.exists() else []

    def _hold(self, spans: list[list]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if spans:
            self.open.update((json.dumps(spans),))
            self.handle.registerTimer(min(map(self._ends, spans)))
        elif self.open.exists():
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spans = self._held()
        for some in rows:
            new = [[at, at, 1, [(at, id_, content)]] for at, id_, content in zip(some["at"].tolist(), some["id"].tolist(), some["content"])]
            spans = merged([*spans, *new], self.ttl, self.kept)
        self._hold(spans)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, spans = timerValues.getCurrentWatermarkInMs(), self._held()
        over = [s for s in spans if self._ends(s) <= now]
        self._hold([s for s in spans if self._ends(s) > now])
        yield pd.DataFrame([(key[0], start, end, n, [m[2] for m in last]) for start, end, n, last in over], columns=["session_id", "started", "ended", "n_messages", "last"])

    def close(self) -> None:
        pass


def expiring_sessions(messages: DataFrame, ttl: int = 1800, late: str = "1 hour", kept: int = KEPT) -> DataFrame:
    """The sessions of a stream as in ``sessions``, each once it is over: when the watermark, ``late`` behind the latest time that
    was seen, has passed its end by ``ttl`` seconds. Messages may come in any order; those behind the watermark are dropped.

    State is one row for a key, which holds its open spans and their last messages and goes when they end, so it is bounded by
    what is alive. Timers are in event time. The state store has to be RocksDB's: run the query within ``state_store``.
    """
    timed = _messages(messages).withWatermark("ts", late)
    return timed.groupBy("session_id").transformWithStateInPandas(statefulProcessor=_Sessions(ttl, kept), outputStructType=SESSIONS, outputMode="append", timeMode="EventTime")


@contextmanager
def state_store(spark: SparkSession):
    """Streaming queries that start inside keep their state in RocksDB; the session's setting is put back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)
