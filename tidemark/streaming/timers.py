"""Notes revised until final, with state that timers and time to live take away again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

#: What the stream needs: state with timers is kept in RocksDB.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = StructType([StructField("id", LongType()), StructField("seq", LongType()), StructField("payload", StringType()), StructField("status", StringType())])
_HELD = StructType([StructField("seq", LongType()), StructField("payload", StringType())])


def prepare(spark: SparkSession) -> None:
    """Names the state store that timers need, for streams started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Revisions(StatefulProcessor):
    """The last revision of each id, handed out once: when it is final, or when none has come for `stall_ms` of event time.

    A closed id leaves a mark for `keep_ms` of event time, so that late revisions of it are known as such; then
    nothing of it is left.
    """

    def __init__(self, stall_ms: int, keep_ms: int) -> None:
        self.stall_ms, self.keep_ms = stall_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _HELD)
        self.closed = handle.getValueState("closed", StructType([StructField("closed", BooleanType())]))

    def _timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.closed.exists():
            return
        best, newest, end = (tuple(self.held.get()) if self.held.exists() else None), None, None
        for frame in rows:
            now = int(frame["at"].max().value // 1_000_000)
            newest = now if newest is None else max(newest, now)
            ends = frame[frame["final"]]
            if len(ends):  # of several final ones in a batch the lowest counts
                low = ends.loc[ends["seq"].idxmin()]
                end = min(end or (int(low["seq"]), low["payload"]), (int(low["seq"]), low["payload"]))
            last = frame.loc[frame["seq"].idxmax()]
            if best is None or int(last["seq"]) > best[0]:
                best = (int(last["seq"]), last["payload"])
        if end is not None:
            self.held.clear()
            self.closed.update((True,))
            self._timer(newest + self.keep_ms)
            yield pd.DataFrame([(key[0], *end, "final")], columns=OUT.names)
        elif newest is not None:
            self.held.update(best)
            self._timer(max([newest + self.stall_ms, *(int(t) for t in self.handle.listTimers())]))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.closed.exists():
            self.closed.clear()
        elif self.held.exists():
            seq, payload = self.held.get()
            self.held.clear()
            self.closed.update((True,))
            self._timer(int(expiredTimerInfo.getExpiryTimeInMs()) + self.keep_ms)
            yield pd.DataFrame([(key[0], int(seq), payload, "stalled")], columns=OUT.names)

    def close(self) -> None:
        pass


def timed_revisions(notes: DataFrame, stall_ms: int, keep_ms: int, late: str = "1 hour") -> DataFrame:
    """(id, seq, payload, status) of each id once: its final revision, or the last one known when it stalled.

    notes: id, seq, payload, final and at, the event time, whose watermark trails by `late`. Rows later than the
    watermark are left out. Call prepare() before the stream starts.
    """
    marked = notes.select("id", "seq", "payload", "final", "at").withWatermark("at", late)
    return marked.groupBy("id").transformWithStateInPandas(Revisions(stall_ms, keep_ms), OUT, "append", "EventTime")


def settled(notes: DataFrame, stall_ms: int, end: str) -> DataFrame:
    """What timed_revisions has handed out when the watermark stands at the column `end`, from a table: the lowest final revision, or the last one of an id that has stalled by then."""
    g = notes.groupBy("id").agg(
        F.min_by(F.struct("seq", "payload"), F.when(F.col("final"), F.col("seq"))).alias("f"), F.max_by(F.struct("seq", "payload"), "seq").alias("l"),
        F.bool_or("final").alias("any_final"), F.max("at").alias("newest"), F.first(end).alias("end"),
    )
    stalled = ~F.col("any_final") & (F.unix_millis(F.col("newest").cast("timestamp")) + stall_ms < F.unix_millis(F.col("end").cast("timestamp")))
    return g.where(F.col("any_final") | stalled).select("id", F.when(F.col("any_final"), F.col("f.seq")).otherwise(F.col("l.seq")).alias("seq"), F.when(F.col("any_final"), F.col("f.payload")).otherwise(F.col("l.payload")).alias("payload"), F.when(F.col("any_final"), "final").otherwise("stalled").alias("status"))
