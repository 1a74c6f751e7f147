"""Structured Streaming: event-time windows, sessions, duplicates, latest versions, stateful revisions, stream-static joins.

Each function turns a streaming DataFrame into another; the same function over a
batch DataFrame gives what the stream comes to when it has read everything. Rows
later than the watermark are left out of windows that have been closed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.ranks import shared_dir
from ..schemas import STREAM_EVENTS


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """The events table as a stream of files; at most so many files a trigger, so a backlog never comes at once."""
    return spark.readStream.schema(STREAM_EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, keys: list[str], width: str, late: str = "0 seconds", slide: str | None = None) -> DataFrame:
    """(keys, start, n, total): counts and sums for each window of event time; sliding ones if `slide` is given."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(*keys, F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, keys: list[str], gap: str, late: str = "0 seconds") -> DataFrame:
    """(keys, start, stop, n): runs of events with no pause of `gap` or longer; stop is the last event plus the gap."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def unique(events: DataFrame, ids: list[str], late: str) -> DataFrame:
    """The first row of each id; ids are forgotten when the watermark has passed them."""
    if not events.isStreaming:
        return events.dropDuplicates(ids)
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(ids)


def latest(events: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """(keys, columns): of each key the row that is last in order. A stream of it runs in update or complete mode."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__row")).select(*keys, "__row.*")


def progress(events: DataFrame, keys: list[str], position: str) -> DataFrame:
    """(keys, position, n): a position that never goes back."""
    return events.groupBy(*keys).agg(F.max(position).alias(position), F.count("*").alias("n"))


def with_state(events: DataFrame, table: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Events with columns of a static table; events without a row there keep nulls."""
    return events.join(table.select(*on, *columns), on, "left")


REVISION = "id long, seq long, payload string, final boolean"


def revisions(notes: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """Notes that are revised until one is final: a row for each id and batch, whichever revision was last by seq.

    What comes after the final one is left out. An id's state is its last seq and whether it is closed. A stream
    that runs for good needs `timeout_ms`, after which an idle id is forgotten; a run over what is there now
    (`table_of`) must go without, as Spark ends no such run while timeouts may still come.
    """

    def last(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seq, closed = state.get if state.exists else (-1, False)
        best = None
        rows = pd.concat(list(frames)).sort_values("seq")  # one id's revisions of one batch
        for r in rows.itertuples(index=False):
            if not closed and r.seq > seq:
                seq, closed, best = int(r.seq), bool(r.final), r
        state.update((seq, closed))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        if best is not None:
            yield pd.DataFrame([(key[0], int(best.seq), best.payload, bool(best.final))], columns=["id", "seq", "payload", "final"])

    return notes.groupBy("id").applyInPandasWithState(last, REVISION, "seq long, closed boolean", "update", GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def table_of(stream: DataFrame, mode: str, folder: str | None = None, upsert: Callable[[DataFrame, str, int], None] | None = None) -> DataFrame:
    """Runs a stream over what is there now and returns the table it has written.

    append: files are added. complete: each batch is a version of the table, the last of which counts. Exactly once
    in both: a batch has a folder of its own, which a repeated batch writes again.
    """
    spark = stream.sparkSession
    root = folder or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema: StructType = stream.schema
    seen: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        if upsert:
            upsert(batch, root, number)
        else:
            batch.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")
        seen.append(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    if not seen:
        return spark.createDataFrame([], schema)
    if mode == "complete":
        return spark.read.schema(schema).parquet(f"{root}/rows/batch={max(seen)}")
    return spark.read.schema(schema).parquet(f"{root}/rows").select(*stream.columns)
