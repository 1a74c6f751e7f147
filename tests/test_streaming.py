"""Streams of several files come to what the batch gives; late rows and final revisions."""

from pyspark.sql import functions as F

from tidemark.schemas import STREAM_EVENTS
from tidemark.streaming import feeds


def _files(spark, sf_dir, tmp_path):
    events = spark.read.schema(STREAM_EVENTS).parquet(f"{sf_dir}/events.parquet")
    folder = str(tmp_path / "in")
    events.repartitionByRange(5, "ts").write.parquet(folder)
    return events, feeds.read_events(spark, folder, 1)


def _rows(df):
    rounded = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return sorted(map(repr, df.select(*rounded).collect()))


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    batch, stream = _files(spark, sf_dir, tmp_path)
    for i, f in enumerate([
        lambda e: feeds.tumbling(e, ["event_type"], "2 hours"), lambda e: feeds.tumbling(e, [], "10 hours", slide="5 hours"),
        lambda e: feeds.sessions(e, ["user_id"], "1 hour", "40 days"), lambda e: feeds.latest(e, ["user_id"], ["ts", "event_id"], ["event_id", "value"]),
    ]):
        assert _rows(feeds.table_of(f(stream), "complete", f"{tmp_path}/out{i}")) == _rows(f(batch)), i


def test_append_closes_windows_behind_the_watermark(spark, sf_dir, tmp_path):
    batch, stream = _files(spark, sf_dir, tmp_path)
    got = feeds.table_of(feeds.tumbling(stream, [], "1 day", "30 days"), "append", f"{tmp_path}/out")
    assert got.count() == 0  # nothing is a month old
    wide = feeds.table_of(feeds.unique(stream.unionByName(stream), ["event_id"], "40 days"), "append", f"{tmp_path}/out2")
    assert wide.count() == batch.select("event_id").distinct().count()


def test_final_revision_closes_an_id(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(1, 1, "a", False), (1, 3, "c", False), (1, 2, "b", False), (2, 1, "x", True), (2, 2, "y", False)]
    spark.createDataFrame(rows, feeds.REVISION).coalesce(1).write.parquet(folder)
    spark.createDataFrame([(1, 4, "d", True), (2, 3, "z", False), (1, 2, "late", False)], feeds.REVISION).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(feeds.REVISION).option("maxFilesPerTrigger", 1).parquet(folder)
    got = {tuple(r) for r in feeds.table_of(feeds.revisions(stream), "update", f"{tmp_path}/out").collect()}
    assert (2, 1, "x", True) in got and (1, 4, "d", True) in got
    assert not any(r[2] in ("y", "z", "late", "a", "b") for r in got)
