"""Exact deduplication by a tree-merge of sorted digest runs.

Every input partition turns its texts into sorted runs of digests, one for each
range of the digest space. Runs then meet in binomial rounds: in each round the
runs of two neighbours are brought together by a shuffle and merged, and of
equal digests one entry is retained, with the best identifier and the number of
rows behind it (``fan_in`` neighbours, where more than two are wanted). A run is
an array of entries, so a merge finds the places of one run in the other and
sorts nothing anew. Ranges number as the rows ask for, so that one has about
``RANGE_ROWS`` digests at most, and no merge holds more than one range; a group of
copies arrives as one entry per run, never as its rows. The answers return along the
lowest level: a join on (run, digest), whose keys are as even as the partitions.

A key is the digest with the byte length and a second, unrelated hash: only
entries that agree in all three are merged.

Defined cases: null text counts as empty; null ids rank below all others; of
rows equal in id and text one stays, the rest are dropped; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut

WIDTH = 48
#: Entries of a run before it is closed and another one begun.
ENTRIES = 1 << 20
#: Rows for each range of the digest space, where the partitions of a shuffle are fewer; digests are even, so a range's run has no more entries, of 73 bytes.
RANGE_ROWS = 1 << 20
#: An entry: its key, whether there is an id, the id (its complement, where the smallest stays), the row, and how many rows.
ENTRY = np.dtype([("key", f"S{WIDTH}"), ("has", "i1"), ("id", "<i8"), ("row", "<i8"), ("rows", "<i8")])


def _better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where an entry of a ranks above that of b: an id before none, then the larger id, then the earlier row."""
    return np.where(a["has"] != b["has"], a["has"] > b["has"], np.where(a["id"] != b["id"], a["id"] > b["id"], a["row"] < b["row"]))


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two runs, each in order of distinct keys, as one."""
    if len(a) < len(b):
        a, b = b, a
    at = np.searchsorted(a["key"], b["key"])
    hit = at < len(a)
    hit[hit] = a["key"][at[hit]] == b["key"][hit]
    old, new = a[at[hit]], b[hit]
    best = np.where(_better(new, old), new, old)
    best["rows"] = old["rows"] + new["rows"]
    a = a.copy()
    a[at[hit]] = best
    return np.insert(a, at[~hit], b[~hit])


def run_of(entries: np.ndarray) -> np.ndarray:
    """Entries in any order as a run."""
    e = entries[np.lexsort((entries["row"], ~entries["id"], -entries["has"], entries["key"]))]
    first = np.flatnonzero(np.append(True, e["key"][1:] != e["key"][:-1]))[: len(e)]
    out = e[first].copy()
    out["rows"] = np.add.reduceat(e["rows"], first) if len(e) else 0
    return out


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).fill_null(0).to_numpy(zero_copy_only=False)


def _keys(column: pa.Array) -> np.ndarray:
    """The keys of a binary column, all of one width."""
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], f"S{WIDTH}", count=len(column), offset=int(first))


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 2, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest" identifier of a group stays.
    """
    spark = docs.sparkSession
    largest = {"largest": True, "smallest": False}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    word = lambda n: F.unhex(F.lpad(F.hex(n), 16, "0"))
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.concat(F.unhex(F.sha2(text.cast("binary"), 256)), word(F.octet_length(text).cast("long")), word(F.xxhash64(text))).alias("key"),
            F.spark_partition_id().alias("run"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    last, total = rows.agg(F.max("run"), F.count("*")).first()
    runs, ranges = 1 + (last or 0), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_rows))

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted runs of a partition, cut at the limits of the ranges."""
        held: list[np.ndarray] = []
        number = 0

        def close() -> pa.RecordBatch:
            run = run_of(np.concatenate(held))
            held.clear()
            top = np.frombuffer(np.ascontiguousarray(run["key"]).tobytes(), ">u4").reshape(-1, WIDTH // 4)[:, 0].astype(np.int64)
            slices = top * ranges >> 32
            starts = np.flatnonzero(np.append(True, slices[1:] != slices[:-1]))
            parts = np.split(run, starts[1:])
            return _batch({"range": (slices[starts].astype(np.int32), pa.int32()), "run": (np.full(len(parts), number, np.int32), pa.int32()), "data": ([p.tobytes() for p in parts], pa.binary())})

        for batch in batches:
            if not batch.num_rows:
                continue
            e = np.zeros(batch.num_rows, ENTRY)
            e["key"], e["has"] = _keys(batch.column("key")), ~batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = _column(batch, "doc_id")
            e["id"], e["row"], e["rows"] = ids if largest else ~ids, _column(batch, "row"), 1
            number = batch.column("run")[0].as_py()
            held.append(e)
            if sum(map(len, held)) >= ENTRIES:
                yield close()
        if held:
            yield close()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs come range by range; those of one range and number become one. Holds the run at hand."""
        at, held = None, None

        def done() -> pa.RecordBatch:
            return _batch({"range": ([at[0]], pa.int32()), "run": ([at[1]], pa.int32()), "data": ([held.tobytes()], pa.binary())})

        for batch in batches:
            for a, b, data in zip(batch.column("range").to_pylist(), batch.column("run").to_pylist(), batch.column("data")):
                run = np.frombuffer(data.as_buffer(), ENTRY)
                if at == (a, b):
                    held = merged(held, run)
                else:
                    if at is not None:
                        yield done()
                    at, held = (a, b), run
        if at is not None:
            yield done()

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("run").to_pylist(), batch.column("data")):
                run = np.frombuffer(data.as_buffer(), ENTRY)
                raw = np.ascontiguousarray(run["key"]).tobytes()
                yield _batch({
                    "run": (np.full(len(run), number, np.int32), pa.int32()),
                    "key": (pa.Array.from_buffers(pa.binary(WIDTH), len(run), [None, pa.py_buffer(raw)]).cast(pa.binary()), pa.binary()),
                    "has": (run["has"] > 0, pa.bool_()), "id": (run["id"] if largest else ~run["id"], pa.int64()), "best": (run["row"].copy(), pa.int64()), "group_size": (run["rows"].copy(), pa.int64()),
                })

    sorted_runs = "range int, run int, data binary"
    entries = "run int, key binary, has boolean, id long, best long, group_size long"
    leaves = cut(rows.mapInArrow(lowest, sorted_runs))
    level = leaves
    for _ in range(max(1, math.ceil(math.log(max(runs, 2), fan_in)))):
        level = (
            level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .repartition(ranges, "range", "run").sortWithinPartitions("range", "run")
            .mapInArrow(merge, sorted_runs)
        )
    top = level.mapInArrow(opened, entries).drop("run")
    # one entry per run and key gets the answer, then the run's rows get it
    told = leaves.mapInArrow(opened, entries).select("run", "key").distinct().join(top, "key")
    return rows.join(told, ["run", "key"]).select(
        "doc_id",
        F.when(F.col("has"), F.col("id")).alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best")).alias("kept"),
        F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"),
    )
