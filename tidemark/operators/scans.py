"""What depends on rows already chosen: anchors, feedback, and rules applied until nothing changes.

None of these is a window function, as a row's answer depends on the answers
before it. Anchors are found by pointer jumping, rules run in rounds over what
they may still touch, and scans with a small state hand it from one stretch of a
key to the next. No key is ever an array, a group or one task's partition.
"""

from __future__ import annotations

import bisect
import math
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import delete, neighbour, rank_in, running_in, shared_dir, steady
from .temporal import asof_join


def islands(rows: DataFrame, keys: list[str], order: list[str], gap: float, name: str) -> DataFrame:
    """Adds the first order[0] of the stretch that a row is in; stretches are `gap` or more apart."""
    t = order[0]
    near = neighbour(rows, keys, order, {t: "__was"})
    begins = F.when(F.col("__was").isNull() | (F.col(t) - F.col("__was") >= gap), F.col(t))
    return running_in(near, keys, order, begins, name, F.max).drop("__was")


def anchors(points: DataFrame, keys: list[str], t: str, gap: float) -> DataFrame:
    """(keys, t): the first point of each key, and again and again the first one at least `gap` after the last anchor.

    Stretches parted by a gap begin anew, and one that is shorter than the gap has its first point only. In the
    others every point knows the point that would follow it as an anchor, and those pointers are doubled: after k
    rounds the first 2**k anchors of every stretch are known.
    """
    at = islands(points.where(F.col(t).isNotNull()).select(*keys, t).distinct(), keys, [t], gap, "__from")
    reach = at.groupBy(*keys, "__from").agg((F.max(t) - F.col("__from") >= gap).alias("__long"))
    known = steady(reach.select(*keys, "__from", F.col("__from").alias("__x"), "__long"))
    own = [*keys, "__from"]
    open_ = at.join(known.where("__long").select(*own), own, "left_semi")
    target = open_.withColumn("__to", F.col(t))
    probe = open_.select(*own, F.col(t).alias("__x"), (F.col(t) + gap).alias(t))
    jump = steady(asof_join(probe, target, own, t, ["__to"], strict=False, forward=True).where("__to_asof is not null").select(*own, "__x", F.col("__to_asof").alias("__to")))
    found = known.select(*own, "__x")
    fresh = known.where("__long").select(*own, "__x")
    while True:
        # anchors known so far, each one jump further
        fresh = steady(fresh.join(jump, [*own, "__x"]).select(*own, F.col("__to").alias("__x")))
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh)
        fresh = found.join(known.where("__long").select(*own), own, "left_semi")
        further = jump.select(*own, F.col("__x").alias("__to"), F.col("__to").alias("__next"))
        jump = steady(jump.join(further, [*own, "__to"]).select(*own, "__x", F.col("__next").alias("__to")))
    return found.select(*keys, F.col("__x").alias(t))


def merge_close(notes: DataFrame, keys: list[str], onset: str, end: str, largest: list[str], gap: float, early: float, least: float) -> DataFrame:
    """(keys, onset, end, largest): notes of a key made free of overlaps.

    A note less than `gap` after the last one kept becomes part of it: the later end and the largest of the other
    columns stay. Notes that are kept end `early` before the next one of their key at the latest, yet last `least`
    at least. Notes without an onset are left out.
    """
    notes = notes.where(F.col(onset).isNotNull())
    marks = anchors(notes, keys, onset, gap).withColumn("__anchor", F.col(onset))
    mine = asof_join(notes.select(*keys, onset, end, *largest), marks, keys, onset, ["__anchor"], strict=False)
    kept = mine.groupBy(*keys, "__anchor_asof").agg(F.max(end).alias(end), *[F.max(c).alias(c) for c in largest])
    kept = neighbour(kept.withColumnRenamed("__anchor_asof", onset), keys, [onset], {onset: "__next"}, ahead=True)
    cut = F.least(F.col(end), F.col("__next") - early)  # skips a null
    return kept.withColumn(end, F.greatest(cut, F.col(onset) + least)).drop("__next")


def prune_ramps(marks: DataFrame, keys: list[str], at: str, value: str, within: float, ratio: float) -> DataFrame:
    """Marks without those that only refine the one before: less than `within` after it and changing by less than `ratio` in logarithm.

    All such marks go at once, which may make new ones of the others, so rounds follow until none is left. A mark
    written twice at one place goes entirely where one of the two does. Only stretches that lost a mark are looked
    at again. Values are above zero.
    """
    order = [at, value, "__id"]
    own = [*keys, "__from"]
    active = steady(islands(marks.withColumn("__id", F.monotonically_increasing_id()), keys, order, within, "__from"))
    done = []
    while True:
        near = neighbour(active, own, order, {at: "__at", value: "__was"})
        fine = (F.col(at) - F.col("__at") < within) & (F.abs(F.ln(F.col(value) / F.col("__was"))) < ratio)
        near = near.withColumn("__drop", F.coalesce(fine, F.lit(False)))
        near = near.withColumn("__drop", F.max("__drop").over(Window.partitionBy(*own, at, value)))
        touched = near.groupBy(*own).agg(F.max("__drop").alias("__touched"))
        kept = steady(near.join(touched, own).where(~F.col("__drop")).select(*active.columns, "__touched"))
        done.append(kept.where(~F.col("__touched")).select(*marks.columns))
        active = kept.where("__touched").drop("__touched")
        if active.isEmpty():
            out = done[0]
            for part in done[1:]:
                out = out.unionByName(part)
            return out


def handed_on(
    rows: DataFrame, keys: list[str], order: list[str], step: Callable[[pd.DataFrame, dict | None], tuple[pd.DataFrame, dict]], state: list[str], added: str, size: int = 1 << 16
) -> DataFrame:
    """rows with the columns `added` that a scan along each key computes: step(stretch, state) gives a stretch's new columns and the state behind it.

    `state` names those of the added columns that make up the state; the state of a key's first row is None. Keys
    are cut into stretches of `size` rows. The first stretches of all keys are scanned together, then the second
    ones, which take the state from what was written of the first. A task streams through its stretches, and a
    round that is lost is read again from the table before it.
    """
    spark = rows.sparkSession
    root = f"{shared_dir(spark)}/scan-{uuid.uuid4().hex}"
    ranked = rank_in(rows, keys, order, "__n").withColumn("__round", F.floor((F.col("__n") - 1) / size).cast("int"))
    ranked.write.partitionBy("__round").parquet(f"{root}/in")
    last = spark.read.schema(ranked.schema).parquet(f"{root}/in").agg(F.max("__round")).first()[0]
    names = [*rows.columns, "__n"]
    shape = spark.createDataFrame([], added).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "`__n` bigint", *(f"`{f.name}` {f.dataType.simpleString()}" for f in shape)])

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now = None, None
        for frame in frames:
            if not len(frame):
                continue
            out = []
            for _, part in frame.groupby("__key", sort=False):
                key = part["__key"].iloc[0]
                if held is None or key != held:
                    first = part.iloc[0]
                    held, now = key, None if first["__n"] == 1 else {s: first[f"__{s}"] for s in state}
                got, now = step(part, now)
                out.append(pd.concat([part[names].reset_index(drop=True), got.reset_index(drop=True)], axis=1))
            yield pd.concat(out)

    out = None
    for r in range((last if last is not None else -1) + 1):
        part = spark.read.schema(ranked.schema).parquet(f"{root}/in").where(F.col("__round") == r).drop("__round").select(*names, F.to_json(F.struct(F.lit(1).alias("one"), *keys)).alias("__key"))
        before = spark.read.parquet(f"{root}/out/{r - 1}").where(F.col("__n") == r * size) if r else None
        if before is not None:
            carried = before.select(F.to_json(F.struct(F.lit(1).alias("one"), *keys)).alias("__key"), *[F.col(s).alias(f"__{s}") for s in state])
            part = part.join(carried, "__key")
        else:
            part = part.select("*", *[F.lit(None).cast(shape[s].dataType).alias(f"__{s}") for s in state])
        part = part.repartition("__key").sortWithinPartitions("__key", "__n")
        part.mapInPandas(scan, schema).write.parquet(f"{root}/out/{r}")
        done = spark.read.schema(schema).parquet(f"{root}/out/{r}").drop("__n")
        out = done if out is None else out.unionByName(done)
    delete(spark, f"{root}/in")  # all rounds are written
    return out if out is not None else rows.limit(0).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in shape])


def log_values(low: float, high: float, count: int) -> list[float]:
    """0, then `count - 1` values evenly spaced in logarithm from low to high."""
    step = (math.log(high) - math.log(low)) / (count - 2)
    return [0.0, *(math.exp(math.log(low) + i * step) for i in range(count - 2)), high]


def nearest_log(x: float, values: list[float], logs: list[float]) -> int:
    """Index of the value nearest in logarithm, the smaller in a tie; 0 where x is below half the least value above 0."""
    if x < values[1] / 2:
        return 0
    at = math.log(x)
    i = min(max(bisect.bisect_left(logs, at), 1), len(logs) - 1)
    return i if abs(logs[i - 1] - at) <= abs(logs[i] - at) else i + 1


def quantise_feedback(starts: DataFrame, keys: list[str], order: list[str], t: str, values: list[float], size: int = 1 << 16) -> DataFrame:
    """starts with `bin` and `decoded`: each step from the decoded time before to the time t, as the bin nearest in logarithm.

    Errors don't add up, as steps are measured from decoded times. The first row is decoded below zero, from the bin
    of its distance to zero. Null times count as the decoded time before (or zero).
    """
    logs = [math.log(v) for v in values[1:]]

    def step(part: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict]:
        now = None if state is None else float(state["decoded"])
        bins, times = [], []
        for x in part[t].astype(float):
            b = nearest_log(max((-x if now is None else x - now) if x == x else 0.0, 0.0), values, logs)
            now = -values[b] if now is None else now + values[b]
            bins.append(b)
            times.append(now)
        return pd.DataFrame({"bin": bins, "decoded": times}), {"decoded": now}

    return handed_on(starts, keys, order, step, ["decoded"], "bin int, decoded double", size)


def decode_steps(rows: DataFrame, keys: list[str], order: list[str], bin_: Column, values: list[float], name: str) -> DataFrame:
    """Adds the time that bins add up to, the first one below zero: what quantise_feedback calls decoded."""
    value = F.get(F.array(*[F.lit(float(v)) for v in values]), bin_)
    first = rank_in(rows, keys, order, "__n").withColumn("__v", F.when(F.col("__n") == 1, -value).otherwise(value))
    return running_in(first, keys, order, F.col("__v"), name).drop("__n", "__v")
