"""Token sequences, segments and searches over one series at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .ranks import rank_in
from .scans import handed_on

# Ids of marks; then times within a patch, kinds, pitches, durations and velocities follow each other.
PAD, END_OF_PATCH, END_OF_SONG = 0, 1, 2
FIRST = 3


def offsets(width: int, pitches: int = 128, durations: int = 1024, velocities: int = 128) -> dict[str, int]:
    """Where each family of tokens begins."""
    at, out = FIRST, {}
    for name, n in (("time", width), ("kind", 3), ("pitch", pitches), ("duration", durations + 1), ("velocity", velocities)):
        out[name], at = at, at + n
    return out


def tokenise(rows: DataFrame, keys: list[str], width: int, limit: int | None = None) -> DataFrame:
    """(keys, patch, tokens): events by patch of time; a time token only where the onset changes.

    rows: keys, onset, kind, pitch, duration, velocity. Events past `limit` tokens are left out; every patch ends
    with a mark.
    """
    o = offsets(width)
    patch = F.floor(F.col("onset") / width).cast("long")
    order = ["onset", "kind", "pitch", "duration", "velocity"]
    w = Window.partitionBy(*keys, "patch").orderBy(*order)
    r = rows.withColumn("patch", patch)
    new = ~F.col("onset").eqNullSafe(F.lag("onset").over(w))
    event = F.when(F.col("kind") == 2, F.array(F.lit(o["kind"]) + F.col("kind"), F.lit(o["pitch"]) + F.col("pitch"), F.lit(o["duration"]) + F.least("duration", F.lit(1024)), F.lit(o["velocity"]) + F.col("velocity"))).otherwise(F.array(F.lit(o["kind"]) + F.col("kind")))
    time = F.when(new, F.array(F.lit(o["time"]) + F.col("onset") - F.col("patch") * width)).otherwise(F.array().cast("array<bigint>"))
    r = r.withColumn("__t", F.concat(time.cast("array<bigint>"), event.cast("array<bigint>")))
    if limit is not None:
        r = r.withColumn("__n", F.sum(F.size("__t")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("__n") <= limit - 1)
    g = r.groupBy(*keys, "patch").agg(F.array_sort(F.collect_list(F.struct(*order, "__t"))).alias("__e"))
    return g.select(*keys, "patch", F.concat(F.flatten("__e.__t"), F.array(F.lit(END_OF_PATCH).cast("bigint"))).alias("tokens"))


def detokenise(patches: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Events from (keys, patch, tokens): what tokenise was given, in order of onset, kind and pitch.

    A patch is read where it lies, some hundred at once: its tokens never become rows to be sorted.
    """
    o = offsets(width)
    values = ("pitch", "duration", "velocity")
    rows = patches.select(*keys, F.col("patch").cast("long").alias("__patch"), F.col("tokens").cast("array<bigint>").alias("__tokens"))
    kind_of = [rows.schema[k] for k in keys] + [StructField("onset", LongType()), StructField("kind", IntegerType())] + [StructField(c, LongType()) for c in values]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                patch, lists = some.column(len(keys)), some.column(len(keys) + 1)
                token = pc.fill_null(pc.list_flatten(lists), -1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                token, row = token[token >= FIRST], row[token >= FIRST]
                e = np.flatnonzero((token >= o["kind"]) & (token < o["pitch"]))
                # the last time before an event, if its patch has one
                time = np.maximum.accumulate(np.where(token < o["kind"], np.arange(len(token)), -1))[e]
                timed = (time >= 0) & (row[time] == row[e])
                base, known = pc.fill_null(patch, 0).to_numpy(zero_copy_only=False), patch.is_valid().to_numpy(zero_copy_only=False)
                onset = pa.array(token[time] - o["time"] + base[row[e]] * width, mask=~(timed & known[row[e]]))
                kind = (token[e] - o["kind"]).astype(np.int32)

                def value(k: int, name: str) -> pa.Array:
                    place = np.minimum(e + k, len(token) - 1)
                    there = (place == e + k) & (row[place] == row[e])
                    return pa.array(np.where(kind == 2, token[place] - o[name], 0), pa.int64(), mask=(kind == 2) & ~there)

                own = [some.column(i).take(pa.array(row[e])) for i in range(len(keys))]
                found = [onset, pa.array(kind), *[value(k + 1, name) for k, name in enumerate(values)]]
                yield pa.RecordBatch.from_arrays([*own, *found], names=[*keys, "onset", "kind", *values])

    return rows.mapInArrow(read, StructType(kind_of))


def first_violation(patches: DataFrame, keys: list[str], width: int, room: int | None = None) -> DataFrame:
    """(keys, patch, violation): the first rule of the token grammar that a patch breaks, or null.

    Times rise within a patch, and a note has its three values. At one time kinds don't go down (a pedal up is 0, down
    1, a note 2), each pedal kind comes once, and pitches of notes rise. The first token is a time or the end. An
    event begins where five tokens fit into `room`. The last token is an end mark, and nothing follows one.
    """
    o = offsets(width)
    t = patches.select(*keys, "patch", F.posexplode("tokens").alias("i", "token"))
    w = Window.partitionBy(*keys, "patch").orderBy("i")
    time = F.when((F.col("token") >= FIRST) & (F.col("token") < o["kind"]), F.col("token"))
    earlier = F.max(time).over(w.rowsBetween(Window.unboundedPreceding, -1))
    note = F.col("token") == o["kind"] + 2
    family = lambda c, a, b: c.between(o[a], o[b] - 1) if b else c >= o[a]
    whole = family(F.lead("token", 1).over(w), "pitch", "duration") & family(F.lead("token", 2).over(w), "duration", "velocity") & family(F.lead("token", 3).over(w), "velocity", None)
    kind = F.when(F.col("token").between(o["kind"], o["pitch"] - 1), F.col("token") - o["kind"])
    now = F.last(time, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumns({"__kind": kind, "__now": now, "__pitch": F.when(note, F.lead("token", 1).over(w))})
    same = Window.partitionBy(*keys, "patch", "__now").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({"__was": F.max("__kind").over(same), "__below": F.max("__pitch").over(same)})
    ended = F.max(F.when(F.col("token").isin(END_OF_PATCH, END_OF_SONG), 1)).over(w.rowsBetween(Window.unboundedPreceding, -1)).isNotNull()
    begins = (F.col("__kind").isNotNull() & (F.coalesce(F.lag(time).over(w).isNull(), F.lit(True)))) | time.isNotNull()
    full = F.lit(False) if room is None else begins & (F.col("i") + 5 > room)
    wrong = F.when(ended, "tokens after the end").when(F.col("__kind").isNotNull() & F.col("__now").isNull(), "no time").when(full, "no room")
    wrong = wrong.when((F.col("__kind") < F.col("__was")) | ((F.col("__kind") < 2) & (F.col("__kind") == F.col("__was"))), "kinds out of order").when(note & (F.col("__pitch") <= F.col("__below")), "pitch does not rise")
    wrong = wrong.when(time.isNotNull() & (time <= earlier), "time does not rise").when(note & ~F.coalesce(whole, F.lit(False)), "note without its values").when((F.lead("token").over(w).isNull()) & ~F.col("token").isin(END_OF_PATCH, END_OF_SONG), "no end")
    return t.withColumn("__v", wrong).groupBy(*keys, "patch").agg(F.min_by("__v", F.when(F.col("__v").isNotNull(), F.col("i"))).alias("violation"))


def segments(rows: DataFrame, keys: list[str], order: str, usable: Column, at_least: int) -> DataFrame:
    """Rows of usable runs of `at_least` rows, with the run's first position and the position within it."""
    w = Window.partitionBy(*keys).orderBy(order)
    r = rows.withColumn("__n", F.row_number().over(w) - 1).where(usable)
    r = r.withColumn("__run", F.col("__n") - F.row_number().over(Window.partitionBy(*keys).orderBy("__n")))
    run = Window.partitionBy(*keys, "__run")
    r = r.withColumns({"segment": F.min("__n").over(run), "segment_rows": F.count("*").over(run)})
    return r.where(F.col("segment_rows") >= at_least).withColumn("position", F.col("__n") - F.col("segment")).drop("__n", "__run")


def viterbi(rows: DataFrame, keys: list[str], order: str, costs: str, switch: list[list[float]], size: int = 1 << 16) -> DataFrame:
    """(keys, order, mode): the cheapest path of modes; costs is an array per row, `switch` the price of each change.

    The start counts as mode 0; the first minimum wins. Two scans along each key, handed on from stretch to stretch:
    one forward, whose state is the cost of the best path into each mode and which leaves where each came from, and
    one back, whose state is the mode that the path came from. Places of a key differ.
    """
    price, k = np.array(switch, float), len(switch)
    names = [f"__c{i}" for i in range(k)]

    def forward(part: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict]:
        cost = np.where(np.arange(k) == 0, 0.0, np.inf) if state is None else np.array([state[n] for n in names], float)
        came, sums = [], []
        for own in part["__costs"]:
            ways = cost[:, None] + price
            best = ways.argmin(0)
            cost = ways[best, np.arange(k)] + np.asarray(own, float)
            came.append(best.astype(np.int32).tolist())
            sums.append(cost)
        out = pd.DataFrame(np.array(sums).reshape(-1, k), columns=names)
        return out.assign(__came=came), dict(zip(names, cost))

    def back(part: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict]:
        now = None if state is None else int(state["__from"])
        modes, before = [], []
        for row, last in zip(part["__came"], part[names].to_numpy(float)):
            now = int(last.argmin()) if now is None else now
            modes.append(now)
            now = int(row[now])
            before.append(now)
        return pd.DataFrame({"mode": modes, "__from": before}), {"__from": now}

    series = rows.select(*keys, order, F.col(costs).cast("array<double>").alias("__costs"))
    there = handed_on(series, keys, [order], forward, names, ", ".join([*(f"{n} double" for n in names), "__came array<int>"]), size).drop("__costs")
    there = rank_in(there, keys, [order], "__back").withColumn("__back", -F.col("__back"))
    return handed_on(there, keys, ["__back"], back, ["__from"], "mode int, __from int", size).select(*keys, order, "mode")


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, a whole row of the table at once in the bits of an integer."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def lcs_f1(pairs: DataFrame, a: str, b: str, out: str = "f1") -> DataFrame:
    """F1 of the longest common subsequence of two arrays; null where either is null or both are empty."""

    @F.pandas_udf("double")
    def f1(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p, q):
            if p is None or q is None or len(p) + len(q) == 0:
                return None
            return 2.0 * lcs_length(list(p), list(q)) / (len(p) + len(q))

        return pd.Series([one(p, q) for p, q in zip(x, y)], dtype=float)

    return pairs.withColumn(out, f1(F.col(a).cast("array<string>"), F.col(b).cast("array<string>")))


def pair_marks(marks: DataFrame, keys: list[str], order: list[str], start: str) -> DataFrame:
    """(keys, open_at, close_at): each stop closes the last start still open of its key; unpaired marks give no row.

    order: position first. A group is one voice of one song.
    """
    kinds = dict(marks.dtypes)
    at = order[0]

    def pair(frame: pd.DataFrame) -> pd.DataFrame:
        frame, stack, out = frame.sort_values(order, kind="stable"), [], []
        for t, opens in zip(frame[at], frame[start]):
            if opens:
                stack.append(t)
            elif stack:
                out.append((stack.pop(), t))
        got = pd.DataFrame(out, columns=["open_at", "close_at"])
        for k in keys:
            got.insert(0, k, frame[k].iloc[0])
        return got[[*keys, "open_at", "close_at"]]

    return marks.groupBy(*keys).applyInPandas(pair, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", open_at {kinds[at]}, close_at {kinds[at]}")


def slots(spans: DataFrame, keys: list[str], start: str, end: str, most: int = 16) -> DataFrame:
    """spans with the smallest number free while they last; spans beyond `most` at once are left out."""
    kinds = dict(spans.dtypes)

    def number(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([start, end], kind="stable")
        until, got = [None] * most, []
        for a, b in zip(frame[start], frame[end]):
            free = next((i for i, u in enumerate(until) if u is None or u <= a), None)
            if free is not None:
                until[free] = b
            got.append(free)
        return frame.assign(slot=pd.array([None if g is None else g + 1 for g in got], "Int32"))

    out = spans.groupBy(*keys).applyInPandas(number, ", ".join(f"{c} {kinds[c]}" for c in spans.columns) + ", slot int")
    return out.where("slot is not null")


def remove_unisons(notes: DataFrame, keys: list[str], onset: str, end: str, pitch: str, voice: str, rank: str) -> DataFrame:
    """Notes without those that sound the pitch of a note of lower rank in another voice at the same time."""
    a = notes.withColumn("__id", F.struct(onset, end, voice, rank))
    b = notes.select(*keys, F.col(pitch).alias("__p"), F.col(onset).alias("__on"), F.col(end).alias("__off"), F.col(voice).alias("__v"), F.col(rank).alias("__r"))
    hit = (F.col(pitch) == F.col("__p")) & (F.col(onset) < F.col("__off")) & (F.col("__on") < F.col(end)) & (F.col(voice) != F.col("__v")) & (F.col("__r") < F.col(rank))
    for k in keys:
        b = b.withColumnRenamed(k, f"__{k}")
        hit = hit & (F.col(k) == F.col(f"__{k}"))
    return a.join(b, hit, "left_anti").drop("__id")


def voice_overlaps(notes: DataFrame, keys: list[str], onset: str, end: str) -> DataFrame:
    """Notes that begin before the note ahead of them in their voice has ended."""
    w = Window.partitionBy(*keys).orderBy(onset, end)
    return notes.withColumn("__e", F.lag(end).over(w)).where(F.col("__e") > F.col(onset)).drop("__e")
