"""Finding one performance's notes in another, and comparing two scores."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import delete, rank_in, running_in, shared_dir
from .temporal import asof_join

#: Notes that vote on a shift together; what counts as the same time; cells of the vote; the reach of the first search and of later ones.
VOTERS, SAME, CELL, FIRST_REACH, REACH = 48, 0.03, 0.01, 30.0, 4.0


def vote(diffs: np.ndarray, cell: float, same: float) -> np.ndarray:
    """The differences near the commonest one: cells count with their neighbours', and the lowest of equal cells wins."""
    cells = np.rint(diffs / cell).astype(np.int64)
    values, counts = np.unique(cells, return_counts=True)
    at = dict(zip(values.tolist(), counts.tolist()))
    votes = [at[v] + at.get(v - 1, 0) + at.get(v + 1, 0) for v in values.tolist()]
    return diffs[np.abs(diffs - values[int(np.argmax(votes))] * cell) < same]


def raw_times(
    notes: DataFrame, raw: DataFrame, keys: list[str], order: list[str], t: str, pitch: str,
    voters: int = VOTERS, same: float = SAME, cell: float = CELL, first_reach: float = FIRST_REACH, reach: float = REACH, windows: int = 64,
) -> DataFrame:
    """notes with `raw_t`, the time of the note's onset in `raw`, and `shift`, the difference found for its window; null where there is none.

    Each `voters` notes of a key in order vote: all notes of the same pitch in `raw` near the note's time plus the
    last shift found (within `first_reach` of the time itself before there is one) give differences, the commonest
    is the mode, and the median of those within `same` of it is the shift, if they number three and three in ten of
    the window. Then a note's raw time is the nearest of its pitch to its time plus the shift, the earlier one in a
    tie, if it is within `same`.

    As a window looks where the last one found, keys go in stretches of `windows` windows, all keys' first ones
    together. A shift moves by `reach` a window at most, so a stretch needs the raw notes near it only: a group is
    a stretch, never a key. Notes with a null time or pitch are left out.
    """
    spark = notes.sparkSession
    root = f"{shared_dir(spark)}/raw-{uuid.uuid4().hex}"
    size = voters * windows
    whole = notes.where(F.col(t).isNotNull() & F.col(pitch).isNotNull())
    ranked = rank_in(whole, keys, order, "__n").withColumn("__round", F.floor((F.col("__n") - 1) / size).cast("int"))
    ranked.write.partitionBy("__round").parquet(f"{root}/in")
    last = spark.read.schema(ranked.schema).parquet(f"{root}/in").agg(F.max("__round")).first()[0]
    tid = [f.name for f in notes.schema]
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in notes.schema), "`__n` bigint, raw_t double, shift double, `__held` double"])

    def recover(mine: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("__n")
        found = {p: np.sort(g["__t"].to_numpy(float)) for p, g in other.groupby("__p")}
        none = np.zeros(0)
        held = mine["__shift"].iloc[0] if len(mine) else None
        held = None if held is None or held != held else float(held)
        times, shifts, ends = np.full(len(mine), np.nan), np.full(len(mine), np.nan), np.full(len(mine), np.nan)
        ts, ps = mine[t].to_numpy(float), mine[pitch].tolist()
        for low in range(0, len(mine), voters):
            some = range(low, min(low + voters, len(mine)))
            far, off = (first_reach, 0.0) if held is None else (reach, held)
            near = []
            for i in some:
                at = found.get(ps[i], none)
                a, b = np.searchsorted(at, ts[i] + off - far, "right"), np.searchsorted(at, ts[i] + off + far, "left")
                near.append(at[a:b] - ts[i])
            diffs = np.concatenate(near)
            close = vote(diffs, cell, same) if len(diffs) else none
            if len(close) and len(close) >= max(3, 0.3 * len(some)):
                held = float(np.median(close))
                for i in some:
                    at = found.get(ps[i], none)
                    j = int(np.searchsorted(at, ts[i] + held))
                    best = min((x for x in at[max(j - 1, 0) : j + 1]), key=lambda x: abs(x - ts[i] - held), default=None)  # noqa: B023
                    shifts[i] = held
                    if best is not None and abs(best - ts[i] - held) < same:
                        times[i] = best
            if held is not None:
                ends[some] = held
        return mine[[*tid, "__n"]].assign(raw_t=times, shift=shifts, __held=ends)

    other = raw.where(F.col(t).isNotNull()).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(t).cast("double").alias("__t"), F.col(pitch).alias("__p"))
    out = None
    for r in range((last if last is not None else -1) + 1):
        part = spark.read.schema(ranked.schema).parquet(f"{root}/in").where(F.col("__round") == r).drop("__round")
        if r:
            before = spark.read.parquet(f"{root}/out/{r - 1}").where(F.col("__n") == r * size).select(*keys, F.col("__held").alias("__shift"))
            part = part.join(before, keys)
        else:
            part = part.withColumn("__shift", F.lit(None).cast("double"))
        off, far = F.coalesce(F.first("__shift"), F.lit(0.0)), first_reach + reach * (windows + 1)
        spans = part.groupBy(*keys).agg((F.min(t) + off - far).alias("__low"), (F.max(t) + off + far).alias("__high"))
        hit = F.col("__t").between(F.col("__low"), F.col("__high"))
        for i, k in enumerate(keys):
            hit = hit & (F.col(k) == F.col(f"__k{i}"))
        theirs = [f"__k{i}" for i in range(len(keys))]
        near = spans.join(other, hit).select(*theirs, "__t", "__p")
        part.groupBy(*keys).cogroup(near.groupBy(*theirs)).applyInPandas(recover, shape).write.parquet(f"{root}/out/{r}")
        done = spark.read.parquet(f"{root}/out/{r}").select(*tid, F.nanvl("raw_t", F.lit(None)).alias("raw_t"), F.nanvl("shift", F.lit(None)).alias("shift"))
        out = done if out is None else out.unionByName(done)
    delete(spark, f"{root}/in")
    return out if out is not None else notes.limit(0).select("*", F.lit(None).cast("double").alias("raw_t"), F.lit(None).cast("double").alias("shift"))


def local_f1(reference: DataFrame, other: DataFrame, keys: list[str], t: str, what: list[str], window: int, reach: int, step: int = 1) -> DataFrame:
    """(keys, local_f1): the mean, weighted by the reference's items, of each window's best F1 over shifts of the other side.

    An item is a time and `what`; sides are sets. Windows are `window` wide from 0 on; the other side moves by any
    multiple of `step` up to `reach`, and what falls into the window then counts. Times are whole numbers not below
    0 and window is a multiple of step. Equal items of a shift are counted from pairs that agree in `what` and in
    the time's remainder, at most 2 * reach / step + 1 for an item; the sizes of moved windows from sums by cell.
    """
    a = reference.select(*keys, t, *what).distinct()
    b = other.select(*keys, t, *what).distinct()
    # b's item at u meets a's at v under the shift v - u
    left = a.select(*keys, *what, F.col(t).alias("__v"), F.pmod(t, F.lit(step)).alias("__rest"), F.floor(F.col(t) / max(reach, 1)).alias("__cell"))
    right = b.select(*keys, *what, F.col(t).alias("__u"), F.pmod(t, F.lit(step)).alias("__rest"), F.explode(F.sequence(F.floor(F.col(t) / max(reach, 1)) - 1, F.floor(F.col(t) / max(reach, 1)) + 1)).alias("__cell"))
    pairs = left.join(right, [*keys, *what, "__rest", "__cell"]).withColumn("__s", F.col("__v") - F.col("__u")).where(F.abs("__s") <= reach)
    hits = pairs.groupBy(*keys, F.floor(F.col("__v") / window).alias("__w"), "__s").agg(F.count("*").alias("__hit"))
    cells = b.groupBy(*keys, F.floor(F.col(t) / step).alias("__c")).agg(F.count("*").alias("__m"))
    moved = cells.select(*keys, "__c", "__m", F.explode(F.sequence(F.lit(-(reach // step)), F.lit(reach // step))).alias("__k"))
    sizes = moved.groupBy(*keys, F.floor((F.col("__c") + F.col("__k")) * step / window).alias("__w"), (F.col("__k") * step).alias("__s")).agg(F.sum("__m").alias("__m"))
    own = a.groupBy(*keys, F.floor(F.col(t) / window).alias("__w")).agg(F.count("*").alias("__a"))
    scored = hits.join(sizes, [*keys, "__w", "__s"]).join(own, [*keys, "__w"]).withColumn("__f", 2.0 * F.col("__hit") / (F.col("__a") + F.col("__m")))
    best = scored.groupBy(*keys, "__w").agg(F.max("__f").alias("__f"))
    every = own.join(best, [*keys, "__w"], "left").withColumn("__f", F.coalesce("__f", F.lit(0.0)))
    return every.groupBy(*keys).agg((F.sum(F.col("__f") * F.col("__a")) / F.sum("__a")).alias("local_f1"))


def agreement(reference: DataFrame, other: DataFrame, keys: list[str], t: str, what: list[str], values: list[str]) -> DataFrame:
    """(keys, n_reference, n_other, n_matched, attack_f1, and for each of `values` the share of matched items that agree in it).

    An item is a time and `what`; of an item given twice, the last by its values counts. Shares are 0 where nothing matches.
    """
    one = lambda d, name: d.groupBy(*keys, t, *what).agg(F.max(F.struct(*values)).alias(name))
    a, b = one(reference, "__a"), one(other, "__b")
    both = a.join(b, [*keys, t, *what], "full")
    n = lambda c: F.count(F.when(c, 1))
    ina, inb = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    out = both.groupBy(*keys).agg(n(ina).alias("n_reference"), n(inb).alias("n_other"), n(ina & inb).alias("n_matched"), *[n(ina & inb & F.col(f"__a.{v}").eqNullSafe(F.col(f"__b.{v}"))).alias(f"__{v}") for v in values])
    share = [(F.col(f"__{v}") / F.greatest("n_matched", F.lit(1))).alias(v) for v in values]
    return out.select(*keys, "n_reference", "n_other", "n_matched", (2.0 * F.col("n_matched") / (F.col("n_reference") + F.col("n_other"))).alias("attack_f1"), *share)


def uncovered(bounds: DataFrame, covered: DataFrame, keys: list[str], at: str, start: str, stop: str, low: str, high: str) -> DataFrame:
    """bounds (keys, at, low, high: one range for each key) with `gap`: the time from `low` up to the bound, within [low, high), that no interval covers.

    `covered` are intervals without overlap. Their lengths are summed up once, and read at every bound by an as-of
    join; the time between two bounds is the difference of two readings.
    """
    lengths = covered.where(F.col(stop) > F.col(start)).select(*keys, start, stop)
    upto = running_in(lengths, keys, [start, stop], F.col(stop) - F.col(start), "__upto")
    state = upto.select(*keys, F.col(start).alias("__at"), F.col(start).alias("__start"), F.col(stop).alias("__stop"), "__upto")
    ends = bounds.withColumn("__to", F.least(F.greatest(F.col(at), F.col(low)), F.col(high)))

    def read(rows: DataFrame, where: str, name: str) -> DataFrame:
        r = asof_join(rows.withColumn("__at", F.col(where)), state, keys, "__at", ["__start", "__stop", "__upto"], strict=False)
        past = F.col("__upto_asof") - F.greatest(F.col("__stop_asof") - F.col(where), F.lit(0))
        return r.select(*rows.columns, F.coalesce(past, F.lit(0)).alias(name))

    both = read(read(ends, "__to", "__b"), low, "__a")
    return both.select(*bounds.columns, (F.col("__to") - F.col(low) - (F.col("__b") - F.col("__a"))).alias("gap"))
