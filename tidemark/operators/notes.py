"""Changes of note tables (song_id, onset, kind, pitch, duration, velocity): the steps of an augmentation, and totals.

Each is a projection or one window by song, so a chain of them stays in one stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bin_of, bounds_of, clip
from ..schemas import HIGH_KEY, LOW_KEY, NOTE, PEDAL_ON
from .temporal import asof_join


def stretch(events: DataFrame, factor: float) -> DataFrame:
    """Times scaled and rounded, halves to even; notes last one frame at least, and a pedal never goes down and up at once.

    A pedal event that rounding brings level with the pedal event before it comes a frame later, as do those behind
    it that this would reach.
    """
    t = F.rint(F.col("onset") * factor).cast("long")
    note = F.col("kind") == NOTE
    w = Window.partitionBy("song_id", note).orderBy("onset", "kind")
    n = F.row_number().over(w)
    out = events.withColumns({"__t": t, "__n": n})
    # the least rising sequence above the rounded times: a running maximum of time less rank
    run = Window.partitionBy("song_id", note).orderBy("onset", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rising = F.max(F.col("__t") - F.col("__n")).over(run) + F.col("__n")
    return out.withColumns({
        "onset": F.when(note, F.col("__t")).otherwise(rising),
        "duration": F.when(note, F.greatest(F.lit(1), F.rint(F.col("duration") * factor).cast("long"))).otherwise(F.col("duration")),
    }).drop("__t", "__n")


def transposed(events: DataFrame, shift: int) -> DataFrame:
    """Notes moved by semitones; those that leave the keyboard go, pedals stay."""
    note = F.col("kind") == NOTE
    moved = events.withColumn("pitch", F.when(note, F.col("pitch") + shift).otherwise(F.col("pitch")))
    return moved.where(~note | F.col("pitch").between(LOW_KEY, HIGH_KEY))


def louder(events: DataFrame, shift: int) -> DataFrame:
    """Velocities of notes moved, within 1 to 127."""
    return events.withColumn("velocity", F.when(F.col("kind") == NOTE, clip(F.col("velocity") + shift, 1, 127)).otherwise(F.col("velocity")))


def drift(events: DataFrame, split: int | Column, shift: int, ramp: int) -> DataFrame:
    """Onsets before the split moved by up to `shift`, less and less over the last `ramp` frames; never below 0."""
    split = F.lit(split) if isinstance(split, int) else split
    share = clip((split - F.col("onset")) / F.lit(float(ramp)), 0.0, 1.0)
    return events.withColumn("onset", F.when(F.col("onset") < split, F.greatest(F.lit(0), F.rint(F.col("onset") + share * shift).cast("long"))).otherwise(F.col("onset")))


def trim_lead(events: DataFrame) -> DataFrame:
    """Songs from their first note on: what is before it goes, but for a pedal still down, which then begins at 0."""
    song = Window.partitionBy("song_id")
    lead = F.min(F.when(F.col("kind") == NOTE, F.col("onset"))).over(song)
    before = F.col("onset") < F.col("__lead")
    e = events.withColumn("__lead", lead)
    last = F.max(F.when(before & (F.col("kind") != NOTE), F.struct("onset", "kind"))).over(song)
    e = e.withColumn("__last", last)
    held = before & (F.col("kind") == PEDAL_ON) & (F.struct("onset", "kind") == F.col("__last"))
    return e.where(~before | held).withColumn("onset", F.greatest(F.lit(0), F.col("onset") - F.col("__lead"))).drop("__lead", "__last")


def change_stats(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], value: str) -> DataFrame:
    """(column, n_changed, changed, n_same, same): mean of `value` where a column differs from the row before, and where not."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = rows.withColumn("__n", F.row_number().over(w))
    out = out.withColumns({f"__{c}": ~F.col(c).eqNullSafe(F.lag(c).over(w)) for c in columns}).where("__n > 1")
    long = out.select(value, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__{c}").alias("on")) for c in columns])).alias("c")).select(value, "c.*")
    on = F.col("on")
    return long.groupBy("column").agg(
        F.count_if(on).alias("n_changed"), F.avg(F.when(on, F.col(value))).alias("changed"), F.count_if(~on).alias("n_same"), F.avg(F.when(~on, F.col(value))).alias("same")
    )


def pedal_safe_bins(notes: DataFrame, changes: DataFrame, keys: list[str], onset: str, duration: str, at: str, values: list[int]) -> DataFrame:
    """notes with `bin`, the index of the value nearest in logarithm to the duration, chosen so that the release stays between the same pedal changes.

    `changes` (keys, at) are the times at which the pedal goes down or up. A release at the time of a change counts as
    before it. Where the nearest value would carry the release past a change, the one among the values that keep it
    in place whose release is nearest is taken, the smaller in a tie; if none does, the nearest value stays. Only
    such rows look at all values.
    """
    ends = changes.select(*keys, at).distinct().withColumn("__at", F.col(at))
    r = notes.withColumn("__id", F.monotonically_increasing_id()).withColumn(at, F.col(onset) + F.col(duration))
    low = asof_join(r, ends, keys, at, ["__at"], strict=True).withColumnRenamed("__at_asof", "__low").drop("t_asof")
    both = asof_join(low, ends, keys, at, ["__at"], strict=False, forward=True).withColumnRenamed("__at_asof", "__high")
    all_ = F.array(*[F.lit(int(v)) for v in values])
    near = bin_of(F.col(duration), bounds_of(values))
    held = lambda x: (F.col("__low").isNull() | (x > F.col("__low"))) & (F.col("__high").isNull() | (x <= F.col("__high")))
    ways = F.filter(F.transform(all_, lambda v, i: F.struct(F.abs(v - F.col(duration)).alias("far"), i.alias("bin"), (F.col(onset) + v).alias("to"))), lambda w: held(w["to"]))
    moved = F.when(held(F.col(onset) + F.get(all_, near)), near).otherwise(F.coalesce(F.array_min(ways)["bin"], near))
    return both.select(*notes.columns, moved.cast("int").alias("bin"))
