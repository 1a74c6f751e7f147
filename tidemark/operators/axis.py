"""The axis of bars and beats, tempo timelines over it, and windows of what lies on it. All are joins and windows; a key is one series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .temporal import asof_join, nearest_join


def beats_of_segments(segments: DataFrame, keys: list[str], start: str, stop: str, period: str, meter: str) -> DataFrame:
    """(keys, start, beat, t, position, bar): the beats of each segment of steady meter; a bar begins where position is 0.

    A last bar that is not filled counts as a bar; a beat that only rounding would bring to the end isn't one.
    """
    n = F.ceil((F.col(stop) - F.col(start)) / F.col(period) - 1e-6).cast("int")
    rows = segments.where(F.col(stop) > F.col(start)).select(*keys, start, period, meter, F.explode(F.sequence(F.lit(0), n - 1)).alias("beat"))
    return rows.select(*keys, start, "beat", (F.col(start) + F.col("beat") * F.col(period)).alias("t"), F.pmod("beat", F.col(meter).cast("int")).alias("position"), F.floor(F.col("beat") / F.col(meter)).cast("int").alias("bar"))


def flag_downbeats(beats: DataFrame, downbeats: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Beats with `downbeat`: whether some downbeat lies nearest to this one (the earlier beat in a tie)."""
    near = nearest_join(downbeats.select(*keys, t).distinct(), beats.select(*keys, t).distinct().withColumn("__at", F.col(t)), keys, t, ["__at"])
    hit = near.where("__at_near is not null").select(*keys, F.col("__at_near").alias(t)).distinct().withColumn("downbeat", F.lit(True))
    return beats.join(hit, [*keys, t], "left").withColumn("downbeat", F.coalesce("downbeat", F.lit(False)))


def beats_of_measures(measures: DataFrame, keys: list[str], measure: str, start: str, length: str, nominal: str, unit: str) -> DataFrame:
    """(keys, measure, beat, position): the beats of each measure, `unit` apart from its start; those of one shorter than nominal (a pickup) are counted back from its end.

    A 64th is the slack at either end.
    """
    short = F.col(length) < F.col(nominal)
    n = F.when(short, F.floor((F.col(length) + 1 / 64) / F.col(unit))).otherwise(F.ceil((F.col(length) - 1 / 64) / F.col(unit))).cast("int")
    rows = measures.withColumn("__n", n).where("__n > 0").withColumn("beat", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    at = F.when(short, F.col(start) + F.col(length) - (F.col("__n") - F.col("beat")) * F.col(unit)).otherwise(F.col(start) + F.col("beat") * F.col(unit))
    return rows.select(*keys, measure, "beat", at.alias("position"))


def measure_tempo(measures: DataFrame, keys: list[str], measure: str, seconds: str, length: str) -> DataFrame:
    """measures with `qpm`, quarters to the minute up to the next measure's time, within 20 and 400; 120 where time stands still, the tempo before for the last one."""
    own = Window.partitionBy(*keys).orderBy(measure)
    span = F.lead(seconds).over(own) - F.col(seconds)
    r = measures.withColumn("__s", span).withColumn("__q", F.when(F.col("__s") > 0, F.col(length) * 60.0 / F.greatest("__s", F.lit(1e-6))).when(F.col("__s").isNotNull(), 120.0))
    qpm = F.coalesce("__q", F.lag("__q").over(own), F.lit(120.0))
    return r.withColumn("qpm", F.greatest(F.lit(20.0), F.least(F.lit(400.0), qpm))).drop("__s", "__q")


def match_by_measure(score: DataFrame, measures: DataFrame, played: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, found, total): how many of a measure's written notes were played near their time.

    score: keys, measure, onset (quarters within it) and pitch; measures: keys, measure, start (seconds) and length
    (quarters); played: keys, t and pitch. A note's time lies in proportion between its measure's start and the next
    one's (the last measure is as fast as the one before); it is found if the nearest note of its pitch is within a
    tenth of a second or 0.12 of the measure's time, whichever is more. Keys with fewer than two measures have no row.
    """
    own = Window.partitionBy(*keys).orderBy("measure")
    m = measures.withColumns({"__d": F.lead("start").over(own) - F.col("start"), "__n": F.count("*").over(Window.partitionBy(*keys))}).where("__n > 1")
    held = F.lag("__d").over(own) * F.col("length") / F.greatest(F.lag("length").over(own), F.lit(1e-3))
    m = m.withColumn("__d", F.coalesce("__d", held)).select(*keys, "measure", "start", "length", "__d")
    at = F.col("start") + F.col("onset") / F.greatest("length", F.lit(1e-3)) * F.col("__d")
    notes = score.join(m, [*keys, "measure"]).select(*keys, "measure", F.col("pitch").alias("__p"), at.alias("__t"), F.greatest(F.lit(0.1), 0.12 * F.col("__d")).alias("__near"))
    near = nearest_join(notes, played.select(*keys, F.col("pitch").alias("__p"), F.col("t").cast("double").alias("__t")), [*keys, "__p"], "__t", [])
    got = near.groupBy(*keys, "measure").agg(F.count(F.when(F.col("distance") <= F.col("__near"), 1)).alias("found"), F.count("*").alias("total"))
    return m.select(*keys, "measure").join(got, [*keys, "measure"], "left").fillna(0, ["found", "total"])


def timeline(tempos: DataFrame, keys: list[str], tick: str, per_tick: str, default: float | None = None) -> DataFrame:
    """Tempo changes with `at`: the time of each, integrating the time per tick from tick 0 on.

    Before the first change of a key `default` holds, from a row of its own at tick 0; without one the first tempo does.
    """
    if default is not None:
        late = tempos.groupBy(*keys).agg(F.min(tick).alias(tick)).where(F.col(tick) > 0)
        kinds = dict(tempos.dtypes)
        tempos = tempos.select(*keys, tick, per_tick).unionByName(late.select(*keys, F.lit(0).cast(kinds[tick]).alias(tick), F.lit(default).cast(kinds[per_tick]).alias(per_tick)))
    own = Window.partitionBy(*keys).orderBy(tick)
    last, was = F.lag(tick).over(own), F.lag(per_tick).over(own)
    step = F.when(last.isNull(), F.col(tick) * F.col(per_tick)).otherwise((F.col(tick) - last) * was)
    return tempos.withColumn("__step", step).withColumn("at", F.sum("__step").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def time_of(rows: DataFrame, tempos: DataFrame, keys: list[str], tick: str, per_tick: str, out: str, default: float | None = None) -> DataFrame:
    """The time of each row's tick on the timeline of its key; where the key has no tempo, at the default one, or null without one."""
    line = timeline(tempos, keys, tick, per_tick, default).withColumn("__tick", F.col(tick))
    first = line.groupBy(*keys).agg(F.min_by(per_tick, tick).alias("__first"))
    r = asof_join(rows, line, keys, tick, ["at", per_tick, "__tick"], strict=False).join(first, keys, "left")
    first_tempo = F.col("__first") if default is None else F.coalesce(F.col("__first"), F.lit(default))
    at = F.when(F.col("at_asof").isNull(), F.col(tick) * first_tempo).otherwise(F.col("at_asof") + (F.col(tick) - F.col("__tick_asof")) * F.col(f"{per_tick}_asof"))
    return r.select(*rows.columns, at.alias(out))


def beat_levels(beats: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Beats with `step`, the time to the next, and `level`: how the smoothed step (median of three) compares with the key's median, as the nearest of 1/2, 1, 2 (0.5 below 0.7, 2 above 1.4)."""
    own = Window.partitionBy(*keys).orderBy(t)
    r = beats.withColumn("step", F.lead(t).over(own) - F.col(t))
    sides = F.array_sort(F.array(F.coalesce(F.lag("step").over(own), "step"), F.col("step"), F.coalesce(F.lead("step").over(own), "step")))
    r = r.withColumn("__mid", F.get(sides, F.lit(1)).cast("double"))
    median = r.groupBy(*keys).agg(F.percentile("step", F.lit(0.5)).alias("__median"))
    ratio = F.col("__mid") / F.col("__median")
    return r.join(median, keys).withColumn("level", F.when(F.col("step").isNull(), None).when(ratio < 0.7, 0.5).when(ratio > 1.4, 2.0).otherwise(1.0)).drop("__mid", "__median")


def steady_share(beats: DataFrame, keys: list[str], t: str, tolerance: float) -> DataFrame:
    """(keys, n, steady): steps of a series, and the share that differ from the step before by the tolerance at most."""
    own = Window.partitionBy(*keys).orderBy(t)
    r = beats.withColumn("__step", F.lead(t).over(own) - F.col(t))
    r = r.withColumn("__ok", F.abs(F.lead("__step").over(own) / F.nullif("__step", F.lit(0)) - 1) <= tolerance)
    return r.groupBy(*keys).agg(F.count("__step").alias("n"), F.avg(F.col("__ok").cast("double")).alias("steady"))


def consecutive(beats: DataFrame, keys: list[str], order: list[str], ok: str) -> DataFrame:
    """(keys, n, ok, consecutive): beats of a series, the share that are ok, and how many ok ones follow an ok one at once."""
    own = Window.partitionBy(*keys).orderBy(*order)
    r = beats.withColumn("__ok", F.coalesce(F.col(ok), F.lit(False))).withColumn("__both", F.col("__ok") & F.coalesce(F.lag("__ok").over(own), F.lit(False)))
    return r.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("__ok").cast("double")).alias("ok"), F.count_if("__both").alias("consecutive"))


def windows_with_memory(rows: DataFrame, keys: list[str], order: list[str], size: int, memory: int) -> DataFrame:
    """Each row in the window of `size` rows that it belongs to (`loss` true), and in those after it that remember it (the last `memory` rows before a window; `loss` false).

    Adds window, place (from 0, memory first) and loss.
    """
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    r = rows.withColumn("__n", n).withColumn("__all", F.count("*").over(Window.partitionBy(*keys)))
    own, last = F.floor(F.col("__n") / size), F.floor((F.col("__all") - 1) / size)
    to = F.least(last, F.floor((F.col("__n") + memory) / size))
    r = r.withColumn("window", F.explode(F.sequence(own.cast("int"), to.cast("int"))))
    begins = F.greatest(F.col("window") * size - memory, F.lit(0))
    return r.withColumn("place", (F.col("__n") - begins).cast("int")).withColumn("loss", F.col("__n") >= F.col("window") * size).drop("__n", "__all")


def padded(rows: DataFrame, batch: list[str], values: str, fill=0) -> DataFrame:
    """Arrays of a batch filled up to its longest: adds length, and `values` padded; a batch's rows stay apart, so none is collected."""
    longest = rows.groupBy(*batch).agg(F.max(F.size(values)).alias("__longest"))
    r = rows.join(longest, batch).withColumn("length", F.size(values))
    return r.withColumn(values, F.concat(values, F.array_repeat(F.lit(fill), F.col("__longest") - F.col("length")))).drop("__longest")


def span_features(rows: DataFrame, spans: DataFrame, keys: list[str], t: str, x: str, start: str, stop: str) -> DataFrame:
    """(keys, start, stop, n, mean, span): rows by the irregular span they fall into; empty spans stay with n 0."""
    state = spans.withColumn("__start", F.col(start)).select(*keys, F.col(start).alias(t), "__start", F.col(stop).alias("__stop"))
    inside = asof_join(rows, state, keys, t, ["__start", "__stop"], strict=False).where(F.col(t) < F.col("__stop_asof"))
    got = inside.groupBy(*keys, F.col("__start_asof").alias(start)).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), (F.max(x) - F.min(x)).alias("span"))
    return spans.select(*keys, start, stop).join(got, [*keys, start], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def mutual_nearest(a: DataFrame, b: DataFrame, keys: list[str], t: str, id_a: str, id_b: str, tolerance: int) -> DataFrame:
    """(id_a, id_b, off): rows that are each other's nearest in time within the tolerance; equal distances go to the earlier row. Times of a key differ within each side."""
    there = nearest_join(a.select(*keys, t, id_a), b.select(*keys, t, id_b), keys, t, [id_b]).where(F.col("distance") <= tolerance)
    back = nearest_join(b.select(*keys, t, id_b), a.select(*keys, t, id_a), keys, t, [id_a])
    both = there.select(id_a, F.col(f"{id_b}_near").alias(id_b), (F.col("t_near") - F.col(t)).alias("off"))
    return both.join(back.select(id_b, F.col(f"{id_a}_near").alias("__a")), id_b).where(F.col(id_a) == F.col("__a")).select(id_a, id_b, "off")


def best_scale(reference: DataFrame, other: DataFrame, keys: list[str], t: str, scales: dict[str, tuple[int, int]]) -> DataFrame:
    """(keys, scale, f1): the scale num/den of the other side's times that gives the largest F1 of common times; the first by name in a tie."""
    names = F.explode(F.array(*[F.struct(F.lit(k).alias("scale"), F.lit(n).alias("num"), F.lit(d).alias("den")) for k, (n, d) in scales.items()]))
    mine = reference.select(*keys, t).distinct()
    theirs = other.select(*keys, t).distinct().select(*keys, t, names.alias("s")).where(F.pmod(F.col(t) * F.col("s.num"), F.col("s.den")) == 0)
    moved = theirs.select(*keys, F.col("s.scale").alias("scale"), (F.col(t) * F.col("s.num") / F.col("s.den")).cast("long").alias(t))
    hits = moved.join(mine, [*keys, t]).groupBy(*keys, "scale").agg(F.count("*").alias("hit"))
    n_other = other.select(*keys, t).distinct().groupBy(*keys).agg(F.count("*").alias("n_b"))
    f1 = hits.join(mine.groupBy(*keys).agg(F.count("*").alias("n_a")), keys).join(n_other, keys).withColumn("f1", 2.0 * F.col("hit") / (F.col("n_a") + F.col("n_b")))
    own = Window.partitionBy(*keys).orderBy(F.desc("f1"), "scale")
    return f1.withColumn("__n", F.row_number().over(own)).where("__n = 1").select(*keys, "scale", "f1")
