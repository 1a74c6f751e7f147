"""How a cover is arranged over its source: how it fills the melody's pauses, how often it plays above the melody, how far it reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import uncovered
from .temporal import asof_join, band_join, merge_intervals

#: The right hand begins here; a cover has notes enough from here on.
MIDDLE, LEAST_NOTES = 60, 10


def arrangement(
    cover: DataFrame, melody: DataFrame, bounds: DataFrame, keys: list[str], near: int,
    shortest: int = 1, least_gap: float = 1.0, least_melody: int = 1, least_notes: int = 1, unit: float = 1.0, scores: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """(keys, low, high, fill, above, span) for each span [low, high) of a key.

    cover: keys, onset, pitch and mapped, the note's time in the source; melody: keys, start, duration and pitch;
    bounds: keys, low and high, spans that follow one another. Times of the source are whole frames, `unit` to the
    second.

    fill: the logarithm of 1 plus the onsets of the right hand by the second of pause, a chord counting once and by
    its first note; a pause is where no melody note sounds (each for `shortest` frames at least) from the cover's
    first to its last note. above: the root of the share of melody notes that the cover plays (the same pitch class
    within `near`) which have a higher note near them. span: highest pitch less lowest. Each is null where there is
    too little to measure (`least_gap` seconds of pause, `least_melody`, `least_notes`), and all are where the cover
    has fewer than ten notes. `scores` gives the mean and deviation by which a column is brought to a standard score.

    Pauses are read off running sums of merged intervals at the bounds, notes near a melody note come by cells of
    time, and both are sums by span, so no frame is ever a row.
    """
    whole = cover.groupBy(*keys).agg(F.count("*").alias("__all"), F.floor(F.min("mapped")).alias("__first"), F.floor(F.max("mapped")).alias("__last"), F.min("mapped").alias("__from"), F.max("mapped").alias("__to")).where(F.col("__all") >= LEAST_NOTES).drop("__all")
    spans = bounds.join(whole, keys, "left")
    edge = lambda t: spans.select(*keys, F.col(t).alias("__edge"), F.col("__first").alias("low"), (F.col("__last") + 1).alias("high")).where("low is not null").distinct()
    sounding = merge_intervals(melody.select(*keys, F.greatest(F.col("start"), F.lit(0)).alias("a"), (F.col("start") + F.greatest(F.col("duration"), F.lit(shortest))).alias("b")).where("a < b"), keys, "a", "b")
    read = uncovered(edge("low").unionByName(edge("high")).distinct(), sounding, keys, "__edge", "a", "b", "low", "high")
    paused = [read.select(*keys, F.col("__edge").alias(side), F.col("gap").alias(f"__{side}")) for side in ("low", "high")]
    out = spans.join(paused[0], [*keys, "low"], "left").join(paused[1], [*keys, "high"], "left").withColumn("__pause", (F.col("__high") - F.col("__low")) / unit)

    starts = bounds.select(*keys, F.col("low").alias("__t"), F.col("low").alias("__span"), F.col("high").alias("__stop"))

    def placed(rows: DataFrame, t: str) -> DataFrame:
        r = asof_join(rows.withColumn("__t", F.col(t)), starts, keys, "__t", ["__span", "__stop"], strict=False)
        return r.where(F.col("__t") < F.col("__stop_asof")).withColumnRenamed("__span_asof", "low")

    frame = cover.withColumn("__f", F.floor("mapped"))
    held = asof_join(frame, sounding.select(*keys, F.col("a").alias("__f"), "b"), keys, "__f", ["b"], strict=False)
    right = held.where((F.col("b_asof").isNull() | (F.col("b_asof") <= F.col("__f"))) & (F.col("pitch") >= MIDDLE))
    chords = placed(right.groupBy(*keys, "onset").agg(F.min("mapped").alias("mapped")), "mapped").groupBy(*keys, "low").agg(F.count("*").alias("__fills"))

    inside = melody.join(whole, keys).where(F.col("start").between(F.col("__from"), F.col("__to"))).select(*keys, F.col("start").alias("__f"), F.col("pitch").alias("__p"), F.monotonically_increasing_id().alias("__id"))
    around = band_join(inside, cover.select(*keys, F.col("mapped").alias("__f"), "pitch"), keys, "__f", near, ["pitch"]).where("t_band is not null")
    same = F.when(F.pmod("pitch", F.lit(12)) == F.pmod("__p", F.lit(12)), F.col("pitch"))
    each = around.groupBy(*keys, "__id", "__f").agg(F.max("pitch").alias("__top"), F.max(same).alias("__same")).where("__same is not null")
    aboves = placed(each, "__f").groupBy(*keys, "low").agg(F.count("*").alias("__played"), F.count(F.when(F.col("__top") > F.col("__same"), 1)).alias("__above"))

    reach = placed(cover, "mapped").groupBy(*keys, "low").agg(F.count("*").alias("__n"), (F.max("pitch") - F.min("pitch")).cast("double").alias("__reach"))
    out = out.join(chords, [*keys, "low"], "left").join(aboves, [*keys, "low"], "left").join(reach, [*keys, "low"], "left")
    known = F.col("__first").isNotNull()
    values = {
        "fill": F.when(known & (F.col("__pause") >= least_gap), F.log1p(F.coalesce("__fills", F.lit(0)) / F.col("__pause"))),
        "above": F.when(known & (F.col("__played") >= least_melody), F.sqrt(F.col("__above") / F.col("__played"))),
        "span": F.when(known & (F.col("__n") >= least_notes), F.col("__reach")),
    }
    for name, (mean, deviation) in (scores or {}).items():
        values[name] = (values[name] - mean) / deviation
    return out.select(*keys, "low", "high", *[v.alias(k) for k, v in values.items()])
