"""Bucketed statistics, standard scores and comparisons of event sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import quantise_score
from .temporal import band_join, nearest_join


def spine(counts: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Every bucket from 0 to a key's last."""
    last = counts.groupBy(*keys).agg(F.max(bucket).alias("__last"))
    return last.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__last"))).alias(bucket))


def bucket_dynamics(rows: DataFrame, keys: list[str], t: str, value: str, width: int, bins: int = 8, at_least: int = 3) -> DataFrame:
    """For each bucket: n, density = ln(1 + n), mean value, their standard scores within the key, and their bins.

    Empty buckets stay. A mean takes part with `at_least` rows; a score is null with fewer than two buckets or
    without spread.
    """
    b = rows.groupBy(*keys, F.floor(F.col(t) / width).cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    b = spine(b, keys, "bucket").join(b, [*keys, "bucket"], "left").fillna(0, ["n"])
    w = Window.partitionBy(*keys)
    b = b.withColumn("density", F.log1p("n")).withColumn("loudness", F.when(F.col("n") >= at_least, F.col("mean")))

    def score(x: str) -> Column:
        sd = F.stddev_pop(x).over(w)
        return F.when((F.count(x).over(w) >= 2) & (sd > 1e-12), (F.col(x) - F.avg(x).over(w)) / sd)

    b = b.withColumn("density_z", score("density")).withColumn("loudness_z", score("loudness"))
    return b.select(*keys, "bucket", "n", *[F.bround(c, 6).alias(c) for c in ("density_z", "loudness_z")], quantise_score(F.bround("density_z", 6), bins).alias("density_bin"), quantise_score(F.bround("loudness_z", 6), bins).alias("loudness_bin"))


def sample_stats(rows: DataFrame, keys: list[str], t: str, pitch: str, velocity: str, duration: str) -> DataFrame:
    """Rows per time unit, rows per onset, mean and deviation of pitch, mean velocity, median duration."""
    span = F.greatest(F.max(F.col(t) + F.col(duration)) - F.min(t), F.lit(1))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), (F.count("*") / span).alias("rate"), (F.count("*") / F.countDistinct(t)).alias("per_onset"),
        F.avg(pitch).alias("pitch_mean"), F.stddev_pop(pitch).alias("pitch_std"), F.avg(velocity).alias("velocity_mean"), F.percentile(duration, F.lit(0.5)).alias("duration_median"),
    )


def sync_metrics(reference: DataFrame, generated: DataFrame, keys: list[str], t: str, tolerance: int, bin_width: int, bin_least: int) -> DataFrame:
    """How generated onsets sit on the reference: share within tolerance, median offset, spread of the bins' medians.

    Onsets are distinct on both sides; a key with fewer than two reference onsets gives no row; the spread needs
    two bins of `bin_least` onsets.
    """
    ref = reference.select(*keys, t).distinct()
    enough = ref.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n >= 2").select(*keys)
    ref = ref.join(enough, keys, "left_semi")
    got = generated.select(*keys, t).distinct().join(enough, keys, "left_semi")
    near = nearest_join(got, ref, keys, t, []).withColumn("offset", F.col(t) - F.col("t_near"))
    bins = near.groupBy(*keys, F.floor(F.col(t) / bin_width).alias("__bin")).agg(F.count("*").alias("__c"), F.percentile("offset", F.lit(0.5)).alias("__m")).where(F.col("__c") >= bin_least)
    drift = bins.groupBy(*keys).agg(F.when(F.count("*") >= 2, F.stddev_pop("__m")).alias("drift_std"))
    base = near.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col("distance") <= tolerance).cast("double")).alias("onset_sync"), F.percentile("offset", F.lit(0.5)).alias("offset_median"))
    return base.join(drift, keys, "left")


def pedal_share(pedals: DataFrame, ends: DataFrame, keys: list[str], start: str, stop: str, end: str) -> DataFrame:
    """(keys, pedal_ratio): the share of a song, up to its end (1 at least), with the pedal down; intervals don't overlap."""
    held = pedals.groupBy(*keys).agg(F.sum(F.col(stop) - F.col(start)).alias("__held"))
    return ends.join(held, keys, "left").select(*keys, (F.coalesce("__held", F.lit(0)) / F.greatest(F.col(end), F.lit(1))).alias("pedal_ratio"))


def melody_metrics(melody: DataFrame, generated: DataFrame, keys: list[str], t: str, pitch: str, near: int, reach: int) -> DataFrame:
    """(keys, n, melody_top, melody_late) over melody notes up to the last generated one.

    melody_top: the share with the highest generated pitch within `near` of the same class; melody_late: the share
    whose class has no generated note within `near`, looked for within `reach`.
    """
    last = generated.groupBy(*keys).agg(F.max(t).alias("__last"))
    mine = melody.join(last, keys).where(F.col(t) <= F.col("__last")).select(*keys, t, F.col(pitch).alias("__p")).withColumn("__id", F.monotonically_increasing_id())
    both = band_join(mine, generated.select(*keys, t, F.col(pitch).alias("__q")), keys, t, reach, ["__q"])
    off, same = F.abs(F.col("t_band") - F.col(t)), F.pmod("__p", F.lit(12)) == F.pmod("__q", F.lit(12))
    each = both.groupBy(*keys, "__id", "__p").agg(F.max(F.when(off <= near, F.col("__q"))).alias("__top"), F.min(F.when(same, off)).alias("__off"))
    top = F.coalesce(F.pmod("__top", F.lit(12)) == F.pmod("__p", F.lit(12)), F.lit(False))
    late = F.coalesce(F.col("__off") > near, F.lit(True))
    return each.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(top.cast("double")).alias("melody_top"), F.avg(late.cast("double")).alias("melody_late"))


def set_f1(a: DataFrame, b: DataFrame, keys: list[str], item: list[str]) -> DataFrame:
    """(keys, n_a, n_b, hit, f1) of two sets of items."""
    both = a.select(*keys, *item, F.lit(1).alias("__a")).distinct().join(b.select(*keys, *item, F.lit(1).alias("__b")).distinct(), [*keys, *item], "full")
    g = both.groupBy(*keys).agg(F.count("__a").alias("n_a"), F.count("__b").alias("n_b"), F.count(F.col("__a") + F.col("__b")).alias("hit"))
    return g.withColumn("f1", F.when(F.col("n_a") + F.col("n_b") > 0, 2.0 * F.col("hit") / (F.col("n_a") + F.col("n_b"))))


def multiset_shift(a: DataFrame, b: DataFrame, keys: list[str], position: str, item: list[str], shifts: list[int]) -> DataFrame:
    """(keys, shift, overlap): the shift of b under which the two multisets share most; the smallest |shift| in a tie."""
    ca = a.groupBy(*keys, position, *item).agg(F.count("*").alias("__a"))
    cb = b.groupBy(*keys, position, *item).agg(F.count("*").alias("__b"))
    cb = cb.withColumn("shift", F.explode(F.array(*[F.lit(s) for s in shifts]))).withColumn(position, F.col(position) + F.col("shift"))
    hit = ca.join(cb, [*keys, position, *item]).groupBy(*keys, "shift").agg(F.sum(F.least("__a", "__b")).alias("overlap"))
    best = F.min_by(F.struct("shift", "overlap"), F.struct(-F.col("overlap"), F.abs("shift"), "shift"))
    return hit.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.shift", "b.overlap")


def rare_share(rows: DataFrame, keys: list[str], group: list[str], below: float) -> DataFrame:
    """(keys, any_rare): whether a key holds a value whose share of all rows is below a limit.

    Shares are counted once over the distinct values, not by a window over all rows.
    """
    counts = rows.groupBy(*group).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"))
    rare = counts.join(F.broadcast(total)).select(*group, (F.col("__n") / F.col("__all") < below).alias("__rare"))
    return rows.select(*keys, *group).distinct().join(rare, group).groupBy(*keys).agg(F.bool_or("__rare").alias("any_rare"))


def histogram(rows: DataFrame, token: str, vocabulary: DataFrame) -> DataFrame:
    """Counts over a fixed vocabulary, zeros kept."""
    return vocabulary.join(rows.groupBy(token).agg(F.count("*").alias("n")), token, "left").fillna(0, ["n"])


def masked_mse(rows: DataFrame, keys: list[str], predicted: str, target: str) -> DataFrame:
    """Mean squared error where both are known."""
    return rows.groupBy(*keys).agg(F.avg(F.pow(F.col(predicted) - F.col(target), 2)).alias("mse"))


def onset_masks(rows: DataFrame, keys: list[str], onset: str, pitch: str) -> DataFrame:
    """(keys, onset, mask): pitch classes that sound together, a bit each."""
    from ..functions.scalar import pitch_class_mask

    return rows.groupBy(*keys, onset).agg(F.bit_or(pitch_class_mask(F.col(pitch))).alias("mask"))
