"""Notes on a grid of beats and bars, their tokens by bar, and the measures of a performance in the order they were played."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequences import detokenise, tokenise
from .temporal import asof_join, containing, interp_join


def to_ticks(rows: DataFrame, beats: DataFrame, keys: list[str], t: str, per_beat: int, out: str) -> DataFrame:
    """rows with the tick of their time, `per_beat` to the beat, halves to even; beyond the ends the outer steps go on.

    beats: keys, beat (0, 1, ...) and t.
    """
    at = interp_join(rows, beats.select(*keys, F.col("t").cast("double").alias(t), F.col("beat").cast("double").alias("__beat")), keys, t, "__beat", extrapolate=True)
    return at.select(*rows.columns, F.rint(F.col("__beat_at") * per_beat).cast("long").alias(out))


def from_ticks(rows: DataFrame, beats: DataFrame, keys: list[str], tick: str, per_beat: int, out: str) -> DataFrame:
    """rows with the time of their tick on the grid."""
    knots = beats.select(*keys, (F.col("beat") * per_beat).cast("double").alias(tick), F.col("t").cast("double").alias("__t"))
    return interp_join(rows, knots, keys, tick, "__t", extrapolate=True).withColumnRenamed("__t_at", out)


def bar_tokenise(rows: DataFrame, bars: DataFrame, keys: list[str], longest: int, limit: int | None = None) -> DataFrame:
    """(keys, bar, tokens, pedal): events by bar, their times counted from the bar's start.

    rows: keys, onset (a tick), kind (0 pedal up, 1 down, 2 note), pitch, duration, velocity; bars: keys, bar and
    start, none longer than `longest`. Rows before the first bar are left out. `pedal` says whether the pedal is down
    where the bar begins: pressed before it and not let go before it. Bars without events have no row.
    """
    placed = asof_join(rows, bars.select(*keys, F.col("start").alias("onset"), "bar", F.col("start").alias("__start")), keys, "onset", ["bar", "__start"], strict=False)
    even = placed.where("bar_asof is not null").withColumn("onset", F.col("bar_asof") * longest + F.col("onset") - F.col("__start_asof"))
    tokens = tokenise(even.select(*keys, *[F.col(c).cast("long").alias(c) for c in ("onset", "kind", "pitch", "duration", "velocity")]), keys, longest, limit).withColumnRenamed("patch", "bar")
    # of several changes at one tick the press counts, as it comes after the release
    pedal = rows.where("kind < 2").groupBy(*keys, F.col("onset").alias("start")).agg((F.max("kind") == 1).alias("__down"))
    # a release where a bar begins comes after the bar's beginning, a press does, too
    down = asof_join(bars.select(*keys, "bar", "start"), pedal, keys, "start", ["__down"], strict=True)
    state = down.select(*keys, "bar", F.coalesce("__down_asof", F.lit(False)).alias("pedal"))
    return tokens.join(state, [*keys, "bar"])


def bar_detokenise(patches: DataFrame, bars: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """The events of bar_tokenise's tokens, at their ticks."""
    even = detokenise(patches.select(*keys, F.col("bar").alias("patch"), "tokens"), keys, longest)
    even = even.withColumn("bar", F.floor(F.col("onset") / longest)).join(bars.select(*keys, "bar", "start"), [*keys, "bar"])
    return even.withColumn("onset", F.col("start") + F.pmod("onset", F.lit(longest))).drop("bar", "start")


def played_order(entries: DataFrame, beats: DataFrame, measures: DataFrame, keys: list[str], most_tail: int = 2) -> tuple[DataFrame, DataFrame]:
    """((keys, place, measure, start), (keys, reason)): the measures of each performance as they were played, and why others have none.

    entries: keys, k (0, 1, ...), entry and t: what is written at a downbeat, a measure's number or several joined
    by "-", of which the first counts and the others follow it. beats: keys and t. measures: keys, measure (from 0)
    and length. Several measures in one entry share the time to the next downbeat: each begins where its share of
    the lengths lies among the beats. A measure 0 that the first entry leaves out begins before it, in the tempo of
    the measure after it; up to `most_tail` measures behind the last entry follow in the tempo before them. Lengths
    are above zero.

    Reasons, the first that holds: "no measures named", "several measures at the last bar line", "a measure the
    score lacks", "times do not rise", "more than one measure before the first bar line".
    """
    line = Window.partitionBy(*keys).orderBy("k")
    e = entries.withColumns({"__first": F.split_part("entry", F.lit("-"), F.lit(1)).cast("int"), "__n": F.size(F.split("entry", "-")), "__next": F.lead("t").over(line)})
    inner = containing(beats.select(*keys, F.col("t")), e.where("__next is not null").select(*keys, F.col("t").alias("a"), F.col("__next").alias("b")), keys, "t", "a", "b")
    inner = inner.where((F.col("t") > F.col("a") + 1e-6) & (F.col("t") < F.col("b") - 1e-6)).groupBy(*keys, F.col("a").alias("t")).agg(F.array_sort(F.collect_list(F.col("t").cast("double"))).alias("__inner"))
    each = e.join(inner, [*keys, "t"], "left").select(*keys, "k", "__n", "__next", F.col("t").cast("double").alias("__t"), "__inner", F.posexplode(F.sequence(F.col("__first"), F.col("__first") + F.col("__n") - 1)).alias("__i", "measure"))
    each = each.join(measures.select(*keys, "measure", F.col("length").cast("double").alias("__len")), [*keys, "measure"], "left")
    group = Window.partitionBy(*keys, "k").orderBy("__i")
    before = F.coalesce(F.sum("__len").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    share = before / F.sum("__len").over(Window.partitionBy(*keys, "k"))
    knots = F.concat(F.array("__t"), F.coalesce("__inner", F.array().cast("array<double>")), F.array(F.col("__next").cast("double")))
    each = each.withColumn("__knots", knots).withColumn("__at", share * (F.size("__knots") - 1))
    low = F.least(F.floor("__at"), F.size("__knots") - 2).cast("int")
    a, b = F.get("__knots", low), F.get("__knots", low + 1)
    each = each.withColumn("start", F.when(F.col("__n") == 1, F.col("__t")).otherwise(a + (b - a) * (F.col("__at") - low)))
    order = Window.partitionBy(*keys).orderBy("k", "__i")
    each = each.withColumns({"__place": F.row_number().over(order), "__was": F.lag("start").over(order)})

    names = entries.select(*keys).distinct()
    found = each.groupBy(*keys).agg(
        F.countDistinct("k").alias("__k"), F.bool_or((F.col("__n") > 1) & F.col("__next").isNull()).alias("__last"), F.bool_or(F.col("__len").isNull()).alias("__lacks"),
        F.bool_or(F.col("start") <= F.col("__was")).alias("__falls"), F.min_by("measure", "__place").alias("__begin"),
    )
    reason = (
        F.when(F.coalesce(F.col("__k") < 2, F.lit(True)), "no measures named").when(F.col("__last"), "several measures at the last bar line").when(F.col("__lacks"), "a measure the score lacks")
        .when(F.col("__falls"), "times do not rise").when(F.col("__begin") > 1, "more than one measure before the first bar line")
    )
    judged = names.join(found, keys, "left").select(*keys, reason.alias("reason"), "__begin")
    good = each.join(judged.where("reason is null").select(*keys, "__begin"), keys)

    ends = good.groupBy(*keys).agg(
        F.min_by(F.struct("start", "__len", "measure"), "__place").alias("f"), F.min_by("start", F.when(F.col("__place") > 1, F.col("__place"))).alias("second"),
        F.max_by(F.struct("start", "measure", "__len"), "__place").alias("z"), F.max("__place").alias("top"), F.max("__begin").alias("__begin"),
    )
    beyond = good.join(ends.select(*keys, "top"), keys).where(F.col("__place") == F.col("top") - 1).select(*keys, F.col("start").alias("y_start"), F.col("__len").alias("y_len"))
    ends = ends.join(beyond, keys).withColumn("tempo", (F.col("z.start") - F.col("y_start")) / F.col("y_len"))
    zero = measures.where("measure = 0").select(*keys, F.col("length").cast("double").alias("l0"))
    pickup = ends.where("__begin = 1").join(zero, keys).select(*keys, F.lit(0).alias("__place"), F.lit(0).alias("measure"), (F.col("f.start") - F.col("l0") * (F.col("second") - F.col("f.start")) / F.col("f.__len")).alias("start"))
    after = measures.join(ends.select(*keys, F.col("z.measure").alias("m"), F.col("z.start").alias("s"), F.col("z.__len").alias("zl"), "tempo", "top"), keys).where("measure > m")
    tail = after.withColumn("__c", F.count("*").over(Window.partitionBy(*keys))).where(F.col("__c") <= most_tail)
    passed = F.coalesce(F.sum(F.col("length").cast("double")).over(Window.partitionBy(*keys).orderBy("measure").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    tail = tail.select(*keys, (F.col("top") + F.col("measure") - F.col("m")).alias("__place"), "measure", (F.col("s") + F.col("tempo") * (F.col("zl") + passed)).alias("start"))
    rows = good.select(*keys, "__place", "measure", "start").unionByName(pickup).unionByName(tail)
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("__place")) - 1)
    return placed.select(*keys, "place", "measure", "start"), judged.where("reason is not null").select(*keys, "reason")
