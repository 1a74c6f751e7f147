"""Operators along ordered rows: smoothing, voting, selecting, folding."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running_in
from .scans import handed_on


def smooth(rows: DataFrame, keys: list[str], order: list[str], x: str, half: int, out: str) -> DataFrame:
    """Centred mean of the values there are; null stays null."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)
    return rows.withColumn(out, F.when(F.col(x).isNotNull(), F.avg(x).over(w)))


def reflect_mean(rows: DataFrame, keys: list[str], order: list[str], x: str, width: int, out: str) -> DataFrame:
    """Mean over width//2 rows before and the rest after; beyond the ends stand mirrored values, 2 * edge - value.

    Groups become arrays, for at most a series' length; a group is one series.
    """
    before, after = width // 2, width - 1 - width // 2
    row = F.array_sort(F.collect_list(F.struct(*order, F.struct("*").alias("__row"), F.col(x).cast("double").alias("__x"))))
    g = rows.groupBy(*keys).agg(row.alias("__s"))
    xs = F.col("__s.__x")
    n = F.size("__s")
    at = lambda i: F.when(i < 0, 2 * F.get(xs, F.lit(0)) - F.get(xs, F.least(-i, n - 1))).when(i >= n, 2 * F.get(xs, n - 1) - F.get(xs, F.greatest(2 * (n - 1) - i, F.lit(0)))).otherwise(F.get(xs, i))
    mean = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(F.sequence(-F.lit(before), F.lit(after)), F.lit(0.0), lambda s, k: s + at(i + k)) / width)
    return g.select(F.explode(F.arrays_zip(F.col("__s"), mean.alias("__m"))).alias("e")).select("e.__s.__row.*", F.col("e.__m").alias(out))


def rolling_median(rows: DataFrame, keys: list[str], order: list[str], x: str, half: int, out: str) -> DataFrame:
    """Median of 2 * half + 1 rows; beyond the ends the end value repeats."""
    w = Window.partitionBy(*keys).orderBy(*order)
    all_rows = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(x).over(all_rows), F.last(x).over(all_rows)
    near = [F.coalesce(F.lag(x, i).over(w), first) for i in range(half, 0, -1)] + [F.col(x)] + [F.coalesce(F.lead(x, i).over(w), last) for i in range(1, half + 1)]
    return rows.withColumn(out, F.get(F.array_sort(F.array(*near)), F.lit(half)))


def majority(rows: DataFrame, keys: list[str], order: list[str], level: str, levels: list[int], half: int, out: str) -> DataFrame:
    """The commonest level within `half` rows; the first of `levels` in a tie."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)
    votes = F.array(*[F.struct((-F.count(F.when(F.col(level) == v, 1)).over(w)).alias("n"), F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(levels)])
    return rows.withColumn(out, F.array_min(votes)["v"])


def rising(rows: DataFrame, keys: list[str], order: list[str], x: str) -> DataFrame:
    """Rows above all before them: what a greedy strictly rising selection keeps."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__top", F.max(x).over(w)).where(F.col("__top").isNull() | (F.col(x) > F.col("__top"))).drop("__top")


def changes(rows: DataFrame, keys: list[str], order: list[str], x: str) -> DataFrame:
    """(keys, n_changes): how often a value differs from the one before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__c", (~F.col(x).eqNullSafe(F.lag(x).over(w)) & F.lag(F.lit(1)).over(w).isNotNull()).cast("int")).groupBy(*keys).agg(F.sum("__c").alias("n_changes"))


def drop_repeats(rows: DataFrame, keys: list[str], order: list[str], x: str) -> DataFrame:
    """Rows whose value is that of the row before are dropped."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).withColumn("__was", F.lag(x).over(w)).where((F.col("__n") == 1) | ~F.col(x).eqNullSafe(F.col("__was"))).drop("__n", "__was")


def carry(rows: DataFrame, keys: list[str], order: list[str], x: str, out: str) -> DataFrame:
    """The last value known."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(x, ignorenulls=True).over(w))


def first_rows(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """At most n rows a key, in order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def thin(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """At most n rows a key, spread evenly over its rows."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    count = F.count("*").over(Window.partitionBy(*keys))
    slot = lambda r: F.floor(r * n / F.col("__c"))
    r = rows.withColumn("__c", count).withColumn("__r", rank)
    return r.where((F.col("__c") <= n) | (F.col("__r") == 0) | (slot(F.col("__r")) != slot(F.col("__r") - 1))).drop("__c", "__r")


def fold(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], zero: Column, merge, finish=None, out: str = "state") -> DataFrame:
    """(keys, out): a fold with carried state over each key's rows in order, in the JVM. A group is one series."""
    item = F.struct(*order, *[c for c in columns if c not in order])
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("__items"))
    args = [F.col("__items"), zero, merge] + ([finish] if finish else [])
    return g.select(*keys, F.aggregate(*args).alias(out))


def tempo_segments(rows: DataFrame, keys: list[str], order: str, x: str, tolerance: float = 0.05, size: int = 1 << 16) -> DataFrame:
    """(keys, segment, first, n, value): stretches whose values stay within tolerance of the running median; values are above zero, places of a key differ.

    A scan handed on along each key, whose state is the sorted values of the segment at hand.
    """

    def middle(held: list[float]) -> float:
        return (held[(len(held) - 1) // 2] + held[len(held) // 2]) / 2

    def step(part: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict]:
        segment, held = (-1, []) if state is None else (int(state["__segment"]), list(state["__held"]))
        segments, medians = [], []
        for v in part[x].astype(float):
            if held and abs(v / middle(held) - 1) <= tolerance:
                bisect.insort(held, v)
            else:
                segment, held = segment + 1, [v]
            segments.append(segment)
            medians.append(middle(held))
        state = {"__segment": segment, "__held": held}
        return pd.DataFrame({"__segment": segments, "__median": medians, "__held": [None] * (len(part) - 1) + [held]}), state

    cast = rows.select(*keys, order, F.col(x).cast("double").alias(x))
    each = handed_on(cast, keys, [order], step, ["__segment", "__held"], "__segment int, __median double, __held array<double>", size)
    g = each.groupBy(*keys, F.col("__segment").alias("segment")).agg(F.count("*").cast("int").alias("n"), F.max_by("__median", order).alias("value"))
    before = Window.partitionBy(*keys).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return g.select(*keys, "segment", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("first"), "n", "value")


def repedal(rows: DataFrame, keys: list[str], on: str, off: str) -> DataFrame:
    """Pedal intervals after rounding: each starts a step after the last start at least, and the last ends by then."""
    own = Window.partitionBy(*keys).orderBy(on, off)
    r = rows.select(*keys, F.col(on).cast("long").alias(on), F.col(off).cast("long").alias(off)).withColumn("__n", F.row_number().over(own))
    start = F.max(F.col(on) - F.col("__n")).over(own.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__n")
    r = r.withColumn("__start", start).withColumn("__stop", F.greatest(off, F.col("__start") + 1))
    r = r.withColumn("__stop", F.least("__stop", F.lead("__start").over(Window.partitionBy(*keys).orderBy("__n"))))
    return r.select(*keys, F.col("__start").alias(on), F.col("__stop").alias(off))


def running_max(rows: DataFrame, keys: list[str], order: list[str], x: str, out: str) -> DataFrame:
    """The largest value so far."""
    return rows.withColumn(out, F.max(x).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def offsets(rows: DataFrame, keys: list[str], order: list[str], length: str, out: str) -> DataFrame:
    """Where each row's items begin when a key's rows are laid end to end; a key may hold any share of all rows."""
    upto = running_in(rows, keys, order, F.coalesce(F.col(length), F.lit(0)), "__upto")
    return upto.withColumn(out, F.col("__upto") - F.coalesce(F.col(length), F.lit(0))).drop("__upto")


def sliding_count(rows: DataFrame, keys: list[str], t: str, reach: int, out: str) -> DataFrame:
    """Rows of the key within reach of each row's time, itself included."""
    return rows.withColumn(out, F.count("*").over(Window.partitionBy(*keys).orderBy(t).rangeBetween(-reach, reach)))


def local_slope(rows: DataFrame, keys: list[str], t: str, x: str, half: int, out: str) -> DataFrame:
    """Slope over `half` rows on either side (fewer at the ends), and its ratio to the key's median slope as `out`_ratio; null where times don't differ."""
    own = Window.partitionBy(*keys).orderBy(t).rowsBetween(-half, half)
    slope = (F.last(x).over(own) - F.first(x).over(own)) / F.nullif(F.last(t).over(own) - F.first(t).over(own), F.lit(0))
    r = rows.withColumn(out, slope)
    median = r.groupBy(*keys).agg(F.percentile(out, F.lit(0.5)).alias("__median"))
    return r.join(median, keys).withColumn(f"{out}_ratio", F.col(out) / F.nullif("__median", F.lit(0.0))).drop("__median")


def last_rows(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key: a log of bounded length."""
    back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("__n", F.row_number().over(back)).where(F.col("__n") <= n).drop("__n")
