"""Predicates over whole groups, lookups with a default, and values taken from the ends of a series.

Aggregates are partial before they are shuffled, so a hot key costs one row a task. Those with a window (`increasing`,
`end_slopes`) keep a key's rows in one task: for songs and sessions, not for keys that hold a large share of a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def increasing(rows: DataFrame, keys: list[str], order: list[str], value: str, least: int = 4) -> DataFrame:
    """Keys with at least so many values, each above the one before. A null value or a tie fails the key."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    found = rows.select(*keys, F.col(value).isNotNull().alias("_known"), (first | F.coalesce(step > 0, F.lit(False))).alias("_up"))
    return found.groupBy(*keys).agg(F.count("*").alias("_n"), F.bool_and(F.col("_up") & F.col("_known")).alias("_all")).where((F.col("_n") >= least) & F.col("_all")).select(*keys)


def share_between(rows: DataFrame, keys: list[str], of: Column, among: Column, low: float, high: float) -> DataFrame:
    """Keys where the share of `of` among the rows that are `among` lies in [low, high]; keys without such rows are left out."""
    share = rows.where(among).groupBy(*keys).agg(F.avg(F.coalesce(of, F.lit(False)).cast("int")).alias("share"))
    return share.where(F.col("share").between(low, high))


def richness(rows: DataFrame, keys: list[str], marked: Column, noted: Column, dynamic: Column, least: float = 0.01) -> DataFrame:
    """For each key whether marks reach a share of the notes and there is any dynamic at all."""
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    some = F.coalesce(F.bool_or(dynamic), F.lit(False))
    return rows.groupBy(*keys).agg(((count(marked) / F.greatest(F.lit(1), count(noted)) >= least) & some).alias("rich"))


def lookup(rows: DataFrame, groups: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """Rows with the value of their key in a small table, or the default. Spark broadcasts the table where its size is known to allow it."""
    return rows.join(groups.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def end_slopes(rows: DataFrame, keys: list[str], order: list[str], x: str, y: str, points: int = 8) -> DataFrame:
    """Least-squares slope of y over x of each key's first and last points: what a series is carried on with beyond its ends."""
    up = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    down = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    ends = rows.withColumn("_up", up).withColumn("_down", down).where((F.col("_up") <= points) | (F.col("_down") <= points))
    slope = lambda where: F.regr_slope(F.when(where, F.col(y)), F.when(where, F.col(x)))
    return ends.groupBy(*keys).agg(slope(F.col("_up") <= points).alias("head"), slope(F.col("_down") <= points).alias("tail"))


def evaluation_windows(lengths: DataFrame, length: str, window: int) -> DataFrame:
    """A row for each whole window of a song, side by side from its start; a song shorter than a window has none."""
    starts = F.sequence(F.lit(0), F.col(length) - window, F.lit(window))
    return lengths.where(F.col(length) >= window).withColumn("start", F.explode(starts)).withColumn("stop", F.col("start") + window)
