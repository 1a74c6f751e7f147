"""Beats of two performances of one piece: on which level they beat, and grids brought to another level."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import majority

#: How many source beats a beat may be, and how far off in logarithm; UNKNOWN is the level of none of them.
LEVELS, TOLERANCE, UNKNOWN = (0.5, 1.0, 2.0), math.log(1.15), 3


def align_levels(beats: DataFrame, keys: list[str], t: str, mapped: str, usable: str, reach: int = 4) -> DataFrame:
    """beats with `level`, the index in LEVELS of how many source beats it is to the next beat, or UNKNOWN.

    `mapped` is the beat's place in source beats. Steps are smoothed by the median over `reach` on either side (fewer
    at the ends), compared with the levels in logarithm, unknown where either beat isn't usable, and then settled by
    the majority of as many neighbours, the lowest level in a tie. The last beat has the level of the step before. A
    series of fewer than four beats is unknown.
    """
    line = Window.partitionBy(*keys).orderBy(t)
    near = line.rowsBetween(-reach, reach)
    r = beats.withColumn("__step", F.lead(mapped).over(line) - F.col(mapped)).withColumn("__ok", F.col(usable) & F.lead(usable).over(line))
    r = r.withColumn("__near", F.array_sort(F.collect_list("__step").over(near))).withColumn("__all", F.count("*").over(Window.partitionBy(*keys)))
    n = F.size("__near")
    median = (F.get("__near", F.floor((n - 1) / 2).cast("int")) + F.get("__near", F.floor(n / 2).cast("int"))) / 2
    at = F.ln(F.greatest(median, F.lit(1e-6)))
    best = F.array_min(F.array(*[F.struct(F.abs(at - math.log(v)).alias("far"), F.lit(i).alias("level")) for i, v in enumerate(LEVELS)]))
    level = F.when(F.col("__step").isNull(), None).when(F.col("__ok") & (best["far"] <= TOLERANCE), best["level"]).otherwise(UNKNOWN)
    r = majority(r.withColumn("__level", level), keys, [t], "__level", [*range(len(LEVELS)), UNKNOWN], reach, "__level2")
    r = r.withColumn("level", F.when(F.col("__step").isNotNull(), F.col("__level2")).otherwise(F.lag("__level2").over(line)))
    r = r.withColumn("level", F.when(F.col("__all") < 4, UNKNOWN).otherwise(F.col("level")))
    return r.select(*beats.columns, "level")


def relevel(beats: DataFrame, keys: list[str], t: str, mapped: str, level: str) -> DataFrame:
    """(keys, t, level, added): beats brought to the source's level.

    In a run of half beats every other one stays: the half that lies nearer to whole source beats on average, the
    one with the first beat in a tie. After each double beat comes one midway to the next. The last beat stays.
    """
    line = Window.partitionBy(*keys).orderBy(t)
    r = beats.select(*keys, t, mapped, level).withColumns({"__n": F.row_number().over(line), "__next": F.lead(t).over(line)})
    half = (F.col(level) == 0) & F.col("__next").isNotNull()
    runs = r.where(half).withColumn("__run", F.col("__n") - F.row_number().over(Window.partitionBy(*keys).orderBy("__n")))
    runs = runs.withColumn("__side", F.pmod(F.row_number().over(Window.partitionBy(*keys, "__run").orderBy("__n")) - 1, F.lit(2)))
    off = runs.groupBy(*keys, "__run", "__side").agg(F.avg(F.abs(F.col(mapped) - F.rint(mapped))).alias("__off"))
    side = off.groupBy(*keys, "__run").agg(F.min(F.struct("__off", "__side"))["__side"].alias("__side"))
    thinned = runs.join(side, [*keys, "__run", "__side"]).select(*keys, t, level, F.lit(False).alias("added"))
    others = r.where(~half)
    between = others.where((F.col(level) == 2) & F.col("__next").isNotNull()).select(*keys, ((F.col(t) + F.col("__next")) / 2).alias(t), level, F.lit(True).alias("added"))
    whole = thinned.unionByName(others.select(*keys, t, level, F.lit(False).alias("added")))
    return whole.withColumn(t, F.col(t).cast("double")).unionByName(between)


def level_grid(beats: DataFrame, keys: list[str], t: str, measure: str, level: float) -> DataFrame:
    """(keys, t) of the grid with `level` beats for each: 2 or 3 divide every step, 0.5 keeps every other beat of a measure.

    A half grid needs an even number of beats in every measure; a key where one has an odd number gets no rows.
    """
    line = Window.partitionBy(*keys).orderBy(t)
    if level >= 1:
        n = int(level)
        r = beats.select(*keys, F.col(t).cast("double").alias(t)).withColumn("__next", F.lead(t).over(line))
        r = r.withColumn("__k", F.explode(F.sequence(F.lit(0), F.when(F.col("__next").isNull(), 0).otherwise(n - 1))))
        return r.select(*keys, F.when(F.col("__k") == 0, F.col(t)).otherwise(F.col(t) + (F.col("__next") - F.col(t)) * F.col("__k") / n).alias(t))
    bar = beats.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, measure).orderBy(t)) - 1)
    odd = bar.groupBy(*keys, measure).agg(F.count("*").alias("__c")).where("pmod(__c, 2) = 1").select(*keys).distinct()
    return bar.where("pmod(__n, 2) = 0").join(odd, keys, "left_anti").select(*keys, F.col(t).cast("double").alias(t))
