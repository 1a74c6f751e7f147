"""Global order without a global task: ranks, running values and neighbours in two steps.

Rows are dealt to range partitions of a total order and kept there. Within a
partition one window does the work; what crosses from one partition to the next
is a row for each partition (and key). So a key that holds a third of all rows
is worked on by many tasks.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where none is named, a temporary one on a local master, as in tests; elsewhere that is an error, as executors
    wouldn't see the driver's folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder under shared_dir(), wherever that lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def steady(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions for every reader, from a reliable checkpoint."""
    folder = shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def split(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows in range partitions of this order, numbered by `__part`; rows equal in it are in one partition."""
    return steady(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))


def _same(a: str, b: str, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def running_in(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, how: Callable[[Column], Column] = F.sum) -> DataFrame:
    """Adds the running sum (or how=F.max, F.min) of `value` within each key, the row itself included. Null where there was no value yet."""
    parts = split(df.withColumn(name, value), [*keys, *order])
    sums = parts.groupBy(*keys, "__part").agg(how(F.col(name)).alias("__sum"))  # a row per partition and key in it
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", how(F.col("__sum")).over(before)).drop("__sum")
    own = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = parts.withColumn("__own", how(F.col(name)).over(own)).alias("a").join(sums.alias("b"), (F.col("a.__part") == F.col("b.__part")) & _same("a", "b", keys))
    joined = F.coalesce(how_of_two(how)(F.col("a.__own"), F.col("b.__before")), F.col("a.__own"), F.col("b.__before"))
    return both.select(*[F.col(f"a.{c}") for c in parts.columns if c not in ("__part", name)], joined.alias(name))


def how_of_two(how: Callable) -> Callable[[Column, Column], Column]:
    """What joins two partial results of an aggregate."""
    return {F.max: F.greatest, F.min: F.least}.get(how, lambda a, b: a + b)


def running(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the running sum of `value` in a total order over all rows."""
    return running_in(df, [], order, value, name)


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Adds 1, 2, 3, ... in a total order."""
    return running(df, order, F.lit(1).cast("long"), name)


def rank_in(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds 1, 2, 3, ... within each key."""
    return running_in(df, keys, order, F.lit(1).cast("long"), name)


def neighbour(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], ahead: bool = False) -> DataFrame:
    """Adds columns of the row before (or, if ahead, after) within each key, by their new names; null at the end."""
    parts = split(df, [*keys, *order])
    held = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    key = F.struct(F.lit(1).alias("one"), *keys)
    place = F.struct(*keys, *order) if keys or order else F.lit(0)
    edge = F.min_by if ahead else F.max_by
    ends = parts.groupBy("__part").agg(edge(F.struct(key.alias("key"), held.alias("held")), place).alias("__end"))
    line = Window.orderBy(F.desc("__part") if ahead else F.asc("__part"))
    ends = ends.select("__part", F.lag("__end").over(line).alias("__end"))  # a row per partition
    ways = [F.col(c).desc_nulls_last() if ahead else F.col(c).asc_nulls_first() for c in [*keys, *order]]
    own = Window.partitionBy("__part").orderBy(*ways)
    near = parts.withColumn("__near", F.lag(F.struct(key.alias("key"), held.alias("held"))).over(own)).join(F.broadcast(ends), "__part")
    near = near.withColumn("__near", F.coalesce("__near", "__end"))
    hit = F.col("__near.key").eqNullSafe(key)
    return near.select(*df.columns, *[F.when(hit, F.col(f"__near.held.c{i}")).alias(name) for i, name in enumerate(columns.values())])
