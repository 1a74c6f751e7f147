"""Sampling whose draws come from hashes: rerun, they are the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running, running_in


def unit_hash(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) from the columns and a seed."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("long") / 4294967296.0


def damped_weights(rows: DataFrame, length: str, group: str, full: float, power: float, scales: dict[str, float] | None = None) -> DataFrame:
    """length * (max(T, full) / full) ** (power - 1), T being the group's total; an unknown group isn't damped."""
    total = rows.groupBy(group).agg(F.sum(length).alias("__total"))
    damp = F.when(F.col(group).isNull(), 1.0).otherwise(F.pow(F.greatest(F.col("__total"), F.lit(full)) / full, power - 1.0))
    out = rows.join(total, group, "left").withColumn("weight", F.col(length) * F.coalesce(damp, F.lit(1.0))).drop("__total")
    for g, s in (scales or {}).items():
        out = out.withColumn("weight", F.when(F.col(group) == g, F.col("weight") * s).otherwise(F.col("weight")))
    return out


def weighted_sample(rows: DataFrame, weight: str, order: list[str], n: int, seed: int) -> DataFrame:
    """n draws by weight, with `draws` for each row drawn: systematic, so counts are within one of n * share."""
    total = rows.agg(F.sum(weight).alias("__all"))
    cum = running(rows.where(F.col(weight) > 0), order, F.col(weight), "__upto").join(F.broadcast(total))
    shift = unit_hash(seed, F.lit("start"))
    at = lambda c: F.floor(n * c / F.col("__all") + shift)
    out = cum.withColumn("draws", (at(F.col("__upto")) - at(F.col("__upto") - F.col(weight))).cast("long"))
    return out.where("draws > 0").drop("__upto", "__all")


def top_p(rows: DataFrame, keys: list[str], weight: str, tie: list[str], p: float) -> DataFrame:
    """Rows kept while the share of those before them is at most p, largest first; the largest always stays."""
    total = rows.groupBy(*keys).agg(F.sum(weight).alias("__all"))
    upto = running_in(rows.withColumn("__down", -F.col(weight)), keys, ["__down", *tie], F.col(weight), "__upto").drop("__down")
    return upto.join(total, keys).where((F.col("__upto") - F.col(weight)) / F.col("__all") <= p).drop("__upto", "__all")


def window_starts(rows: DataFrame, id_col: str, length: str, size: int, seed: int) -> DataFrame:
    """A seeded start for a window of `size` in each row's length."""
    return rows.withColumn("start", F.floor(unit_hash(seed, F.col(id_col)) * F.greatest(F.col(length) - size + 1, F.lit(1))).cast("long"))


def permutation(rows: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Rows with a sort key of a seeded random order."""
    return rows.withColumn("shuffle_key", F.xxhash64(F.lit(seed), F.col(id_col)))


def drop_columns(rows: DataFrame, id_col: str, columns: list[str], p: float, seed: int) -> DataFrame:
    """Nulls all the columns of a row with probability p, and else each of them with p / 2."""
    whole = unit_hash(seed, F.col(id_col)) < p
    return rows.withColumns({c: F.when(~whole & (unit_hash(seed, F.col(id_col), F.lit(c)) >= p / 2), F.col(c)) for c in columns})


def mix_ratio(rows: DataFrame, source: str, weight: str, shares: dict[str, float]) -> DataFrame:
    """Weights scaled so that each source's sum is its share."""
    total = rows.groupBy(source).agg(F.sum(weight).alias("__t"))
    share = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
    return rows.join(total, source).withColumn(weight, F.col(weight) * F.coalesce(share[F.col(source)], F.lit(0.0)) / F.col("__t")).drop("__t")
