"""Joins and merges over time-ordered tables.

All are built from equi-joins, unions and windows keyed by `keys`, so each
shuffles once by key and no range predicate ever meets a whole key group in a
nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(probe: DataFrame, state: DataFrame, keys: list[str], t: str, values: list[str], strict: bool = True, forward: bool = False) -> DataFrame:
    """probe with the values of the last state row before it (at it too, unless strict); the next one if forward.

    One union and one window: at equal times, the order of the two sides decides.
    """
    first = (0 if strict else 1) if not forward else (0 if not strict else 1)
    held = F.struct(*[F.col(v) for v in values], F.col(t).alias("__t"))
    state = state.where(F.col(t).isNotNull()).select(*keys, F.col(t).alias("__at"), held.alias("__held"), F.lit(1 - first).alias("__side"), F.lit(None).alias("__row"))
    rows = probe.select(*keys, F.col(t).alias("__at"), F.lit(None).cast(state.schema["__held"].dataType).alias("__held"), F.lit(first).alias("__side"), F.struct("*").alias("__row"))
    state = state.withColumn("__row", F.lit(None).cast(rows.schema["__row"].dataType))
    both = rows.unionByName(state)
    # both ways the frame begins at the partition's edge, so that a row costs the same however many there are
    w = Window.partitionBy(*keys).orderBy(*([F.desc("__at"), F.desc("__side")] if forward else ["__at", "__side"]))
    found = F.last("__held", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1 if forward else 0))
    out = both.withColumn("__found", found).where("__row is not null")
    return out.select("__row.*", *[F.col(f"__found.{v}").alias(f"{v}_asof") for v in values], F.col("__found.__t").alias("t_asof"))


def nearest_join(probe: DataFrame, target: DataFrame, keys: list[str], t: str, values: list[str]) -> DataFrame:
    """probe with the values of the target row nearest in time; the earlier one in a tie."""
    back = asof_join(probe, target, keys, t, values, strict=False)
    back = back.withColumnsRenamed({f"{v}_asof": f"{v}_back" for v in values} | {"t_asof": "t_back"})
    both = asof_join(back, target, keys, t, values, strict=True, forward=True)
    later = F.col("t_back").isNull() | (F.col("t_asof") - F.col(t) < F.col(t) - F.col("t_back"))
    pick = lambda v: F.when(later & F.col("t_asof").isNotNull(), F.col(f"{v}_asof")).otherwise(F.col(f"{v}_back"))
    out = both.select(*probe.columns, *[pick(v).alias(f"{v}_near") for v in values], pick("t").alias("t_near"))
    return out.withColumn("distance", F.abs(F.col("t_near") - F.col(t)))


def interp_join(probe: DataFrame, knots: DataFrame, keys: list[str], x: str, y: str, extrapolate: bool = False, max_gap: float | None = None) -> DataFrame:
    """probe with y interpolated at x between knots: held at the ends, or carried on by the end slopes.

    Null where the two knots lie more than max_gap apart. Of knots equal in x the last by y counts.
    """
    one = knots.groupBy(*keys, x).agg(F.max(y).alias(y))
    w = Window.partitionBy(*keys).orderBy(x)
    nx, ny = F.lead(x).over(w), F.lead(y).over(w)
    px, py = F.lag(x).over(w), F.lag(y).over(w)
    inner = (ny - F.col(y)) / (nx - F.col(x))
    slope = F.when(nx.isNotNull(), inner).otherwise((F.col(y) - py) / (F.col(x) - px) if extrapolate else F.lit(0.0))
    gap = nx - F.col(x)
    one = one.withColumns({"kx": F.col(x), "ky": F.col(y), "ks": F.coalesce(slope, F.lit(0.0)), "kg": gap})
    head = one.groupBy(*keys).agg(F.min_by(F.struct("kx", "ky", "ks"), x).alias("head"))
    out = asof_join(probe, one.select(*keys, x, "kx", "ky", "ks", "kg"), keys, x, ["kx", "ky", "ks", "kg"], strict=False).join(head, keys, "left")
    early = F.col("head.ky") + ((F.col(x) - F.col("head.kx")) * F.col("head.ks") if extrapolate else F.lit(0.0))
    at = F.when(F.col("kx_asof").isNull(), early).otherwise(F.col("ky_asof") + (F.col(x) - F.col("kx_asof")) * F.col("ks_asof"))
    if max_gap is not None:
        at = F.when(F.coalesce(F.col("kg_asof") > max_gap, F.lit(False)) & (F.col(x) > F.col("kx_asof")), None).otherwise(at)
    return out.select(*probe.columns, at.alias(f"{y}_at"))


def band_join(probe: DataFrame, target: DataFrame, keys: list[str], t: str, tolerance: int, columns: list[str]) -> DataFrame:
    """Pairs of equal keys within the tolerance, both ends counting; probes without a pair keep one row of nulls.

    Times fall into cells as wide as the tolerance; each target is in three cells, each probe in one, so the
    join is on equality.
    """
    cell = lambda c: F.floor(c / (tolerance or 1)).cast("long")
    right = target.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(t).alias("t_band"), *columns)
    right = right.withColumn("__cell", F.explode(F.sequence(cell(F.col("t_band")) - 1, cell(F.col("t_band")) + 1)))
    left = probe.withColumn("__own", cell(F.col(t)))
    on = (F.col("__own") == F.col("__cell")) & (F.abs(F.col(t) - F.col("t_band")) <= tolerance)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return left.join(right, on, "left").drop("__own", "__cell", *[f"__{k}" for k in keys])


def containing(probe: DataFrame, spans: DataFrame, keys: list[str], t: str, start: str, end: str) -> DataFrame:
    """probe with the span [start, end) that holds it, of spans without overlap; null if none does."""
    found = asof_join(probe, spans.select(*keys, F.col(start).alias(t), F.col(end).alias("__end")), keys, t, ["__end"], strict=False)
    inside = F.col(t) < F.col("__end_asof")
    return found.select(*probe.columns, F.when(inside, F.col("t_asof")).alias(start), F.when(inside, F.col("__end_asof")).alias(end))


def merge_intervals(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Overlapping intervals united; those that only touch stay apart."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) >= reach), 1).otherwise(0)
    return (
        spans.withColumn("__new", new)
        .withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")
    )


def toggle_intervals(changes: DataFrame, keys: list[str], t: str, on: str, end: Column, tie: list[str] = ()) -> DataFrame:
    """(keys, start, stop): from each switch on to the next switch off; repeats don't count; open ones close at `end`."""
    w = Window.partitionBy(*keys).orderBy(t, *tie)
    flips = changes.withColumn("__was", F.lag(on).over(w)).where(F.coalesce(F.col("__was") != F.col(on), F.col(on)))
    closed = flips.withColumn("stop", F.coalesce(F.lead(t).over(w), end))
    return closed.where(on).select(*keys, F.col(t).alias("start"), "stop")


def clip_to_next(rows: DataFrame, keys: list[str], onset: str, duration: str, tie: list[str] = ()) -> DataFrame:
    """Durations end where the next row of the same keys begins, and stay at 1 at least."""
    nxt = F.lead(onset).over(Window.partitionBy(*keys).orderBy(onset, *tie))
    over = F.col(onset) + F.col(duration) > nxt
    return rows.withColumn(duration, F.when(over, F.greatest(F.lit(1), nxt - F.col(onset))).otherwise(F.col(duration)))


def runs(rows: DataFrame, keys: list[str], order: list[str], flag: str, at_least: int = 1) -> DataFrame:
    """(keys, first, last, length): runs of true flags, by position."""
    w = Window.partitionBy(*keys).orderBy(*order)
    n = rows.withColumn("__n", F.row_number().over(w) - 1)
    island = F.col("__n") - F.row_number().over(Window.partitionBy(*keys).orderBy("__n"))
    return (
        n.where(flag).withColumn("__island", island).groupBy(*keys, "__island")
        .agg(F.min("__n").alias("first"), F.max("__n").alias("last"), F.count("*").alias("length"))
        .where(F.col("length") >= at_least).drop("__island")
    )


def sessions(rows: DataFrame, keys: list[str], t: str, gap: int, tie: list[str] = ()) -> DataFrame:
    """(keys, session, start, stop, n): rows with no pause longer than the gap."""
    w = Window.partitionBy(*keys).orderBy(t, *tie)
    new = F.coalesce((F.col(t) - F.lag(t).over(w) > gap).cast("int"), F.lit(0))
    return (
        rows.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "session").agg(F.min(t).alias("start"), F.max(t).alias("stop"), F.count("*").alias("n"))
    )


def lag_search(probe: DataFrame, target: DataFrame, keys: list[str], t: str, low: int, high: int, tolerance: int = 0) -> DataFrame:
    """(keys, lag, hits): how many probes have a target within tolerance of t + lag, for every lag from low to high.

    Probes, not pairs, are counted; lags without a hit are there with 0.
    """
    p = probe.select(*keys, F.col(t).alias("__p")).distinct()
    q = target.select(*keys, F.col(t).alias("__q")).distinct()
    reach = max(abs(low), abs(high)) + tolerance
    pairs = band_join(p.withColumnRenamed("__p", "__t"), q.withColumnRenamed("__q", "__t"), keys, "__t", max(reach, 1), []).where("t_band is not null")
    d = F.col("t_band") - F.col("__t")
    lags = F.filter(F.sequence(d - tolerance, d + tolerance), lambda x: x.between(low, high))
    hits = pairs.select(*keys, "__t", F.explode(lags).alias("lag")).distinct().groupBy(*keys, "lag").agg(F.count("*").alias("hits"))
    spine = p.select(*keys).distinct().withColumn("lag", F.explode(F.sequence(F.lit(low), F.lit(high)).cast("array<bigint>")))
    return spine.join(hits, [*keys, "lag"], "left").fillna(0, ["hits"])


def best_by(rows: DataFrame, keys: list[str], score: str, tie: list[Column], columns: list[str]) -> DataFrame:
    """The row of largest score for each key; ties by the given order."""
    best = F.min_by(F.struct(*columns, score), F.struct((-F.col(score)).alias("s"), *[c.alias(f"t{i}") for i, c in enumerate(tie)]))
    return rows.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*")
