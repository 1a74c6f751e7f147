"""Mixing sources to target weights by capped water-filling.

Shares are poured out in proportion to weight; a source never gets more than
``max_epochs`` times its size, and what it cannot take flows on to the rest. The
level at which this settles is found by sorting sources by cap per weight.

A source's target over its size is its number of epochs: the whole part repeats
every document, the fraction takes the documents that come first in a seeded
hash order until their words fill it. The hash order is summed in two steps,
slices first and then only the slice where the fraction ends, so a source that
holds a third of all rows is never ordered in one task.

Defined cases: null text has size 0; a null source is a source, last in order; a
source of size 0 has target 0; rows equal in id share a decision; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import WORD, cut

#: Slices of the hash order of each source.
SLICES = 4096


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("key"),
    )


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target): a row for each source.

    Windows here run over sources, of which there are few: one row each.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    src = src.withColumn("weight", F.get(w, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    src = src.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    everything = Window.partitionBy()
    src = src.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    src = src.withColumn("all_weight", F.sum("weight").over(everything))
    fill = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    src = src.withColumn(
        "level",
        (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    # the first source, by cap per weight, that the level leaves below its cap sets the level for all after it
    src = src.withColumn("settled", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(everything))
    poured = F.least(F.col("cap"), F.col("settled.level") * F.col("weight"))
    return src.select("source", "source_size", F.coalesce(poured, F.col("cap")).alias("target"))


def decisions(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target, whole, upto): documents are taken `whole` times, and once more where key < upto."""
    goal = targets(sizes, weights, share, max_epochs)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = cut(goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    piece = F.floor(F.conv(F.substring("key", 1, 6), 16, 10).cast("long") * SLICES / F.lit(1 << 24)).cast("long")
    cells = sizes.withColumn("slice", piece).groupBy("source", "slice").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    a, b = cells.alias("a"), goal.alias("b")
    edge = (
        a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")))
        .where("before <= rest and rest < before + words")
        .select(F.col("a.source").alias("source"), "slice", "before", "rest")
    )
    edge = cut(edge)
    e, s = edge.alias("e"), sizes.withColumn("slice", piece).alias("s")
    inside = s.join(F.broadcast(e) if edge.count() <= 10_000 else e, F.col("s.source").eqNullSafe(F.col("e.source")) & (F.col("s.slice") == F.col("e.slice"))).select(
        "s.source", "s.slice", "key", "size", "before", "rest"
    )
    sums = inside.groupBy("source", "slice", "key", "before", "rest").agg(F.sum("size").alias("size"))
    upto = Window.partitionBy("source", "slice").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    # the document on the edge is taken if that comes nearer to the target
    sums = sums.withColumn("after", F.col("before") + F.sum("size").over(upto)).where(F.col("after") - F.col("size") / 2.0 > F.col("rest"))
    stop = sums.groupBy("source").agg(F.min("key").alias("stop_key"), F.lit(True).alias("known"))
    last = cells.join(edge.select(F.col("source").alias("es"), F.col("slice").alias("eslice")), F.col("source").eqNullSafe(F.col("es")) & (F.col("slice") == F.col("eslice")))
    g, k, n = goal.alias("g"), stop.alias("k"), last.select(F.col("es"), F.lpad(F.hex(((F.col("eslice") + 1) * F.lit((1 << 24) // SLICES))), 6, "0").alias("next_key")).alias("n")
    return (
        g.join(k, F.col("g.source").eqNullSafe(F.col("k.source")), "left")
        .join(n, F.col("g.source").eqNullSafe(F.col("n.es")), "left")
        .select("g.source", "source_size", "target", "whole", F.when(F.col("rest") > 0, F.lower(F.coalesce("stop_key", "next_key", F.lit("g")))).otherwise("").alias("upto"))
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 20240101, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies."""
    sizes = cut(_sizes(docs, id_col, text_col, source_col, seed))
    goal = cut(decisions(sizes, weights, share, max_epochs))
    s, g = sizes.alias("s"), (F.broadcast(goal) if goal.count() <= 10_000 else goal).alias("g")
    return s.join(g, F.col("s.source").eqNullSafe(F.col("g.source"))).select(
        "doc_id", "s.source", "size", "source_size", "target",
        (F.col("whole") + (F.col("key") < F.col("upto")).cast("long")).alias("copies"),
    )


def mixed_documents(docs: DataFrame, seed: int = 20240101, **how) -> DataFrame:
    """The documents themselves, each repeated as often as the mix takes it; same columns."""
    sizes = cut(_sizes(docs, "doc_id", "text", "source", seed))
    goal = cut(decisions(sizes, how.get("weights", (5, 2, 1)), how.get("share", 1.5), how.get("max_epochs", 2.0)))
    goal = (F.broadcast(goal) if goal.count() <= 10_000 else goal).alias("g")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("source"), key.alias("key")).alias("d")
    copies = (F.col("whole") + (F.col("key") < F.col("upto")).cast("long")).cast("int")
    taken = rows.join(goal, F.col("d.source").eqNullSafe(F.col("g.source"))).select("row", F.explode(F.array_repeat(F.lit(0), copies)))
    return taken.select("row.*")
