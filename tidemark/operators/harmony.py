"""Spelling of notes and chords by key, chord placement in measures, beat grids, melody marks.

Notes stand on the line of fifths: F -1, C 0, G 1, ... ; a sharp is seven steps up. A pitch class names every twelfth
place of that line, a key of k sharps (flats below 0) owns the seven places from k - 1, and both letter and accidental
follow from the place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import drop_repeats
from .temporal import asof_join, band_join

# Letters in order of fifths from F, and pitch classes of white keys.
FIFTHS = "FCGDAEB"
WHITE = (0, 2, 4, 5, 7, 9, 11)
NO_CHORD = "N.C."


def _alter(place: Column) -> Column:
    return F.floor((place + 1) / 7).cast("int")


def _own(place: Column, key: Column) -> Column:
    return place.between(key - 1, key + 5)


def place_of(pitch_class: Column, key: Column, preferred: Column | None = None) -> Column:
    """The place on the line of fifths by which a key spells a pitch class.

    The key's own spelling; else the preferred accidental where it may be used; else the place nearest to the middle of
    the key, sharps first. No double accidentals, and white keys get accidentals only where the key has them.
    """
    r = F.pmod(pitch_class * 7, F.lit(12)).cast("int")
    may = F.filter(F.array(r - 12, r, r + 12), lambda p: p.between(-8, 12) & ((_alter(p) == 0) | ~pitch_class.isin(*WHITE) | _own(p, key)))
    own = F.get(F.filter(may, lambda p: _own(p, key)), F.lit(0))
    near = F.array_min(F.transform(may, lambda p: F.struct(F.abs(p - key - 2).alias("d"), (-_alter(p)).alias("s"), p.alias("p"))))["p"]
    if preferred is None:
        return F.coalesce(own, near)
    return F.coalesce(own, F.get(F.filter(may, lambda p: _alter(p) == preferred), F.lit(0)), near)


def note_name(place: Column) -> Column:
    letter = F.substring(F.lit(FIFTHS), (F.pmod(place + 1, F.lit(7)) + 1).cast("int"), F.lit(1))
    return F.concat(letter, F.element_at(F.array(F.lit("b"), F.lit(""), F.lit("#")), _alter(place) + 2))


def _spelt(name: Column, key: Column) -> Column:
    """A note name spelt anew by the key; null where it is none."""
    alter = F.length(name) - F.length(F.replace(name, F.lit("#"))) - (F.length(name) - F.length(F.replace(name, F.lit("b"))))
    place = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(FIFTHS) for x in (c, i - 1)]), F.substring(name, 1, 1)) + 7 * alter
    pitch_class = F.pmod(place * 7, F.lit(12))
    return F.when(name.rlike("^[A-G][#b]*$"), note_name(place_of(pitch_class, key, alter)))


def chord_symbol(text: Column, key: Column) -> Column:
    """`A:m7/E` as a chord symbol of the key: `Am7/E`. `N` is N.C.; what can't be read is null."""
    main, bass = F.split_part(text, F.lit("/"), F.lit(1)), F.split_part(text, F.lit("/"), F.lit(2))
    quality = F.split_part(main, F.lit(":"), F.lit(2))
    symbol = F.concat(_spelt(F.split_part(main, F.lit(":"), F.lit(1)), key), F.when(quality == "maj", "").otherwise(quality))
    return F.when(text == "N", NO_CHORD).when(bass == "", symbol).otherwise(F.concat(symbol, F.lit("/"), _spelt(bass, key)))


def place_chords(chords: DataFrame, measures: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, position, symbol): chords at the nearest eighth of their measure.

    chords: keys, t, text. measures: keys, measure (0, 1, ...), start, length in quarters, key. Chords before the first
    measure stand at its head; the last of one place counts; repeats, and N.C. before any chord, are left out.
    """
    w = Window.partitionBy(*keys).orderBy("measure")
    m = measures.withColumn("span", F.lead("start").over(w) - F.col("start"))
    pace = F.median(F.col("span") / F.col("length")).over(Window.partitionBy(*keys))
    m = m.withColumn("span", F.coalesce("span", F.col("length") * pace, F.col("length"))).withColumn("next_key", F.lead("key").over(w))
    held = ["measure", "start", "length", "span", "key", "next_key"]
    at = asof_join(chords.select(*keys, "t", "text"), m.select(*keys, F.col("start").alias("t"), *held), keys, "t", held, strict=False)
    head = m.where("measure = 0").select(*keys, F.struct(*held).alias("head"))
    at = at.join(head, keys)
    of = lambda c: F.coalesce(f"{c}_asof", f"head.{c}")
    share = F.when(F.col("measure_asof").isNull(), 0.0).otherwise((F.col("t") - F.col("start_asof")) / F.col("span_asof"))
    at = at.select(*keys, "t", "text", of("measure").alias("measure"), of("length").alias("length"), of("key").alias("key"), F.col("next_key_asof").alias("next_key"), (F.rint(share * of("length") * 2) / 2).alias("position"))
    over = F.col("position") >= F.col("length")
    at = at.where(~over | F.col("next_key").isNotNull()).select(
        *keys, "t", (F.col("measure") + over.cast("int")).alias("measure"), F.when(over, 0.0).otherwise(F.col("position")).alias("position"), chord_symbol(F.col("text"), F.when(over, F.col("next_key")).otherwise(F.col("key"))).alias("symbol"), "text"
    )
    one = at.groupBy(*keys, "measure", "position").agg(F.max_by("symbol", F.struct("t", "text")).alias("symbol")).where("symbol is not null")
    once = drop_repeats(one, keys, ["measure", "position"], "symbol")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("measure", "position"))
    return once.withColumn("__n", first).where(~((F.col("__n") == 1) & (F.col("symbol") == NO_CHORD))).drop("__n")


def extend_beats(beats: DataFrame, spans: DataFrame, keys: list[str], t: str) -> DataFrame:
    """(keys, t, given): beats carried on in the step of each end until they cover [first, last] of spans, and one more.

    Keys with fewer than four beats give no row; equal beats count once.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    b = beats.select(*keys, t).distinct().withColumns({"__n": F.row_number().over(w), "__all": F.count("*").over(Window.partitionBy(*keys))}).where("__all >= 4")
    ends = b.groupBy(*keys).agg(
        F.min(t).alias("a"), F.min(F.when(F.col("__n") == 2, F.col(t))).alias("a2"), F.max(t).alias("z"), F.max(F.when(F.col("__n") == F.col("__all") - 1, F.col(t))).alias("z2")
    ).join(spans.select(*keys, "first", "last"), keys)
    before, after = F.col("a2") - F.col("a"), F.col("z") - F.col("z2")
    front = F.greatest(F.lit(0), F.ceil((F.col("a") - F.col("first")) / before) + 1).cast("int")
    back = F.greatest(F.lit(0), F.ceil((F.col("last") - F.col("z")) / after) + 1).cast("int")
    steps = lambda n: F.filter(F.sequence(F.lit(0), n), lambda i: i > 0)
    more = F.concat(F.transform(steps(front), lambda i: F.col("a") - before * i), F.transform(steps(back), lambda i: F.col("z") + after * i))
    return b.select(*keys, t, F.lit(True).alias("given")).unionByName(ends.select(*keys, F.explode(more).alias(t), F.lit(False).alias("given")))


def mark_melody(notes: DataFrame, melody: DataFrame, keys: list[str], t: str, tolerance: int, id_col: str) -> DataFrame:
    """notes with `melody`: true for the highest note of a melody note's pitch class within the tolerance, nearest first in a tie.

    notes: keys, t, pitch, id. melody: keys, t, pitch.
    """
    pitch_class = F.pmod("pitch", F.lit(12))
    tune = melody.select(*keys, t, pitch_class.alias("__class")).distinct()
    found = band_join(tune, notes.select(*keys, t, pitch_class.alias("__class"), "pitch", F.col(id_col).alias("__id")).withColumnRenamed("__class", "__other"), keys, t, tolerance, ["__other", "pitch", "__id"])
    found = found.where("__class = __other")
    best = F.max_by("__id", F.struct("pitch", (-F.abs(F.col(t) - F.col("t_band"))).alias("near"), (-F.col("__id")).alias("first")))
    marked = found.groupBy(*keys, t, "__class").agg(best.alias(id_col)).select(id_col).distinct().withColumn("melody", F.lit(True))
    return notes.join(marked, id_col, "left").withColumn("melody", F.coalesce("melody", F.lit(False)))
