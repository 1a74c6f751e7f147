"""Views of a song's source: rows of notes, beats, chords and keys in one table, and what is replaced, added or perturbed in them.

rows: keys, onset, type (NOTE, BEAT, CHORD, KEY) and four attributes: of a note pitch, duration, velocity and
instrument; of a beat whether it begins a bar; of a chord root, quality and bass; of a key tonic and whether it is minor.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import snap_to_metronome
from .ranks import running_in
from .sampling import unit_hash

# Types of rows; instruments from SUNG on are annotated melodies; no root and no bass; drums.
NOTE, BEAT, CHORD, KEY = range(4)
SUNG, DRUMS, NONE = 37, 36, 12


def is_annotated(kind: Column, instrument: Column) -> Column:
    """A note of an annotated melody, not of the source itself."""
    return (kind == NOTE) & (instrument >= SUNG)


def is_own(kind: Column, instrument: Column) -> Column:
    """A note of the source itself."""
    return (kind == NOTE) & (instrument < SUNG)


def with_annotation(rows: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the beats of `extra` in place of their own where it has beats, and its notes beside theirs."""
    has = extra.where(F.col("type") == BEAT).select(*keys).distinct()
    own = rows.where(F.col("type") == BEAT).join(has, keys, "left_anti")
    added = extra.where(F.col("type").isin(NOTE, BEAT)).select(*rows.columns)
    return rows.where(F.col("type") != BEAT).unionByName(own).unionByName(added)


def shifted(rows: DataFrame, by: int) -> DataFrame:
    """Notes other than drums moved by semitones, out of 0..127 left out; roots, basses and tonics moved round the octave, none staying none."""
    pitched = (F.col("type") == NOTE) & (F.col("d") != DRUMS)
    turn = lambda c, none: F.when(F.col(c) == none, F.col(c)).otherwise(F.pmod(F.col(c) + by, F.lit(12)))
    a = F.when(pitched, F.col("a") + by).when(F.col("type") == CHORD, turn("a", NONE)).when(F.col("type") == KEY, F.pmod(F.col("a") + by, F.lit(12))).otherwise(F.col("a"))
    c = F.when(F.col("type") == CHORD, turn("c", NONE)).otherwise(F.col("c"))
    return rows.where(~pitched | (F.col("a") + by).between(0, 127)).withColumns({"a": a, "c": c})


def from_first_note(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows from the first note on, which is at 0 then; the last chord and the last key before it begin with it. Songs without notes stay as they are."""
    lead = rows.where(F.col("type") == NOTE).groupBy(*keys).agg(F.min("onset").alias("__lead"))
    r = rows.join(lead, keys, "left")
    before = F.col("onset") < F.col("__lead")
    own = Window.partitionBy(*keys, "type").orderBy(F.desc("onset"), *[F.desc(c) for c in "abcd"])
    held = r.where(before & F.col("type").isin(CHORD, KEY)).withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n").withColumn("onset", F.col("__lead"))
    kept = r.where(F.coalesce(~before, F.lit(True))).unionByName(held)
    return kept.withColumn("onset", F.col("onset") - F.coalesce("__lead", F.lit(0))).select(*rows.columns)


def feature_index(kind: Column, values: dict[int, tuple[int, Column]]) -> Column:
    """One index for all types: by type, where its values begin and its value; null for other types."""
    out = F.lit(None).cast("long")
    for t, (offset, value) in values.items():
        out = F.when(kind == t, offset + value).otherwise(out)
    return out.cast("long")


def performance_rows(notes: DataFrame, pedals: DataFrame, keys: list[str], bins: int = 32, shortest: float = 0.02, longest: float = 8.0) -> DataFrame:
    """(keys, t, kind, pitch, length, velocity, melody): notes (kind 0) and pedals (1) as one table of features.

    notes: keys, start, stop, pitch, velocity, melody; pedals: keys, start, stop. Lengths are in `bins` steps of
    logarithm from `shortest` to `longest`, from 1 on, velocities in `bins` equal ones from 1 on; 0 where there is none.
    """
    span = F.greatest(F.lit(shortest), F.least(F.lit(longest), F.col("stop") - F.col("start")))
    length = (1 + F.least(F.lit(bins - 1), F.floor(F.ln(span / shortest) / math.log(longest / shortest) * bins))).cast("int")
    n = notes.select(*keys, F.col("start").alias("t"), F.lit(0).alias("kind"), F.col("pitch").cast("int").alias("pitch"), length.alias("length"), (1 + F.least(F.lit(bins - 1), F.floor(F.col("velocity") * bins / 128))).cast("int").alias("velocity"), F.col("melody").cast("int").alias("melody"))
    p = pedals.select(*keys, F.col("start").alias("t"), F.lit(1).alias("kind"), F.lit(0).alias("pitch"), length.alias("length"), F.lit(0).alias("velocity"), F.lit(0).alias("melody"))
    return n.unionByName(p)


def transfer(target: DataFrame, source: DataFrame, keys: list[str], blocks: list[str], lyrics: str = "lyric") -> DataFrame:
    """target with the rows of some kinds (`what`) taken from the source: `blocks` as they are, lyrics of all tracks on track 0.

    Kinds that the source lacks are gone from the target, too. Songs without a source stay as they are.
    """
    has = source.select(*keys).distinct().withColumn("__has", F.lit(True))
    own = target.join(has, keys, "left").where(F.col("__has").isNull() | ~F.col("what").isin(*blocks, lyrics)).drop("__has")
    taken = source.join(target.select(*keys).distinct(), keys, "left_semi").where(F.col("what").isin(*blocks, lyrics))
    return own.unionByName(taken.withColumn("track", F.when(F.col("what") == lyrics, F.lit(0)).otherwise(F.col("track"))).select(*target.columns))


def beat_map(beats: DataFrame, bars: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, beats, unit, qpm, meter): a measure for each bar and for the time before the first, with its tempo, and whether its meter is new.

    beats: keys and t; bars: keys, start, beats and unit. A measure's tempo is even and brings it to the next one's
    start; the last one's follows the beats in it, or the measure before. Before the first bar, time 0 to the first
    beat is filled with beats as far apart as the first two, and measures of the first bar's meter end where that
    bar begins, a shorter one first. Songs with fewer than two beats or without bars have no rows.
    """
    own = Window.partitionBy(*keys).orderBy("t")
    b = beats.select(*keys, F.col("t").cast("double").alias("t")).withColumn("__i", F.row_number().over(own) - 1)
    bar = bars.select(*keys, F.col("start").cast("double").alias("start"), "beats", "unit").withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("start")) - 1)
    first = bar.where("__k = 0").select(*keys, F.col("start").alias("s0"), F.greatest(F.lit(1), F.col("beats").cast("int")).alias("m0"), F.col("unit").alias("u0"))
    head = b.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by("t", "__i").alias("t0"), F.min_by("t", F.when(F.col("__i") > 0, F.col("__i"))).alias("t1"))
    song = head.where("n >= 2").join(first, keys).withColumn("gap", F.col("t1") - F.col("t0"))
    song = song.withColumn("fill", F.when(F.col("t0") > 1e-3, F.greatest(F.lit(1), F.rint(F.col("t0") / F.col("gap")).cast("int"))).otherwise(0))
    early = b.join(song.select(*keys, "s0"), keys).where(F.col("t") < F.col("s0") - 1e-6).groupBy(*keys).agg(F.count("*").alias("lead"))
    song = song.join(early, keys, "left").withColumn("pre", F.col("fill") + F.coalesce("lead", F.lit(0)).cast("int")).withColumn("short", F.pmod("pre", "m0"))
    # beats before the first bar: those that fill the time, then the song's own
    steps = song.where("fill > 0").select(*keys, F.explode(F.sequence(F.lit(0), F.col("fill") - 1)).alias("p"), "t0", "fill").select(*keys, "p", (F.col("t0") / F.col("fill") * F.col("p")).alias("t"))
    steps = steps.unionByName(b.join(song.select(*keys, "fill", "lead"), keys).where(F.col("__i") < F.coalesce("lead", F.lit(0))).select(*keys, (F.col("fill") + F.col("__i")).alias("p"), "t"))
    lead_in = song.select(*keys, "m0", "u0", "short", F.explode(F.filter(F.sequence(F.lit(0), F.greatest(F.col("pre"), F.lit(0))), lambda p: (p < F.col("pre")) & (((p == 0) & (F.col("short") > 0)) | (F.pmod(p - F.col("short"), F.col("m0")) == 0) & (p >= F.col("short"))))).alias("p"))
    lead_in = lead_in.join(steps, [*keys, "p"]).select(*keys, "t", F.when((F.col("p") == 0) & (F.col("short") > 0), F.col("short")).otherwise(F.col("m0")).alias("beats"), F.col("u0").alias("unit"), F.lit(False).alias("last"))
    nxt = F.lead("start").over(Window.partitionBy(*keys).orderBy("start"))
    spans = bar.join(song.select(*keys), keys).withColumn("end", nxt)
    inside = b.select(*keys, "t", F.lit(None).cast("long").alias("__k")).unionByName(spans.select(*keys, (F.col("start") - 1e-6).alias("t"), F.col("__k").cast("long").alias("__k")))
    inside = inside.withColumn("__at", F.last("__k", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("t", F.col("__k").isNull()).rowsBetween(Window.unboundedPreceding, 0)))
    counts = inside.where("__k is null").groupBy(*keys, F.col("__at").alias("__k")).agg(F.count("*").alias("c"), F.min("t").alias("low"), F.max("t").alias("high"))
    full = spans.join(counts, [*keys, "__k"], "left")
    count = F.when(F.col("end").isNull(), F.col("beats")).otherwise(F.coalesce("c", F.lit(0))).cast("int")
    mine = full.select(*keys, F.col("start").alias("t"), F.greatest(F.lit(1), count).alias("beats"), "unit", F.col("end").isNull().alias("last"), F.when(F.col("end").isNull() & (F.col("c") >= 2), (F.col("high") - F.col("low")) / (F.col("c") - 1)).alias("mean"))
    all_ = lead_in.withColumn("mean", F.lit(None).cast("double")).unionByName(mine)
    line = Window.partitionBy(*keys).orderBy("t")
    all_ = all_.withColumn("__n", F.row_number().over(line)).withColumn("t", F.when(F.col("__n") == 1, 0.0).otherwise(F.col("t")))
    by = Window.partitionBy(*keys).orderBy("__n")
    all_ = all_.withColumns({"__next": F.lead("t").over(by), "__was": F.lag("t").over(by), "__count": F.lag("beats").over(by), "__unit": F.lag("unit").over(by)}).join(song.select(*keys, "gap"), keys)
    length = F.when(F.col("__next").isNotNull(), (F.col("__next") - F.col("t")) / F.col("beats")).otherwise(F.coalesce("mean", (F.col("t") - F.col("__was")) / F.col("__count"), "gap"))
    new = F.col("__was").isNull() | (F.col("beats") != F.col("__count")) | (F.col("unit") != F.col("__unit"))
    return all_.select(*keys, "t", "beats", "unit", (4.0 / F.col("unit") * 60.0 / F.greatest(length, F.lit(1e-3))).alias("qpm"), new.alias("meter"))


def normal(seed: int, *cols: Column) -> Column:
    """A standard normal number from the columns and a seed."""
    u, v = unit_hash(seed, *cols, F.lit("u")), unit_hash(seed, *cols, F.lit("v"))
    return F.sqrt(-2.0 * F.ln(1.0 - u)) * F.cos(2.0 * math.pi * v)


def vary_tempo(times: DataFrame, keys: list[str], order: str, t: str, scale: float, jitter: float, seed: int) -> DataFrame:
    """times with `varied`: steps scaled, each multiplied by a seeded log-normal factor, and added up again from 0."""
    own = Window.partitionBy(*keys).orderBy(order)
    step = F.coalesce(F.col(t) - F.lag(t).over(own), F.lit(0.0)) * scale * F.exp(jitter * normal(seed, *[F.col(k) for k in keys], F.col(order)))
    return running_in(times.withColumn("__step", step), keys, [order], F.col("__step"), "varied").drop("__step")


def perturbed_context(events: DataFrame, songs: DataFrame, keys: list[str], patch: int, share: float, most: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(events, songs): a share of the songs have the events before a split moved, and loss only after it.

    songs: keys and `patches`, how many there are to learn from. The split is 2 to half of them, but 2 at least; before it
    events move by up to `most` either way, drawn once for a song, never below 0. The songs get `split` (null where
    nothing moved), `shift` and `loss`, whether each patch counts. Songs of fewer than four patches stay as they are.
    """
    key = [F.col(k) for k in keys]
    draw = lambda what: unit_hash(seed, *key, F.lit(what))
    moved = (F.col("patches") >= 4) & (draw("song") < share)
    half = F.greatest(F.lit(2), F.floor(F.col("patches") / 2))
    split = F.when(moved, 2 + F.floor(draw("split") * (half - 1)).cast("int"))
    shift = F.when(moved, F.rint((2 * draw("shift") - 1) * most).cast("long"))
    told = songs.withColumns({"split": split, "shift": shift})
    loss = F.transform(F.sequence(F.lit(0), F.col("patches") - 1), lambda i: i >= F.coalesce(F.col("split"), F.lit(0)))
    out = events.join(told.select(*keys, "split", "shift"), keys, "left")
    onset = F.when(F.col("onset") < F.col("split") * patch, F.greatest(F.lit(0), F.col("onset") + F.col("shift"))).otherwise(F.col("onset"))
    return out.withColumn("onset", onset).select(*events.columns), told.withColumn("loss", F.when(F.col("patches") > 0, loss).otherwise(F.array().cast("array<boolean>")))


def rescaled_metronome(bpm: Column, factor: float) -> Column:
    """The metronome mark for a performance that is `factor` times as long."""
    return snap_to_metronome(bpm / factor)


def chosen_songs(songs: DataFrame, quality: DataFrame, spans: DataFrame, keys: list[str], least_span: int) -> DataFrame:
    """Songs whose quality is known and not low and whose pitches span enough. quality: keys, low; spans: keys, span."""
    good = quality.where(~F.col("low")).select(*keys)
    wide = spans.where(F.col("span") >= least_span).select(*keys)
    return songs.join(good, keys, "left_semi").join(wide, keys, "left_semi")
