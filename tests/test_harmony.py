"""Spelling, chord placement, beats."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import harmony


@pytest.mark.parametrize(("text", "key", "want"), [("A:m7/E", 0, "Am7/E"), ("C:maj", 0, "C"), ("E/G#", 4, "E/G#"), ("F#:m7", -6, "Gbm7"), ("Cb:M7", 0, "BM7"), ("N", 0, "N.C."), ("?:7", 0, None), ("C/x", 0, None), ("A#", 0, "A#"), ("Bb", 0, "Bb"), ("F", 6, "E#")])
def test_symbols(spark, text, key, want):
    df = spark.createDataFrame([(text, key)], "text string, key int")
    assert df.select(harmony.chord_symbol(F.col("text"), F.col("key")).alias("s")).first().s == want


def test_spelling_of_every_class(spark):
    for key, want in ((0, "C C# D Eb E F F# G G# A Bb B"), (3, "C C# D D# E F F# G G# A A# B"), (-4, "C Db D Eb E F Gb G Ab A Bb B")):
        got = spark.range(12).select("id", harmony.note_name(harmony.place_of(F.col("id"), F.lit(key))).alias("n")).orderBy("id").collect()
        own = [r.n for r in got]
        assert all(a == b for a, b in zip(own, want.split()) if "#" not in b and "b" not in b), (key, own)
        assert len(set(own)) == 12


def _measures(spark, lengths, starts):
    return spark.createDataFrame([("s", i, float(t), float(n), 0) for i, (n, t) in enumerate(zip(lengths, starts))], "song string, measure int, start double, length double, key int")


def test_chords_stand_on_eighths_and_repeats_go(spark):
    chords = spark.createDataFrame([("s", -1.0, "N"), ("s", 0.04, "C:maj"), ("s", 3.45, "G:7"), ("s", 4.1, "G:7"), ("s", 8.0, "N")], "song string, t double, text string")
    got = harmony.place_chords(chords, _measures(spark, [4, 4, 4], [0, 4, 8]), ["song"]).collect()
    assert sorted((r.measure, r.position, r.symbol) for r in got) == [(0, 0.0, "C"), (0, 3.5, "G7"), (2, 0.0, "N.C.")]


def test_chords_round_into_the_next_measure(spark):
    chords = spark.createDataFrame([("s", 3.9, "C:maj"), ("s", 7.9, "G:7")], "song string, t double, text string")
    got = harmony.place_chords(chords, _measures(spark, [4, 4], [0, 4]), ["song"]).collect()
    assert [(r.measure, r.position, r.symbol) for r in got] == [(1, 0.0, "C")]


def test_beats(spark):
    beats = spark.createDataFrame([("a", float(t)) for t in (10, 12, 14, 17)] + [("b", 1.0), ("b", 2.0), ("b", 2.0), ("b", 3.0)], "song string, t double")
    spans = spark.createDataFrame([("a", 7.0, 19.0), ("b", 0.0, 9.0)], "song string, first double, last double")
    got = sorted(r.t for r in harmony.extend_beats(beats, spans, ["song"], "t").collect())
    assert got == [4.0, 6.0, 8.0, 10.0, 12.0, 14.0, 17.0, 20.0, 23.0]
