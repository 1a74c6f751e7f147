"""Augmentation steps of note tables."""

from tidemark.operators import notes

SCHEMA = "song_id string, onset long, kind int, pitch int, duration long, velocity int"


def _rows(df):
    return sorted(tuple(r)[1:] for r in df.select("song_id", "onset", "kind", "pitch", "duration", "velocity").collect())


def test_stretch_keeps_pedals_apart(spark):
    df = spark.createDataFrame([("s", 10, 1, 0, 0, 0), ("s", 11, 0, 0, 0, 0), ("s", 12, 1, 0, 0, 0), ("s", 10, 2, 60, 1, 64), ("s", 40, 0, 0, 0, 0)], SCHEMA)
    assert _rows(notes.stretch(df, 0.25)) == [(2, 1, 0, 0, 0), (2, 2, 60, 1, 64), (3, 0, 0, 0, 0), (4, 1, 0, 0, 0), (10, 0, 0, 0, 0)]


def test_transpose_velocity_and_drift(spark):
    df = spark.createDataFrame([("s", 0, 2, 105, 5, 120), ("s", 50, 2, 60, 5, 3), ("s", 100, 1, 0, 0, 0)], SCHEMA)
    assert _rows(notes.transposed(df, 4)) == [(50, 2, 64, 5, 3), (100, 1, 0, 0, 0)]
    assert _rows(notes.louder(df, 10)) == [(0, 2, 105, 5, 127), (50, 2, 60, 5, 13), (100, 1, 0, 0, 0)]
    assert [r[0] for r in _rows(notes.drift(df, 60, -8, 20))] == [0, 46, 100]


def test_trim_lead_keeps_the_pedal_that_is_down(spark):
    df = spark.createDataFrame([("s", 5, 1, 0, 0, 0), ("s", 20, 2, 60, 5, 64), ("s", 30, 0, 0, 0, 0), ("t", 1, 1, 0, 0, 0), ("t", 2, 0, 0, 0, 0), ("t", 9, 2, 61, 1, 1)], SCHEMA)
    assert _rows(notes.trim_lead(df)) == [(0, 1, 0, 0, 0), (0, 2, 60, 5, 64), (0, 2, 61, 1, 1), (10, 0, 0, 0, 0)]
