"""Schemas and fixed values, stated once; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# Note tables count time in frames of 10 ms; kinds of events; piano keys; velocities.
FRAME_RATE = 100
PEDAL_OFF, PEDAL_ON, NOTE = 0, 1, 2
LOW_KEY, HIGH_KEY = 21, 108
VELOCITY_BINS = 32

EVENTS = T.StructType([
    T.StructField("song_id", T.StringType()),
    T.StructField("onset", T.LongType()),
    T.StructField("kind", T.IntegerType()),
    T.StructField("pitch", T.IntegerType()),
    T.StructField("duration", T.LongType()),
    T.StructField("velocity", T.IntegerType()),
])
SCORE_NOTES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("part", T.StringType()),
    T.StructField("measure", T.IntegerType()),
    T.StructField("staff", T.IntegerType()),
    T.StructField("voice", T.StringType()),
    T.StructField("onset", T.DoubleType()),
    T.StructField("length", T.DoubleType()),
    T.StructField("pitch", T.IntegerType()),
    T.StructField("tie", T.StringType()),
    T.StructField("error", T.StringType()),
])
STREAM_EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])
