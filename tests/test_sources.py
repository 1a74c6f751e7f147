"""Files in and out: MIDI, MusicXML, manifests, caches."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from tidemark.sources import files, midi, musicxml


def test_midi_events_follow_the_rules(spark):
    """Longest of equal notes, pedals merged only where they overlap, silence cut, drums and far keys left out."""
    rows = [("p", "note", False, 1.0, 1.5, 60, 64), ("p", "note", False, 1.001, 1.2, 60, 99), ("p", "note", False, 2.0, 2.0, 20, 64), ("p", "note", True, 0.1, 0.2, 60, 64),
            ("p", "note", False, 3.0, 3.001, 108, 0), ("p", "pedal", False, 0.5, 1.0, None, None), ("p", "pedal", False, 1.0, 1.3, None, None), ("p", "pedal", False, 1.2, 1.25, None, None)]
    df = spark.createDataFrame(rows, "path string, what string, drum boolean, start double, stop double, a int, b int")
    got = sorted(tuple(r)[1:] for r in midi.events_of(df).collect())
    assert got == [(0, 1, 0, 0, 0), (50, 0, 0, 0, 0), (50, 1, 0, 0, 0), (50, 2, 60, 50, 64), (80, 0, 0, 0, 0), (250, 2, 108, 1, 1)]
    assert midi.song_ends(midi.events_of(df)).first().end_frame == 251


def test_midi_files(spark, tmp_path):
    events = spark.createDataFrame([("s", 0, 2, 60, 30, 64), ("s", 10, 1, 0, 0, 0), ("s", 10, 2, 64, 300, 127), ("s", 90, 0, 0, 0, 0), ("s", 31, 2, 60, 5, 1)], "song_id string, onset long, kind int, pitch int, duration long, velocity int")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "s.mid").write_bytes(bytes(midi.contents(events).first().content))
    (tmp_path / "bad.mid").write_bytes(b"RIFF")
    (tmp_path / "cut.mid").write_bytes(b"MThd\x00\x00")
    rows = midi.read_midi(spark, str(tmp_path))
    assert rows.where("error is not null").count() == 2
    got = midi.events_of(rows.where("error is null")).drop("song_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, events.drop("song_id").collect()))


def test_midi_tempo_changes_and_running_status():
    track = b"\x00\xff\x51\x03\x07\xa1\x20" + b"\x00\x90\x3c\x40" + b"\x60\x3c\x00" + b"\x00\xff\x51\x03\x0f\x42\x40" + b"\x00\x90\x3e\x40" + b"\x60\x80\x3e\x00" + b"\x00\xff\x06\x05C:maj\x00\xff\x2f\x00"
    content = b"MThd\x00\x00\x00\x06\x00\x00\x00\x01\x00\x60MTrk" + len(track).to_bytes(4, "big") + track
    rows = midi.parse(content)
    notes = [(r[3], r[4], r[5]) for r in rows if r[0] == "note"]
    assert notes == [(0.0, 0.5, 60), (0.5, 1.5, 62)]
    assert [(r[3], r[7]) for r in rows if r[0] == "marker"] == [(1.5, "C:maj")]


SCORE = """<score-partwise><work><work-title> Étude </work-title></work><part id="P1">
<measure><attributes><divisions>4</divisions></attributes>
<note><pitch><step>C</step><octave>4</octave></pitch><duration>4</duration><voice>1</voice></note>
<note><chord/><pitch><step>E</step><alter>-1</alter><octave>4</octave></pitch><duration>4</duration><voice>1</voice></note>
<note><rest/><duration>4</duration></note>
<backup><duration>8</duration></backup>
<note><pitch><step>G</step><octave>2</octave></pitch><duration>8</duration><tie type="start"/><voice>2</voice><staff>2</staff></note>
</measure>
<measure><note><pitch><step>G</step><octave>2</octave></pitch><duration>2</duration><tie type="stop"/><voice>2</voice><staff>2</staff></note></measure>
</part></score-partwise>"""


def test_musicxml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(SCORE)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("META-INF/container.xml", "<container/>")
        z.writestr("score.xml", SCORE)
    (tmp_path / "b.mxl").write_bytes(packed.getvalue())
    (tmp_path / "c.xml").write_text("<score-partwise><part>")
    found = musicxml.read_scores(spark, str(tmp_path))
    notes = musicxml.scan(found)
    assert notes.where("error is not null").count() == 1
    want = [(0, 1, "1", 0.0, 1.0, 60, None), (0, 1, "1", 0.0, 1.0, 63, None), (0, 2, "2", 0.0, 2.0, 43, "star"), (1, 2, "2", 2.0, 0.5, 43, "stop")]
    for name in ("a.xml", "b.mxl"):
        got = notes.where(F.col("path").endswith(name)).select("measure", "staff", "voice", "onset", "length", "pitch", "tie")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    held = musicxml.sounding(notes).where("staff = 2").select("onset", "length").distinct().collect()
    assert [tuple(r) for r in held] == [(0.0, 2.5)]
    assert {r.title for r in musicxml.titles(found).collect()} == {"Étude", None}
    stats = musicxml.score_stats(notes).first()
    assert (stats.notes, stats.measures) == (4, 2)


def test_manifest_with_mark_and_documents(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("﻿id,title\n1,été\n2,\n".encode())
    assert [tuple(r) for r in files.read_manifest(spark, str(tmp_path / "m.csv"), "id long, title string").orderBy("id").collect()] == [(1, "été"), (2, None)]
    (tmp_path / "d.json").write_text(json.dumps({"songs": {"a": 1, "b": 2}}))
    d = files.read_documents(spark, str(tmp_path / "d.json"), "songs map<string,long>")
    assert sorted(map(tuple, files.entries(d, "songs").collect())) == [("a", 1), ("b", 2)]


def test_cache_resume_and_shards(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("song"), (F.col("id") % 2).alias("split"))
    folder = str(tmp_path / "cache")
    assert files.resume(spark, rows, folder, ["song"]).count() == 100
    files.write_cache(rows.where("song < 60"), folder, "song", 4, "split")
    assert [r.song for r in files.read_cache(spark, folder, "song", 7).collect()] == [7]
    assert "PushedFilters: [In" in files.read_cache(spark, folder, "song", 7, 8)._jdf.queryExecution().toString() or "song" in files.read_cache(spark, folder, "song", 7)._jdf.queryExecution().toString()
    assert files.resume(spark, rows, folder, ["song"]).count() == 40
    assert sum(files.shard(rows, "song", i, 3).count() for i in range(3)) == 100
    assert files.listing(spark, folder, "*.parquet").count() > 0
    names = spark.createDataFrame([("a\\b\\C d.MID",), ("x/y.mid",)], "p string").select(files.file_key(F.col("p")).alias("k"))
    assert [r.k for r in names.collect()] == ["c d", "y"]
    o = files.overlay(spark.createDataFrame([({"a": "9"},), (None,)], "doc map<string,string>"), "doc", {"a": "1", "b": "2"})
    assert [r.doc for r in o.collect()] == [{"a": "9", "b": "2"}, {"a": "1", "b": "2"}]
    assert [r.downbeat for r in files.beat_grid(spark, 120.0, 3, 4).orderBy("beat").collect()] == [True, False, False, True]
    assert rows.select(files.content_key("song", "split").alias("k")).distinct().count() == 100
