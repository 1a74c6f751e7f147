"""Pairing, numbering and overlaps within a voice."""

from tidemark.operators import sequences


def _rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_each_stop_closes_the_last_open_start(spark):
    df = spark.createDataFrame([("v", 0, True), ("v", 1, True), ("v", 2, False), ("v", 3, False), ("v", 4, False), ("w", 0, True)], "voice string, t long, opens boolean")
    assert _rows(sequences.pair_marks(df, ["voice"], ["t"], "opens"), "voice", "open_at", "close_at") == [("v", 0, 3), ("v", 1, 2)]


def test_smallest_free_slot(spark):
    df = spark.createDataFrame([("v", 0, 10), ("v", 1, 3), ("v", 2, 5), ("v", 3, 4)], "voice string, a long, b long")
    assert _rows(sequences.slots(df, ["voice"], "a", "b"), "a", "slot") == [(0, 1), (1, 2), (2, 3), (3, 2)]
    assert _rows(sequences.slots(df, ["voice"], "a", "b", most=2), "a", "slot") == [(0, 1), (1, 2), (3, 2)]


def test_unisons_go_from_the_lower_rank(spark):
    df = spark.createDataFrame([("s", 0, 4, 64, "melody", 0), ("s", 0, 4, 60, "melody", 0), ("s", 2, 6, 64, "left", 1), ("s", 4, 6, 64, "left", 1), ("s", 0, 4, 48, "left", 1)], "song string, on long, off long, pitch int, voice string, rank int")
    got = _rows(sequences.remove_unisons(df, ["song"], "on", "off", "pitch", "voice", "rank"), "on", "pitch", "voice")
    assert got == [(0, 48, "left"), (0, 60, "melody"), (0, 64, "melody"), (4, 64, "left")]


def test_voice_overlaps(spark):
    df = spark.createDataFrame([("v", 0, 4), ("v", 3, 5), ("v", 5, 6), ("w", 0, 9)], "voice string, a long, b long")
    assert _rows(sequences.voice_overlaps(df, ["voice"], "a", "b"), "voice", "a") == [("v", 3)]


def test_first_violation(spark):
    o = sequences.offsets(100)
    t, note = o["time"], [o["kind"] + 2, o["pitch"] + 60, o["duration"] + 4, o["velocity"] + 64]
    rows = [(0, [t + 1, *note, t + 5, *note, 1]), (1, [t + 5, *note, t + 5, *note, 1]), (2, [t + 1, *note[:2], 1]), (3, [t + 1, *note])]
    df = spark.createDataFrame([("s", p, x) for p, x in rows], "song string, patch long, tokens array<long>")
    got = {r.patch: r.violation for r in sequences.first_violation(df, ["song"], 100).collect()}
    assert got == {0: None, 1: "time does not rise", 2: "note without its values", 3: "no end"}


def test_detokenise_reads_odd_patches_and_sorts_nothing(spark):
    o = sequences.offsets(48)
    time, up, note = o["time"] + 5, o["kind"], o["kind"] + 2
    three = [o["pitch"] + 60, o["duration"] + 7, o["velocity"] + 9]
    rows = [("a", 2, [time, note, *three, up, sequences.END_OF_PATCH]), (None, 0, [time, None, up]), ("b", 1, [note, *three]), ("c", 3, [time, note, three[0]]), ("c", 4, three), ("d", 0, []), ("e", 0, None), ("f", None, [time, up])]
    found = sequences.detokenise(spark.createDataFrame(rows, "k string, patch int, tokens array<bigint>").coalesce(1), ["k"], 48)
    want = [("a", 101, 2, 60, 7, 9), ("a", 101, 0, 0, 0, 0), (None, 5, 0, 0, 0, 0), ("b", None, 2, 60, 7, 9), ("c", 149, 2, 60, None, None), ("f", None, 0, 0, 0, 0)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan and "Exchange" not in plan
