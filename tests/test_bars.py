"""Grids, bar tokens, played order, arrangement and SQL names against plain rules; a stream of several files with late rows against its table."""

import math
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.operators import arrangement, bars, sequences
from tidemark.streaming import feeds, timers


def test_ticks_there_and_back(spark):
    beats = [("s", i, t) for i, t in enumerate([10.0, 10.5, 11.5, 12.0, 14.0])]
    grid = spark.createDataFrame(beats, "k string, beat int, t double")
    rows = spark.createDataFrame([("s", 9.0), ("s", 10.0), ("s", 10.25), ("s", 11.0), ("s", 15.0)], "k string, t double")
    ticks = bars.to_ticks(rows, grid, ["k"], "t", 12, "tick")
    assert [(r.t, r.tick) for r in ticks.orderBy("t").collect()] == [(9.0, -24), (10.0, 0), (10.25, 6), (11.0, 18), (15.0, 54)]
    back = bars.from_ticks(ticks.drop("t").withColumn("tick", F.col("tick").cast("double")), grid, ["k"], "tick", 12, "again")
    assert sorted(r.again for r in back.collect()) == [9.0, 10.0, 10.25, 11.0, 15.0]


def test_bar_tokens_and_pedal(spark):
    grid = spark.createDataFrame([("s", 0, 0), ("s", 1, 48), ("s", 2, 84), ("s", 3, 132)], "k string, bar int, start long")
    rows = [("s", 0, 2, 60, 12, 80), ("s", 0, 2, 64, 12, 80), ("s", 40, 1, 0, 0, 0), ("s", 48, 2, 62, 300, 1), ("s", 84, 0, 0, 0, 0), ("s", 90, 2, 65, 1, 127), ("s", 132, 1, 0, 0, 0), ("s", 140, 0, 0, 0, 0)]
    frame = spark.createDataFrame(rows, "k string, onset long, kind int, pitch long, duration long, velocity long")
    coded = bars.bar_tokenise(frame, grid, ["k"], 48)
    got = {r.bar: (len(r.tokens), r.pedal) for r in coded.collect()}
    assert got == {0: (1 + 4 + 4 + 2 + 1, False), 1: (6, True), 2: (2 + 5 + 1, True), 3: (5, False)}
    back = bars.bar_detokenise(coded, grid, ["k"], 48).select("k", "onset", "kind", "pitch", "duration", "velocity")
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def _order(entries, downs, beats, lengths, most):
    order, starts = [], []
    if len(entries) < 2:
        return "no measures named"
    for k, e in enumerate(entries):
        parts = e.split("-")
        group = [int(parts[0]) + i for i in range(len(parts))]
        if len(group) > 1 and k + 1 == len(entries):
            return "several measures at the last bar line"
        if group[-1] >= len(lengths):
            return "a measure the score lacks"
        if len(group) == 1:
            starts.append(downs[k])
        else:
            knots = [downs[k], *(b for b in beats if downs[k] + 1e-6 < b < downs[k + 1] - 1e-6), downs[k + 1]]
            total, passed = sum(lengths[m] for m in group), 0.0
            for m in group:
                starts.append(float(np.interp(passed / total * (len(knots) - 1), range(len(knots)), knots)))
                passed += lengths[m]
        order += group
    if any(b <= a for a, b in zip(starts, starts[1:])):
        return "times do not rise"
    if order[0] > 1:
        return "more than one measure before the first bar line"
    if order[0] == 1:
        starts.insert(0, starts[0] - lengths[0] * (starts[1] - starts[0]) / lengths[1])
        order.insert(0, 0)
    tail = range(order[-1] + 1, len(lengths))
    if len(tail) <= most:
        for m in tail:
            starts.append(starts[-1] + lengths[order[-1]] * (starts[-1] - starts[-2]) / lengths[order[-2]])
            order.append(m)
    return list(zip(order, starts))


CASES = {
    "plain": (["0", "1", "2"], [1.0, 3.0, 5.0], [1.0, 2.0, 3.0, 4.0, 5.0], [4.0, 4.0, 4.0]),
    "pickup": (["1", "2", "3"], [1.0, 3.0, 6.0], [], [1.0, 4.0, 4.0, 2.0]),
    "groups": (["0-1-2", "3", "4-9", "0"], [0.0, 6.0, 8.0, 13.0], [0.0, 1.0, 2.5, 4.0, 5.0, 6.0, 7.0, 9.0], [2.0, 1.0, 3.0, 2.0, 4.0, 4.0]),
    "repeat": (["0", "1", "0", "1", "2"], [0.0, 2.0, 4.5, 6.0, 9.0], [], [2.0, 2.0, 2.0]),
    "tail": (["0", "1"], [0.0, 2.0], [], [2.0, 3.0, 2.0, 5.0]),
    "long tail": (["0", "1"], [0.0, 2.0], [], [2.0] * 6),
    "one": (["0"], [0.0], [], [2.0]),
    "last": (["0", "1-2"], [0.0, 2.0], [], [2.0] * 4),
    "lacks": (["0", "7"], [0.0, 2.0], [], [2.0] * 4),
    "falls": (["0", "1", "2"], [0.0, 2.0, 2.0], [], [2.0] * 4),
    "two before": (["2", "3"], [0.0, 2.0], [], [2.0] * 4),
}


def test_played_order(spark):
    entries = spark.createDataFrame([(c, k, e, t) for c, (es, ts, _, _) in CASES.items() for k, (e, t) in enumerate(zip(es, ts))], "c string, k int, entry string, t double")
    beats = spark.createDataFrame([(c, b) for c, (_, _, bs, _) in CASES.items() for b in bs], "c string, t double")
    measures = spark.createDataFrame([(c, m, x) for c, (*_, ls) in CASES.items() for m, x in enumerate(ls)], "c string, measure int, length double")
    rows, wrong = bars.played_order(entries, beats, measures, ["c"], 2)
    got, reasons = defaultdict(list), {r.c: r.reason for r in wrong.collect()}
    for r in rows.orderBy("c", "place").collect():
        assert r.place == len(got[r.c])
        got[r.c].append((r.measure, r.start))
    for c, case in CASES.items():
        want = _order(*case, 2)
        if isinstance(want, str):
            assert reasons.get(c) == want and c not in got, c
        else:
            assert [m for m, _ in got[c]] == [m for m, _ in want] and np.allclose([t for _, t in got[c]], [t for _, t in want]), c


def test_arrangement(spark):
    """Against a bitmap of frames, with times between frames and spans that the cover only partly fills."""
    r = random.Random(4)
    cover = [("s", i // 2, r.randint(50, 80), round(r.uniform(20, 180), 2)) for i in range(60)] + [("few", i, 70, float(i)) for i in range(9)]
    melody = [("s", r.randint(0, 200), r.randint(0, 12), r.randint(50, 80)) for _ in range(16)]
    spans = [("s", 0, 30), ("s", 30, 90), ("s", 90, 100), ("s", 100, 300), ("few", 0, 10)]
    got = {(x.k, x.low): x for x in arrangement.arrangement(
        spark.createDataFrame(cover, "k string, onset int, pitch int, mapped double"), spark.createDataFrame(melody, "k string, start int, duration int, pitch int"),
        spark.createDataFrame(spans, "k string, low int, high int"), ["k"], 5, shortest=4, least_gap=0.5, least_melody=2, least_notes=4, unit=10.0).collect()}
    mine = sorted((x for x in cover if x[0] == "s"), key=lambda x: x[3])
    first, last = mine[0][3], mine[-1][3]
    sounding = {f for _, a, d, _ in melody for f in range(a, a + max(d, 4))}
    gap = [f for f in range(int(first), int(last) + 1) if f not in sounding]
    chords = {}
    for _, onset, pitch, m in mine:
        if int(m) in gap and pitch >= 60:
            chords.setdefault(onset, m)
    for _, low, high in spans[:4]:
        x = got["s", low]
        pause = sum(low <= f < high for f in gap) / 10
        fills = sum(low <= m < high for m in chords.values())
        played = above = 0
        for _, a, _, p in melody:
            near = [q for _, _, q, m in mine if abs(m - a) <= 5]
            same = [q for q in near if q % 12 == p % 12]
            if first <= a <= last and low <= a < high and same:
                played, above = played + 1, above + (max(near) > max(same))
        inside = [q for _, _, q, m in mine if low <= m < high]
        assert x.fill == (pytest.approx(math.log1p(fills / pause)) if pause >= 0.5 else None)
        assert x.above == (pytest.approx(math.sqrt(above / played)) if played >= 2 else None)
        assert x.span == (max(inside) - min(inside) if len(inside) >= 4 else None)
    assert (got["few", 0].fill, got["few", 0].above, got["few", 0].span) == (None, None, None)


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_length():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 90))] for _ in range(2))
        assert sequences.lcs_length(a, b) == _lcs(a, b)


def test_names(spark, sf_dir):
    from tidemark.plans import catalogue
    from tidemark.sources import midi

    assert len(names.register(spark)) == len(set(names.register(spark))) > 10
    files = midi.contents(catalogue._songs(spark, sf_dir)) if hasattr(catalogue, "_songs") else None
    path = [c for c, t in files.dtypes if t == "binary"][0]
    rows = spark.sql(f"SELECT count(*) AS n, count(error) AS wrong FROM {{files}} f, LATERAL tide_midi_rows(f.{path}) m", files=files).first()
    assert rows.n > 0 and rows.wrong == 0
    assert spark.sql("SELECT error FROM tide_midi_rows(cast('no midi' AS BINARY))").first().error is not None
    assert spark.sql("SELECT tide_lcs_f1(s, p, x) AS f FROM VALUES (0, 1, 7), (0, 2, 8), (1, 1, 8), (1, 2, 7) AS t(s, p, x)").first().f == 0.5
    assert spark.sql("SELECT tide_beat_unit(6, 8) AS a, tide_beat_unit(3, 8) AS b, tide_score_bin(NULL) AS c, tide_frames(0.125D, 100) AS d").first() == (1.5, 0.5, 0, 12)


BATCHES = [
    [(1, 1, "a", False, 0), (1, 2, "b", False, 10), (2, 1, "x", False, 20)],
    [(1, 3, "c", True, 3000), (3, 1, "q", False, 3100), (6, 1, "u", False, 3150), (6, 0, "older", False, 3160)],
    [(1, 4, "after the end", False, 3200), (2, 2, "y", False, 9000), (2, 3, "too late to count", False, -90_000)],
    [(4, 1, "z", True, 40_000)],
    [(3, 2, "behind the watermark", False, 100), (5, 1, "w", False, 40_001), (1, 9, "after the mark", True, 40_100)],
    [(7, 1, "end", False, 200_000)],
]


def test_timed_revisions_over_files(spark, tmp_path):
    """Files with late rows, ids that stall, and ids that are revised after they were closed: the stream hands out what its table says."""
    timers.prepare(spark)
    for i, rows in enumerate(BATCHES):
        frame = spark.createDataFrame(rows, "id long, seq long, payload string, final boolean, sec int").withColumn("at", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("sec"))).drop("sec")
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.02)
    source = spark.readStream.schema("id long, seq long, payload string, final boolean, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = feeds.table_of(timers.timed_revisions(source, 7_200_000, 86_400_000), "append", f"{tmp_path}/out")
    got = sorted(map(tuple, out.collect()))
    on_time = [r for b in BATCHES for r in b if r[4] >= 0 and "behind" not in r[2] and "after" not in r[2]]
    table = spark.createDataFrame(on_time, "id long, seq long, payload string, final boolean, sec int").withColumn("at", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("sec")))
    table = table.withColumn("end", F.timestamp_seconds(F.lit(1_704_067_200 + 200_000 - 3600)))
    assert got == sorted(map(tuple, timers.settled(table, 7_200_000, "end").collect()))
    assert got == [(1, 3, "c", "final"), (2, 2, "y", "stalled"), (3, 1, "q", "stalled"), (4, 1, "z", "final"), (5, 1, "w", "stalled"), (6, 1, "u", "stalled")]
