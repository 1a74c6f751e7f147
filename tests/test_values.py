"""Rules against values worked out by hand or by brute force."""

import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import sequences, series, temporal


def _of(spark, column, values, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in frame.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_chords(spark):
    got = _of(spark, scalar.chord, ["N", "Ab:add9/C", "C", "F#:m7", "Cb:M7/E", "Cxyz", "C:what", "H", "", "A:m7/x", None])
    kind = scalar.CHORD_KINDS.index
    want = [(12, 0, 12), (8, kind("add9"), 0), (0, kind("maj"), 12), (6, kind("m7"), 12), (11, kind("M7"), 4), None, (0, kind("other"), 12), None, None, None, None]
    assert [tuple(x) if x else None for x in got] == want


def test_meter_and_ledgers(spark):
    rows = spark.createDataFrame([(6, 8), (9, 16), (6, 32), (3, 8), (4, 4)], "b int, u int")
    assert [r.x for r in rows.select(scalar.beat_unit(F.col("b"), F.col("u")).alias("x")).collect()] == [1.5, 0.75, 0.125, 0.5, 1.0]
    assert _of(spark, scalar.ledger_cost, [0, 2, 3, 6], "int") == [0, 0, 1, 8]
    assert _of(spark, lambda x: scalar.log_bin(x, 1.0, 8.0, 4), [0.0, 1.0, 2.1, 5.0, 100.0], "double") == [None, 0, 1, 2, 3]
    assert _of(spark, lambda x: scalar.floor_div(x, 7), [-1, 0, 13, -(2**53) - 1], "long") == [-1, 0, 1, (-(2**53) - 1) // 7]


def test_tempo_segments(spark):
    """Against the rule, step by step, over random walks with jumps; whole keys and stretches of three rows give the same."""
    r = random.Random(12)
    walks = {}
    for k in range(5):
        x, walks[k] = 90.0, []
        for _ in range(40):
            x *= r.choice([0.7, 1.4]) if r.random() < 0.1 else r.uniform(0.975, 1.03)
            walks[k].append(round(x, 3))

    def rule(xs):
        out = []
        for x in xs:
            if out and abs(x / statistics.median(out[-1]) - 1) <= 0.05:
                out[-1].append(x)
            else:
                out.append([x])
        return [(sum(map(len, out[:i])), len(s), statistics.median(s)) for i, s in enumerate(out)]

    rows = spark.createDataFrame([(k, i, x) for k, xs in walks.items() for i, x in enumerate(xs)], "k int, i int, x double").repartition(3)
    for size in (1 << 16, 3):
        got = {k: [] for k in walks}
        for x in series.tempo_segments(rows, ["k"], "i", "x", size=size).orderBy("k", "segment").collect():
            got[x.k].append((x.first, x.n, x.value))
        assert got == {k: rule(xs) for k, xs in walks.items()}
    assert all(3 < len(g) < 40 for g in got.values())


def test_viterbi_is_the_cheapest_path(spark):
    r = random.Random(3)
    switch = [[0.0, 2.0, 4.0], [2.5, 0.0, 2.0], [4.0, 1.5, 0.0]]
    rows = [(k, i, [r.randint(0, 9) / 2 for _ in range(3)]) for k in range(6) for i in range(k + 1)]
    frame = spark.createDataFrame(rows, "k int, i int, costs array<double>").repartition(3)
    got = {}
    for x in sequences.viterbi(frame, ["k"], "i", "costs", switch).orderBy("k", "i").collect():
        got.setdefault(x.k, []).append(x.mode)

    def price(path, costs):
        return sum(switch[a][b] + c[b] for a, b, c in zip([0, *path], path, costs))

    for k in range(6):
        costs = [c for kk, _, c in rows if kk == k]
        assert price(got[k], costs) == pytest.approx(min(price(p, costs) for p in itertools.product(range(3), repeat=k + 1)))


def test_viterbi_over_stretches(spark):
    """A path handed on from stretch to stretch, both ways, is the one of a single stretch."""
    import random

    r = random.Random(5)
    rows = [(k, i, [float(r.randint(0, 5)) for _ in range(3)]) for k in ("a", "b", None) for i in range(23)]
    frame = spark.createDataFrame(rows, "k string, i int, costs array<double>")
    switch = [[0, 1, 3], [1, 0, 1], [3, 1, 0]]
    one, many = (sorted(map(repr, sequences.viterbi(frame, ["k"], "i", "costs", switch, size=n).collect())) for n in (1 << 16, 4))
    assert one == many and len(one) == 69


def test_lcs(spark):
    rows = [(1, ["C", "G", "Am", "F"], ["C", "Am", "F", "G"]), (2, ["C"], ["D"]), (3, [], []), (4, None, ["C"])]
    got = {r.k: r.f1 for r in sequences.lcs_f1(spark.createDataFrame(rows, "k int, a array<string>, b array<string>"), "a", "b").collect()}
    assert got == {1: 0.75, 2: 0.0, 3: None, 4: None}


def test_band_join_of_equal_times(spark):
    a = spark.createDataFrame([("k", 1), ("k", 2)], "k string, t long")
    b = spark.createDataFrame([("k", 2, "x"), ("k", 3, "y")], "k string, t long, v string")
    assert {(r.t, r.v) for r in temporal.band_join(a, b, ["k"], "t", 0, ["v"]).collect()} == {(1, None), (2, "x")}


def test_small_scalars(spark):
    from tidemark.functions import scalar
    from pyspark.sql import functions as F

    one = spark.range(1).select(
        scalar.ending_numbers(F.lit("1-3, 5,x")).alias("ends"), scalar.snap_to_metronome(F.lit(118.0)).alias("mark"), scalar.lcm_of(F.array(F.lit(4), F.lit(6), F.lit(10))).alias("lcm"),
        scalar.lcm_of(F.array().cast("array<long>")).alias("none"), scalar.velocity_bin(F.lit(200)).alias("top"), scalar.velocity_of_bin(F.lit(31)).alias("middle"),
        scalar.note_quarters(F.lit(1.0), F.lit(1), F.lit(3), F.lit(2), F.lit(False)).alias("dotted"), scalar.tempo_bin(F.lit(30.0)).alias("slow"), scalar.utc_now().alias("now"),
    ).first()
    assert (one.ends, one.mark, one.lcm, one.none, one.top, one.middle, one.dotted, one.slow) == ([1, 2, 3, 5], 116, 60, 1, 31, 126, 1.0, 0)
    assert one.now[10] == "T" and one.now[-1] == "Z"


def test_increasing_groups_know_nulls_and_ties(spark):
    from tidemark.operators import groups

    rows = [("up", 1, 1.0), ("up", 2, 2.0), ("tie", 1, 1.0), ("tie", 2, 1.0), ("null", 1, None), ("null", 2, 2.0), ("short", 1, 1.0)]
    found = groups.increasing(spark.createDataFrame(rows, "k string, n int, v double"), ["k"], ["n"], "v", 2)
    assert [r.k for r in found.collect()] == ["up"]
