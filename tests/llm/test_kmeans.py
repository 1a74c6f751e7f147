"""Drake's bounds against plain Lloyd rounds over Python's integers."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm.drake_kmeans import Bounds, drake_kmeans, squares


def _plain(rows, k, rounds, dims, scale=256):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda p: (hashlib.sha256(f"2:{'' if p[0] is None else p[0]}".encode()).hexdigest(), p[1]))[:k]
    c = [v for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((far(v, m), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            group = [v for (_, v), o in zip(kept, own) if o == j]
            if group:
                c[j] = [sum(x) // len(group) for x in zip(*group)]
    last = [(i, *nearest(v)) for i, v in kept]
    total = Counter()
    for _, d, j in last:
        total[j] += d
    return Counter((i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in last)


def _rows(n, dims, seed):
    r = random.Random(seed)
    middles = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(9)]
    rows = [(i, [float(np.float32(m + r.gauss(0, 0.3))) for m in r.choice(middles)]) for i in range(n)]
    rows += [rows[3], rows[3], (None, rows[4][1]), (None, rows[4][1]), (n, rows[5][1])]
    rows += [(n + 1, None), (n + 2, []), (n + 3, rows[0][1][:-1]), (n + 4, [None, *rows[0][1][1:]]), (n + 5, [float("nan"), *rows[0][1][1:]]), (n + 6, [float("-inf"), *rows[0][1][1:]])]
    return rows + [(n + 7, [0.0] * dims), (2**60, [-0.001] * dims)]


SCHEMA = "vec_id long, embedding array<float>, v string, cluster string, near int, total long"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("k,rounds,dims", [(12, 4, 5), (40, 5, 8), (1, 2, 4), (2, 3, 4), (500, 2, 4)])
def test_rounds(spark, k, rounds, dims):
    rows = _rows(160, dims, k)
    got = drake_kmeans(_frame(spark, rows).repartition(3), k=k, rounds=rounds, dims=dims).collect()
    assert Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == _plain(rows, k, rounds, dims)


def test_empty(spark):
    out = drake_kmeans(_frame(spark, []))
    assert out.collect() == [] and out.columns[:2] == ["vec_id", "cluster"]
    assert drake_kmeans(_frame(spark, [(1, None), (2, [1.0])])).collect() == []


def test_large_components(spark):
    """Beyond what doubles multiply exactly, integers do; beyond those, an error."""
    rows = [(i, [float(2**18 + i), float(-(2**18) - 3 * i)]) for i in range(30)]
    got = drake_kmeans(_frame(spark, rows), k=4, rounds=3, dims=2)
    assert Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got.collect()) == _plain(rows, 4, 3, 2)
    with pytest.raises(OverflowError):
        squares(np.array([[2**31 - 1]]), np.array([[-(2**31) + 1]]))


def test_bounds_hold_and_spare():
    """After every move the bounds are true, the order is right, and well-parted vectors are hardly measured."""
    r = np.random.default_rng(4)
    middles = r.integers(-3000, 3000, (16, 6))
    v = (middles[r.integers(0, 16, 3000)] + r.integers(-40, 40, (3000, 6))).astype(np.int32)
    c = middles.copy()
    state, spared = Bounds.unknown(v, 4), 0
    for step in range(6):
        state.settle(c)
        far = squares(v, c)
        assert (state.cluster == far.argmin(1)).all()
        true = np.sqrt(far)
        assert (state.upper + 1e-6 >= true[np.arange(len(v)), state.cluster]).all()
        assert (state.lower[:, :-1] <= np.take_along_axis(true, state.near.astype(np.int64), 1) + 1e-6).all()
        named = np.zeros_like(true, bool)
        np.put_along_axis(named, state.near.astype(np.int64), True, 1)
        named[np.arange(len(v)), state.cluster] = True
        assert (state.lower[:, -1] <= np.where(named, np.inf, true).min(1) + 1e-6).all()
        spared += int((state.looked == 0).sum()) if step else 0
        moved = c + r.integers(-60, 60, c.shape)
        state.move(np.sqrt(((moved - c) ** 2).sum(1)))
        c = moved
        if step == 2:
            state.fold(2)
        state.measured[:] = 0
    assert spared > 3000


def test_last_pass_spares(spark, sf_dir):
    found = drake_kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).selectExpr("sum(measured)", "count(*)").first()
    assert found[0] < 0.7 * 40 * found[1]
