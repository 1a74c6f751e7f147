"""Water-filling against a plain loop, and copies near their targets."""

import hashlib
from collections import defaultdict

import pytest
from odd import docs, texts
from pyspark.sql import functions as F

from tidemark.llm.mixing import mix, mixed_documents


def _poured(size, weights, share, cap):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(size.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * size[s] + 1e-9}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = cap * size[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def plain_mix(rows, share=1.5, seed=20240101):
    """How often each row is taken: whole times, and once more while the hash order has not filled the rest."""
    sizes = [len((t or "").split()) for _, t, *_ in rows]
    key = [hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest() for i, *_ in rows]
    size, group = defaultdict(int), defaultdict(int)
    for (_, _, _, s), n, k in zip(rows, sizes, key):
        size[s] += n
        group[s, k] += n
    want, taken = _poured(size, (5, 2, 1), share, 2.0), {}
    for s in size:
        whole = want[s] // size[s] if size[s] else 0
        rest, upto = want[s] - whole * size[s], 0
        for k in sorted(k for t, k in group if t == s):
            upto += group[s, k]
            taken[s, k] = int(whole) + (rest > 0 and upto - group[s, k] / 2 <= rest)
    return [taken[s, k] for (_, _, _, s), k in zip(rows, key)]


@pytest.mark.parametrize("share", [0.3, 1.5, 2.0, 5.0])
def test_targets_and_taken(spark, share):
    rows = texts()
    size = defaultdict(int)
    for _, t, _, s in rows:
        size[s] += len((t or "").split())
    want = _poured(size, (5, 2, 1), share, 2.0)
    got = mix(docs(spark), share=share).collect()
    assert len(got) == len(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = mix(docs(spark).repartition(9), share=share).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    copies = mixed_documents(docs(spark), share=share)
    assert copies.count() == sum(r.copies for r in got)
    assert copies.columns == docs(spark).columns


def test_empty(spark):
    assert mix(docs(spark, [])).collect() == []
    assert mixed_documents(docs(spark, [])).collect() == []
    assert mix(docs(spark, [(1, None, None, None), (2, " ", None, "a")])).agg(F.sum("copies")).first()[0] in (0, None)
