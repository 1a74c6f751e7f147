"""The Pitman-Yor model: base columns by brute force, seating against exact posteriors, scores against a direct computation."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from odd import docs, texts

from tidemark.llm import hpy_lm as m


def _out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def _tokens(t):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())
    return [*re.findall(rb"[^\x20\x09-\x0D]+", lower), None]


def test_language_model(spark):
    rows = texts(200)
    got = m.hpy_scores(docs(spark, rows).repartition(3)).collect()
    count = Counter(w for i, t, *_ in rows if not _out(i) for w in _tokens(t))
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t, *_ in rows:
        ws = _tokens(t)
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        want[i, _out(i), len(ws), sum(count[w] > 0 for w in ws), n, f"{base:.5g}"] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.5g}") for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    again = m.hpy_scores(docs(spark, rows).repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert m.hpy_scores(docs(spark, [])).collect() == []


def _partitions(n):
    """All ways to seat n customers at tables, as lists of tables."""
    if n == 0:
        yield []
        return
    for p in _partitions(n - 1):
        for k in range(len(p)):
            yield [*p[:k], p[k] + 1, *p[k + 1 :]]
        yield [*p, 1]


def _posterior(c, others, parent, d):
    """P(tables) of a dish with c customers, by enumeration of all seatings."""
    weight = Counter()
    for p in _partitions(c):
        w = 1.0
        for k, n in enumerate(p):
            w *= (m.STRENGTH + d * (others + k)) * parent * math.prod(j - d for j in range(1, n))
        weight[len(p)] += w
    total = sum(weight.values())
    return {t: w / total for t, w in weight.items()}


@pytest.mark.parametrize("others, parent, d", [(3, 0.2, 0.6), (40, 0.01, 0.3)])
def test_seating_follows_the_posterior(others, parent, d):
    rng = np.random.default_rng(8)
    want = _posterior(6, others, parent, d)
    n = 40_000
    same = lambda x: np.full(n, x)
    drawn = Counter(m.together(same(6), same(others), same(parent), d, rng).tolist())
    sizes = [np.array([6])] * 4000
    for _ in range(3):
        sizes = m.one_by_one(sizes, np.full(4000, 6), np.full(4000, others), np.full(4000, parent), d, rng, moves=60)
    walked = Counter(len(s) for s in sizes)
    assert all(s.sum() == 6 for s in sizes)
    for t, p in want.items():
        assert abs(drawn[t] / n - p) < 4 * math.sqrt(p / n) + 1e-4
        assert abs(walked[t] / 4000 - p) < 4 * math.sqrt(p / 4000) + 1e-3


@pytest.mark.parametrize("c, others, parent, d", [(65, 0, 1e-9, 0.8), (100, 5, 0.1, 0.3), (300, 400, 0.3, 0.95), (700, 50_000, 1e-3, 0.6), (700, 10**6, 0.5, 0.5)])
def test_crowds_follow_the_posterior(c, others, parent, d):
    t, n = np.arange(1, c + 1), 4000
    log = m.stirling(d, c)[c, 1:]
    whole = m.log_stirling(np.full(c, float(c)), t.astype(float), d) - m._lgamma(t.astype(float)) + math.lgamma(c + 1)
    assert np.abs(whole - log).max() < 1e-6
    w = log + np.cumsum(np.log(m.STRENGTH + d * (others + t - 1))) + t * np.log(parent)
    w = np.exp(w - w.max()) / np.exp(w - w.max()).sum()
    same = lambda x: np.full(n, x)
    drawn = np.bincount(m.at_once(same(c), same(others), same(parent), d, np.random.default_rng(8)), minlength=c + 1)[1:] / n
    assert np.abs(np.cumsum(drawn) - np.cumsum(w)).max() < 2 / math.sqrt(n)


def test_a_sweep_seats_everyone():
    """5,000 customers at few tables sit at as many as their new parent asks for after one sweep, however they sat before."""
    n, c, d = 200, 5000, 0.5
    same = lambda x: np.full(n, x)
    rng = np.random.default_rng(4)
    level = m.Level(same(1)).sample(same(c), same(1001), same(1e-9), d, rng)
    assert level.tables.max() == 1
    level = level.sample(same(c), level.tables + 1000, same(0.5), d, rng)
    t = np.arange(1, c + 1)
    w = m.log_stirling(np.full(c, float(c)), t.astype(float), d) - m._lgamma(t.astype(float)) + np.cumsum(np.log(m.STRENGTH + d * (999 + t))) + t * np.log(0.5)
    w = np.exp(w - w.max()) / np.exp(w - w.max()).sum()
    assert level.tables.mean() == pytest.approx((w * t).sum(), rel=0.01)


def test_customers_come_and_go():
    rng = np.random.default_rng(9)
    want = np.array([300, 80, 100])
    sizes = m.first_tables(np.array([100, 100, 100]), np.array([5, 5, 5]), np.full(3, 0.1), 0.5, rng)
    assert [s.sum() for s in sizes] == [100] * 3
    sizes = m.one_by_one(sizes, want, np.array([5, 5, 5]), np.full(3, 0.1), 0.5, rng)
    assert [s.sum() for s in sizes] == want.tolist() and all((s > 0).all() for s in sizes)


def test_probabilities_sum_to_one_and_scores_are_theirs(spark):
    """A chain over two buckets: in every context, P of all known words and of the rest's spelling make one; a score is the sum of the averaged logarithms."""
    rng = np.random.default_rng(1)
    words = [b"a", b"b", b"abc", b"zz", b""]
    lines = [[words[int(k)] for k in rng.integers(0, 4, 30)] + [b""] for _ in range(20)]
    pair = Counter(p for line in lines for p in itertools.pairwise([b"", *line]))
    rows = [(i, b" ".join(line[:-1]).decode(), None, None) for i, line in zip((i for i in itertools.count() if not _out(i)), lines)]
    probe = next(i for i in itertools.count(1000) if _out(i))
    rows += [(probe, "b a new abc", None, None)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    made = d.mapInArrow(m._blocks(2, 10), "block long, bucket long, data binary")
    chain = m.Sampler(made.where("bucket >= 0"), 2, 5)
    mean = Counter()
    for swept in range(4):
        chain.sweep()
        state = {r.bucket: r.data for r in chain.state.collect()}
        fixed = {r.bucket: r.data for r in chain.fixed.collect()}
        told = chain.tables.toPandas()
        totals = chain.totals
        bucket = {b: m.Bucket.of(bytes(x)) for b, x in fixed.items()}
        tables, seated = Counter(), Counter()
        for b, x in bucket.items():
            x.take(bytes(state[b]))
            total = m._totals_of(told[told["bucket"] == b], 1)[0]
            for name, t, c in zip(x.contexts.tolist(), total.tolist(), x.seated.tolist()):
                tables[name], seated[name] = t, c
        dish, own = {}, Counter()
        for x in bucket.values():
            for w, u, c, t in zip(x.word, x.context, x.count, x.levels[0].tables):
                dish[int(x.contexts[u]), x.words[w]] = (int(c), int(t))
                own[int(x.contexts[u])] += int(t)
        assert {k: c for k, (c, _) in dish.items()} == {(m._context(u), w): n for (u, w), n in pair.items()}
        assert all(tables[u] == n for u, n in own.items())
        assert all(seated[m._context(u)] == sum(n for (a, _), n in pair.items() if a == u) for u in words)
        d2, d1, d0 = totals["d"]
        root, group = {}, {}
        for x in bucket.values():
            one, zero = x.customers()
            spelt = totals["spelling"].of(x.codes, x.starts)
            for k, w in enumerate(x.words):
                root[w] = (zero[k] - d0 * x.levels[2].tables[k] + (1 + d0 * totals["T0"]) * spelt[k]) / (1 + totals["C0"])
            for k, g in enumerate(x.group.tolist()):
                group[g & 65535, x.words[g >> 16]] = one[k] - d1 * x.levels[1].tables[k]

        def p(u, w):
            g = m._context(u) & 65535
            spelt = totals["spelling"].of(*m._codes([w]))[0]
            under = root.get(w, (1 + d0 * totals["T0"]) / (1 + totals["C0"]) * spelt)
            under = (group.get((g, w), 0.0) + (1 + d1 * totals["T1"][g]) * under) / (1 + totals["C1"][g])
            c, t = dish.get((m._context(u), w), (0, 0))
            return (c - d2 * t + (1 + d2 * tables[m._context(u)]) * under) / (1 + seated[m._context(u)])

        for u in (b"", b"a", b"b", b"new"):
            known = sum(p(u, w) for w in words)
            rest = sum(p(u, bytes([c])) for c in range(33, 256) if bytes([c]) not in words)
            assert 0.5 < known < 1 and known + rest <= 1 + 1e-9
        if swept >= 2:
            for u, w in itertools.pairwise([b"", b"b", b"a", b"new", b"abc", b""]):
                mean[u, w] += p(u, w) / 2
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        got = {r.doc_id: r.score for r in m.hpy_scores(d, burn_in=2, samples=2, seed=5).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[probe] == pytest.approx(sum(math.log10(x) for x in mean.values()), rel=1e-5)


def test_blocks_lie_on_disk_once(spark):
    """What is dealt once is read where its checkpoint lies: nothing is cached beside it, nor dealt again for the answers."""
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    out = m.hpy_scores(docs(spark, texts(200)).repartition(3))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "InMemory" not in plan and spark.sparkContext._jsc.getPersistentRDDs().size() == held
    assert plan.count("Exchange hashpartitioning") == 1  # of the answers to their blocks
