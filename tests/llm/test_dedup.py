"""Exact and near duplicates against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from odd import docs, texts

from tidemark.llm import embedding_dedup
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.simhash import near_duplicates, simhash


def _components(n, linked):
    comp = list(range(n))
    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("fan_in,range_rows", [(2, 1 << 20), (8, 1 << 20), (2, 3)])
def test_exact(spark, keep, fan_in, range_rows):
    rows = texts()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    best = {t: (max if keep == "largest" else min)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    want = Counter((i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)
    got = exact_dedup(docs(spark).repartition(7), keep=keep, fan_in=fan_in, range_rows=range_rows).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_empty(spark):
    assert exact_dedup(docs(spark, [])).collect() == []


def _plain_simhash(text, words):
    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    found = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in found]
    if not found:
        return 0
    grams = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("words", [3, 5])
def test_fingerprint(words):
    for t in [None, "", "One", "one TWO", "a b c d e f g", "Ä b C d", "w " * 500]:
        assert simhash(t, words) & (2**64 - 1) == _plain_simhash(t, words)


def test_near_duplicates(spark):
    rows = [r for r in texts() if r[0] is not None]
    got = near_duplicates(docs(spark, rows).repartition(5), words=3).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    fp = [int(r.fingerprint, 16) for r in got]
    comp = _components(len(got), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 2)
    low = {}
    for r, c in zip(got, comp):
        low[c] = min(low.get(c, r.doc_id), r.doc_id)
    assert [r.component_id for r in got] == [low[c] for c in comp]


def test_near_duplicates_empty_and_null_ids(spark):
    assert near_duplicates(docs(spark, [])).collect() == []
    got = near_duplicates(docs(spark, [(None, "a b", None, None), (4, "a b", None, None), (None, "z", None, None)])).collect()
    assert sorted((repr(r.doc_id), repr(r.component_id)) for r in got) == [("4", "4"), ("None", "4"), ("None", "None")]


def test_links_of_a_crowded_chain(spark, monkeypatch):
    """Chains of two segments alone, and chains that go on over the third, give the components of all pairs within two bits."""
    from tidemark.llm import simhash as m
    from tidemark.llm.base import components

    rng = np.random.default_rng(3)
    bit = lambda: 1 << int(rng.integers(0, 64))
    fps = set()
    for _ in range(4):
        base = int(rng.integers(0, 1 << 64, dtype=np.uint64))
        fps |= {base} | {base ^ bit() ^ bit() for _ in range(60)} | {base ^ bit() ^ bit() ^ bit() ^ bit() for _ in range(60)} | {base ^ int(x) << 22 for x in rng.integers(1, 1 << 40, 20)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    entries = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(5)
    comp = _components(len(fps), lambda i, j: ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 2)
    for crowd in (64, 4, 1):
        monkeypatch.setattr(m, "CROWD", crowd)
        found = m.links(entries).collect()
        assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in found)
        got = {r.node: r.component for r in components(m.links(entries)).collect()}
        assert [got.get(f, f) for f in fps] == [fps[c] for c in comp]


def test_chains_prune_no_similar_pair():
    """Pairs of all similarities about 0.8, small sets and such as fill the cells: none that is similar goes, and far ones do."""
    from fractions import Fraction

    from tidemark.llm.simhash import LEAST, cells_of, in_a_chain

    rng = np.random.default_rng(6)
    a, b, like = [], [], []
    for size in (1, 2, 9, 10, 45, 200, 900, 5000, 100_000):
        for share in np.linspace(0.55, 1.0, 30 if size < 10_000 else 6):
            common = round(size * share)
            h = rng.integers(-(2**63), 2**63 - 1, 2 * size - common)
            p, q = np.unique(h[:size]), np.unique(np.concatenate([h[:common], h[size:]]))
            a.append(p)
            b.append(q)
            like.append(Fraction(len(np.intersect1d(p, q)), len(np.union1d(p, q))))
    got = in_a_chain(np.array([cells_of(x) for x in a]), np.array([len(x) for x in a]), np.array([cells_of(x) for x in b]), np.array([len(x) for x in b]), LEAST)
    assert all(g for g, x in zip(got, like) if x >= LEAST) and sum(x >= LEAST for x in like) > 80
    far = [g for g, x, p in zip(got, like, a) if x < 0.5 and 45 <= len(p) < 5000]
    assert len(far) > 10 and sum(far) < 0.2 * len(far)


def test_names_that_texts_share(spark):
    """With names of two bits nearly all texts share one, and are told apart all the same."""
    from tidemark.llm.simhash import near_texts

    rows = texts()
    want = sorted(map(repr, near_texts(docs(spark, rows)).collect()))
    assert sorted(map(repr, near_texts(docs(spark, rows), bits=2).collect())) == want
    whole = {r.doc_id for r in near_texts(docs(spark, rows)).collect()}
    assert whole == {r[0] for r in rows}


def test_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + rng.standard_normal(16) * 0.18).tolist()) for i in range(400)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), rows[5], (402, [2 * x for x in rows[7][1]]), (403, None), (404, [0.0] * 16), (405, [float("nan")] + [1.0] * 15), (406, [None] + [1.0] * 15), (407, []), (408, [1.0, 2.0]), (409, [float("inf")] * 16), (410, [1e300] * 16), (411, [2e300] * 16)]
    fine = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {}
    for i in fine:
        v = np.array(rows[i][1])
        v = v / np.abs(v).max()
        unit[i] = v / np.linalg.norm(v)
    linked = lambda i, j: i in unit and j in unit and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.95
    comp = _components(len(rows), linked)
    low = {}
    for (k, _), c in zip(rows, comp):
        low[c] = min(low.get(c, k), k)
    want = Counter((k, sum(linked(i, j) for j in range(len(rows)) if j != i), low[comp[i]]) for i, (k, _) in enumerate(rows))
    frame = spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<double>, c string, leaf int").repartition(5)
    for leaf in (1000, 40):  # in one leaf, and in blocks of many leaves
        got = embedding_dedup.near_vectors(frame, leaf=leaf)
        assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
        assert Counter((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == want
    assert embedding_dedup.near_vectors(frame.limit(0)).collect() == []


def test_vectors_where_the_sample_runs_out(spark):
    """Tight groups far larger than a leaf, in nodes of a few sampled vectors: 99 % of all links are found at least."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((4, 64)).repeat(150, 0) + rng.standard_normal((600, 64)) * 0.12
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    assert want.sum() > 80_000
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = embedding_dedup.near_vectors(frame, sample=24, leaf=20).select("vec_id", "n_links").collect()
    assert sum(r.n_links for r in got) >= 0.99 * want.sum()
    assert all(r.n_links <= want[r.vec_id] for r in got)


def test_texts_about_a_large_group(spark, monkeypatch):
    """A large group of near copies, outliers that a few of them only or none are like, and a second group that some bridge, at limits so low that all ways are taken."""
    import random
    from fractions import Fraction

    from tidemark.llm import simhash as m

    r = random.Random(9)
    word = lambda: f"w{r.randrange(4000)}"
    base = [word() for _ in range(120)]
    lines = []
    for changes in [*(r.randrange(1, 4) for _ in range(70)), *(r.randrange(4, 9) for _ in range(40))]:
        copy = list(base)
        for _ in range(changes):
            copy[r.randrange(len(copy))] = word()
        lines.append(copy)
    other = base[:70] + [word() for _ in range(50)]
    for _ in range(40):
        copy = list(other)
        copy[r.randrange(len(copy))] = word()
        lines.append(copy)
    lines += [[word() for _ in range(60)] + base[:20] for _ in range(10)]
    r.shuffle(lines)
    grams = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in lines]
    want = _components(len(lines), lambda i, j: Fraction(len(grams[i] & grams[j]), len(grams[i] | grams[j])) >= Fraction(4, 5))
    assert 12 < len(set(want)) < 100
    frame = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string").repartition(4)
    for large, block in ((64, 2000), (5, 7), (1, 3)):
        monkeypatch.setattr(m, "LARGE", large)
        monkeypatch.setattr(m, "BLOCK", block)
        got = {x.doc_id: x.component_id for x in m.near_texts(frame).collect()}
        assert [got[i] for i in range(len(lines))] == want
