"""Phrases against plain counting, and the automaton's states against their definition."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd import docs, texts

from tidemark.llm import phrases
from tidemark.llm.phrases import automaton, classes, collocations


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _plain(rows, depth, least, covered, top, scale=1000):
    count = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", _lower(text)):
            words = re.findall("[^ \t]+", piece)
            for size in range(1, depth + 1):
                count[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in count.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        have = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        kept = []
        for p, a in have.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and 100 * c >= covered * a and inside(q) for q, c in have.items()):
                continue
            score, k = min((scale * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, le, r, n, -s) for i, (s, a, p, le, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("depth,least,covered,top,bits", [(5, 3, 100, 2000, 27), (5, 3, 60, 7, 15), (3, 2, 100, 50, 15), (2, 4, 100, 5, 20)])
def test_phrases(spark, monkeypatch, depth, least, covered, top, bits):
    monkeypatch.setattr("tidemark.llm.words.BLOCK_BYTES", 700)  # in the driver only; workers take the usual size
    rows = texts()
    r = random.Random(8)
    rows += [(900 + i, r.choice(["New York city hall.", "new york, City Hall! I went", "in new\tyork city hall\nall at once", "\x0b\x0c;;", "à la carte à la carte"]) * r.randint(1, 3), r.choice(["en", "fr", None]), None) for i in range(40)]
    got = collocations(docs(spark, rows).repartition(5), depth=depth, least=least, covered=covered, top=top, bits=bits).collect()
    assert sorted(tuple(x) for x in got) == _plain([(x[1], x[2]) for x in rows], depth, least, covered, top)


def test_empty(spark):
    assert collocations(docs(spark, [])).collect() == []
    assert collocations(docs(spark, [(1, None, None, None), (2, " ;. ", "en", None)]), least=1).collect() == []


def test_crowded_bitmap_keeps_all(spark, monkeypatch):
    """Where all hashes are frequent, nothing is cut and results stay the same."""
    rows = texts(30)
    monkeypatch.setattr(phrases, "frequent_pairs", lambda d, least, bits: np.full(max(2**bits // 8, 4096), 255, np.uint8))
    got = collocations(docs(spark, rows), least=3).collect()
    assert sorted(tuple(x) for x in got) == _plain([(x[1], x[2]) for x in rows], 5, 3, 100, 2000)


def test_automaton():
    r = np.random.default_rng(3)
    symbol = r.integers(0, 4, 300)
    piece = np.sort(r.integers(0, 40, 300))
    depth = 4
    levels = automaton(symbol, piece, depth)
    ends = defaultdict(set)
    for end in range(300):
        for size in range(1, depth + 1):
            if end - size + 1 >= 0 and piece[end - size + 1] == piece[end]:
                ends[tuple(symbol[end - size + 1 : end + 1])].add(end)
    spelt = {}
    for size, level in enumerate(levels, 1):
        names = [tuple(symbol[e - size + 1 : e + 1]) for e in level.end]
        assert len(set(names)) == len(names)
        for s, name in enumerate(names):
            spelt[size, s] = name
            assert ends[name] == set(np.flatnonzero(level.at == s)) and level.count[s] == len(ends[name])
            if size > 1:
                assert spelt[size - 1, level.link[s]] == name[1:]
    assert set(spelt.values()) == set(ends)
    found = Counter()
    for size, states, shortest in classes(levels):
        for s, low in zip(states, shortest):
            name = spelt[size, s]
            for k in range(low, size + 1):  # one class: the same end positions
                assert ends[name[size - k :]] == ends[name]
                found[name[size - k :]] += 1
            if low > 2:  # and no shorter suffix of two or more belongs to it
                assert ends[name[size - low + 1 :]] != ends[name]
    assert found == Counter(dict.fromkeys(ends, 1))


def test_words_of_blocks():
    import pyarrow as pa

    from tidemark.llm import words

    texts_ = ["a b", None, "", "  B,c\ta ", "é  b", "x" * 50, ";"]
    got = words.words_of(pa.array(texts_), b" \t", b",;", lower=True)
    names = [x.decode() for x in got.names.to_pylist()]
    assert [(r, names[w]) for r, w in zip(got.row, got.word)] == [(0, "a"), (0, "b"), (3, "b"), (3, "c"), (3, "a"), (4, "é"), (4, "b"), (5, "x" * 50)]
    assert [bool(x) for x in np.diff(got.piece)] == [False, True, True, False, True, False, True]
    sliced = words.words_of(pa.array(texts_).slice(3, 2), b" \t", b",;")
    assert [sliced.names[int(w)].as_py() for w in sliced.word] == [b"B", b"c", b"a", "é".encode(), b"b"]
