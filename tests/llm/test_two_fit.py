"""Packing by best two fit: pieces against the tokenizer, bins against packing piece by piece."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd import docs, key, texts

from tidemark.llm.two_fit import pack_two_fit, plan


def _one_by_one(lengths, window):
    """Bins made one at a time over a list of single lengths."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        bin_, room = [], window
        for n in list(left):
            if n <= room:
                bin_.append(n)
                left.remove(n)
                room -= n
        gap = room + bin_[-1]
        if room and len(bin_) > 1:
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if bin_[-1] < a + b <= gap]
            if pairs:
                _, a, b = max(pairs)
                left.append(bin_.pop())
                left.sort(reverse=True)
                bin_ += [a, b]
                left.remove(a)
                left.remove(b)
        bins.append(tuple(sorted(bin_)))
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    r = random.Random(seed)
    window = r.choice([7, 16, 50, 100])
    lengths = [min(window, 1 + int(r.paretovariate(0.7)) if seed % 2 else r.randint(1, window)) for _ in range(r.randint(0, 90))]
    got = plan(Counter(lengths), window)
    bins = [tuple(sorted(Counter(b).elements())) for times, b in got for _ in range(times)]
    assert Counter(bins) == Counter(_one_by_one(lengths, window))
    assert sum((Counter(b) for b in bins), Counter()) == Counter(lengths)
    assert all(sum(b) <= window for b in bins)


def test_two_better_than_greedy():
    """60 + 30 leaves 10 empty; 60 + 21 + 19 fills the bin."""
    assert plan({60: 1, 30: 1, 21: 1, 19: 1}, 100)[0] == (1, {60: 1, 21: 1, 19: 1})


def test_plan_grows_with_lengths_only():
    r = random.Random(1)
    small = Counter(min(4096, 1 + int(r.lognormvariate(6, 1))) for _ in range(20_000))
    steps = [len(plan({n: c * f for n, c in small.items()}, 4096)) for f in (1, 1000, 10**6)]
    assert max(steps) < 4 * len(small)


@pytest.mark.parametrize("window", [16, 4096])
def test_pieces(spark, window):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = texts()
    odd = ["<|endoftext|>", "a<|startoftext|>b <|END", "it's 'tis we'll x", "é ́e", " wide line\x85next\x1c.", "don't.Stop,now", "a.'s!'tis,'ll.'d;x", "5.5,x:9 a.,b", "e.́ a≮.b!", "İstanbul ΣΑΣ ß ǅ", "  \t\n", "≮ 가"]
    rows += [(700 + i, t, None, None) for i, t in enumerate(odd)]
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for p, at in enumerate(range(0, len(ids), window)):
            part = ids[at : at + window]
            want[i, p, at, len(part), zlib.crc32(part.tobytes())] += 1
    got = pack_two_fit(docs(spark, rows).repartition(3), window=window).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= window
    assert len(bins) == len(_one_by_one([r.length for r in got], window))
    assert sorted((key(r.doc_id) for r in got if r.piece == 0)) == sorted(key(r[0]) for r in rows)


def test_empty(spark):
    assert pack_two_fit(docs(spark, [])).collect() == []


def test_whole_table(spark, sf_dir):
    """Every document's ids once, and hardly more bins than tokens need."""
    found = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = pack_two_fit(found).toPandas()
    assert got.doc_id.nunique() == found.count()
    first = got.sort_values(["doc_id", "piece"]).groupby("doc_id")
    assert (first.start.first() == 0).all() and (first.piece.count() == first.piece.max() + 1).all()
    assert (got[got.piece < got.doc_id.map(first.piece.max())].length == 4096).all()
    assert got.sequence_id.nunique() <= 1.02 * got.length.sum() / 4096 + 1
