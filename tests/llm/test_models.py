"""Packing, language, language model and quality: round trips, brute force and held-out accuracy."""

import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from odd import docs, texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import language_id, queries, quality_crf
from tidemark.llm.packing import pack


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing_round_trip(spark, tokenizer):
    rows = texts() + [(900, "q <|endoftext|> r  <|endoftext|>", "en", "web"), (901, " " * 2_000_000 + "x", "en", "web")]
    got = pack(docs(spark, rows), window=256).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, len(ids), 256):
            want[i, at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert pack(docs(spark, [])).collect() == []


@pytest.mark.parametrize("word", ["tion", "a☃b", "über"])
def test_segmentations_are_summed(word):
    """The forward algorithm against an enumeration of all ways to cut a word, and expected counts against their derivatives."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    number = {p: k for k, p in enumerate(p for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) for p in [sp.id_to_piece(i)])}
    word = language_id.MARK + word
    prob = np.random.default_rng(2).random((len(number) + 1, 1)) / len(number)
    total, uses = 0.0, Counter()
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        ends = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        pieces = [word[a:b] for a, b in itertools.pairwise(ends)]
        if all(p in number or len(p) == 1 for p in pieces):
            ks = [number.get(p, len(number)) for p in pieces]
            p = math.prod(prob[k, 0] for k in ks)
            total += p
            for k in ks:
                uses[k] += p
    lattice = language_id.Lattice(["▁x", word, "▁yes"], None)
    assert lattice.forward(prob)[1, 0] == pytest.approx(math.log(total))
    got = lattice.expected(prob, np.array([0.0, 1.0, 0.0]))
    assert {k: got[k] for k in uses} == pytest.approx({k: p / total for k, p in uses.items()})
    assert got.sum() == pytest.approx(sum(uses.values()) / total)


def test_long_words_are_not_cut():
    """A word of thousands of characters against the plain recursion in logarithms."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    number = {p: k for k, p in enumerate(p for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) for p in [sp.id_to_piece(i)])}
    rng = np.random.default_rng(5)
    prob = rng.random((len(number) + 1, 2)) * [1e-4, 1e-6]
    words = [language_id.MARK + "".join(rng.choice(list("abcdeёש中☃")) for _ in range(n)) for n in (3, 40, 3000)]
    got = language_id.Lattice(words, None).forward(prob)
    for w, row in zip(words, got):
        for lang in range(2):
            f = [0.0]
            for j in range(1, len(w) + 1):
                terms = [f[i] + math.log(prob[number.get(w[i:j], len(number)), lang]) for i in range(max(0, j - 40), j) if w[i:j] in number or i == j - 1]
                top = max(terms)
                f.append(top + math.log(sum(math.exp(t - top) for t in terms)))
            assert row[lang] == pytest.approx(f[-1])


def test_language_cases(spark):
    d = docs(spark)
    model = language_id.fit(d)
    answers = language_id.predict(d, model).collect()
    assert Counter(r.doc_id for r in answers) == Counter(i for i, *_ in texts())
    got = {r.doc_id: r for r in answers if r.doc_id is not None}
    assert got[63].lang_pred == got[64].lang_pred == got[65].lang_pred == got[69].lang_pred == "und"  # null, empty, blank, digits
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und") for r in got.values())
    nothing = language_id.fit(d.limit(0))
    assert {r.lang_pred for r in language_id.predict(d, nothing).collect()} == {"und"}
    assert language_id.predict(d.limit(0), model).collect() == []


def test_held_out_accuracy(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs = queries.op7_language_id(spark, sf_dir).where("held_out").join(d.where("lang is not null"), "doc_id")
    right, n = langs.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 10 and right / n > 0.9
    quality = queries.op10_quality(spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    right, n = quality.agg(F.sum((F.col("quality") == F.col("predicted")).cast("int")), F.count("*")).first()
    assert n > 5 and right / n > 0.85


def test_marginals():
    """Forward-backward against an enumeration of all labellings."""
    rng = np.random.default_rng(4)
    score, step, length = rng.standard_normal((2, 4)), rng.standard_normal((2, 2)), np.array([4, 2])
    good, _, log_z = quality_crf.marginals(score, step, length)
    for d, n in enumerate(length):
        weight = {y: math.exp(sum(score[d, i] * y[i] for i in range(n)) + sum(step[y[i], y[i + 1]] for i in range(n - 1))) for y in itertools.product([0, 1], repeat=int(n))}
        z = sum(weight.values())
        assert log_z[d] == pytest.approx(math.log(z))
        for i in range(n):
            assert good[d, i] == pytest.approx(sum(w for y, w in weight.items() if y[i]) / z)


def test_quality_cases(spark):
    d = docs(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, 0, 0), (None, 1, 0), (5, None, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_crf.score(d, quality_crf.fit(d, labels), score_col="q").collect()
    assert len(got) == d.count() and all(0 <= r.q <= 1 for r in got)
    assert {r.q for r in quality_crf.score(d, quality_crf.fit(d, labels.limit(0)), score_col="q").collect()} == {0.5}
    assert quality_crf.score(d.limit(0), (None, 0.5)).collect() == []
