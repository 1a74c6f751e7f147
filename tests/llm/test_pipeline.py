"""Every stage against a brute-force version, on odd rows whose other columns clash with the operators' own."""

import zlib
from collections import Counter

import corpus_pipeline as p
import numpy as np
import public_tokenizers
from odd import docs, texts
from pyspark.sql import functions as F
from test_mixing import plain_mix
from tokenizers import Tokenizer

from tidemark.llm import quality_crf


def _ids(df):
    return Counter(r.doc_id for r in df.collect())


def test_quality_stage(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("row", F.lit(1)).withColumn("score", F.lit("x")).withColumn("k", F.lit(2))
    kept = p.quality(spark, d, sf_dir)
    assert kept.columns == d.columns
    model = quality_crf.fit(d.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    rows = d.select("doc_id", "text").collect()
    scores = quality_crf.document_scores([r.text for r in rows], *model)
    assert _ids(kept) == Counter(r.doc_id for r, s in zip(rows, scores) if s >= quality_crf.THRESHOLD)
    odd = docs(spark)
    assert p.quality(spark, odd, sf_dir).columns == odd.columns
    assert p.quality(spark, odd.limit(0), sf_dir).collect() == []


def test_dedup_stage(spark, sf_dir):
    rows = texts()
    d = docs(spark)
    kept = p.dedup(spark, d.repartition(5), sf_dir)
    assert kept.columns == d.columns
    best: dict = {}
    for i, t, *_ in rows:
        old = best.get(t or "")
        best[t or ""] = i if old is None or (i is not None and i > old) else old
    assert Counter((r.text or "", r.doc_id) for r in kept.collect()) == Counter(best.items())
    assert p.dedup(spark, docs(spark, []), sf_dir).collect() == []


def test_mixing_stage(spark, sf_dir):
    rows = texts()
    d = docs(spark, rows)
    mixed = p.mixing(spark, d.repartition(5), sf_dir)
    assert mixed.columns == d.columns
    want = Counter()
    for (i, *_), copies in zip(rows, plain_mix(rows)):
        want[i] += copies
    assert _ids(mixed) == +want
    assert p.mixing(spark, docs(spark, []), sf_dir).collect() == []


def test_packing_stage(spark, sf_dir):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = texts()
    packed = p.packing(spark, docs(spark, rows).repartition(5), sf_dir).collect()
    want = Counter()
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, len(ids), 1024):
            want[i, at, len(ids[at : at + 1024]), zlib.crc32(ids[at : at + 1024].tobytes())] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed) == want
    filled = Counter()
    for r in packed:
        filled[r.sequence_id] += r.length
    room = sum(n if n & (n - 1) == 0 else 1024 for n in filled.values())
    assert max(filled.values()) <= 1024 and sum(filled.values()) / room > 0.95
    assert p.packing(spark, docs(spark, []), sf_dir).collect() == []


def test_near_dedup_odd_rows(spark, sf_dir):
    d = docs(spark)
    kept = p.near_dedup(spark, d, sf_dir)
    assert kept.columns == d.columns
    got = _ids(kept)
    assert got[None] == sum(i is None for i, *_ in texts())
    assert got[3] == 2 and 60 not in got and 61 not in got and 62 not in got  # copies of a text, and one with a space more
    assert p.near_dedup(spark, docs(spark, []), sf_dir).collect() == []


def test_run(spark, sf_dir):
    """The stages one after the other are what run gives."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in p.STAGES:
        d = spark.createDataFrame(stage(spark, d, sf_dir).collect(), stage(spark, d, sf_dir).schema)
    names = ["doc_id", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, d.select(*names).collect())) == Counter(map(tuple, p.run(spark, sf_dir).select(*names).collect()))


def test_near_dedup_is_jaccard(spark, sf_dir):
    """Links of all degrees about 0.8, one large group of near copies around a text, and texts with a passage in common."""
    import random

    r = random.Random(4)
    word = lambda: f"w{r.randrange(5000)}"
    passage = [word() for _ in range(30)]
    lines = []
    for k in range(25):
        base = [word() for _ in range(r.choice([3, 5, 12, 60, 200]))] + (passage if k % 3 == 0 else [])
        lines.append(base)
        for changes in range(1, 6):
            copy = list(base)
            for _ in range(changes):
                copy[r.randrange(len(copy))] = word()
            lines.append(copy)
    big = [word() for _ in range(150)]
    for _ in range(80):
        copy = list(big)
        for _ in range(r.randrange(1, 5)):
            copy[r.randrange(len(copy))] = word()
        lines.append(copy)
    r.shuffle(lines)
    rows = [(i, " ".join(x), None, None) for i, x in enumerate(lines)]

    grams = [{tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} for x in lines]
    low = list(range(len(lines)))
    def find(i):
        while low[i] != i:
            i = low[i]
        return i
    for i in range(len(lines)):
        for j in range(i):
            if 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]):
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
    want = {i for i in range(len(lines)) if find(i) == i}
    assert len(want) < len(lines) - 60
    assert {x.doc_id for x in p.near_dedup(spark, docs(spark, rows).repartition(5), sf_dir).collect()} == want


def test_batches_are_small_for_a_while(spark):
    from tidemark.llm.base import small_batches

    name, d = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.range(0, 5000, 1, 1)
    sizes = lambda: [r.n for r in d.mapInPandas(lambda frames: (f.iloc[:1].assign(n=len(f))[["n"]] for f in frames), "n long").collect()]
    before = spark.conf.get(name)
    with small_batches(spark, 500):
        assert max(sizes()) == 500
    assert spark.conf.get(name) == before


def test_shingles_are_gone_over_once(spark, monkeypatch):
    """Where texts are shown to a large group, the shingles of all other texts aren't written anew."""
    import random

    from tidemark.llm import simhash

    r = random.Random(5)
    some = lambda n: [f"w{r.randrange(9000)}" for _ in range(n)]
    big, lines = some(100), []
    for _ in range(80):
        copy = list(big)
        copy[r.randrange(100)] = some(1)[0]
        lines.append(copy)
    lines.append(big[:60] + some(60))
    for _ in range(100):
        passage = some(60)
        lines += [passage + some(40), some(40) + passage]
    sizes, real = [], simhash.cut

    def cut(df):
        out = real(df)
        if {"key", "e", "at"} <= set(out.columns) and "hub" not in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(simhash, "cut", cut)
    rows = [(i, " ".join(x), None, None) for i, x in enumerate(lines)]
    out = simhash.near_texts(docs(spark, rows)).collect()
    assert {x.component_id for x in out if x.doc_id < 80} == {0} and len({x.component_id for x in out}) == 202
    assert len(sizes) > 2 and sum(n > max(sizes) / 2 for n in sizes) == 2  # at first, and when pairs are made
