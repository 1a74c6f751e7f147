"""SimHash near-duplicates with a pigeonring filter.

A fingerprint has 64 bits, cut into a ring of segments. If two fingerprints
differ in at most d bits, then from some segment on every chain of l consecutive
segments of m differs in at most l * d / m bits. With d = 2 and m = 3 the chain
has no difference in its first segment, at most one in its first two, at most
two in all three.

``near_duplicates`` links fingerprints of up to two different bits. Its index is
the chain of two segments: an entry stands under its own two segments, and under
those with one bit of the second flipped; candidates are entries of which one
stands there as it is. Where more than ``CROWD`` entries share such a chain, the
chain goes on over the third segment in the same way, which closes the ring: all
entries that meet there are within two bits, so a star links them. So no group
is compared pair by pair, and no link is lost. Rows with the same fingerprint
are one entry.

``near_texts`` links texts that have `least` of all their shingles in common
(0.8). Two such texts differ in some 10 of 64 bits, and no index over so short a
fingerprint finds that many. So its candidates are texts that share a shingle
among the rarest n - ceil(least * n) + 1 of each (n: its distinct shingles), as
any two such texts do. The order, rarest first, comes from a bounded sample and
changes what is compared, never what is found. Candidates are pruned by
pigeonring, too, over counts instead of bits: a set's hashes are counted by
``CELLS`` cells, the cells are cut into a ring of segments, and what two sets
differ by in the cells is at most what they differ by at all, (1 - least) / (1 +
least) of both their sizes. So from some segment on every chain around the ring
stays within its share of that; no pair of the similarity is lost. Only texts of
pairs that are left travel, to be decided by their whole sets. Every text is
first compared with a few texts (``HUBS``) that stand for its shingles, which
joins most of a large group in a linear number of comparisons; then all
candidates that are not joined yet are compared. Those of a group that is large
by then are not paired off: its counts are dealt in blocks, every text that has a
shingle in common with it and is no part of it is shown to each block, and what
leaves a block is first the nearest of it, and then, for texts that this did not
join, all that the budgets allow. A text is named by 64 bits of
hash; names that two texts share (told apart by 128 bits more) are given anew.

Defined cases: null text counts as empty; no words give fingerprint zero, linked
like any other; fewer words than a shingle are one shingle; a null id can link
but is never a component's id unless all are null; repeated rows each get an
answer; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import components, cut, free, small_batches

#: (low bit, bits) of each segment of the ring.
RING = ((0, 21), (21, 21), (42, 22))
DIFFER = 2
CROWD = 64
SEED = 42
#: Of near_texts: texts of the sample, shingles it is asked for, stand-ins a text is compared with, and what is broadcast at most: shared shingles, ids of texts.
SAMPLE, COMMON, HUBS, SENT, SENT_IDS = 5_000, 200_000, 4, 100_000, 1_000_000
LEAST = Fraction(4, 5)
#: Texts of a group from which on it is dealt in blocks, and of a block.
LARGE, BLOCK = 64, 2000
#: Cells by which a set's hashes are counted, and the segments of their ring.
CELLS, SEGMENTS = 256, 8
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _fingerprint(hashes: Iterator[np.ndarray], n: int) -> int:
    """The bits that are set in over half of n hashes, as a signed integer."""
    one = np.zeros(64, np.int64)
    for h in hashes:
        one += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((one * 2 > n).astype(np.uint8), bitorder="little").view("<i8")[0])


def simhash(text: str | None, words: int) -> int:
    """The fingerprint of a text, as a signed 64-bit integer."""
    found = _WORD.findall((text or "").encode().lower())  # bytes: only A-Z change
    if not found:
        return 0
    line = b" ".join(found)
    size = min(words, len(found))
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends[: len(found) - size])).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = (  # a very long text goes by in pieces
        np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536])), np.uint64)
        for at in range(0, len(starts), 65536)
    )
    return _fingerprint(hashes, len(starts))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, fp)."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, words) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), of(F.col(text_col)).alias("fp"))


def _long(x: int):
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def _bits(low: int, bits: int) -> int:
    return ((1 << bits) - 1) << low


def _chains() -> list[tuple[int, int, list[int], list[int]]]:
    """For each start: the mask of the first two segments, a mark in the third, and the single bits of the second and third."""
    out = []
    for i in range(3):
        first, second, third = (RING[(i + j) % 3] for j in range(3))
        single = [[1 << (low + k) for k in range(n)] for low, n in (second, third)]
        out.append((_bits(*first) | _bits(*second), (i + 1) << third[0], *single))
    return out


def links(entries: DataFrame) -> DataFrame:
    """(a, b): enough pairs of different fingerprints within two bits to reach all that all such pairs reach."""
    fp, chains = F.col("fp"), _chains()
    name = lambda mask, mark: fp.bitwiseAND(_long(mask)).bitwiseOR(_long(mark))
    whole = entries.select("fp", F.explode(F.array(*[name(m, k) for m, k, *_ in chains])).alias("chain"))
    flipped = entries.select("fp", F.explode(F.array(*[name(m, k).bitwiseXOR(_long(b)) for m, k, second, _ in chains for b in second])).alias("chain"))
    flipped = flipped.join(whole.select("chain").distinct(), "chain", "left_semi")
    met = whole.withColumn("flip", F.lit(False)).unionByName(flipped.withColumn("flip", F.lit(True)))
    sizes = met.groupBy("chain").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(met.join(sizes, "chain"))

    few = met.where(F.col("n") <= CROWD)
    a = few.where("not flip").select("chain", F.col("fp").alias("a"))
    b = few.select("chain", F.col("fp").alias("b"), "flip")
    pairs = a.join(b, "chain").where("flip or a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DIFFER)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    # which start a crowded chain has is told by its mark; entries that are whole so far may still differ by one bit each
    third = F.lit(None)
    for m, k, _, bits in chains:
        mine = F.col("chain").bitwiseAND(_long(~m & (2**64 - 1))) == _long(k)
        rest = fp.bitwiseAND(_long(~m & (2**64 - 1)))
        third = F.when(mine, F.when(F.col("flip"), F.array(rest)).otherwise(F.array(rest, *[rest.bitwiseXOR(_long(b)) for b in bits]))).otherwise(third)
    closed = met.where(F.col("n") > CROWD).select("fp", "chain", F.explode(third).alias("rest"))
    ring = Window.partitionBy("chain", "rest")  # at most 45 entries
    stars = closed.withColumn("hub", F.min("fp").over(ring)).where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id; linked at two different bits or fewer."""
    prints = cut(fingerprints(docs, id_col, text_col, words))
    entries = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = components(links(entries))
    of = entries.join(joined.withColumnRenamed("node", "fp"), "fp", "left")
    of = of.select("fp", "first", F.coalesce("component", "fp").alias("component"))
    low = of.groupBy("component").agg(F.min("first").alias("component_id"))
    of = of.join(low, "component").select("fp", "component_id")
    # a hot fingerprint is one row on the right; adaptive execution splits its rows on the left
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- texts of a similarity ----------------------------------------------------------------------------------


class _Words(dict):
    """Hashes of words, kept while there are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


_words = _Words()
_ODD = [int(x) | 1 for x in np.random.default_rng(SEED).integers(0, 1 << 64, 256, dtype=np.uint64)]


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted hashes of the distinct shingles of a text, of 64 bits each."""
    found = _WORD.findall((text or "").encode().lower())
    if not found:
        return np.zeros(1, np.int64)
    w = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    size = min(words, len(found))
    h = np.zeros(len(found) - size + 1, np.uint64)
    for j in range(size):
        h += w[j : j + len(h)] * np.uint64(_ODD[j])
    h ^= h >> np.uint64(32)
    h *= np.uint64(_ODD[-1])
    h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def cells_of(h: np.ndarray) -> np.ndarray:
    """How many of a set's hashes fall into each cell; 255 stands for as many or more, too."""
    return np.minimum(np.bincount((h.view(np.uint64) >> np.uint64(56)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8)


def in_a_chain(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, least: Fraction) -> np.ndarray:
    """Whether two sets, by their counts and sizes, may have this similarity: from some segment on, all chains around the ring are within their budgets.

    Counts that stop at 255 differ by no more than the whole ones.
    """
    differ = np.abs(a.astype(np.int16) - b).reshape(len(a), SEGMENTS, -1).sum(2, dtype=np.int64)
    up, down = least.denominator - least.numerator, least.denominator + least.numerator
    budget = (n + m)[:, None] * up * np.arange(1, SEGMENTS + 1)
    ring, found = np.concatenate([differ, differ], 1) * SEGMENTS * down, np.zeros(len(a), bool)
    for i in range(SEGMENTS):
        found |= (ring[:, i : i + SEGMENTS].cumsum(1) <= budget).all(1)
    return found


def _matrix(cells) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), np.uint8).reshape(-1, CELLS)


def _counts(asked: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(e, n, cells): sizes and counts of the sets of these texts. asked: e."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                sets = [shingles(t.as_py(), words) for t in some.column("text")]
                yield pa.RecordBatch.from_arrays([some.column("e"), pa.array([len(h) for h in sets], pa.int64()), pa.array([cells_of(h).tobytes() for h in sets], pa.binary())], names=["e", "n", "cells"])

    return cut(texts.join(asked, "e", "left_semi").mapInArrow(count, "e long, n long, cells binary").dropDuplicates(["e"]))


def _against_large(shown: DataFrame, members: DataFrame, counts: DataFrame, least: Fraction, nearest: bool) -> DataFrame:
    """(a, b): shown texts with the members of a group that they may be similar to; of each block only the nearest, if asked.

    shown: (e, large); members: (e, large). Both sides are dealt in blocks, so a task holds two.
    """
    many = lambda rows, name: rows.groupBy("large").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    dealt = many(members, "blocks").join(many(shown, "parts"), "large")
    own = lambda c: F.pmod(F.xxhash64("e"), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    theirs = members.join(dealt, "large").select("e", "large", own("blocks").alias("block"), each("parts").alias("part"), F.lit(False).alias("asks"))
    mine = shown.join(dealt, "large").select("e", "large", each("blocks").alias("block"), own("parts").alias("part"), F.lit(True).alias("asks"))
    rows = mine.unionByName(theirs).join(counts, "e")

    def compare(table: pa.Table) -> pa.Table:
        asks, e, n = (table.column(k).to_numpy() for k in ("asks", "e", "n"))
        cells, out = _matrix(table.column("cells")), []
        other = np.flatnonzero(~asks)
        for i in np.flatnonzero(asks) if len(other) else ():
            near = other[in_a_chain(np.broadcast_to(cells[i], (len(other), CELLS)), np.broadcast_to(n[i], len(other)), cells[other], n[other], least)]
            if nearest and len(near):
                differ = np.abs(cells[near].astype(np.int16) - cells[i]).sum(1, dtype=np.int64)
                near = near[[int((differ / (n[near] + n[i])).argmin())]]
            out.append(np.stack([np.full(len(near), e[i]), e[near]]))
        a, b = np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return cut(rows.groupBy("large", "block", "part").applyInArrow(compare, "a long, b long").distinct())


def _similar(pairs: DataFrame, texts: DataFrame, words: int, least: Fraction) -> DataFrame:
    """Of pairs (a, b), those of similarity `least` or more. texts: (e, text)."""

    def ends(some: DataFrame) -> DataFrame:
        asked = some.select(F.explode(F.array("a", "b")).alias("e")).distinct()
        return F.broadcast(asked) if 2 * some.count() <= SENT_IDS else asked

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                held = in_a_chain(_matrix(batch.column("s")), batch.column("n").to_numpy(), _matrix(batch.column("t")), batch.column("m").to_numpy(), least)
                yield batch.select(["a", "b"]).filter(pa.array(held))

    counts = _counts(ends(pairs), texts, words)
    both = pairs.join(counts.select(F.col("e").alias("a"), "n", F.col("cells").alias("s")), "a").join(counts.select(F.col("e").alias("b"), F.col("n").alias("m"), F.col("cells").alias("t")), "b")
    near = cut(both.select("a", "b", "n", "m", "s", "t").mapInArrow(prune, "a long, b long"))
    some = texts.join(ends(near), "e", "left_semi").groupBy("e").agg(F.first("text").alias("text"))
    both = near.join(some.select(F.col("e").alias("a"), F.col("text").alias("s")), "a").join(some.select(F.col("e").alias("b"), F.col("text").alias("t")), "b")

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, np.ndarray] = {}

        def set_of(e: int, text: str) -> np.ndarray:
            if e not in kept:
                if len(kept) > 500:
                    kept.clear()
                kept[e] = shingles(text, words)
            return kept[e]

        for frame in frames:
            found = []
            for a, b, s, t in zip(frame["a"], frame["b"], frame["s"], frame["t"]):
                p, q = set_of(a, s), set_of(b, t)
                common = len(np.intersect1d(p, q, assume_unique=True))
                found.append(common * least.denominator >= (len(p) + len(q) - common) * least.numerator)
            yield frame.loc[np.array(found, bool), ["a", "b"]]

    return cut(both.mapInPandas(decide, "a long, b long"))


def _named(docs: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    """(doc_id, e, text): rows with a number e of each different text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    e = F.xxhash64(text) if bits == 64 else F.pmod(F.xxhash64(text), F.lit(1 << bits))
    rows, n = docs.select(F.col(id_col).cast("long").alias("doc_id"), e.alias("e"), text.alias("text")), 0
    while True:
        told = rows.select("e", F.md5(F.col("text").cast("binary")).alias("m")).distinct()
        twice = cut(told.groupBy("e").agg(F.count("*").alias("n")).where("n > 1").select("e"))
        many, n = twice.count(), n + 1
        if not many:
            return rows
        marked = F.broadcast(twice) if many <= SENT else twice
        again = F.xxhash64("e", F.md5(F.col("text").cast("binary")), F.lit(n))
        rows = rows.join(marked.withColumn("twice", F.lit(True)), "e", "left").select("doc_id", F.when(F.col("twice"), again).otherwise(F.col("e")).alias("e"), "text")


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: Fraction = LEAST, bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, component_id. bits: width of the names that texts get at first."""
    with small_batches(docs.sparkSession, 500):
        return _near_texts(docs, id_col, text_col, words, least, bits)


def _near_texts(docs: DataFrame, id_col: str, text_col: str, words: int, least: Fraction, bits: int) -> DataFrame:
    spark = docs.sparkSession
    rows = _named(docs, id_col, text_col, bits)
    texts = rows.select("e", "text")

    @F.pandas_udf("array<long>")
    def sets(found: pd.Series) -> pd.Series:
        return found.map(lambda t: shingles(t, words))

    share = max(1, rows.count() // SAMPLE)
    common = (
        texts.where(F.pmod(F.xxhash64("e"), F.lit(share)) == 0).select(F.explode(sets("text")).alias("key"))
        .groupBy("key").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "key").limit(COMMON).toPandas().sort_values("key")
    )
    sent = spark.sparkContext.broadcast((common["key"].to_numpy(np.int64), common["n"].to_numpy(np.int64)))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = sent.value
        for batch in batches:
            ids, found = batch.column("e").to_numpy(), batch.column("text")
            for at in range(0, len(ids), 200):
                e, at_of, keys = [], [], []
                for k in range(at, min(at + 200, len(ids))):
                    h = shingles(found[k].as_py(), words)
                    if len(known):
                        place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        h = h[np.argsort(np.where(known[place] == h, often[place], 0), kind="stable")]
                    first = len(h) - math.ceil(least * len(h)) + 1
                    e.append(np.full(first, ids[k], np.int64))
                    at_of.append(np.arange(first, dtype=np.int64) | len(h) << 32)
                    keys.append(h[:first])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, e, at_of)], names=["key", "e", "at"])

    # at: the size of the text's set, and in the lower 32 bits the shingle's place in it
    first = texts.mapInArrow(prefixes, "key long, e long, at long")
    # a key that many texts share is one row here, and the join below splits its rows
    hubs = cut(first.groupBy("key").agg(F.min("e").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub"))
    free(spark)
    shared = cut(first.join(F.broadcast(hubs) if hubs.count() <= SENT else hubs, "key"))
    free(spark)

    up, down = least.numerator, least.denominator + least.numerator

    def possible(p, q):
        """Whether what follows a common shingle is enough; true of the first common one of any similar pair."""
        n, m = F.shiftright(p, 32), F.shiftright(q, 32)
        low = F.lit(0xFFFFFFFF).cast("long")
        return F.lit(down) * F.least(n - p.bitwiseAND(low), m - q.bitwiseAND(low)) >= F.lit(up) * (n + m)

    order = Window.partitionBy("e").orderBy(F.desc("n"), "hub")
    stand = shared.where("e = hub").groupBy("key").agg(F.first("at").alias("hub_at"))
    stars = shared.where("e <> hub").join(stand, "key").where(possible(F.col("at"), F.col("hub_at"))).groupBy("e", "hub").agg(F.count("*").alias("n"))
    stars = stars.withColumn("k", F.row_number().over(order)).where(F.col("k") <= HUBS)
    stars = cut(stars.select(F.least("e", "hub").alias("a"), F.greatest("e", "hub").alias("b")).distinct())
    near = _similar(stars, texts, words, least)
    free(spark)
    joined = components(near).select(F.col("node").alias("e"), "component")

    def now(some: DataFrame, joined: DataFrame) -> DataFrame:
        """Rows of shingles with the group (c) that each text is in by now."""
        return some.join(joined, "e", "left").withColumn("c", F.coalesce("component", "e")).drop("component")

    def apart(joined: DataFrame) -> DataFrame:
        """The shingles' texts (key, e, at) where they are of several groups."""
        left = now(shared.drop("hub"), joined)
        several = left.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
        return cut(shared.drop("hub").join(several, "key", "left_semi").distinct())

    def shown(left: DataFrame, joined: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(e, large): texts that share a shingle with a large group that is not theirs, nor smaller than theirs; and all large groups' members."""
        sizes = cut(joined.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") > LARGE))
        members = cut(joined.join(sizes.select("component"), "component", "left_semi").select("e", F.col("component").alias("large")))
        # what stands under no shingle of a large group isn't looked at again
        near_one = left.join(left.join(members, "e", "left_semi").select("key").distinct(), "key", "left_semi")
        own = now(cut(near_one), joined).join(sizes.withColumnRenamed("component", "c"), "c", "left").withColumn("size", F.coalesce("size", F.lit(1)))
        large = own.where(F.col("size") > LARGE).select("key", F.col("c").alias("large"), F.col("size").alias("of")).distinct()
        ask = own.join(large, "key").where((F.col("c") != F.col("large")) & (F.struct("size", "c") < F.struct(F.col("of").alias("size"), F.col("large").alias("c"))))
        return cut(ask.select("e", "large").distinct()), members

    left = apart(joined)
    del shared, apart
    free(spark)
    for nearest in (True, False):
        ask, inside = shown(left, joined)
        if ask.isEmpty():
            break
        members = inside.join(ask.select("large").distinct(), "large", "left_semi")
        counts = _counts(ask.select("e").unionByName(members.select("e")).distinct(), texts, words)
        found = _similar(_against_large(ask, members, counts, least, nearest), texts, words, least)
        near = cut(near.unionByName(found).distinct())
        del counts, found
        free(spark)
        joined = components(near).select(F.col("node").alias("e"), "component")
        free(spark)
    # groups only grow, so what was apart once is all that can be; those that were large when texts were last shown to them have been compared as a whole
    left = cut(now(left.join(inside.select("e"), "e", "left_anti"), joined))
    a = left.select("key", F.col("e").alias("a"), F.col("at").alias("ap"), F.col("c").alias("ac"))
    b = left.select("key", F.col("e").alias("b"), F.col("at").alias("bp"), F.col("c").alias("bc"))
    fits = possible(F.col("ap"), F.col("bp"))
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & (F.col("ac") != F.col("bc")) & fits).select("a", "b").distinct()
    more = _similar(cut(pairs.join(stars, ["a", "b"], "left_anti")), texts, words, least)
    joined = components(near.unionByName(more)).select(F.col("node").alias("e"), "component")

    out = cut(rows.select("doc_id", "e")).join(joined, "e", "left").select("doc_id", F.coalesce("component", "e").alias("component"))
    low = out.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return out.join(low, "component").select("doc_id", "component_id")
