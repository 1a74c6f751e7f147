"""Phrases whose words go together, by generalised suffix automata.

A shard (a block of texts) gets one automaton over the word sequences of all its
pieces, bounded in depth: a state is reached from the start by its words, its
suffix link leads to the state of the same words without the first, and its
endpos count says how often they occur. States that a left extension of equal
count ends, too, have the same end positions as it: they are one class, which
leaves the shard as a single row with its longest phrase and the length of its
shortest. Levels are built one after another by array operations, as all states
of a depth are transitions from the states one word shorter.

Counts of all shards are summed by phrase. A phrase that is frequent has frequent
word pairs only, so pairs are counted first, by a hash of fixed width, and what
the automata spell is cut between words whose pair can't be frequent. Pairs that
share a hash count together, which may keep a pair in vain, but never drops one.
The set of frequent hashes is a bitmap of 2**bits bits, whatever the corpus.

A candidate inside a longer one of the same (or nearly the same) count is
dropped: each candidate's prefixes, and behind each the chain of its suffix
links, are the phrases that it contains.

Defined cases: null text counts as empty, null lang as `und`; repeated rows count
again; an empty table gives an empty result; other columns are ignored, whatever
their names. Scores are exact: products are decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut
from .words import blocks, words_of

BREAKS = b".,;:!?\n\x0b\x0c\r"
SPACES = b" \t"
SALTS = 32


def _number(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, first, count): keys numbered by first occurrence, where each number first occurs, and how often."""
    ids = np.asarray(pa.array(keys).dictionary_encode().indices)
    n = int(ids.max(initial=-1)) + 1
    first = np.empty(n, np.int64)
    first[ids[::-1]] = np.arange(len(ids) - 1, -1, -1)
    return ids, first, np.bincount(ids, minlength=n)


@dataclass
class Level:
    """The automaton's states of one depth."""

    #: The state at each end position, -1 where none ends there.
    at: np.ndarray
    #: An end position of each state.
    end: np.ndarray
    #: How many end positions each state has.
    count: np.ndarray
    #: The state of the level before that a state's suffix link leads to.
    link: np.ndarray


def automaton(symbol: np.ndarray, piece: np.ndarray, depth: int, joined: np.ndarray | None = None) -> list[Level]:
    """The generalised suffix automaton of pieces of symbols, to this depth.

    `joined` says of each position whether its symbol may go on the one before it.
    """
    n = len(symbol)
    at, end, count = _number(symbol)
    levels = [Level(at, end, count, np.full(len(end), -1))]
    follows = np.zeros(n, bool)
    follows[1:] = piece[1:] == piece[:-1]
    if joined is not None:
        follows &= joined
    spot = np.flatnonzero(follows)
    for _ in range(1, depth):
        upper = levels[-1]
        spot = spot[(upper.at[spot - 1] >= 0) & (upper.at[spot] >= 0)]
        ids, first, count = _number(upper.at[spot - 1].astype(np.int64) * len(levels[0].count) + levels[0].at[spot])
        at = np.full(n, -1, np.int32)
        at[spot] = ids
        end = spot[first]
        levels.append(Level(at, end, count, upper.at[end]))
    return levels


def classes(levels: list[Level]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, states, shortest) of the longest states of the endpos classes, and the depth of each class's shortest; single symbols stay apart."""
    shortest: list[np.ndarray] = [np.ones(len(levels[0].count), np.int64)]
    for depth, level in enumerate(levels[1:], 2):
        own = np.full(len(level.count), depth)
        if depth > 2:
            same = levels[depth - 2].count[level.link] == level.count
            own[same] = shortest[-1][level.link[same]]
        shortest.append(own)
    for depth, level in enumerate(levels, 1):
        longest = np.ones(len(level.count), bool)
        if 1 < depth < len(levels):
            longer = levels[depth]
            longest[longer.link[level.count[longer.link] == longer.count]] = False
        states = np.flatnonzero(longest)
        yield depth, states, shortest[depth - 1][states]


@dataclass
class Shard:
    """Words of a block of texts; symbols are words of a language."""

    lang: np.ndarray
    langs: pa.Array
    word: np.ndarray
    names: pa.Array
    piece: np.ndarray

    @property
    def symbol(self) -> np.ndarray:
        return self.lang.astype(np.int64) * len(self.names) + self.word

    def pair_hashes(self, bits: int) -> np.ndarray:
        """For each position, a hash of `bits` bits of its word, the one before it, and their language; from 1 on."""
        seeds = np.array([xxhash.xxh64_intdigest(x.as_py()) for x in self.langs], np.uint64)
        own = np.fromiter((xxhash.xxh64_intdigest(x.as_py()) for x in self.names), np.uint64, len(self.names))[self.word]
        out = np.zeros(len(own), np.int64)
        mixed = (own[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (own[1:] + seeds[self.lang[1:]])) * np.uint64(0xC2B2AE3D27D4EB4F)
        out[1:] = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x165667B19E3779F9) >> np.uint64(64 - bits)).astype(np.int64) + 1
        return out


def _shard(texts: pa.Array, langs: pa.Array) -> Shard:
    found, langs = words_of(texts, SPACES, BREAKS, lower=True), langs.dictionary_encode()
    return Shard(np.asarray(langs.indices)[found.row], langs.dictionary, found.word, found.names, found.piece)


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """A shard a block; the generator keeps hold of none."""
    for batch in batches:
        for low, high in blocks(batch.column("text")):
            yield _shard(batch.column("text").slice(low, high - low), batch.column("lang").slice(low, high - low))


def frequent_pairs(docs: DataFrame, least: int, bits: int) -> np.ndarray:
    """A bitmap of the hashes that word pairs with `least` or more occurrences have."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            inner = np.flatnonzero(shard.piece[1:] == shard.piece[:-1]) + 1
            hashes = np.sort(shard.pair_hashes(bits)[inner])
            del shard, inner
            edge = np.flatnonzero(np.diff(hashes, prepend=0))  # hashes start at 1
            yield pa.RecordBatch.from_arrays([pa.array(hashes[edge]), pa.array(np.diff(np.append(edge, len(hashes))))], names=["pair", "n"])

    found = docs.mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    parts = found.groupBy(F.bitmap_bucket_number("pair").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("pair")).alias("bits"))
    out = np.zeros(max(2**bits // 8, 4096), np.uint8)
    for row in parts.toLocalIterator():  # 2**bits / 32768 rows of 4 KB at most
        out[(row.part - 1) * 4096 : row.part * 4096] = np.frombuffer(row.bits, np.uint8)
    return out


def phrase_counts(docs: DataFrame, depth: int, least: int, bits: int) -> DataFrame:
    """(lang, phrase, size, n) of all single words and of the phrases of up to `depth` words that occur `least` times or more."""
    wanted = docs.sparkSession.sparkContext.broadcast(frequent_pairs(docs, least, bits))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            pair = shard.pair_hashes(bits) - 1
            levels = automaton(shard.symbol, shard.piece, depth, (wanted.value[pair >> 3] >> (pair & 7).astype(np.uint8) & 1).astype(bool))
            for size, states, shortest in classes(levels):
                if not len(states):
                    continue
                end = levels[size - 1].end[states]
                words = [shard.names.take(pa.array(shard.word[end - back])) for back in range(size - 1, -1, -1)]
                phrase = words[0] if size == 1 else pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary()))
                count = levels[size - 1].count[states]
                yield pa.RecordBatch.from_arrays(
                    [shard.langs.take(pa.array(shard.lang[end])), phrase.cast(pa.large_string()).cast(pa.string()), pa.array(np.full(len(end), size, np.int32)), pa.array(shortest.astype(np.int32)), pa.array(count)],
                    names=["lang", "phrase", "size", "shortest", "n"],
                )
            del shard, levels, pair

    found = docs.mapInArrow(spell, "lang string, phrase string, size int, shortest int, n long")
    each = found.select("lang", "phrase", "n", F.explode(F.sequence("shortest", "size")).alias("size"))
    each = each.withColumn("phrase", F.expr("substring_index(phrase, ' ', -size)"))
    return each.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where((F.col("size") == 1) | (F.col("n") >= least))


def collocations(
    docs: DataFrame, depth: int = 5, least: int = 100, scale: int = 1000, covered: int = 100, top: int = 2000, bits: int = 27, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases of 2 to `depth` words.

    A phrase inside a longer candidate with at least `covered` percent of its count is dropped.
    """
    docs = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    counts = cut(phrase_counts(docs, depth, least, bits))
    total = counts.where("size = 1").groupBy("lang").agg(F.sum("n").alias("n"))  # a row per language
    phrases = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - size)")})
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    cuts = cuts.join(total, "lang")
    product = lambda x, y: x.cast("decimal(19,0)") * y.cast("decimal(18,0)")
    cuts = cuts.withColumn("over", product(F.col("a") * scale, F.col("n"))).withColumn("under", product(F.col("l"), F.col("r")))
    cuts = cuts.withColumn("score", F.expr("over div under"))
    worst = cuts.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # the phrases in a phrase: its prefixes, and the suffix links behind each
    spans = F.expr("filter(flatten(transform(sequence(2, size), i -> transform(sequence(2, i), j -> struct(i, j)))), s -> s.j < size)")
    inner = phrases.where("size > 2").withColumn("span", F.explode(spans))
    inner = inner.select("lang", F.expr("substring_index(substring_index(phrase, ' ', span.i), ' ', -span.j) AS phrase"), "a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = worst.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's first in each of some parts, then among those
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*best))).where(F.col("rank") <= top)
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return left.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
