"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities over the pieces of a fixed public vocabulary. A
word's probability is the sum over all its segmentations into pieces, found by
the forward algorithm; a text's is the product over its words. Piece
probabilities are learned by expectation-maximisation, with forward-backward
counts, on a bounded sample (``SAMPLE`` documents of each language, smallest hash first). The
prediction is the language of the largest posterior, and the score is that
posterior.

Words are whole, with a mark in front as the vocabulary has them, however long:
the forward pass keeps the positions that a piece can span and rescales them as
it goes, so that neither memory nor the smallest number grows with the word. A
character that is no piece has a small fixed probability.

Defined cases: null text, or text without any letter, is `und` with score 0;
with nothing to learn from, all texts are; ties go to the first language in
order; repeated rows each get the same answer; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import held_out

SAMPLE = 600
FOLDS = 5
UNKNOWN = 1e-7
MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words remembered in a task, at most, and their longest.
KEPT, LONGEST = 300_000, 48


class Vocabulary:
    """For each length: sorted hashes of the pieces, their numbers, and sorted hashes of what longer pieces begin with."""

    def __init__(self, pieces: list[str]):
        self.size, self.longest = len(pieces), max(map(len, pieces))
        chars = np.zeros((len(pieces), self.longest), np.uint64)
        length = np.array([len(p) for p in pieces])
        chars[np.arange(self.longest) < length[:, None]] = _codes("".join(pieces))
        h, self.table = np.zeros(len(pieces), np.uint64), []
        for n in range(1, self.longest + 1):
            h = _further(h, chars[:, n - 1])
            own = np.flatnonzero(length == n)
            own = own[np.argsort(h[own])]
            self.table.append((h[own], own, np.unique(h[length > n])))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _further(h: np.ndarray, char: np.ndarray) -> np.ndarray:
    return h * _BASE + char + np.uint64(1)


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, whether h is there)."""
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


@cache
def vocabulary(path: str | None) -> Vocabulary:
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    return Vocabulary([sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))])


def words_of(text: str) -> list[str]:
    return [MARK + w for w in text.split()]


class Lattice:
    """All pieces at all places of some words."""

    def __init__(self, words: list[str], path: str | None):
        v = vocabulary(path)
        self.pieces, self.ring, self.rows = v.size, v.longest + 1, len(words)
        self.length = np.array([len(w) for w in words])
        flat = _codes("".join(words))
        row = np.repeat(np.arange(self.rows), self.length)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        left = self.length[row] - place
        at, h, arcs = np.arange(len(flat)), np.zeros(len(flat), np.uint64), []
        for n, (keys, numbers, further) in enumerate(v.table, 1):
            h = _further(h, flat[at + n - 1])
            k, hit = _find(keys, h)
            arcs.append((at[hit], np.full(hit.sum(), n), numbers[k[hit]] if len(keys) else k[hit]))
            if n == 1:  # a character that is no piece: number -1
                arcs.append((at[~hit], np.ones((~hit).sum(), np.int64), np.full((~hit).sum(), -1)))
            on = _find(further, h)[1] & (left[at] > n)
            at, h = at[on], h[on]
            if not len(at):
                break
        at, n, k = (np.concatenate(x) for x in zip(*arcs))
        #: (start, length, rows where a piece stands there, its number), by start
        self.arcs = self._grouped(place[at], n, row[at], k)

    @staticmethod
    def _grouped(start: np.ndarray, n: np.ndarray, row: np.ndarray, k: np.ndarray) -> list[tuple]:
        order = np.lexsort((n, start))
        start, n, row, k = start[order], n[order], row[order], k[order]
        cuts = np.flatnonzero((np.diff(start) != 0) | (np.diff(n) != 0)) + 1
        firsts = np.append(0, cuts) if len(start) else cuts
        return list(zip(start[firsts].tolist(), n[firsts].tolist(), np.split(row, cuts), np.split(k, cuts)))

    def forward(self, prob: np.ndarray, trace: np.ndarray | None = None) -> np.ndarray:
        """log of the sum over all segmentations: rows x languages. prob: (pieces + 1) x languages; its last row is for unknown characters.

        trace: takes the log sums of all prefixes, for one language: (longest word + 1) x rows.
        """
        out = np.zeros((self.ring, self.rows, prob.shape[1]))
        out[0] = 1.0
        scale, total = np.zeros(out.shape[1:]), np.zeros(out.shape[1:])
        ends = np.argsort(self.length, kind="stable")
        edge = np.searchsorted(self.length[ends], np.arange(self.length.max() + 2))
        g = 0
        for i in range(self.length.max() + 1):
            now = out[i % self.ring]
            if edge[i] < edge[i + 1]:
                done = ends[edge[i] : edge[i + 1]]
                total[done] = np.log(now[done]) + scale[done]
            if trace is not None:
                trace[i] = np.log(np.maximum(now[:, 0], 1e-300)) + scale[:, 0]
            while g < len(self.arcs) and self.arcs[g][0] == i:
                _, n, rows, k = self.arcs[g]
                out[(i + n) % self.ring][rows] += now[rows] * prob[k]
                g += 1
            now[:] = 0.0
            if i % 16 == 15:
                most = out.max(0)
                low = (most < 1e-100) & (most > 0)
                out *= np.where(low, 1 / np.where(low, most, 1), 1)
                scale += np.where(low, np.log(np.where(low, most, 1)), 0)
        return total

    def expected(self, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts of pieces, from the shares of all pieces that end at a place. prob: (pieces + 1) x 1."""
        log_f = np.zeros((self.length.max() + 1, self.rows))
        self.forward(prob, log_f)
        log_p, passed = np.log(prob[:, 0]), np.zeros_like(log_f)
        passed[self.length, np.arange(self.rows)] = 1.0
        numbers, shares = [], []
        for i, n, rows, k in sorted(self.arcs, key=lambda a: -a[0] - a[1]):
            share = passed[i + n][rows] * np.exp(log_f[i][rows] + log_p[k] - log_f[i + n][rows])
            passed[i][rows] += share
            numbers.append(k)
            shares.append(share * weight[rows])
        k = np.concatenate(numbers)
        return np.bincount(np.where(k < 0, len(prob) - 1, k), np.concatenate(shares), len(prob))


def _slabs(words: list[str], cells: int, each: int) -> Iterator[list[str]]:
    """Words by length, so many together that rows x max(length, each) stays below cells (a longer word is a slab of its own)."""
    part: list[str] = []
    for w in sorted(words, key=len):
        if part and (len(part) + 1) * max(len(w), each) > cells:
            yield part
            part = []
        part.append(w)
    if part:
        yield part


def learn(counts: dict[str, Counter], path: str | None, rounds: int = 3) -> tuple[list[str], np.ndarray]:
    """(languages, (pieces + 1) x languages probabilities)."""
    names = sorted(counts)
    size = vocabulary(path).size
    columns = []
    for name in names:
        lattices = [(Lattice(ws, path), np.array([counts[name][w] for w in ws], float)) for ws in _slabs(list(counts[name]), 400_000, 40)]
        prob = np.full((size + 1, 1), 1.0 / size)
        prob[-1] = UNKNOWN
        for _ in range(rounds):
            count = sum(lat.expected(prob, w) for lat, w in lattices)[:-1] + 0.05
            prob = np.append(count / count.sum(), UNKNOWN)[:, None]
        columns.append(prob[:, 0])
    return names, np.stack(columns, 1) if columns else np.zeros((size + 1, 0))


def word_scores(words: list[str], prob: np.ndarray, path: str | None) -> dict[str, np.ndarray]:
    """log P(word) in each language."""
    out: dict[str, np.ndarray] = {}
    for ws in _slabs(words, 4_000_000 // max(prob.shape[1], 1), vocabulary(path).longest):
        out.update(zip(ws, Lattice(ws, path).forward(prob)))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, folds: int = FOLDS, path: str | None = None):
    """Learns from documents outside the held-out fold whose language is known; returns a model for `predict`."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col, folds))
    own = Window.partitionBy("lang").orderBy(F.xxhash64("k"), "k")  # limited before the shuffle, so a large language is no large task
    ids = known.select(F.col(id_col).alias("k"), F.col(lang_col).alias("lang")).where("k is not null").withColumn("n", F.row_number().over(own)).where(F.col("n") <= sample).select("k")
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        docs_of: Counter = Counter()
        for frame in frames:
            for text, lang in zip(frame["text"], frame["lang"]):
                docs_of[lang] += 1
                found.update((lang, w) for w in words_of(text))
        yield pd.DataFrame([(a, b, n) for (a, b), n in found.items()] + [(a, None, n) for a, n in docs_of.items()], columns=["lang", "word", "n"])

    counts: dict[str, Counter] = defaultdict(Counter)
    prior: Counter = Counter()
    for lang, word, n in rows.join(F.broadcast(ids), "k", "left_semi").mapInPandas(count, "lang string, word string, n long").toLocalIterator():
        if word is None:
            prior[lang] += n
        else:
            counts[lang][word] += n
    for lang in prior:
        counts[lang].update([])
    names, prob = learn({k: v for k, v in counts.items()}, path)
    return names, prob, np.log(np.array([prior[n] for n in names], float) / max(sum(prior.values()), 1)), path


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score."""
    names, prob, prior, path = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            for at in range(0, len(texts), 500):
                bags = [Counter(words_of(t)) if t and names and any(map(str.isalpha, t)) else None for t in texts[at : at + 500]]
                if len(known) > KEPT:
                    known = {}
                fresh = word_scores(list({w for b in bags if b for w in b if w not in known}), prob, path)
                known.update((w, p) for w, p in fresh.items() if len(w) <= LONGEST)
                for i, bag in enumerate(bags, at):
                    if bag:
                        total = prior + np.fromiter(bag.values(), float) @ np.array([known[w] if w in known else fresh[w] for w in bag])
                        post = np.exp(total - total.max())
                        k = int(post.argmax())
                        langs[i], scores[i] = names[k], float(post[k] / post.sum())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
