"""Best-two-fit packing: as few sequences as the lengths allow, by plans on the length histogram.

Documents longer than the window are cut into full windows and one rest; the
others stay whole. The histogram of the pieces' lengths, of at most `window`
numbers, goes to the driver. A bin is filled greedily, longest first; then its
smallest piece gives way to two unpacked ones if they fill its gap more tightly.
Bins with the same lengths are made at once, as often as the pieces last, so the
plan takes a step for each length or so, never one for each bin, and is the one
that packing piece by piece would give. It holds a few numbers for each length.

Each piece then takes the place of its rank among the pieces of its length. Ranks
are counted within the partitions of the written pieces and added up, so a length
or an id that a third of all pieces share is numbered by many tasks.

A text's ids are those of its runs between white space and between letters and
points, as no token reaches across either: a block's distinct runs are encoded
once each, and those seen first are kept. Tests compare with the tokenizer on
whole texts. As the tokenizer does unless told otherwise, its
special tokens' strings in a text become those tokens' ids.

Defined cases: null text counts as empty and is the end token alone; repeated
rows are packed each; a null id stays null; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut
from .words import blocks, words_of

END = 1
SPACES = b" \t\n\x0b\x0c\r"
#: Between a letter and one of these, in either order, ends a token, too.
POINTS = b".,;:!?"
#: Encoded runs that a worker keeps, and the longest of them in bytes.
KEPT_RUNS, KEPT_BYTES = 500_000, 64
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of blocks of texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already
        from tokenizers import Tokenizer

        self.model, self.known = Tokenizer.from_file(path), {}

    def _runs(self, names: list[bytes]) -> list[list[int]]:
        """The ids of each run. The tokenizer lowers all letters; runs of ASCII letters alone are lowered before it, so that they are one."""
        names = [x.lower() if x.isalpha() else x for x in names]
        new = [x for x in dict.fromkeys(names) if x not in self.known]
        self.known.update((x, y.ids) for x, y in zip(new, self.model.encode_batch_fast([x.decode() for x in new], add_special_tokens=False)))
        out = list(map(self.known.__getitem__, names))
        for x in new[max(0, len(new) - max(0, len(self.known) - KEPT_RUNS)) :]:  # frequent runs come early
            del self.known[x]
        for x in new:
            if len(x) > KEPT_BYTES:
                self.known.pop(x, None)
        return out

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, without an end."""
        found = words_of(texts, SPACES, apart=POINTS)
        runs = self._runs(found.names.to_pylist())
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        pool = np.fromiter(chain.from_iterable(runs), "<u4", int(size.sum()))
        many = size[found.word]
        upto = np.cumsum(many)
        ids = pool[np.repeat((np.cumsum(size) - size)[found.word] - (upto - many), many) + np.arange(upto[-1] if len(upto) else 0)]
        ends = np.cumsum(np.bincount(found.row, weights=many, minlength=len(texts)).astype(np.int64))
        return (ids[b - a : b] for a, b in zip(np.diff(ends, prepend=0).tolist(), ends.tolist()))


@cache
def encoder(path: str | None) -> Encoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Encoder(path)


def cut_documents(docs: DataFrame, window: int, id_col: str, text_col: str, path: str | None) -> DataFrame:
    """A row for each piece; only documents longer than the window have more than one."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for low, high in blocks(batch.column("text")):
                row, piece, length, crc = [], [], [], []
                for k, ids in enumerate(encode(batch.column("text").slice(low, high - low))):
                    ids = np.append(ids, np.array([END], "<u4"))
                    for at in range(0, len(ids), window):
                        part = ids[at : at + window]
                        row.append(low + k)
                        piece.append(at // window)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                number = pa.array(piece, pa.int32())
                own = batch.column("doc_id").take(pa.array(row, pa.int64()))
                start = pa.array(np.array(piece, np.int64) * window)
                yield pa.RecordBatch.from_arrays([own, number, start, pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, _PIECES)


def plan(hist: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """(repeats, pieces of each length in a bin) that use every piece of the histogram exactly once."""
    left = np.zeros(window + 1, np.int64)
    for n, count in hist.items():
        left[n] = count
    at, out = np.arange(window + 1), []
    while True:
        rest = left.copy()  # pieces outside this bin
        below = np.maximum.accumulate(np.where(rest > 0, at, 0))  # the longest unpacked length up to each
        if not below[window]:
            return out
        bin_, room = {}, window
        while n := int(below[room]):
            k = min(int(rest[n]), room // n)
            bin_[n] = bin_.get(n, 0) + k
            rest[n] -= k
            room -= n * k
            if not rest[n]:
                below = np.maximum.accumulate(np.where(rest > 0, at, 0))
        if room and sum(bin_.values()) > 1:
            least = min(bin_)
            pair = _two(rest, below, room + least)
            if sum(pair) > least:
                bin_[least] -= 1
                for n in pair:
                    bin_[n] = bin_.get(n, 0) + 1
                bin_ = {n: k for n, k in bin_.items() if k}
        times = min(int(left[n]) // k for n, k in bin_.items())
        for n, k in bin_.items():
            left[n] -= times * k
        out.append((times, bin_))


def _two(rest: np.ndarray, below: np.ndarray, gap: int) -> tuple[int, int]:
    """The two unpacked lengths with the largest sum in the gap, the longer one as long as can be; zeros where there are none."""
    a = np.flatnonzero(rest[: gap + 1] > 0)[::-1]
    b = below[np.minimum(a, gap - a)]
    single = (b == a) & (rest[a] < 2)
    b = np.where(single, below[np.maximum(a - 1, 0)], b)
    total = np.where(b > 0, a + b, 0)
    if not total.any():
        return 0, 0
    best = int(total.argmax())
    return int(a[best]), int(b[best])


def pack_two_fit(docs: DataFrame, window: int = 4096, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = cut(cut_documents(docs, window, id_col, text_col, path).withColumn("block", F.spark_partition_id()))
    cells = cut(pieces.groupBy("length", "block").agg(F.count("*").alias("n")))
    hist = {r.length: r.n for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length
    slots, used, base = [], dict.fromkeys(hist, 0), 0
    for times, bin_ in plan(hist, window):
        offset = 0
        for n, k in bin_.items():
            slots.append((n, used[n], used[n] + times * k, base, k, offset))
            used[n] += times * k
            offset += n * k
        base += times
    slot = spark.createDataFrame(slots, "s_length long, low long, high long, base long, k long, first long")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("own", F.row_number().over(own) - 1).join(cells, ["length", "block"])
    ranked = ranked.withColumn("rank", F.col("own") + F.col("before"))
    # the slots number a few for each length, whatever the corpus
    hit = (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    nth = F.col("rank") - F.col("low")
    sequence, copy = F.col("base") + F.floor(nth / F.col("k")), nth % F.col("k")
    return ranked.join(F.broadcast(slot), hit).select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), (F.col("first") + copy * F.col("length")).alias("offset"))
