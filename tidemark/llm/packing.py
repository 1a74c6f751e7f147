"""Packing token sequences into windows by non-negative least squares.

Documents are cut into full windows and one rest. The histogram of the rests'
lengths, of at most ``window`` numbers, goes to the driver. There, shallow
combinations that fill a window exactly (pairs, and one, two or three equal
pieces with a rest; windows are ``window`` and the powers of two below it, which
need no padding) get repeat counts by non-negative least squares against the
histogram, solved by coordinate descent and rounded down. What the rounding
leaves is packed greedily, longest first, again as combinations with repeat
counts. So the plan's size depends on the window only, never on the corpus.

Each piece then takes the slot of its rank among the pieces of its length. Ranks
are counted in blocks, so a length that a third of all pieces share is numbered
by many tasks.

Ids come from the ranks of the vocabulary file, which give the tokenizer's own
ids at a fraction of its time; tests compare both. As the tokenizer does unless
told otherwise, its special token's string in a text becomes that token's id.

Defined cases: null text counts as empty and is the end token alone; repeated
rows are packed each; a null id stays null; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, small_batches

END = 0
BLOCKS = 512
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@cache
def encoder(ranks_path: str | None, json_path: str | None):
    """text -> ids of the byte-level BPE vocabulary in these files."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    with open(json_path, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    plain: list = []  # loaded where it is needed
    lines = open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except ValueError:  # its pattern engine gives up on very long runs of white space
            plain[:] = plain or [Tokenizer.from_file(json_path)]
            return plain[0].encode(text, add_special_tokens=False).ids

    return ids


def cut_documents(docs: DataFrame, window: int, id_col: str, text_col: str, ranks_path: str | None, json_path: str | None) -> DataFrame:
    """A row for each piece: full windows, then the rest."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, json_path)
        for batch in batches:
            row, start, length, crc, tokens = [], [], [], [], []
            for k, text in enumerate(batch.column("text")):
                ids = np.array([*encode(text.as_py() or ""), END], "<u4")
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    row.append(k)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    tokens.append(len(ids))
            own = batch.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([own, *(pa.array(c, pa.int64()) for c in (start, length, crc, tokens))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, _PIECES)


def combinations(lengths: list[int], window: int) -> list[tuple[int, ...]]:
    """Shallow combinations of these lengths that fill a power of two up to the window."""
    have, out = set(lengths), []
    total = window
    while total >= 1:
        if total in have:
            out.append((total,))
        for a in lengths:
            for k in (1, 2, 3):
                b = total - k * a
                if b > 0 and b in have and (k > 1 or a <= b) and not (k > 1 and a == b):
                    out.append((a,) * k + (b,))
        total //= 2
    return out


def repeat_counts(combos: list[tuple[int, ...]], hist: dict[int, int], slack: float = 0.5) -> list[float]:
    """Non-negative least squares: counts x with sum(x * combo) nearest to the histogram, by coordinate descent.

    Ends where the conditions of the optimum hold but for `slack` pieces: no
    combination's gradient is above it, and none that is used has one below.
    """
    rest = {n: float(c) for n, c in hist.items()}
    parts = [[(n, c.count(n)) for n in set(c)] for c in combos]
    square = [sum(m * m for _, m in p) for p in parts]
    x = [0.0] * len(combos)
    active = range(len(combos))
    while True:
        off = []
        for i in active:
            gradient = sum(m * rest[n] for n, m in parts[i])
            if gradient > slack or (gradient < -slack and x[i] > 0):
                off.append(i)
                new = max(0.0, x[i] + gradient / square[i])
                for n, m in parts[i]:
                    rest[n] -= m * (new - x[i])
                x[i] = new
        if off:
            active = off if len(active) > len(off) else active
        elif len(active) < len(combos):
            active = range(len(combos))  # all of them once more
        else:
            return x


def plan(hist: dict[int, int], window: int) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths) that use every piece of the histogram exactly once."""
    left = {n: c for n, c in hist.items() if c > 0}
    combos = combinations(sorted(left), window)
    out: list[tuple[int, tuple[int, ...]]] = []

    def take(times: int, combo: tuple[int, ...]) -> None:
        if times > 0:
            out.append((times, combo))
            for n in combo:
                left[n] -= times

    for x, combo in sorted(zip(repeat_counts(combos, left), combos), key=lambda p: -p[0]):
        take(min([int(x + 1e-9), *(left[n] // combo.count(n) for n in set(combo))]), combo)
    for combo in sorted(combos, key=len):  # what rounding left may still fill windows
        take(min(left[n] // combo.count(n) for n in set(combo)), combo)
    while rest := sorted((n for n, c in left.items() if c > 0), reverse=True):
        combo, room = [], window
        for n in rest:
            k = min(left[n], room // n)
            combo += [n] * k
            room -= n * k
        take(min(left[n] // combo.count(n) for n in set(combo)), tuple(combo))
    return out


def pack(docs: DataFrame, window: int = 1024, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, json_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    with small_batches(spark):
        pieces = cut(cut_documents(docs, window, id_col, text_col, ranks_path, json_path))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "start"), F.lit(BLOCKS)).cast("int"))
    cells = cut(pieces.groupBy("length", "block").agg(F.count("*").alias("n")))
    hist = {r.length: r.n for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length
    slots, used, base = [], dict.fromkeys(hist, 0), 0
    for times, combo in plan(hist, window):
        offset = 0
        for n in combo:
            slots.append((n, used[n], used[n] + times, base, offset))
            used[n] += times
            offset += n
        base += times
    slot = spark.createDataFrame(slots, "s_length long, low long, high long, base long, offset long")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("own", F.row_number().over(own) - 1).join(cells, ["length", "block"])
    ranked = ranked.withColumn("rank", F.col("own") + F.col("before"))
    # the slots number a few times the window's length, whatever the corpus
    hit = (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    return ranked.join(F.broadcast(slot), hit).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset"
    )
