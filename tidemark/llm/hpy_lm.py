"""Language-model scoring with a hierarchical Pitman-Yor model.

A word is a customer in the restaurant of its context, the whole word before it
(the end of a text, for a text's first word). Restaurants of contexts that end in
the same two bytes share a parent, those parents share the word restaurant, and
that one's parent spells words: restaurants of one byte of context share one
without context, over uniform bytes. Tables of a restaurant are customers of its
parent, but for spelling, which is fitted to the vocabulary and stays.

Seating is sampled by Gibbs sweeps, dish by dish, each given the tables of all
other dishes. In every sweep all customers of a dish get up together, however
many they are, and their number of tables is drawn from its distribution given
all others, over generalised Stirling numbers: from a table of those for up to
``BLOCK`` customers (``together``), and beyond from their integral along a contour
(``at_once``). How many sit at which table follows from the number and is needed
nowhere. A sweep sees the other buckets' tables, and each level's parent, as they stood
before it, which is what lets restaurants run in parallel. After ``BURN_IN``
sweeps, the predictive probabilities of ``SAMPLES`` sweeps are averaged.

How it runs. Blocks of documents become a blob of tokens, and requests: the
block's distinct words and (context, word) pairs with counts, by bucket of words.
All there is about a word meets in its bucket, a (context, word) pair once for
each block however often it occurs; buckets number as many as the input needs
(``BUCKET_CHARS`` of text each). A bucket isn't split, so the one with the
commonest word grows with the contexts that the word has in all blocks. After a sweep, buckets send
their tables by context to that context's range, where they are summed, and get
the totals back; the totals of 65,536 endings and of spellings, bounded by the
alphabet, go by way of the driver. Every sweep's seating is checkpointed and its
randomness seeded; what earlier sweeps and the sums left on disk is freed. Contexts are told
apart by 48 bits of hash and their ending. Answers go back to the blocks.

Defined cases: null text counts as empty and is the end token alone; a null id is
held out, as the empty text's remainder is 0; with no training text all probability is spelling; repeated rows
each count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, dealt, free
from .words import words_of

FOLDS = 10
BURN_IN, SAMPLES = 1, 2
STRENGTH = 1.0
SPELL_DISCOUNT = 0.5
BLOCK = 512
#: Of at_once: places along a contour, and numbers of tables to which the rest of a dish's are interpolated.
PLACES, NODES = 48, 12
#: Text of a block of documents, in characters; a longer document is a block of its own.
BLOCK_CHARS = 12_000_000
#: Text for each bucket of words, in characters, where the partitions of a shuffle are fewer.
BUCKET_CHARS = 32_000_000
#: Seconds until the JVM knows what is no longer wanted.
PAUSE = 1.5
ENDINGS = 65536
SPACES = b" \t\n\x0b\x0c\r"
_STOP = 10


def _pack(*parts) -> bytes:
    """Arrays and bytes as one blob; of arrays, all first bytes come together, then all second ones, which makes small numbers cheap."""
    raw = []
    for p in parts:
        p = np.frombuffer(p, np.uint8) if isinstance(p, bytes) else np.ascontiguousarray(p)
        raw.append(p.view(np.uint8).reshape(len(p), p.itemsize).T.tobytes() if len(p) else b"")
    return zstandard.compress(struct.pack(f"<{len(raw)}q", *map(len, raw)) + b"".join(raw), 3)


def _unpack(blob: bytes, *kinds):
    raw = memoryview(zstandard.decompress(blob))
    sizes, at, out = struct.unpack_from(f"<{len(kinds)}q", raw), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds):
        width = 1 if kind is bytes else np.dtype(kind).itemsize
        part = np.frombuffer(raw[at : at + n], np.uint8).reshape(width, -1)
        out.append(part.tobytes() if kind is bytes else np.ascontiguousarray(part.T).view(kind).ravel())
        at += n
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """A rising array as its differences, the first one from 0."""
    return np.diff(x, prepend=x.dtype.type(0))


# ---- blocks -------------------------------------------------------------------------------------------------


def _context(word: bytes) -> int:
    """The name of a context: 48 bits of hash and the word's last two bytes; 0 is the end of a text."""
    return xxhash.xxh64_intdigest(word) >> 16 << 16 | int.from_bytes(word[-2:], "big") if word else 0


def _block(ids: list, texts: list, buckets: int, folds: int) -> Iterator[tuple[int, bytes]]:
    """(-1, token blob), then (bucket, request) for each bucket that the block has words of."""
    found = words_of(pa.array(texts, pa.large_string()), SPACES, lower=True)
    sizes = np.bincount(found.row, minlength=len(texts)) + 1
    words = [*found.names.to_pylist(), b""]
    local = np.full(int(sizes.sum()), len(words) - 1)
    local[np.arange(len(found.word)) + found.row] = found.word  # an end behind each text
    del found
    pa.default_memory_pool().release_unused()  # what the words' arrays took is not wanted again before the next block
    home = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
    order = np.lexsort((np.arange(len(words)), home))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    words, home, token = [words[i] for i in order], home[order], place[local]
    names, named = np.unique(np.array([_context(w) for w in words], np.uint64), return_inverse=True)
    context = np.empty(len(token), np.int64)
    context[1:] = named[token[:-1]]
    context[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = 0  # of a text's end, the smallest name
    pairs, which = np.unique(token * len(names) + context, return_inverse=True)
    of, before = pairs // len(names), pairs % len(names)
    out = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % folds == 0 for i in ids])
    count = np.bincount(which[np.repeat(~out, sizes)], minlength=len(pairs)).astype(np.uint32)
    of_word = np.bincount(of, minlength=len(words)).astype(np.uint32)
    null = np.array([i is None for i in ids])
    doc = np.repeat(np.arange(len(ids)), sizes)
    which = np.sort(doc * len(pairs) + which) % len(pairs)  # a text's order no longer counts
    yield -1, _pack(np.array([0 if i is None else i for i in ids], np.int64), null, out, sizes, of_word, _steps(which).astype(np.int32))
    edge = np.concatenate(([0], np.cumsum(of_word, dtype=np.int64)))
    starts = np.flatnonzero(np.diff(home, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(words)]):
        p, q = edge[a], edge[b]
        own, at = np.unique(before[p:q], return_inverse=True)
        pair = np.repeat(np.arange(b - a), of_word[a:b]) * len(own) + at
        yield int(home[a]), _pack(b"\n".join(words[a:b]), _steps(names[own]), _steps(pair), count[p:q])


def _blocks(buckets: int, folds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list = []
        held = 0

        def flush() -> pa.RecordBatch:
            rows = list(_block(ids, texts, buckets, folds))
            block = task * (1 << 24) + number
            own = [b if b >= 0 else -1 - block for b, _ in rows]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), block, np.int64)), pa.array(own, pa.int64()), pa.array([d for _, d in rows], pa.binary())], names=["block", "bucket", "data"])

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids.append(i)
                texts.append(t.as_py())
                held += len(texts[-1] or "")
                if held >= BLOCK_CHARS:
                    yield flush()
                    number, held = number + 1, 0
                    ids.clear()
                    texts.clear()
        if ids:
            yield flush()

    return run


# ---- seating ------------------------------------------------------------------------------------------------


@cache
def stirling(discount: float, top: int = BLOCK) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: [c, t] weighs all ways to seat c customers at t tables."""
    log = np.full((top + 1, top + 1), -np.inf)
    log[1, 1] = 0.0
    t = np.arange(1, top + 1)
    for c in range(1, top):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(c - discount * t > 0, log[c, 1:] + np.log(np.maximum(c - discount * t, 1e-300)), -np.inf)
        log[c + 1, 1:] = np.logaddexp(log[c, :-1], stay)
    return log


def together(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables, drawn given all else, of dishes with 1 to BLOCK customers.

    others: tables of other dishes in the restaurant; parent: the parent's probability of the dish.
    """
    out = np.ones(len(customers), np.int64)
    log = stirling(discount)
    order = np.argsort(customers, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(customers[order])) + 1):
        c = int(customers[rows[0]]) if len(rows) else 1
        for part in np.array_split(rows, 1 + len(rows) * c // 1_000_000) if c > 1 else ():
            t = np.arange(c)
            opened = np.cumsum(np.log(STRENGTH + discount * (others[part, None] + t)), axis=1) + (t + 1) * np.log(parent[part, None])
            weight = log[c, 1 : c + 1] + opened
            weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), axis=1)
            out[part] = 1 + (weight < rng.random(len(part))[:, None] * weight[:, -1:]).sum(1)
    return out


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of numbers above 0."""
    y, low = np.where(x < 10, x + 10, x), np.minimum(x, 10)
    below = np.where(x < 10, sum(np.log(low + k) for k in range(10)), 0.0)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y - below


def _saddle(x: np.ndarray, c: np.ndarray, d: float) -> np.ndarray:
    """The logarithm of the number of tables for which exp(x) = 1 - z is the saddle of log_stirling's integrand."""
    return np.log(c / d) + np.log(-np.expm1(d * x)) + (1 - d) * x - np.log(-np.expm1(x))


def _halved(below, shape: tuple, times: int) -> np.ndarray:
    """Where on (-700, 0) `below` of a point ceases to hold."""
    low, high = np.full(shape, -700.0), np.full(shape, -1e-12)
    for _ in range(times):
        middle = (low + high) / 2
        under = below(middle)
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return (low + high) / 2


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log(S(c, t) * Gamma(t) / c!) of generalised Stirling numbers S of discount d, for real t from 1 to c.

    S(c, t) is c! / t! times the coefficient of z**c in ((1 - (1 - z)**d) / d)**t: an integral over w = log z, along a
    parabola about the cut from w = 0 on, which passes near the saddle; along a line where that lies far from the cut.
    """
    with np.errstate(all="ignore"):
        e = np.exp(_halved(lambda x: _saddle(x, c, d) < np.log(t), c.shape, 36))
        mu = np.maximum(-np.log1p(-np.minimum(e, 1 - 1e-15)), 4 / c)
        z, q = np.exp(-mu), -np.expm1(-mu)
        g = -np.expm1(d * np.log(q))
        mean = d * z * q ** (d - 1) / g
        width = np.sqrt(np.maximum(t * (mean * (1 + z * (1 - d) / q) - mean * mean), 1e-3))
        k = (np.arange(PLACES) + 0.5) / PLACES
        upright, up = (mu > 1)[:, None], np.minimum(np.pi, 11 / width)[:, None]
        out = np.minimum(6.5 / np.sqrt((c - d * t) * mu), 11 / (2 * mu * width))[:, None]
        turn = 1 - 1j * out * k
        w = np.where(upright, -mu[:, None] + 1j * up * k, -mu[:, None] * turn**2)
        step = np.where(upright, 1j * up, 2j * mu[:, None] * out * turn) / PLACES
        base = t * np.log(g / d) + c * mu
        rest = t[:, None] * np.log(-np.expm1(d * np.log(-np.expm1(w))) / d) - c[:, None] * w - base[:, None]
        total = base + np.log((np.exp(rest) * step).imag.sum(1) / np.pi) - np.log(t)
    return np.where(t >= c, -np.log(c), total)


def _stretch(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, log_stirling at NODES numbers of tables from low to high) of each dish; what lies outside has no weight that a double shows."""
    c, more, p = customers.astype(float), STRENGTH / d + others, np.log(parent)

    def slope(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tables, what the log weight rises by with one more)"""
        t = _saddle(x, c, d)
        return np.exp(t), np.log(-np.expm1(d * x)) + p + np.log(more + np.exp(t)) - t

    with np.errstate(all="ignore"):
        x = _halved(lambda x: slope(x)[1] > 0, c.shape, 48)
        (t, a), (u, b) = slope(x), slope(x * (1 + 1e-4))
        spread = np.nan_to_num(np.sqrt(np.abs((u - t) / (b - a))), nan=1.0)
        reach = 10 * spread + 12
    low, high = np.maximum(1, np.floor(t - reach)), np.minimum(c, np.ceil(t + reach))
    at = low[:, None] + (high - low)[:, None] * (1 - np.cos(np.pi * np.arange(NODES) / (NODES - 1))) / 2
    return low, high, log_stirling(np.repeat(c, NODES), at.ravel(), d).reshape(at.shape)


def at_once(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables, as `together` draws them, of dishes with more customers.

    The Stirling numbers' logarithms, without what bends them at the ends, are a smooth function of the tables,
    interpolated between NODES of them.
    """
    out, d = np.ones(len(customers), np.int64), discount
    node = -np.cos(np.pi * np.arange(NODES) / (NODES - 1))
    share = (-1.0) ** np.arange(NODES)
    share[[0, -1]] /= 2
    for rows in np.split(np.arange(len(customers)), np.arange(256, len(customers), 256)) if len(customers) else ():
        low, high, log = _stretch(customers[rows], others[rows], parent[rows], d)
        near = (4 * high > customers[rows]).astype(float)  # the other end, where as many tables as customers are
        ends = lambda c, t, near: near * _lgamma(np.where(near > 0, np.maximum(c - t, 0), 0.0) + 1)
        # only whole numbers of tables mean anything where almost everyone sits alone
        single = (high > customers[rows] - 20) & (high - low <= 400)
        log = log + ends(customers[rows][:, None], low[:, None] + (high - low)[:, None] * (1 + node) / 2, near[:, None])
        many = (high - low).astype(np.int64) + 1
        order = np.argsort(many, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(np.cumsum(many[order]) // 100_000)) + 1):
            t = low[part, None] + np.arange(many[part].max())
            x = 2 * (t - low[part, None]) / np.maximum(high - low, 1)[part, None] - 1
            up, down = np.zeros(t.shape), np.zeros(t.shape)
            hit = np.full(t.shape, -1)
            for k in range(NODES):
                away = x - node[k]
                hit = np.where(np.abs(away) < 1e-13, k, hit)
                away = share[k] / np.where(away == 0, 1.0, away)
                up, down = up + away * log[part, k, None], down + away
            weight = np.where(hit >= 0, np.take_along_axis(log[part], np.maximum(hit, 0), 1), up / np.where((hit >= 0) | (t > high[part, None]), 1.0, down))
            if len(each := np.flatnonzero(single[part])):
                own = np.minimum(t[each], customers[rows][part[each], None]).astype(float)
                own_c = np.broadcast_to(customers[rows][part[each], None].astype(float), own.shape)
                weight[each] = log_stirling(own_c.ravel(), own.ravel(), d).reshape(own.shape) + ends(own_c, own, near[part[each], None])
            more = STRENGTH / d + others[rows][part, None]
            weight = weight - ends(customers[rows][part, None], t, near[part, None]) - _lgamma(t) + _lgamma(more + t) + t * (np.log(d) + np.log(parent[rows][part, None]))
            weight = np.where(t <= high[part, None], weight, -np.inf)
            weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), axis=1)
            found = (weight < rng.random(len(part))[:, None] * weight[:, -1:]).sum(1)
            out[rows[part]] = low[part].astype(np.int64) + found
    return out


def first_tables(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, rng: np.random.Generator) -> list[np.ndarray]:
    """A seating to begin with for each dish of more than BLOCK customers: tables open as they would, in parties that grow; the sizes are even."""
    tables, seated = np.ones(len(customers)), np.ones(len(customers))
    while (on := seated < customers).any():
        party = np.minimum(np.maximum(1, seated // 8), customers - seated)
        mass = (STRENGTH + discount * (others + tables)) * parent
        new = rng.binomial(party.astype(np.int64), np.minimum(1, mass / (mass + seated - discount * tables)))
        tables, seated = np.where(on, tables + new, tables), seated + party
    return [c // t + (np.arange(t) < c % t) for c, t in zip(customers.tolist(), tables.astype(np.int64).tolist())]


def one_by_one(sizes: list[np.ndarray], customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, rng: np.random.Generator, moves: int | None = None) -> list[np.ndarray]:
    """The same walk as at_once and together draw the end of, customer by customer: sizes of the tables of each dish after some have come or gone, so that there are `customers` of them, and `moves` have sat down anew, as many as sit at the fullest dish unless told. Tests compare."""
    if not sizes:
        return []
    moves = int(customers.max()) if moves is None else moves
    change = customers - np.array([s.sum() for s in sizes])
    spare = moves + np.maximum(change, 0)
    width = np.array([len(s) for s in sizes]) + spare
    end = np.cumsum(width)
    start, free = end - width, end - spare
    flat = np.concatenate([np.append(s, np.zeros(k, np.int64)) for s, k in zip(sizes, spare)])
    total, tables = np.array([s.sum() for s in sizes]), np.array([len(s) for s in sizes])

    def someone(rows: np.ndarray) -> np.ndarray:
        """The table of a customer of each row, all being equally likely."""
        upto = np.cumsum(flat)
        below = np.where(start[rows] > 0, upto[start[rows] - 1], 0)
        return np.searchsorted(upto, below + (rng.random(len(rows)) * total[rows]).astype(np.int64), side="right")

    def leave(rows: np.ndarray) -> None:
        at = someone(rows)
        flat[at] -= 1
        total[rows] -= 1
        tables[rows] -= flat[at] == 0

    def sit(rows: np.ndarray) -> None:
        mass = (STRENGTH + discount * (others[rows] + tables[rows])) * parent[rows]
        new = rng.random(len(rows)) * (mass + total[rows] - discount * tables[rows]) < mass
        opened = rows[new]
        flat[free[opened]] = 1
        free[opened] += 1
        tables[opened] += 1
        rest = rows[~new]
        seat_of, open_ = np.zeros(len(rest), np.int64), np.ones(len(rest), bool)
        while open_.any():  # a customer's table, kept with probability (size - discount) / size
            at = someone(rest[open_])
            kept = rng.random(len(at)) * flat[at] < flat[at] - discount
            which = np.flatnonzero(open_)[kept]
            seat_of[which] = at[kept]
            open_[which] = False
        flat[seat_of] += 1
        total[rows] += 1

    while (more := np.flatnonzero(total < customers)).size:
        sit(more)
    while (more := np.flatnonzero(total > customers)).size:
        leave(more)
    everyone = np.arange(len(sizes))
    for _ in range(moves):
        leave(everyone)
        sit(everyone)
    return [x[x > 0] for x in np.split(flat, end[:-1])]


class Level:
    """The dishes of one level of restaurants: their numbers of tables."""

    def __init__(self, tables: np.ndarray):
        self.tables = tables

    def sample(self, customers: np.ndarray, total: np.ndarray, parent: np.ndarray, discount: float, rng: np.random.Generator) -> Level:
        """A new seating of all customers. total: tables of each dish's restaurant before the sweep, its own included."""
        others = np.maximum(total - self.tables, 0)
        out = np.zeros(len(customers), np.int64)
        few = np.flatnonzero((customers > 0) & (customers <= BLOCK))
        out[few] = together(customers[few], others[few], parent[few], discount, rng)
        many = np.flatnonzero(customers > BLOCK)
        out[many] = at_once(customers[many], others[many], parent[many], discount, rng)
        return Level(out)


# ---- spelling -----------------------------------------------------------------------------------------------


def _codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts): the byte before and the byte of every place of the words, and where each word starts."""
    x = np.frombuffer(b"\n".join(words) + b"\n", np.uint8).astype(np.int64)
    starts = np.concatenate(([0], np.flatnonzero(x == _STOP)[:-1] + 1))
    return np.concatenate(([_STOP], x[:-1])) << 8 | x, starts


class Spelling:
    """Byte restaurants of one and no byte of context, whose customers are the bytes of all words, once each. Seated once."""

    def __init__(self, customers: np.ndarray, seed: int):
        d, rng = SPELL_DISCOUNT, np.random.default_rng([seed, 77])
        context, byte = np.arange(65536) >> 8, np.arange(65536) & 255
        begun = np.minimum(customers, 1)
        one = Level(begun).sample(customers, np.bincount(context, begun, 256)[context], np.full(65536, 1 / 256), d, rng).tables
        under = np.bincount(byte, one, 256).astype(np.int64)
        begun = np.minimum(under, 1)
        none = Level(begun).sample(under, np.full(256, begun.sum()), np.full(256, 1 / 256), d, rng).tables
        self.single = (under - d * none + (STRENGTH + d * none.sum()) / 256) / (STRENGTH + under.sum())
        tables, seated = np.bincount(context, one, 256), np.bincount(context, customers, 256)
        self.double = (customers - d * one + (STRENGTH + d * tables)[context] * self.single[byte]) / (STRENGTH + seated)[context]

    def of(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """P(spelling) of each word, not below what a double holds."""
        return np.exp(np.maximum(np.add.reduceat(np.log(self.double)[codes], starts), -690.0))


# ---- buckets ------------------------------------------------------------------------------------------------


def _request(blob: bytes):
    words, names, pair, count = _unpack(blob, bytes, np.uint64, np.int64, np.uint32)
    words, names, pair = words.split(b"\n"), np.cumsum(names, dtype=np.uint64), np.cumsum(pair)
    return words, np.bincount(pair // len(names), minlength=len(words)), names, pair % len(names), count.astype(np.int64)


def _merged(requests: list) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, names of contexts, and word, context and count of every pair that training has) of a bucket's requests.

    Words are those of training texts, contexts all that are asked for.
    """
    place: dict[bytes, int] = {}
    for words, of_word, _, _, count in requests:
        seen = np.add.reduceat(count, np.cumsum(of_word) - of_word) > 0
        for w, on in zip(words, seen.tolist()):
            if on:
                place.setdefault(w, len(place))
    names = sorted(place)
    place = {w: i for i, w in enumerate(names)}
    contexts = np.unique(np.concatenate([r[2] for r in requests]))
    keys, counts = [], []
    for words, of_word, own, context, count in requests:
        at = np.repeat(np.array([place.get(w, -1) for w in words], np.int64), of_word)
        on = count > 0
        keys.append(at[on] * len(contexts) + np.searchsorted(contexts, own)[context[on]])
        counts.append(count[on])
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return names, contexts, key // len(contexts), key % len(contexts), np.bincount(where, np.concatenate(counts), len(key)).astype(np.int64)


class Bucket:
    """A bucket's words and pairs, which never change, and how its customers sit."""

    def __init__(self, words: list[bytes], contexts: np.ndarray, word: np.ndarray, context: np.ndarray, count: np.ndarray):
        self.words, self.contexts, self.word, self.context, self.count = words, contexts, word, context, count
        ending = (contexts & np.uint64(ENDINGS - 1)).astype(np.int64)
        #: dishes of the endings' restaurants: word and ending, and where each pair's tables go
        self.group, self.up = np.unique(word * ENDINGS + ending[context], return_inverse=True)
        self.group_word, self.ending = self.group // ENDINGS, self.group & (ENDINGS - 1)
        self.codes, self.starts = _codes(words) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.levels = [Level(np.ones(len(count), np.int64)), Level(np.ones(len(self.group), np.int64)), Level(np.ones(len(words), np.int64))]
        self.seated = np.zeros(len(contexts), np.int64)

    def parts(self) -> list:
        return [b"\n".join(self.words), _steps(self.contexts), _steps(self.word * len(self.contexts) + self.context), self.count.astype(np.uint32)]

    @staticmethod
    def of(blob: bytes) -> Bucket:
        words, contexts, pair, count = _unpack(blob, bytes, np.uint64, np.int64, np.uint32)
        contexts, pair = np.cumsum(contexts, dtype=np.uint64), np.cumsum(pair)
        return Bucket(words.split(b"\n") if len(count) else [], contexts, pair // len(contexts), pair % len(contexts), count.astype(np.int64))

    def take(self, state: bytes) -> None:
        seated, *tables = _unpack(state, *(np.uint32,) * 4)
        self.seated = seated.astype(np.int64)
        self.levels = [Level(t.astype(np.int64)) for t in tables]

    def state(self) -> bytes:
        return _pack(self.seated.astype(np.uint32), *[level.tables.astype(np.uint32) for level in self.levels])

    def customers(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the endings' restaurants and of the word restaurant, by dish."""
        one = np.bincount(self.up, self.levels[0].tables, len(self.group)).astype(np.int64)
        return one, np.bincount(self.group_word, self.levels[1].tables, len(self.words)).astype(np.int64)

    def parents(self, totals: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(spelling) and P(word) of each word, and P(word | ending) of each dish of the endings' restaurants."""
        if not self.words:
            return (np.zeros(0),) * 3
        _, d1, d0 = totals["d"]
        one, zero = self.customers()
        spelt = totals["spelling"].of(self.codes, self.starts)
        root = (zero - d0 * self.levels[2].tables + (STRENGTH + d0 * totals["T0"]) * spelt) / (STRENGTH + totals["C0"])
        ending = (one - d1 * self.levels[1].tables + (STRENGTH + d1 * totals["T1"][self.ending]) * root[self.group_word]) / (STRENGTH + totals["C1"][self.ending])
        return spelt, root, ending

    def sweep(self, tables: np.ndarray, totals: dict, rng: np.random.Generator) -> None:
        """tables: of each context's restaurant, over all buckets."""
        spelt, root, ending = self.parents(totals)
        d2, d1, d0 = totals["d"]
        pairs, groups, words = self.levels
        pairs = pairs.sample(self.count, tables[self.context], ending[self.up], d2, rng)
        groups = groups.sample(np.bincount(self.up, pairs.tables, len(self.group)).astype(np.int64), totals["T1"][self.ending], root[self.group_word], d1, rng)
        words = words.sample(np.bincount(self.group_word, groups.tables, len(self.words)).astype(np.int64), np.full(len(self.words), totals["T0"]), spelt, d0, rng)
        self.levels = [pairs, groups, words]

    def places(self, word: np.ndarray, name: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where pairs and their endings' dishes are, or -1. word: a number, or -1 if training has none such."""
        def at(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
            k = np.minimum(np.searchsorted(keys, x), max(len(keys) - 1, 0))
            return np.where((keys[k] == x) & (word >= 0), k, -1) if len(keys) else np.full(len(x), -1)

        ending = (name & np.uint64(ENDINGS - 1)).astype(np.int64)
        return at(self.word * len(self.contexts) + self.context, word * len(self.contexts) + context), at(self.group, word * ENDINGS + ending), ending

    def predict(self, word: np.ndarray, context: np.ndarray, places: tuple[np.ndarray, ...], tables: np.ndarray, totals: dict, parents: tuple[np.ndarray, ...], spelt: np.ndarray) -> np.ndarray:
        """P(word | context) of pairs. spelt: the spelling of each pair's word."""
        d2, d1, d0 = totals["d"]
        pair, group, ending = places
        chosen = lambda at, value, other: np.where(at >= 0, value[at], other) if len(value) else other
        p = chosen(word, parents[1], (STRENGTH + d0 * totals["T0"]) / (STRENGTH + totals["C0"]) * spelt)
        p = chosen(group, parents[2], ((STRENGTH + d1 * totals["T1"]) / (STRENGTH + totals["C1"]))[ending] * p)
        own = chosen(pair, self.count - d2 * self.levels[0].tables, 0.0)
        return (own + (STRENGTH + d2 * tables[context]) * p) / (STRENGTH + self.seated[context])

    def sums(self) -> bytes:
        """What all buckets need to know of this one's seating, bounded by the alphabet."""
        one, zero = self.customers()
        width = np.diff(np.append(self.starts, len(self.codes)))
        spell = np.bincount(self.codes, np.repeat(self.levels[2].tables, width), 65536)
        tally = lambda x: [int((x == 1).sum()), int((x == 2).sum())]
        kinds = [self.count, np.bincount(self.up, minlength=len(self.group)), np.bincount(self.group_word, minlength=len(self.words))]
        few = [zero.sum(), self.levels[2].tables.sum(), self.count.sum(), len(self.words), *(n for k in kinds for n in tally(k))]
        return _pack(np.bincount(self.ending, self.levels[1].tables, ENDINGS).astype(np.int64), np.bincount(self.ending, one, ENDINGS).astype(np.int64), spell.astype(np.int64), np.array(few, np.int64))


def _added(blobs: Iterator[bytes]) -> list[np.ndarray]:
    total = [np.zeros(n, np.int64) for n in (ENDINGS, ENDINGS, 65536, 10)]
    for b in blobs:
        for t, x in zip(total, _unpack(b, *(np.int64,) * 4)):
            t += x
    return total


def _discount(one: int, two: int) -> float:
    return min(max(one / (one + 2 * two), 0.05), 0.95) if one else 0.5


# ---- sweeps -------------------------------------------------------------------------------------------------

_ROWS = "bucket long, kind string, part int, data binary"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "kind", "part", "data"])


def _told(number: int, bucket: Bucket, buckets: int, first: bool) -> list[tuple]:
    """The rows that a bucket gives after a sweep: its seating, its sums, and its tables by context, each to the context's range."""
    tables = np.bincount(bucket.context, bucket.levels[0].tables, len(bucket.contexts)).astype(np.int64)
    seated = np.bincount(bucket.context, bucket.count, len(bucket.contexts)).astype(np.int64)
    parts = ((bucket.contexts >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.diff(parts, prepend=-1))
    rows = [(number, "state", 0, bucket.state()), (number, "sums", 0, bucket.sums())]
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(parts)]):
        more = (seated[a:b],) if first else ()
        rows.append((number, "tables", int(parts[a]), _pack(_steps(bucket.contexts[a:b]), tables[a:b], *more)))
    return rows


def _total(kinds: int):
    """Sums what buckets tell of the contexts of a range, for each of them."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        got = [_unpack(d, np.uint64, *(np.int64,) * kinds) for d in frame["data"]]
        got = [(np.cumsum(g[0], dtype=np.uint64), *g[1:]) for g in got]
        _, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([g[k] for g in got])).astype(np.int64)[at] for k in range(1, kinds + 1)]
        edge = np.cumsum([len(g[0]) for g in got])[:-1]
        each = zip(*(np.split(s, edge) for s in sums))
        return _frame([(b, "total", p, _pack(*e)) for b, p, e in zip(frame["bucket"], frame["part"], each)])

    return run


def _totals_of(rows: pd.DataFrame, kinds: int) -> list[np.ndarray]:
    got = [_unpack(d, *(np.int64,) * kinds) for d in rows.sort_values("part")["data"]]
    return [np.concatenate([g[k] for g in got]) for k in range(kinds)]


class Sampler:
    """The sweeps over all buckets, one job each."""

    def __init__(self, requests: DataFrame, buckets: int, seed: int):
        self.spark, self.buckets, self.seed, self.sweeps = requests.sparkSession, buckets, seed, 0

        def begin(frame: pd.DataFrame) -> pd.DataFrame:
            number = int(frame["bucket"].iloc[0])
            bucket = Bucket(*_merged([_request(d) for d in frame["data"]]))
            return _frame([(number, "fixed", 0, _pack(*bucket.parts())), *_told(number, bucket, buckets, True)])

        rows = cut(requests.groupBy("bucket").applyInPandas(begin, _ROWS))
        free(self.spark, PAUSE)
        # dealt once; the checkpoint is the only copy
        self.fixed = dealt(rows.where("kind = 'fixed'"), buckets, "bucket")
        self.totals: dict = {}
        self._after(rows, 2)
        del rows
        free(self.spark)

    def _after(self, rows: DataFrame, kinds: int) -> None:
        # each is written by itself, so that the parts of the sums can go, and as the buckets are dealt, so that none is shuffled again
        self.state, self.kinds = dealt(rows.where("kind = 'state'"), self.buckets, "bucket"), kinds
        self.tables = dealt(rows.where("kind = 'tables'").groupBy("part").applyInPandas(_total(kinds), _ROWS), self.buckets, "bucket")
        add = lambda frame: _frame([(0, "sums", 0, _pack(*_added(frame["data"])))])
        some = rows.where("kind = 'sums'").groupBy(F.pmod("bucket", F.lit(32)).alias("some")).applyInPandas(add, _ROWS)
        t1, c1, spell, few = _added(r.data for r in some.toLocalIterator())  # 32 rows at most
        c0, t0, n, v, *tally = few.tolist()
        d = self.totals.get("d") or tuple(_discount(*tally[k : k + 2]) for k in (0, 2, 4))
        self.totals = {"T1": t1, "C1": c1, "C0": c0, "T0": t0, "N": n, "V": v, "d": d, "spelling": self.totals.get("spelling") or Spelling(spell, self.seed)}

    def sweep(self) -> None:
        sent, kinds, buckets = self.spark.sparkContext.broadcast(self.totals), self.kinds, self.buckets
        seed = (self.seed, self.sweeps)

        def run(fixed: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
            number, kind = int(frame["bucket"].iloc[0]), frame["kind"]
            bucket = Bucket.of(fixed["data"].iloc[0])
            bucket.take(frame["data"][kind == "state"].iloc[0])
            tables, *seated = _totals_of(frame[kind == "total"], kinds)
            bucket.seated = seated[0] if seated else bucket.seated
            bucket.sweep(tables, sent.value, np.random.default_rng([*seed, number]))
            return _frame(_told(number, bucket, buckets, False))

        rows = cut(self.fixed.groupBy("bucket").cogroup(self.state.unionByName(self.tables).groupBy("bucket")).applyInPandas(run, _ROWS))
        self.sweeps += 1
        self._after(rows, 1)
        del rows
        free(self.spark)


def _answers(fixed: bytes, samples: list[tuple], requests: Iterator[bytes]) -> Iterator[bytes]:
    """For each request, one after the other: the training count of its words, and the averaged log10 P(word | context) of its pairs. samples: (state, tables, totals)."""
    bucket = Bucket.of(fixed)
    place = {w: i for i, w in enumerate(bucket.words)}
    count_of = np.append(np.bincount(bucket.word, bucket.count, len(bucket.words)), 0).astype(np.uint32)
    spelling, chains = samples[0][2]["spelling"], []
    for state, tables, totals in samples:
        bucket.take(state)
        chains.append((bucket.levels, bucket.seated, tables, totals, bucket.parents(totals)))
    for request in requests:
        words, of_word, own, context, _ = _request(request)
        at = np.array([place.get(w, -1) for w in words], np.int64)
        of, context = np.repeat(np.arange(len(words)), of_word), np.searchsorted(bucket.contexts, own)[context]
        places, spelt = bucket.places(at[of], bucket.contexts[context], context), spelling.of(*_codes(words))[of]
        total = np.zeros(len(of))
        for levels, seated, tables, totals, parents in chains:
            bucket.levels, bucket.seated = levels, seated
            total += bucket.predict(at[of], context, places, tables, totals, parents, spelt)
        yield _pack(count_of[at], np.log10(total / len(samples)))


def hpy_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, burn_in: int = BURN_IN, samples: int = SAMPLES, seed: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS))
    # dealt once, to be read for the first seating, for the answers and for the sums, of which the checkpoint is the only copy
    made = dealt(rows.mapInArrow(_blocks(buckets, folds), "block long, bucket long, data binary"), buckets, "bucket")
    free(spark, PAUSE)
    requests = made.where("bucket >= 0")
    chain = Sampler(requests, buckets, seed)
    kept, totals = [], []
    for k in range(burn_in + samples):
        chain.sweep()
        if k >= burn_in:
            of = len(kept)
            kept.append(chain.state.unionByName(chain.tables).select("bucket", F.concat("kind", F.lit(of)).alias("kind"), "part", "data"))
            totals.append(chain.totals)
    free(spark, PAUSE)  # of the last sweep, before the answers take their room
    told = spark.sparkContext.broadcast(totals)
    n, v = chain.totals["N"], chain.totals["V"]

    def answer(own: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        kind = frame["kind"]
        one = lambda name: frame["data"][kind == name].iloc[0]
        chains = [(one(f"state{k}"), _totals_of(frame[kind == f"total{k}"], 1)[0], t) for k, t in enumerate(told.value)]
        return pd.DataFrame({"block": own["block"], "bucket": own["bucket"], "data": list(_answers(one("fixed"), chains, own["data"]))})

    def combine(own: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bucket")
        ids, null, out, sizes, of_word, which = _unpack(own["data"].iloc[0], np.int64, np.bool_, np.bool_, np.int64, np.uint32, np.int32)
        which = np.cumsum(which, dtype=np.int64)
        parts = [_unpack(d, np.uint32, np.float64) for d in frame["data"]]
        word_count = np.concatenate([c for c, _ in parts]).astype(float)
        log_p = np.concatenate([p for _, p in parts]).astype(float)
        base = np.repeat(np.log10((word_count + 0.1) / (n + 0.1 * (v + 1))), of_word)
        known = np.repeat(word_count > 0, of_word)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        add = lambda x: np.add.reduceat(x[which], starts)
        return pd.DataFrame({
            "doc_id": pd.array(np.where(null, 0, ids), "Int64").copy() if not null.any() else pd.array([None if z else i for i, z in zip(ids.tolist(), null)], "Int64"),
            "held_out": out, "n_tokens": sizes, "n_known": add(known.astype(np.int64)), "train_tokens": n, "base_score": add(base), "score": add(log_p),
        })

    seating = chain.fixed
    for more in kept:
        seating = seating.unionByName(more)
    answers = requests.groupBy("bucket").cogroup(seating.groupBy("bucket")).applyInPandas(answer, "block long, bucket long, data binary")
    answers = answers.withColumn("of", -1 - F.col("block"))
    return made.where("bucket < 0").groupBy("bucket").cogroup(answers.groupBy("of")).applyInPandas(
        combine, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
