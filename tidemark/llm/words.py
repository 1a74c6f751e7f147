"""Words of a block of texts as numbers, by array operations on their bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one block has at most, unless a single text is longer.
BLOCK_BYTES = 4 << 20


@dataclass
class Words:
    """Words in the order of the texts."""

    #: Each word's text, as its place in the block.
    row: np.ndarray
    #: Each word's piece: equal for words of one row with no break between them, growing from piece to piece.
    piece: np.ndarray
    #: Each word's number, 0, 1, ... by first occurrence.
    word: np.ndarray
    #: The bytes of the words by number.
    names: pa.Array


def blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of BLOCK_BYTES at most."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    at = 0
    while at < len(texts):
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + BLOCK_BYTES, "right")))
        yield at, end
        at = end


def words_of(texts: pa.Array, spaces: bytes, breaks: bytes = b"", lower: bool = False, apart: bytes = b"") -> Words:
    """Runs of anything but spaces and breaks; A-Z in lower case where asked. Spaces and breaks are single ASCII bytes; null counts as empty.

    A run also ends between an ASCII letter and a byte of `apart`, in either order.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size = int(offsets[-1] - offsets[0])
    data = np.frombuffer(texts.buffers()[2], np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
        data = table[data]
    inside = np.ones(256, bool)
    inside[list(spaces + breaks)] = False
    inside = inside[data]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    if apart:
        side = np.zeros(256, np.uint8)
        side[[*range(65, 91), *range(97, 123)]] = 1
        side[list(apart)] = 2
        side = side[data]
        start[1:] |= (side[1:] ^ side[:-1]) == 3
    start = np.flatnonzero(start)
    kind = np.int32 if size < 2**31 else np.int64
    row = (np.searchsorted(offsets, start, "right") - 1).astype(np.int32)
    upto = np.cumsum(inside, dtype=kind)  # bytes of words up to and with a byte
    bounds = np.append(upto[start].astype(np.int64) - 1, upto[-1] if size else 0) if len(start) else np.zeros(1, np.int64)
    kept = data[inside]
    del upto, edge
    names = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.ascontiguousarray(bounds)), pa.py_buffer(kept)]).dictionary_encode()
    piece = row.astype(kind)
    if breaks:
        cuts = np.zeros(256, bool)
        cuts[list(breaks)] = True
        piece += np.cumsum(cuts[data], dtype=kind)[start]
    return Words(row, piece, np.asarray(names.indices), names.dictionary)
