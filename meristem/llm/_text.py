"""Vectorised text kernels over Arrow batches, shared by the operators that work in Python tasks.

A batch's texts are handled in blocks of a bounded number of bytes, whole documents at a time, so a
worker's memory follows the block (or the longest single document), never the partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

#: The bytes between words (space, tab, line feed, vertical tab, form feed, carriage return).
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise."""
    x = x.astype(_U, copy=True)
    x += _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_VALUE = mix(np.arange(256, dtype=_U))
_BYTE_VALUE[65:91] = _BYTE_VALUE[97:123]  # A-Z hash as a-z
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SEPARATORS)] = False
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(0, _U), np.ones(0, _U))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; grown on demand and kept by the worker."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        tables = []
        for b in (_BASE, _INVERSE):
            t = np.full(size, _U(b))
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers = (tables[0], tables[1])
    return _powers


def crc32_of_id(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    column = column.fill_null("") if column.null_count else column
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    if len(column) == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of blocks of whole texts, of limit bytes or one text at most."""
    data, offsets = text_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each text's first word (n + 1 numbers)."""
    word = IS_WORD[data]
    if not len(word):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:-1] | np.concatenate(([True], ~word[:-1]))))
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate((~word[1:], [True])))) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and the index of each text's first word (n + 1 numbers)."""
    starts, ends, first = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, _U), first
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE_VALUE[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts]), first


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text; of fewer words, the whole sequence's; of none, none."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    total = np.full(n - width + 1, _U(width * 0xA24BAED4963EE407 % (1 << 64)))
    for j in range(width):
        total = mix(total + words[j : n - width + 1 + j])
    return total


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unicode code points of a block, and offsets counted in them."""
    lead = (data & 0xC0) != 0x80
    position = np.concatenate(([0], np.cumsum(lead)))
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), position[offsets]
