"""Elias-Fano sequences over numpy arrays, searched in bulk, and files of them that tasks map into memory."""

from __future__ import annotations

import json
import mmap
import uuid

import numpy as np
import pyarrow.fs

_U = np.uint64
_SELECT = np.full((256, 8), 8, np.uint8)  # place of the k-th one in a byte
for _b in range(256):
    for _k, _p in enumerate([i for i in range(8) if _b >> i & 1]):
        _SELECT[_b, _k] = _p


class EliasFano:
    """A rising sequence of non-negative numbers: low bits packed, high bits in unary with zeros that end buckets.

    zeros and ones have the zeros and ones before each word of the high bits, so that both can be selected.
    """

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.zeros, self.ones = n, bits, low, high, zeros, ones

    @staticmethod
    def build(values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        values = values.astype(_U)
        low = np.zeros(n * bits // 64 + 2, _U)
        if bits and n:
            part = values & _U((1 << bits) - 1)
            at = np.arange(n, dtype=_U) * _U(bits)
            word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + _U(bits) > _U(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (_U(64) - shift[over]))
        top = (values >> _U(bits)).astype(np.int64)
        buckets = (max(universe - 1, 0) >> bits) + 1
        flags = np.zeros((n + buckets + 63) // 64 * 64 + 64, np.uint8)
        flags[top + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view(_U)
        set_ = np.bitwise_count(high).astype(np.int64)
        narrow = np.uint32 if len(flags) < 1 << 32 else np.uint64
        zeros, ones = (np.concatenate(([0], np.cumsum(c))).astype(narrow) for c in (64 - set_, set_))
        return EliasFano(n, bits, low, high, zeros, ones)

    @staticmethod
    def _select(high: np.ndarray, before: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        """Places of the k-th zeros or ones (from 0), with those before each word."""
        k = k.astype(before.dtype)
        word = np.searchsorted(before, k, side="right") - 1
        rest = (k - before[word]).astype(_U)
        bits = ~high[word] if flip else high[word]
        # in each byte of a word: the ones up to and with that byte
        upto = bits - ((bits >> _U(1)) & _U(0x5555555555555555))
        upto = (upto & _U(0x3333333333333333)) + ((upto >> _U(2)) & _U(0x3333333333333333))
        upto = ((upto + (upto >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _U(0x0101010101010101)
        # a byte's top bit stays set where no more than the wanted number have come by it
        passed = ((rest * _U(0x0101010101010101)) | _U(0x8080808080808080)) - upto
        shift = np.bitwise_count(passed & _U(0x8080808080808080)).astype(_U) << _U(3)
        rest -= ((upto << _U(8)) >> shift) & _U(0xFF)
        return word * 64 + shift.astype(np.int64) + _SELECT[((bits >> shift) & _U(0xFF)).astype(np.uint8), rest.astype(np.uint8)]

    def _low_at(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), _U)
        at = i.astype(_U) * _U(self.bits)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        first = self.low[word] >> shift
        over = np.where(shift > 0, self.low[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return (first | over) & _U((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at indexes."""
        top = self._select(self.high, self.ones, i, False) - i
        return (top.astype(_U) << _U(self.bits)) | self._low_at(i)

    def find(self, values: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Indexes of values, each within its own range of indexes where ranges are given; -1 for those that are not there.

        A range of one is looked at. Else the bucket of a value's high bits is selected and cut down to
        the range, and the successor of its low bits searched there.
        """
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        several = np.ones(len(values), bool)
        if start is not None:
            one = np.flatnonzero(end - start == 1)
            out[one] = np.where(self.access(start[one]) == values[one], start[one], -1)
            several = end - start > 1
        top = (values >> _U(self.bits)).astype(np.int64)
        inside = np.flatnonzero(several & (top < int(self.zeros[-1]) - 64))  # the last zeros are padding
        top, part = top[inside], values[inside] & _U((1 << self.bits) - 1)
        stop = self._select(self.high, self.zeros, top, True) - top
        at = np.where(top > 0, self._select(self.high, self.zeros, np.maximum(top - 1, 0), True) - (top - 1), 0)
        if start is not None:
            at, stop = np.maximum(at, start[inside]), np.minimum(stop, end[inside])
        last = stop.copy()
        live = np.flatnonzero(at < stop)
        while len(live):
            middle = (at[live] + stop[live]) >> 1
            less = self._low_at(middle) < part[live]
            at[live[less]] = middle[less] + 1
            stop[live[~less]] = middle[~less]
            live = live[at[live] < stop[live]]
        some = np.flatnonzero(at < last)
        some = some[self._low_at(at[some]) == part[some]]
        out[inside[some]] = at[some]
        return out

    def arrays(self, prefix: str = "") -> dict[str, np.ndarray]:
        own = {"shape": np.array([self.n, self.bits], np.int64), "low": self.low, "high": self.high, "zeros": self.zeros, "ones": self.ones}
        return {prefix + k: v for k, v in own.items()}

    @staticmethod
    def of(arrays: dict[str, np.ndarray], prefix: str = "") -> EliasFano:
        n, bits = arrays[prefix + "shape"].tolist()
        return EliasFano(n, bits, *(arrays[prefix + k] for k in ("low", "high", "zeros", "ones")))


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file in a folder that all executors share. A repeated attempt writes the same bytes, and a rename makes them appear at once."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    spec, at = {}, 0
    for k, v in arrays.items():
        spec[k] = [str(v.dtype), v.shape, at]
        at += -(-v.nbytes // 64) * 64
    head = json.dumps(spec).encode()
    head = len(head).to_bytes(8, "little") + head
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as f:
        f.write(head + bytes(-len(head) % 64))
        for v in arrays.values():
            f.write(np.ascontiguousarray(v).tobytes() + bytes(-v.nbytes % 64))
    fs.move(draft, f"{path}/{name}")


def is_mapped(arrays: dict[str, np.ndarray]) -> bool:
    """Whether the arrays of map_arrays lie in a mapped file."""
    base = next(iter(arrays.values()), None)
    while isinstance(base, np.ndarray) and not isinstance(base, np.memmap):
        base = base.base
    return isinstance(base, (np.memmap, mmap.mmap))


def map_arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    """The file's arrays, mapped into memory; from a store that is no file system they are read into memory."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        data = np.asarray(np.memmap(f"{path}/{name}", np.uint8, "r"))
    else:
        with fs.open_input_file(f"{path}/{name}") as f:
            data = np.frombuffer(f.read_buffer(), np.uint8)
    size = int.from_bytes(data[:8].tobytes(), "little")
    spec = json.loads(data[8 : 8 + size].tobytes())
    base = -(-(8 + size) // 64) * 64
    out = {}
    for k, (kind, shape, at) in spec.items():
        kind = np.dtype(kind)
        count = int(np.prod(shape))
        out[k] = data[base + at : base + at + count * kind.itemsize].view(kind).reshape(shape)
    return out
