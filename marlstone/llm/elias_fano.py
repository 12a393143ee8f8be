"""Elias-Fano sequences and the levels of an n-gram trie, as flat arrays that can be memory-mapped."""

from __future__ import annotations

import io
import os
import tempfile

import numpy as np

_WORD = 64
#: Place of the k-th set bit of a byte, by byte and k.
_SELECT8 = np.zeros((256, 8), dtype=np.int64)
for _b in range(256):
    for _k, _at in enumerate(i for i in range(8) if _b >> i & 1):
        _SELECT8[_b, _k] = _at


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit (from 0); before counts set bits before each word."""
    word = np.searchsorted(before, k, side="right") - 1
    rest = k - before[word]
    eight = words[word][:, None] >> (np.arange(8, dtype=np.uint64) * np.uint64(8)) & np.uint64(255)
    ends = np.cumsum(np.bitwise_count(eight), axis=1, dtype=np.int64)
    byte = (ends <= rest[:, None]).sum(axis=1)
    row = np.arange(len(k))
    rest = rest - np.where(byte > 0, ends[row, byte - 1], 0)
    return word * _WORD + byte * 8 + _SELECT8[eight[row, byte].astype(np.int64), rest]


class EliasFano:
    """A non-decreasing sequence below a bound: high parts in unary, low parts packed.

    get() reads members, first_from() finds the first member not less than a value among a range of
    members; both take whole arrays of queries.
    """

    FIELDS = ("low", "high", "ones", "zeros")

    def __init__(self, size: int, shift: int, arrays: dict[str, np.ndarray]):
        self.size, self.shift = size, shift
        self.low, self.high, self.ones, self.zeros = (arrays[f] for f in self.FIELDS)

    @staticmethod
    def of(values: np.ndarray, bound: int) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        shift = max(0, int(bound // max(n, 1)).bit_length() - 1)
        at = (values >> np.uint64(shift)).astype(np.int64) + np.arange(n)
        bits = np.zeros(((bound >> shift) + n) // _WORD * _WORD + 2 * _WORD, dtype=np.uint8)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        count = np.bitwise_count(high).astype(np.int64)
        ones = np.append(0, np.cumsum(count))[:-1]
        return EliasFano(n, shift, {"low": _pack(values, shift), "high": high, "ones": ones, "zeros": np.arange(len(high)) * _WORD - ones})

    def _lows(self, i: np.ndarray) -> np.ndarray:
        return _unpack(self.low, i, self.shift)

    def get(self, i: np.ndarray) -> np.ndarray:
        place = _select(self.high, self.ones, i)
        return ((place - i).astype(np.uint64) << np.uint64(self.shift)) | self._lows(i)

    def first_from(self, value: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Index of the first member of start..end that is not less than value, or end."""
        high = (value >> np.uint64(self.shift)).astype(np.int64)
        zero = lambda k: _select(~self.high, self.zeros, k) - k  # noqa: E731  members before the k-th zero
        low = np.where(high > 0, zero(np.maximum(high - 1, 0)), 0)
        top = np.clip(zero(high), start, end)
        low = np.clip(low, start, end)
        rest = value & np.uint64((1 << self.shift) - 1)
        while True:  # binary search of the low parts among members with this high part
            open_ = np.flatnonzero(low < top)
            if not len(open_):
                return low
            mid = (low[open_] + top[open_]) >> 1
            less = self._lows(mid) < rest[open_]
            low[open_] = np.where(less, mid + 1, low[open_])
            top[open_] = np.where(less, top[open_], mid)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest width bits of values after one another, in words, and one word to spare."""
    out = np.zeros(len(values) * width // _WORD + 2, dtype=np.uint64)
    if width:
        kept = values & np.uint64((1 << width) - 1)
        at = np.arange(len(values), dtype=np.int64) * width
        offset = (at & 63).astype(np.uint64)
        np.bitwise_or.at(out, at >> 6, kept << offset)
        over = np.flatnonzero(offset + np.uint64(width) > 64)
        np.bitwise_or.at(out, (at[over] >> 6) + 1, kept[over] >> (np.uint64(64) - offset[over]))
    return out


def _unpack(words: np.ndarray, i: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(i), dtype=np.uint64)
    at = i.astype(np.int64) * width
    offset = (at & 63).astype(np.uint64)
    out = words[at >> 6] >> offset
    over = np.flatnonzero(offset + np.uint64(width) > 64)
    out[over] |= words[(at[over] >> 6) + 1] << (np.uint64(64) - offset[over])
    return out & np.uint64((1 << width) - 1)


class Trie:
    """Contexts, pointers to their successors, successors, and a quantised probability for each successor.

    Contexts and successors are numbers below 2 ** bits. The successor level holds each successor
    behind its context's rank, which makes the level one non-decreasing sequence; a query finds its
    context, follows the pointers and searches the successors between them.
    """

    PARTS = ("contexts", "pointers", "successors")

    def __init__(self, bits: int, levels: dict[str, EliasFano], codes: np.ndarray):
        self.bits, self.codes = bits, codes
        self.contexts, self.pointers, self.successors = (levels[p] for p in self.PARTS)

    @staticmethod
    def of(keys: np.ndarray, codes: np.ndarray, bits: int) -> Trie:
        """From sorted distinct keys (context << bits | successor) and their codes."""
        context = keys >> np.uint64(bits)
        new = np.append(True, context[1:] != context[:-1]) if len(keys) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        rank = (np.cumsum(new) - 1).astype(np.uint64)
        level = (rank << np.uint64(bits)) | (keys & np.uint64((1 << bits) - 1))
        levels = {"contexts": EliasFano.of(context[start], 1 << bits), "pointers": EliasFano.of(np.append(start, len(keys)), len(keys) + 1), "successors": EliasFano.of(level, (len(start) + 1) << bits)}
        return Trie(bits, levels, codes.astype(np.uint16))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The code of each key, 0 if the trie doesn't have it."""
        out = np.zeros(len(keys), dtype=np.uint16)
        if not len(self.codes) or not len(keys):
            return out
        context = keys >> np.uint64(self.bits)
        n = np.full(len(keys), self.contexts.size)
        rank = self.contexts.first_from(context, np.zeros(len(keys), dtype=np.int64), n)
        of = np.flatnonzero(rank < self.contexts.size)
        of = of[self.contexts.get(rank[of]) == context[of]]
        own = rank[of]
        start, end = (self.pointers.get(own + k).astype(np.int64) for k in (0, 1))
        want = (own.astype(np.uint64) << np.uint64(self.bits)) | (keys[of] & np.uint64((1 << self.bits) - 1))
        at = self.successors.first_from(want, start, end)
        inside = np.flatnonzero(at < end)
        inside = inside[self.successors.get(at[inside]) == want[inside]]
        out[of[inside]] = self.codes[at[inside]]
        return out

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        parts = [getattr(getattr(self, p), f) for p in self.PARTS for f in EliasFano.FIELDS] + [self.codes]
        head = [self.bits] + [x for p in self.PARTS for x in (getattr(self, p).size, getattr(self, p).shift)] + [x.nbytes for x in parts]
        out.write(np.array(head, dtype=np.int64).tobytes())
        for x in parts:
            out.write(np.ascontiguousarray(x).tobytes() + bytes(-x.nbytes % 8))
        return out.getvalue()

    @staticmethod
    def from_buffer(data: np.ndarray) -> Trie:
        """From to_bytes() as an array of bytes, of memory or of a mapped file, without copying it."""
        n_parts = len(Trie.PARTS) * len(EliasFano.FIELDS) + 1
        head = data[: 8 * (1 + 2 * len(Trie.PARTS) + n_parts)].view(np.int64)
        at = head.nbytes
        arrays = []
        for k, size in enumerate(head[1 + 2 * len(Trie.PARTS) :].tolist()):
            kind = np.uint16 if k == n_parts - 1 else (np.uint64, np.uint64, np.int64, np.int64)[k % 4]
            arrays.append(data[at : at + size].view(kind))
            at += size + -size % 8
        levels = {p: EliasFano(int(head[1 + 2 * i]), int(head[2 + 2 * i]), dict(zip(EliasFano.FIELDS, arrays[4 * i : 4 * i + 4]))) for i, p in enumerate(Trie.PARTS)}
        return Trie(int(head[0]), levels, arrays[-1])


def mapped(data: bytes) -> np.ndarray:
    """data as a memory-mapped file that is gone as soon as the mapping is."""
    handle, path = tempfile.mkstemp()
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        return np.memmap(path, dtype=np.uint8, mode="r")
    finally:
        os.unlink(path)
