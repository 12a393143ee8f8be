"""Vectorised text primitives on Arrow buffers: no Python code runs per word or byte."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space of the word contracts: space, tab, line feed, vertical tab, form feed, return.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: Text that one vectorised step takes at most, unless a single document is longer.
CHUNK_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_NOT_SPACE = np.ones(256, dtype=bool)
_NOT_SPACE[list(SPACE_BYTES)] = False
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[ord("0") : ord("9") + 1] = True
_ALNUM[ord("A") : ord("Z") + 1] = True
_ALNUM[ord("a") : ord("z") + 1] = True
_ALNUM[128:] = True


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows with about limit bytes of text each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts after one another and the offsets (n + 1); null is empty."""
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def words(texts: pa.Array, kind: str = "space", lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts (binary, in order) and the offsets of each text's words (n + 1).

    kind "space": maximal runs of bytes that aren't ASCII white space. kind "alnum": maximal runs
    of ASCII letters, digits and non-ASCII bytes. lower: A-Z become a-z. Null and empty: no word.
    """
    data, at = raw(texts)
    spread = np.full(len(data) + len(at), 32, dtype=np.uint8)  # a space before each text and at the end
    where = np.ones(len(spread), dtype=bool)
    where[at + np.arange(len(at))] = False
    spread[where] = data
    inside = (_NOT_SPACE if kind == "space" else _ALNUM)[spread]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    kept = spread[inside]
    if lower:
        kept = _LOWER[kept]
    ends_at = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=ends_at[1:])
    out = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends_at), pa.py_buffer(kept)])
    return out, np.searchsorted(starts, at + np.arange(len(at)))


def coded(tokens: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Local ids of tokens, and the distinct tokens by id."""
    if not len(tokens):
        return np.zeros(0, np.int64), tokens
    d = pc.dictionary_encode(tokens)
    return d.indices.to_numpy().astype(np.int64), d.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes of a token that are hashed place by place with those of others; what is behind is folded in by itself.
_WALKED = 64
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, dtype=np.uint64))


def hashes(tokens: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each token: a function of the token alone, on every machine.

    Places up to the longest token are walked together, so the work is in proportion to the bytes:
    tokens are taken longest first and leave the walk as they end.
    """
    data, at = raw(tokens)
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    alive, h = size[order], mix(size.astype(np.uint64) + np.uint64(seed * 7919 + 1))[order]
    first = at[:-1][order]
    for j in range(int(min(_WALKED, alive[0]))) if len(alive) else ():
        left = int(np.searchsorted(-alive, -j, side="left"))  # tokens longer than j
        h[:left] = (h[:left] ^ data[first[:left] + j]) * np.uint64(0x100000001B3)
        h[:left] ^= h[:left] >> np.uint64(29)
    for i in range(int(np.searchsorted(-alive, -_WALKED, side="left"))):
        for b in range(_WALKED, int(alive[i]), len(_POWERS)):
            part = data[first[i] + b : first[i] + min(b + len(_POWERS), int(alive[i]))].astype(np.uint64)
            h[i : i + 1] = mix(h[i : i + 1] ^ np.sum((part + np.uint64(1)) * _POWERS[: len(part)], dtype=np.uint64))
    out = np.empty_like(h)
    out[order] = mix(h)
    return out


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row that each element belongs to, by the rows' offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def rows_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values by row (0 for a row without elements)."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
