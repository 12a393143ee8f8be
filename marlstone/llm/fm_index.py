"""Benchmark decontamination by an FM-index over each shard of training documents.

A shard is a run of whole documents with about SHARD_BYTES of text. All its words become symbols,
those that no benchmark window has one symbol together; the Burrows-Wheeler transform of the
symbols is held in a wavelet matrix whose ranks drive backward search of every benchmark window at
once; occurrences are located by walking to sampled suffix positions; their word spans merge.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import text
from marlstone.llm.store import map_batches

#: Words of a window; a shorter item is one window as it is.
WINDOW = 13
#: Benchmark text that one pass over the documents searches for; a larger benchmark takes more passes.
BLOCK_BYTES = 8 << 20
#: Text of the documents that are indexed together; a longer document is a shard of its own.
SHARD_BYTES = 8 << 20
#: Distance of sampled suffix positions.
SAMPLE = 16
#: Symbols that end the shard, end a document and stand for words that no window has.
_END, _GAP, _OTHER, _FIRST = 0, 1, 2, 3


class Bits:
    """A bit vector with constant-time rank: packed words and a running count per word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Wavelet:
    """Ranks of any symbol in a sequence: one bit vector for each bit of the symbols, highest first."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.shifts = list(range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1))
        self.levels, self.zeros = [], []
        for shift in self.shifts:
            bits = ((sequence >> shift) & 1).astype(bool)
            self.levels.append(Bits(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            sequence = np.concatenate([sequence[~bits], sequence[bits]])
        self.start = self._down(np.arange(symbols), np.zeros(symbols, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, level, zeros in zip(self.shifts, self.levels, self.zeros):
            ones = level.rank(at)
            at = np.where((symbol >> shift) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._down(symbol, at) - self.start[symbol]

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it stands before it."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for shift, level, zeros in zip(self.shifts, self.levels, self.zeros):
            bit, ones = level.get(at), level.rank(at)
            symbol |= bit.astype(np.int64) << shift
            at = np.where(bit, zeros + ones, at - ones)
        return symbol, at - self.start[symbol]


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling over those that are still tied.

    The first order is by as many symbols, a power of two, as one integer holds.
    """
    n = len(sequence)
    bits = int(sequence.max(initial=0) + 1).bit_length()
    rank = np.empty(n, dtype=np.int64)
    keys, step = sequence.astype(np.int64) + 1, 1
    while 2 * step * bits < 63:
        keys = (keys << (step * bits)) | np.append(keys[step:], np.zeros(min(step, n), np.int64))
        step *= 2
    order = np.argsort(keys)

    def ranks(of: np.ndarray, keys: np.ndarray, base: np.ndarray) -> None:
        new = np.ones(len(of), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        rank[of] = base[np.maximum.accumulate(np.where(new, np.arange(len(of)), 0))]

    ranks(order, keys[order], np.arange(n))
    while True:
        sorted_rank = rank[order]
        tied = np.zeros(n, dtype=bool)
        same = sorted_rank[1:] == sorted_rank[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        part = order[at]
        next_rank = np.where(part + step < n, rank[np.minimum(part + step, n - 1)] + 1, 0)
        by = np.lexsort((next_rank, sorted_rank[at]))
        part, group, next_rank = part[by], sorted_rank[at][by], next_rank[by]
        order[at] = part
        ranks(part, group * (n + 1) + next_rank, at)
        step *= 2


class FmIndex:
    """Counts and places of patterns in a sequence of symbols above _END."""

    def __init__(self, sequence: np.ndarray, symbols: int, sample: int = SAMPLE):
        sequence = np.append(sequence, _END)
        order = suffix_array(sequence)
        self.size = len(sequence)
        self.bwt = Wavelet(sequence[order - 1], symbols)
        self.first = np.zeros(symbols + 1, dtype=np.int64)
        np.cumsum(np.bincount(sequence, minlength=symbols), out=self.first[1:])
        sampled = order % sample == 0
        self.sampled, self.samples = Bits(sampled), order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that start with each row of patterns (empty: it doesn't occur)."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.size, dtype=np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            low[live] = self.first[c] + self.bwt.rank(c, low[live])
            high[live] = self.first[c] + self.bwt.rank(c, high[live])
            live = live[high[live] > low[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the sequence of the suffix in each row."""
        out, steps, at, of = np.empty(len(rows), dtype=np.int64), 0, rows, np.arange(len(rows))
        while len(of):
            done = self.sampled.get(at)
            out[of[done]] = self.samples[self.sampled.rank(at[done])] + steps
            at, of, steps = at[~done], of[~done], steps + 1
            symbol, before = self.bwt.read(at)
            at = self.first[symbol] + before
        return out


@dataclass
class Phrases:
    """Windows of one block of the benchmark."""

    vocabulary: pa.Array
    #: By window length: word ids, a row for each window, and offsets and numbers of the items that have it.
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    items: list[str]

    @staticmethod
    def of(items: list[str], texts: list[str | None], size: int = WINDOW) -> Phrases:
        names = sorted(set(items))
        number = np.searchsorted(names, items) if names else np.zeros(0, np.int64)
        tokens, at = text.words(pa.array(texts, pa.string()), "alnum")
        ids, vocabulary = text.coded(tokens)
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for k in range(len(items)):
            own = ids[at[k] : at[k + 1]]
            if len(own):
                rows = np.lib.stride_tricks.sliding_window_view(own, min(size, len(own)))
                found.setdefault(rows.shape[1], []).append((rows, np.full(len(rows), number[k])))
        windows = {}
        for length, parts in found.items():
            rows, of = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            rows, inverse = np.unique(rows, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([inverse.ravel(), of], axis=1), axis=0)
            windows[length] = (rows, np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1)), pairs[:, 1])
        return Phrases(vocabulary, windows, names)


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges low..high, and the range each belongs to."""
    size = high - low
    of = np.repeat(np.arange(len(low)), size)
    return low[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size), of


def _hits(texts: pa.Array, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's texts: words by text; (text, first, last) of occurrences, one row each; (text, item) pairs."""
    tokens, at = text.words(texts, "alnum")
    n_words = np.diff(at)
    if not phrases.windows or not len(tokens):
        return n_words, np.zeros((0, 3), np.int64), np.zeros((0, 2), np.int64)
    sequence = np.full(len(tokens) + len(texts), _GAP, dtype=np.int64)
    opens = at[:-1] + np.arange(len(texts))  # where each text's words start in the sequence
    sequence[np.arange(len(tokens)) + text.row_of(at)] = pc.fill_null(pc.index_in(tokens, value_set=phrases.vocabulary), _OTHER - _FIRST).to_numpy() + _FIRST
    del tokens
    present = np.union1d(sequence, [_END])
    local = np.full(len(phrases.vocabulary) + _FIRST, -1, dtype=np.int64)
    local[present] = np.arange(len(present))
    index = FmIndex(local[sequence], len(present))
    spans, pairs = [], []
    for length, (windows, item_at, item_of) in phrases.windows.items():
        symbols = local[windows + _FIRST]
        there = np.flatnonzero((symbols >= 0).all(axis=1))
        low, high = index.search(symbols[there])
        found = np.flatnonzero(high > low)
        rows, of = _spread(low[found], high[found])
        place = index.locate(rows)
        row = np.searchsorted(opens, place, side="right") - 1
        start, window = place - opens[row], there[found][of]
        spans.append(np.stack([row, start, start + length - 1], axis=1))
        once = np.unique(np.stack([row, window], axis=1), axis=0)
        k, which = _spread(item_at[once[:, 1]], item_at[once[:, 1] + 1])
        pairs.append(np.stack([once[which, 0], item_of[k]], axis=1))
    return n_words, np.concatenate(spans), np.unique(np.concatenate(pairs), axis=0)


def merged(spans: np.ndarray) -> np.ndarray:
    """Rows (text, first, last) with overlapping and touching spans of a text made one, in order."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    base = spans[:, 0] * (int(spans[:, 2].max()) + 3)  # so that spans of different texts never touch
    reach = np.maximum.accumulate(base + spans[:, 2])
    new = np.append(True, base[1:] + spans[1:, 1] > reach[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(spans)) - 1
    return np.stack([spans[at, 0], spans[at, 1], (reach - base)[last]], axis=1)


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_SPANS_SQL = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
#: The columns that scan() adds.
ADDED = ("n_words", "n_hit", "spans", "items")


def _lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values)


def _scan(batches: Iterator[pa.RecordBatch], phrases: Phrases, text_col: str, keep: list[str], shard_bytes: int = SHARD_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in (shard for batch in batches for shard in text.slices(batch, text_col, shard_bytes)):
        n_words, spans, pairs = _hits(batch.column(text_col), phrases)
        names = [phrases.items[i] for i in pairs[:, 1]]
        if "spans" in batch.schema.names:  # a later block of the benchmark: add what earlier ones found
            was = batch.column("spans")
            row = text.row_of(was.offsets.to_numpy())
            spans = np.concatenate([spans, np.stack([row, *(was.flatten().field(c).to_numpy() for c in ("first", "last"))], axis=1).astype(np.int64)])
            was = batch.column("items")
            both = sorted({*zip(pairs[:, 0].tolist(), names), *zip(text.row_of(was.offsets.to_numpy()).tolist(), was.flatten().to_pylist())})
            rows, names = np.array([r for r, _ in both], dtype=np.int64), [x for _, x in both]
        else:
            rows = pairs[:, 0]
        spans = merged(spans)
        covered = np.zeros(batch.num_rows, dtype=np.int64)
        np.add.at(covered, spans[:, 0], spans[:, 2] - spans[:, 1] + 1)
        pieces = pa.StructArray.from_arrays([pa.array(spans[:, 1], pa.int32()), pa.array(spans[:, 2], pa.int32())], names=["first", "last"])
        added = [pa.array(n_words, pa.int64()), pa.array(covered, pa.int64()), _lists(spans[:, 0], batch.num_rows, pieces), _lists(rows, batch.num_rows, pa.array(names, pa.string()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *added], names=[*keep, *ADDED])


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[list[str], list[str]]]:
    """The benchmark in blocks of about limit bytes of text, read one partition at a time."""
    ids: list[str] = []
    texts: list[str] = []
    size = 0
    for item, body in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).toLocalIterator():
        ids.append(item)
        texts.append(body)
        size += len(body.encode())
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    yield ids, texts


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, keep_text: bool = True) -> DataFrame:
    """docs with what the benchmark has in common with them.

    Added: n_words and n_hit (bigint), spans (first and last word, from 0, of the merged spans to
    remove, in order), items (the item ids, as sorted distinct strings). Columns of docs by those
    names are replaced. Words are maximal runs of ASCII letters, digits and non-ASCII characters,
    A-Z lower-cased. Null or empty text has no words and no hits. Items with a null id or text are
    passed over; rows that share an id are one item. Rows of docs stay as they are, repeated ones too.
    """
    out = docs.drop(*ADDED)
    sc = docs.sparkSession.sparkContext
    first = True
    all_blocks = blocks(benchmark, item_id, item_text, block_bytes)
    block = next(all_blocks)
    while block is not None:
        following = next(all_blocks, None)
        if following == ([], []):
            following = None
        phrases = sc.broadcast(Phrases.of(*block, window))
        keep = [c for c in docs.columns if c.lower() not in ADDED and (keep_text or c != text_col or following is not None)]
        fields = [out.schema[c] for c in keep] + [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", _SPANS_SQL), T.StructField("items", T.ArrayType(T.StringType()))]
        source = out if first else out.select(*[c for c in docs.columns if c.lower() not in ADDED], "spans", "items")
        out = map_batches(source, lambda it, p=phrases, k=keep: _scan(it, p.value, text_col, k, shard_bytes), T.StructType(fields))
        block, first = following, False
    return out


def contaminated(n_words="n_words", n_hit="n_hit"):
    """At least a twentieth of the words are hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
