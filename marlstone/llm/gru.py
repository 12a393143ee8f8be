"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads words byte by byte in both directions, from a blank before to a blank after, and
gives every byte a distribution over languages; a document pools those of all its bytes. State
starts anew at each word, so equal words have equal labels and each distinct word of a run of
documents is computed once. Training is backpropagation through time in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import text
from marlstone.llm.labelled import append, fold
from marlstone.llm.store import map_batches

HIDDEN, EMBED = 12, 8
#: Bytes that one pass reads; a longer run without a blank is read in pieces of this length, cut between characters.
PIECE = 256
#: Byte places that one pass holds.
CELLS = 8192 * 24
#: Labelled documents of each language that the network is trained on at most, by all their words.
DOCS_PER_LANGUAGE = 400
#: Groups of partitions in which a language's first rows are found before they meet.
SALTS = 64
#: Sampled ids that are broadcast; more, as with very many languages, are matched by a shuffled join.
MAX_BROADCAST = 2_000_000
STEPS, BATCH, RATE = 800, 384, 0.015
#: Text taken at once.
CHUNK_BYTES = 8 << 20
UNDETERMINED = "und"
_BLANK = 32


def _pieces(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded bytes of the pieces of words (0 after the end), their sizes, and the word of each."""
    data, at = text.raw(words)
    size = np.diff(at)
    starts, ends, word = at[:-1].copy(), at[1:].copy(), np.arange(len(size))
    more = np.flatnonzero(size > PIECE)
    if len(more):
        starts, ends, word = [starts[size <= PIECE]], [ends[size <= PIECE]], [word[size <= PIECE]]
        for i in more:
            cuts = [int(at[i])]
            while at[i + 1] - cuts[-1] > PIECE:
                cut = cuts[-1] + PIECE
                while cut > cuts[-1] + PIECE - 3 and data[cut] & 0xC0 == 0x80:  # not inside a character
                    cut -= 1
                cuts.append(cut)
            starts.append(np.array(cuts))
            ends.append(np.array([*cuts[1:], int(at[i + 1])]))
            word.append(np.full(len(cuts), i))
        starts, ends, word = np.concatenate(starts), np.concatenate(ends), np.concatenate(word)
    length = ends - starts
    width = max(1, int(length.max(initial=0)))
    out = np.zeros((len(word), width), dtype=np.uint8)
    inside = np.arange(width) < length[:, None]
    out[inside] = data[(starts[:, None] + np.arange(width))[inside]]
    return out, length, word


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Cell:
    """One direction: update and reset gates and a candidate state."""

    def __init__(self, rng: np.random.Generator):
        self.x = rng.normal(0, 0.3, (EMBED, 3 * HIDDEN)).astype(np.float32)
        self.h = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN)).astype(np.float32)
        self.b = np.zeros(3 * HIDDEN, dtype=np.float32)

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        """x: input projections with the bias. Next state, and what backward() needs."""
        a = h @ self.h
        gates = _sigmoid(x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
        return z * h + (1 - z) * c, (h, z, r, c, a[:, 2 * HIDDEN :])

    def back(self, d: np.ndarray, kept: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of the state before, of the input projections and of the recurrent weights."""
        h, z, r, c, a = kept
        dc = d * (1 - z) * (1 - c * c)
        da = np.concatenate([d * (h - c) * z * (1 - z), dc * a * r * (1 - r), dc * r], axis=1)
        dx = np.concatenate([da[:, : 2 * HIDDEN], dc], axis=1)
        return d * z + da @ self.h.T, dx, h.T @ da


class Network:
    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.cells = (Cell(rng), Cell(rng))
        self.out = rng.normal(0, 0.2, (2 * HIDDEN, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), dtype=np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.out, self.bias, *(w for c in self.cells for w in (c.x, c.h, c.b))]

    def _orders(self, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places read at each step: forwards, and backwards from each piece's end."""
        longest = int(length.max(initial=0))
        step = np.arange(longest)[:, None]
        return np.broadcast_to(step, (longest, len(length))), np.maximum(length[None, :] - 1 - step, 0)

    def states(self, pieces: np.ndarray, length: np.ndarray, keep: bool = False):
        """States of both directions at every byte (piece, place, 2 * HIDDEN); pieces are longest first."""
        n, longest = len(pieces), int(length.max(initial=0))
        out = np.zeros((n, longest, 2 * HIDDEN), dtype=np.float32)
        tape = []
        for d, (cell, order) in enumerate(zip(self.cells, self._orders(length))):
            table = self.embed @ cell.x + cell.b
            h, steps = cell.step(np.broadcast_to(table[_BLANK], (n, 3 * HIDDEN)), np.zeros((n, HIDDEN), dtype=np.float32))[0], []
            first = h
            for t in range(longest):
                left = int(np.searchsorted(-length, -t, side="left"))  # pieces longer than t
                rows, place = np.arange(left), order[t][:left]
                h, kept = cell.step(table[pieces[rows, place]], h[:left])
                out[rows, place, d * HIDDEN : (d + 1) * HIDDEN] = h
                if keep:
                    steps.append((left, place, kept))
            tape.append((first, steps))
        return (out, tape) if keep else out

    def label(self, states: np.ndarray) -> np.ndarray:
        """Distribution over languages of each state."""
        x = states @ self.out + self.bias
        x = np.exp(x - x.max(axis=-1, keepdims=True))
        return x / x.sum(axis=-1, keepdims=True)

    def words(self, words: pa.Array) -> np.ndarray:
        """Log-probabilities of the languages, summed over the bytes of each word."""
        pieces, length, word = _pieces(words)
        total = np.zeros((len(words), len(self.languages)), dtype=np.float64)
        order = np.argsort(-length, kind="stable")
        i = 0
        while i < len(order):
            longest = max(1, int(length[order[i]]))
            own = order[i : i + max(1, CELLS // longest)]
            p = np.log(self.label(self.states(pieces[own], length[own])) + 1e-6)
            p *= (np.arange(p.shape[1]) < length[own][:, None])[:, :, None]
            np.add.at(total, word[own], p.sum(axis=1))
            i += len(own)
        return total

    def gradients(self, pieces: np.ndarray, length: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all bytes, and its gradient by weights(), through time."""
        states, tape = self.states(pieces, length, keep=True)
        mask = np.arange(states.shape[1]) < length[:, None]
        p = self.label(states)
        n = float(mask.sum())
        rows, places = np.nonzero(mask)
        loss = -float(np.log(p[rows, places, target[rows]] + 1e-9).sum()) / n
        delta = np.zeros_like(p)
        delta[mask] = p[mask] / n
        delta[rows, places, target[rows]] -= 1 / n
        d_embed, d_cells = np.zeros_like(self.embed), []
        d_states = delta @ self.out.T
        for d, (cell, (first, steps)) in enumerate(zip(self.cells, tape)):
            gx, gh, gb = np.zeros_like(cell.x), np.zeros_like(cell.h), np.zeros_like(cell.b)
            back = np.zeros((len(pieces), HIDDEN), dtype=np.float32)

            def at_input(byte: np.ndarray, dx: np.ndarray) -> None:
                nonlocal gb
                np.add.at(d_embed, byte, dx @ cell.x.T)
                gx[...] += self.embed[byte].T @ dx
                gb = gb + dx.sum(axis=0)

            for left, place, kept in reversed(steps):
                now = back[:left] + d_states[np.arange(left), place, d * HIDDEN : (d + 1) * HIDDEN]
                before, dx, dh = cell.back(now, kept)
                back[:left] = before
                gh += dh
                at_input(pieces[np.arange(left), place], dx)
            zero = np.zeros_like(first)
            x = np.broadcast_to(self.embed[_BLANK] @ cell.x + cell.b, (len(pieces), 3 * HIDDEN))
            _, kept = cell.step(x, zero)
            _, dx, _ = cell.back(back, kept)
            at_input(np.full(len(pieces), _BLANK), dx)
            d_cells += [gx, gh, gb]
        return loss, [d_embed, states.reshape(-1, 2 * HIDDEN).T @ delta.reshape(-1, delta.shape[-1]), delta.sum(axis=(0, 1)), *d_cells]


def train(words: pa.Array, times: np.ndarray, target: np.ndarray, languages: list[str], steps: int = STEPS) -> Network:
    """A network fitted by Adam on words drawn as often as times says, every byte labelled by its word's language."""
    net, rng = Network(languages), np.random.default_rng(1)
    pieces, length, word = _pieces(words)
    chance = times[word].astype(np.float64)
    cumulative = np.cumsum(chance / chance.sum())
    weights = net.weights()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        own = np.minimum(np.searchsorted(cumulative, rng.random(BATCH)), len(word) - 1)
        own = own[np.argsort(-length[own], kind="stable")]
        _, gradients = net.gradients(pieces[own], length[own], target[word[own]])
        norm = np.sqrt(sum(float((g * g).sum()) for g in gradients))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(weights, gradients, first, second):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def sample(docs: DataFrame, train_rows, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """Columns text and lang: per_language training documents of each language at most, those with the smallest id hashes.

    One scan of ids and languages: each partition keeps its first rows of a language before any are shuffled.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), train_rows.alias("train")).where(F.col("lang").isNotNull() & F.col("train"))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h", "id"))
    ids = rows.select("id", "lang", F.xxhash64("id").alias("h"), F.spark_partition_id().alias("part"))
    for by in ("part", F.pmod("part", F.lit(SALTS)), F.lit(0)):  # the last step gets SALTS * per_language rows of a language at most
        ids = ids.withColumn("n", first("lang", by)).where(F.col("n") <= per_language)
    chosen = ids.select("id", "lang").distinct().persist()
    few = chosen.count() <= MAX_BROADCAST
    return rows.join(F.broadcast(chosen) if few else chosen, ["id", "lang"], "left_semi").select("text", "lang")


def fit(docs: DataFrame, train_rows=None, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Train on a bounded sample of labelled documents (see sample()); by default of those whose crc32 fold of 4 isn't 2.

    All words of a sampled document are learned from, and each document weighs the same; words are
    counted where the texts are. Without labelled documents the network knows no language and every
    text is undetermined.
    """
    train_rows = fold(id_col, 4) != 2 if train_rows is None else train_rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch, "text"):
                tokens, at = text.words(part.column("text"))
                ids, distinct = text.coded(tokens)
                keys, times = np.unique(text.row_of(at) * max(1, len(distinct)) + ids, return_counts=True)
                row = keys // max(1, len(distinct))
                share = np.rint(times * 1e6 / np.maximum(1, np.diff(at))[row]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("lang").take(pa.array(row)), distinct.take(pa.array(keys % max(1, len(distinct)))).cast(pa.binary()), pa.array(share)], names=["lang", "word", "share"])

    counted = map_batches(sample(docs, train_rows, lang_col, id_col, text_col), count, "lang string, word binary, share bigint").groupBy("lang", "word").agg(F.sum("share").alias("share"))
    found = counted.where("share > 0").toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    if not found.num_rows:
        return Network([])
    lang = np.array(found.column("lang").to_pylist(), dtype=object)
    languages, target = np.unique(lang.astype(str), return_inverse=True)
    share = found.column("share").to_numpy().astype(np.float64)
    per = np.bincount(target, weights=share)  # each language weighs the same, however many documents it has here
    return train(pa.array(found.column("word").to_pylist(), pa.large_binary()), share / per[target], target, languages.tolist())


def _predict(texts: pa.Array, net: Network) -> dict[str, pa.Array]:
    n = len(texts)
    if not net.languages:
        return {"lang_pred": pa.array([UNDETERMINED] * n, pa.string()), "score": pa.array(np.zeros(n))}
    tokens, at = text.words(texts)
    ids, distinct = text.coded(tokens)
    per_word = net.words(distinct)
    size = np.diff(text.raw(distinct)[1])
    letters = np.array([any(c.isalpha() for c in w) for w in distinct.cast(pa.large_string(), safe=False).to_pylist()], dtype=bool)
    # Words without a letter say nothing.
    per_word *= letters[:, None]
    size = size * letters
    length = text.rows_sum(size[ids], at)
    pooled = np.stack([text.rows_sum(per_word[ids, k], at) for k in range(len(net.languages))], axis=1) / np.maximum(length, 1)[:, None]
    pooled = np.exp(pooled - pooled.max(axis=1, keepdims=True))
    pooled /= pooled.sum(axis=1, keepdims=True)
    best = pooled.argmax(axis=1)
    known = length > 0
    return {"lang_pred": pa.array(np.where(known, np.array(net.languages, dtype=object)[best], UNDETERMINED), pa.string()), "score": pa.array(np.where(known, pooled[np.arange(n), best], 0.0))}


def predict(docs: DataFrame, net: Network, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with lang_pred and score: the language whose bytes' geometric mean probability is largest, and its share.

    Null texts and texts without a letter are 'und' with score 0. Columns by those names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return append(docs, text_col, {"lang_pred": T.StringType(), "score": T.DoubleType()}, lambda t: _predict(t, shared.value), keep_text, CHUNK_BYTES)
