"""Toxicity by noisy-channel deobfuscation.

A character language model counted over the whole corpus is the source; the channel swaps letters
for look-alikes, repeats them and puts spaces or marks between them. Each suspicious token is a
lattice of what its characters may stand for, decoded by Viterbi search under source and channel.
Restored texts are scored by a logistic model over words that set toxic labelled texts apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import text
from marlstone.llm.labelled import append, calibrate, class_sizes, sample, sigmoid
from marlstone.llm.store import map_batches

#: What a character may stand for besides itself.
LOOK_ALIKES: dict[str, str] = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "*": "aeiou",
}
#: Characters that may stand between letters and mean nothing.
FILLERS = "._-~*'`,/\\#% "
#: Log10 channel probabilities: a look-alike, a filler, a repeat that is dropped, a repeat that is kept.
SWAP, FILL, DROP_REPEAT, KEEP_REPEAT = -0.3, -0.3, -0.4, -0.6
#: Characters of a token after which only the best state goes on: no word is so long, and time and memory stay in proportion.
COMMIT = 1024
#: Order of the character model, and its symbols: word boundary, a to z, any other character.
ORDER, SYMBOLS = 4, 28
#: Words of the scoring lexicon at most, and the least labelled texts that must hold one.
LEXICON, LEAST_TEXTS, LEAST_STRENGTH = 400, 4, 4.5
_EDGES = ".,;:!?\"'()[]{}<>#%&*-_~^/\\|="
#: Tokens that have more than one reading: a letter or a mark that looks like one, and a look-alike, an inner filler or a
#: doubled letter. The channel leaves any other token as it is; numbers without a letter are numbers.
_LETTER = "[a-z@$!|+*]"
_LEET = "[0-9@$!|+*]"
_INNER = r"[a-z0-9@$!|+*][._\-~*'`,/\\#%]+[a-z0-9@$!|+*]"
_DOUBLED = "|".join(f"{c}{c}" for c in "abcdefghijklmnopqrstuvwxyz")
_CODE = np.full(256, SYMBOLS - 1, dtype=np.int64)
_CODE[ord("a") : ord("z") + 1] = np.arange(1, 27)
_MARK = r"^[._~'`,/\\-]+$"
_RUN = np.zeros(256, dtype=bool)
_RUN[list(b"abcdefghijklmnopqrstuvwxyz0123456789@$!+*")] = True


def _char_grams(words: pa.Array) -> np.ndarray:
    """Codes of all character ORDER-grams of words, each with boundaries around it."""
    data, at = text.raw(words)
    n = len(words)
    size = np.diff(at) + ORDER  # ORDER - 1 boundaries before, one after
    ends = np.cumsum(size)
    codes = np.zeros(int(ends[-1]) if n else 0, dtype=np.int64)
    inside = np.arange(len(data)) + ORDER * np.repeat(np.arange(n), np.diff(at)) + ORDER - 1
    codes[inside] = _CODE[data]
    gram = np.zeros(max(0, len(codes) - ORDER + 1), dtype=np.int64)
    for j in range(ORDER):
        gram = gram * SYMBOLS + codes[j : j + len(gram)]
    whole = np.ones(len(codes), dtype=bool)  # no gram runs over the end of a word
    for j in range(1, ORDER):
        whole[ends - j] = False
    return gram[whole[: len(gram)]]


def count_char_grams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of character grams over all texts: each word of letters counts as often as texts have it.

    There are SYMBOLS ** ORDER counts, however large the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**ORDER, dtype=np.int64)
        for batch in batches:
            for part in text.slices(batch, text_col):
                ids, distinct = text.coded(text.words(part.column(text_col))[0])
                core = pc.utf8_trim(distinct.cast(pa.large_string(), safe=False), _EDGES)
                plain = pc.match_substring_regex(core, "^[^0-9@$!|+*._~`#%&<>]+$")
                times = np.bincount(ids, minlength=len(distinct))[plain.to_numpy(zero_copy_only=False).astype(bool)]
                core = core.filter(plain)
                # A word has a gram for each of its bytes and one for its end.
                grams = np.repeat(times, np.diff(text.raw(core)[1]) + 1)
                total += np.bincount(_char_grams(core), weights=grams, minlength=len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["gram", "n"])

    out = np.zeros(SYMBOLS**ORDER, dtype=np.float64)
    for r in map_batches(docs.select(text_col), run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r["gram"]] = r["n"]
    return out


def char_model(counts: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """log10 P(next | three before), each order smoothed by the shorter one (Dirichlet)."""
    full = counts.reshape((SYMBOLS,) * ORDER)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, ORDER + 1):
        c = full.sum(axis=tuple(range(ORDER - order)))
        p = (c + weight * p) / (c.sum(axis=-1, keepdims=True) + weight)
    return np.log10(p)


def _means(c: str) -> list[tuple[int, float]]:
    """Symbols that a character may stand for, with channel log-probabilities."""
    if "a" <= c <= "z":
        return [(ord(c) - 96, 0.0)]
    return [(ord(x) - 96, SWAP - math.log10(len(LOOK_ALIKES[c]))) for x in LOOK_ALIKES.get(c, "")]


def _viterbi(token: str, model: np.ndarray, split: bool) -> str:
    """The likeliest reading of a token; with split, of words that follow one another, with spaces between.

    States are the last three symbols; a character adds a letter, repeats the last one without
    adding, or is a filler; with split, a word may end before any character.
    """
    best: dict[tuple[int, int, int], tuple[float, tuple]] = {(0, 0, 0): (0.0, ())}
    for i, c in enumerate(token):
        if i % COMMIT == COMMIT - 1:
            best = dict([max(best.items(), key=lambda e: e[1][0])])
        means = _means(c)
        other = not means and c not in FILLERS
        following: dict[tuple[int, int, int], tuple[float, tuple]] = {}
        if split:
            ends = [(score + model[state + (0,)], (path, " ")) for state, (score, path) in best.items() if state[2]]
            if ends:
                best[0, 0, 0] = max([*ends, best.get((0, 0, 0), (-math.inf, ()))], key=lambda e: e[0])
        for (a, b, last), (score, path) in best.items():
            steps = []
            if other:
                steps.append(((b, last, SYMBOLS - 1), score + model[a, b, last, SYMBOLS - 1], (path, c)))
            if c in FILLERS:
                steps.append(((a, b, last), score + FILL, path))
            for symbol, cost in means:
                same = symbol == last
                steps.append(((b, last, symbol), score + cost + model[a, b, last, symbol] + (KEEP_REPEAT if same else 0.0), (path, chr(96 + symbol))))
                if same:
                    steps.append(((a, b, last), score + cost + DROP_REPEAT, path))
            for state, s, w in steps:
                if state not in following or s > following[state][0]:
                    following[state] = (s, w)
        best = following

    def spelled(path: tuple) -> str:
        out = []
        while path:
            path, c = path
            out.append(c)
        return "".join(reversed(out))

    top = max(score + model[state + (0,)] for state, (score, _) in best.items())
    return max(spelled(path) for state, (score, path) in best.items() if score + model[state + (0,)] == top)


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest word behind a token of a to z, look-alikes and fillers; other characters stay themselves."""
    return _viterbi(token, model, False)


def segment(run: str, model: np.ndarray) -> list[str]:
    """The likeliest words behind letters that were written apart, however many."""
    return _viterbi(run, model, True).split()


@dataclass
class Restorer:
    """Texts to distinct restored words, with a cache of decoded tokens."""

    model: np.ndarray
    cache: dict[str, str] = field(default_factory=dict)

    def word(self, token: str) -> str:
        return self._cached(token, lambda: decode(token, self.model))

    def spaced(self, run: str) -> list[str]:
        """Words that a run of single letters may be: those it falls into, and the whole as one."""
        return [*self._cached(f" {run}", lambda: " ".join(segment(run, self.model))).split(), self.word(run)]

    def _cached(self, key: str, make: Callable[[], str]) -> str:
        found = self.cache.get(key)
        if found is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            found = self.cache[key] = make()
        return found

    def restore(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(text, word) pairs: number of the text, the distinct words, number of the word.

        Words have punctuation taken off both ends. Suspicious ones also count as what they decode
        to, and so do the words that a run of three or more single letters falls into.
        """
        tokens, at = text.words(texts)
        ids, distinct = text.coded(tokens)
        row = text.row_of(at)
        names = distinct.cast(pa.large_string(), safe=False)
        core = pc.utf8_trim(pc.utf8_rtrim(names, _EDGES + "$+@"), _EDGES)
        has = lambda pattern: pc.match_substring_regex(names, pattern).to_numpy(zero_copy_only=False).astype(bool)
        odd = np.flatnonzero(has(_LETTER) & has(f"{_LEET}|{_INNER}|{_DOUBLED}"))
        decoded = {int(i): self.word(names[int(i)].as_py().strip(".,;:?\"'()[]{}<>#%&-_~^/\\=")) for i in odd}
        rows, extra = [row], []
        if decoded:
            slot = np.full(len(names), -1, dtype=np.int64)
            slot[list(decoded)] = np.arange(len(decoded))
            hit = np.flatnonzero(slot[ids] >= 0)
            extra = list(decoded.values())
            rows.append(row[hit])
            words = [ids, slot[ids[hit]] + len(names)]
        else:
            words = [ids]
        # Spaced-out words: runs of single letters, with or without marks at them and between them.
        bare = pc.if_else(pc.equal(pc.binary_length(names), 1), names, pc.utf8_trim(names, _EDGES)) if len(names) else names
        single = (pc.binary_length(bare).to_numpy() == 1) if len(names) else np.zeros(0, bool)
        if single.any():
            data, starts = text.raw(bare)
            first = np.append(data, np.uint8(0))[starts[:-1]]
            single &= _RUN[first]
            mark = pc.match_substring_regex(names, _MARK).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], (single | mark)[ids] * (row + 1), [0]])))
            letters = np.append(0, np.cumsum(single[ids]))
            spans = [(a, b) for a, b in zip(edge, edge[1:]) if letters[b] - letters[a] >= 3]
            for a, b in spans:
                own = ids[a:b]
                found = self.spaced(bytes(first[own[single[own]]]).decode())
                rows.append(np.repeat(row[a : a + 1], len(found)))
                words.append(len(names) + len(extra) + np.arange(len(found)))
                extra += found
        both = pa.concat_arrays([core, pa.array(extra, pa.large_string())]) if extra else core
        code, vocabulary = text.coded(both)
        keys = np.unique(np.concatenate(rows) * max(1, len(vocabulary)) + code[np.concatenate(words)]) if len(both) else np.zeros(0, np.int64)
        return keys // max(1, len(vocabulary)), vocabulary, keys % max(1, len(vocabulary))


@dataclass
class Model:
    restorer: Restorer
    lexicon: pa.Array
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def __getstate__(self):
        return self.__dict__ | {"restorer": Restorer(self.restorer.model)}

    def margins(self, texts: pa.Array) -> np.ndarray:
        rows, vocabulary, word = self.restorer.restore(texts)
        known = pc.fill_null(pc.index_in(vocabulary, value_set=self.lexicon), -1).to_numpy().astype(np.int64) if len(vocabulary) else np.zeros(0, np.int64)
        value = np.append(self.weights, 0.0)[known[word]]
        return np.bincount(rows, weights=value, minlength=len(texts)) + self.bias

    def score(self, texts: pa.Array) -> np.ndarray:
        return sigmoid(self.slope * self.margins(texts) + self.offset)


def _logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = sigmoid(x @ w)
        g = x.T @ (weights * (p - y)) + ridge * np.append(w[:-1], 0)
        h = (x * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", rows_per_class: int = 6000, text_col: str = "text", id_col: str = "doc_id") -> Model:
    """The character model of all texts, and a scorer from labelled training rows (crc32 fold not 0).

    The scorer takes rows_per_class labelled texts of each class at most. Its lexicon is the words
    that class-1 texts have more often than chance allows, by log-likelihood ratio.
    """
    restorer = Restorer(char_model(count_char_grams(docs, text_col)))
    shared = docs.sparkSession.sparkContext.broadcast(restorer.model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Restorer(shared.value)
        for batch in batches:
            for part in text.slices(batch, "text"):
                rows, vocabulary, word = own.restore(part.column("text"))
                at = np.searchsorted(rows, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at, pa.int32()), vocabulary.take(pa.array(word)).cast(pa.string())), part.column("label").cast(pa.int64())], names=["words", "label"])

    rows = map_batches(sample(docs, labels, target, rows_per_class, id_col=id_col, text_col=text_col), run, "words array<string>, label bigint").persist()
    counts = rows.select("label", F.explode("words").alias("w")).groupBy("w").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q")).where(F.col("p") >= LEAST_TEXTS)
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    sizes = class_sizes(labels, target, id_col=id_col)
    share = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
    plain = float(np.log(share / (1 - share)))
    if not n.get(0) or not n.get(1):
        rows.unpersist()
        return Model(restorer, pa.array([], pa.large_string()), np.zeros(0), 0.0, 1.0, plain)
    # Signed root of the log-likelihood ratio: rare words that only toxic texts have count too.
    both = F.col("p") + F.col("q")
    part = lambda c, k: F.when(c > 0, c * F.log(c * (n[0] + n[1]) / (both * k))).otherwise(0.0)
    strength = F.when(F.col("p") * n[0] > F.col("q") * n[1], F.sqrt(F.greatest(2 * (part(F.col("p"), n[1]) + part(F.col("q"), n[0])), F.lit(0.0))))
    lexicon = [r["w"] for r in counts.withColumn("z", strength).where((F.col("z") > LEAST_STRENGTH) & (F.length("w") >= 3)).orderBy(F.desc("z"), "w").limit(LEXICON).collect()]
    inside = rows.select("label", F.array_intersect("words", F.array(*[F.lit(w) for w in lexicon]) if lexicon else F.array().cast("array<string>")).alias("words")).collect()
    rows.unpersist()
    inside.sort(key=lambda r: (r["label"], sorted(r["words"])))
    y = np.array([r["label"] for r in inside], dtype=np.float64)
    number = {w: i for i, w in enumerate(lexicon)}
    x = np.zeros((len(inside), len(lexicon) + 1))
    x[:, -1] = 1
    for i, r in enumerate(inside):
        x[i, [number[w] for w in r["words"]]] = 1
    prior = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum()) * len(y)
    held = np.arange(len(y)) % 4 == 0
    w = _logistic(x[~held], y[~held], np.ones((~held).sum()))
    slope, offset = calibrate((x @ w)[held], y[held], prior[held])
    return Model(restorer, pa.array(lexicon, pa.large_string()), w[:-1], float(w[-1]), slope, offset)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with score, P(label 1) of each restored text; null text is empty, and a text without any word of the lexicon gets the score of none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return append(docs, text_col, {"score": T.DoubleType()}, lambda t: {"score": pa.array(shared.value.score(t))}, keep_text)
