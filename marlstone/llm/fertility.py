"""Quality rules from how public tokenisers take a text.

A vocabulary measures a text's characters per token, the share of byte-fallback tokens and the
entropy of its tokens; bands per language, or else per script, reject texts outside them. Counts of
words, symbols, repeated lines and repeated word windows stand beside them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marlstone.llm import text
from marlstone.llm.store import map_batches

#: Where the public vocabularies are, parameters of measure(): one of pieces with byte fallback, and one of bytes for many languages.
VOCABULARY, SECOND = "/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Text taken at once: distinct words are tokenised once for each such run of documents.
CHUNK_BYTES = 2 << 20
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


@dataclass(frozen=True)
class Band:
    """What is kept: bounds of characters per token, byte-fallback share and bits of token entropy, and of characters per token of the second vocabulary.

    min_entropy holds for texts of entropy_from tokens or more; shorter ones can't reach it. So do
    entropy_floors, the least entropy of texts of FLOOR_TOKENS tokens, between which it goes with
    the logarithm of their number.
    """

    min_chars: float = 0.0
    max_chars: float = 1e9
    max_fallback: float = 1.0
    min_entropy: float = 0.0
    entropy_from: int = 100
    entropy_floors: tuple[float, ...] = ()
    min_second: float = 0.0

    def least_entropy(self, n_tokens: np.ndarray) -> np.ndarray:
        least = np.full(len(n_tokens), self.min_entropy)
        if self.entropy_floors:
            least = np.maximum(least, np.interp(np.log2(np.maximum(n_tokens, 1)), np.log2(FLOOR_TOKENS), self.entropy_floors))
        return np.where(n_tokens >= self.entropy_from, least, 0.0)


#: Token counts at which entropy floors are given: a text's entropy grows with its length.
FLOOR_TOKENS = (100, 200, 400, 800, 1600, 3200, 6400)

#: Scripts by the lead bytes of their letters in UTF-8.
SCRIPTS = ("Latin", "Greek", "Cyrillic", "Hebrew", "Arabic", "Indic", "Kana or Han", "Hangul", "other")
_SCRIPT = np.full(256, len(SCRIPTS) - 1, dtype=np.int64)
for _name, _leads in {"Latin": [*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)], "Greek": [0xCE, 0xCF], "Cyrillic": [0xD0, 0xD1, 0xD2, 0xD3], "Hebrew": [0xD7], "Arabic": [0xD8, 0xD9, 0xDA, 0xDB], "Indic": [0xE0], "Kana or Han": [*range(0xE3, 0xEA)], "Hangul": [0xEA, 0xEB, 0xEC, 0xED]}.items():
    _SCRIPT[_leads] = SCRIPTS.index(_name)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC2, 256)]] = True

#: Kept bands by language; other texts take the band of their script. Those of languages lie four deviations
#: below the mean entropy of texts labelled clean, or lower, and 7 % below the least characters a token of the second
#: vocabulary that such a text has; Latin's are 0.3 bits and a fifth or more below the lowest of them.
BANDS: dict[str, Band] = {
    "en": Band(min_chars=1.6, max_chars=8.0, max_fallback=0.10, min_entropy=3.2, entropy_floors=(5.2, 5.7, 6.1, 6.4, 6.6, 6.75, 6.8), min_second=1.85),
    "de": Band(min_chars=1.7, max_chars=8.0, max_fallback=0.10, min_entropy=3.2, entropy_floors=(5.0, 5.4, 5.95, 6.2, 6.4, 6.5, 6.6), min_second=1.95),
    "fr": Band(min_chars=1.5, max_chars=8.0, max_fallback=0.10, min_entropy=3.2, entropy_floors=(5.0, 5.5, 5.85, 6.05, 6.3, 6.4, 6.5), min_second=1.68),
    "es": Band(min_chars=1.6, max_chars=8.0, max_fallback=0.10, min_entropy=3.2, entropy_floors=(5.0, 5.4, 5.8, 6.15, 6.4, 6.5, 6.65), min_second=1.78),
    "Latin": Band(min_chars=1.0, max_chars=8.0, max_fallback=0.20, min_entropy=3.2, entropy_floors=(4.7, 5.1, 5.5, 5.75, 6.0, 6.1, 6.2), min_second=1.3),
    "Greek": Band(min_chars=0.6, max_chars=6.0, max_fallback=0.35, min_entropy=3.0),
    "Cyrillic": Band(min_chars=0.8, max_chars=8.0, max_fallback=0.35, min_entropy=3.2),
    "Hebrew": Band(min_chars=0.4, max_chars=6.0, max_fallback=0.5, min_entropy=3.0),
    "Arabic": Band(min_chars=0.4, max_chars=6.0, max_fallback=0.5, min_entropy=3.0),
    "Indic": Band(min_chars=0.25, max_chars=5.0, max_fallback=0.95, min_entropy=2.5),
    "Kana or Han": Band(min_chars=0.3, max_chars=4.0, max_fallback=0.9, min_entropy=3.5),
    "Hangul": Band(min_chars=0.3, max_chars=4.0, max_fallback=0.95, min_entropy=3.0),
    "other": Band(min_chars=0.25, max_chars=8.0, max_fallback=1.0, min_entropy=2.0),
}

_MEASURES: dict[str, T.DataType] = {
    "n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(), "n_repeat_words": T.LongType(),
    "n_tokens": T.LongType(), "chars_per_token": T.DoubleType(), "byte_fallback_share": T.DoubleType(), "token_entropy": T.DoubleType(), "second_chars_per_token": T.DoubleType(),
    "script": T.StringType(), "base_failed": T.BooleanType(), "kept": T.BooleanType(),
}


@lru_cache(maxsize=2)
def _pieces(model: bytes):
    """A SentencePiece processor and which of its ids are byte tokens; opened once in a process, whichever query asks."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    return processor, np.array([processor.IsByte(i) for i in range(processor.vocab_size())])


@lru_cache(maxsize=2)
def _ranks(body: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in body.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=r" ?\p{L}{1,40}| ?\p{N}{1,40}| ?[^\s\p{L}\p{N}]{1,40}|\s", mergeable_ranks=ranks, special_tokens={})


@dataclass(frozen=True)
class Vocabulary:
    """A SentencePiece model."""

    model: bytes

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of all words after one another, offsets by word, and which ids are byte tokens."""
        processor, is_byte = _pieces(self.model)
        # Replacement characters stand in for bytes that no text has; Spark strings are UTF-8.
        lists = processor.encode([w.decode("utf-8", "replace") for w in words.to_pylist()], num_threads=1)
        at = np.zeros(len(lists) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)), out=at[1:])
        return np.fromiter((t for x in lists for t in x), np.int64, at[-1]), at, is_byte


@dataclass(frozen=True)
class ByteVocabulary:
    """Ranks of a byte-level BPE."""

    ranks: bytes

    def sizes(self, words: pa.Array) -> np.ndarray:
        """Tokens of each word, read behind a space; runs of one kind of character are cut at 40, as merging takes the square of their length."""
        encode = _ranks(self.ranks).encode_ordinary
        return np.fromiter((len(encode(" " + w.decode("utf-8", "replace"))) for w in words.to_pylist()), np.int64, len(words))


def repeated_words(ids: np.ndarray, at: np.ndarray, window: int = REPEAT_WINDOW) -> np.ndarray:
    """By text: words inside windows that the text has twice or more."""
    n = len(ids) - window + 1
    out = np.zeros(len(at) - 1, dtype=np.int64)
    if n <= 0:
        return out
    h = text.mix(ids.astype(np.uint64) + np.uint64(1))
    row = text.row_of(at)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    key = text.mix(key ^ text.mix(row[:n].astype(np.uint64) + np.uint64(77)))
    whole = row[:n] == row[window - 1 :]
    sorted_keys = np.sort(key[whole])
    twice = np.unique(sorted_keys[1:][sorted_keys[1:] == sorted_keys[:-1]])
    if not len(twice):
        return out
    slot = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    starts = np.flatnonzero(whole & (twice[slot] == key))
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return text.rows_sum((np.cumsum(cover[:-1]) > 0).astype(np.int64), at)


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """By text: lines with a word that equal an earlier line of the text."""
    data, at = text.raw(texts)
    spread = np.insert(data, at[1:], 10)  # a line feed ends each text
    end = np.flatnonzero(spread == 10)
    size = np.diff(np.append(-1, end)) - 1
    solid = np.zeros(len(spread) + 1, dtype=np.int64)
    np.cumsum(text._NOT_SPACE[spread], out=solid[1:])
    has_word = solid[end] > solid[end - size]
    line_at = np.zeros(len(end) + 1, dtype=np.int64)
    np.cumsum(size, out=line_at[1:])
    lines = pa.Array.from_buffers(pa.large_binary(), len(end), [None, pa.py_buffer(line_at), pa.py_buffer(spread[spread != 10])])
    ids, distinct = text.coded(lines)
    row = np.searchsorted(at[1:] + np.arange(len(at) - 1), end)
    once = np.unique(row[has_word] * max(1, len(distinct)) + ids[has_word])
    n = len(at) - 1
    return np.bincount(row[has_word], minlength=n) - np.bincount(once // max(1, len(distinct)), minlength=n)


def _measure(texts: pa.Array, langs: list[str | None], vocabulary: Vocabulary, second: ByteVocabulary | None, bands: dict[str, Band]) -> dict[str, pa.Array]:
    tokens, at = text.words(texts, lower=False)
    ids, distinct = text.coded(tokens)
    data, byte_at = text.raw(texts)
    n_words = np.diff(at)
    word_data, word_at = text.raw(distinct)
    chars = text.rows_sum(((word_data & 0xC0) != 0x80).astype(np.int64), word_at)
    word_chars = text.rows_sum(chars[ids], at)
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    n_symbols = text.rows_sum(symbol[data], byte_at)

    piece, piece_at, is_byte = vocabulary.encode(distinct)
    sizes = np.diff(piece_at)
    fallback = text.rows_sum(is_byte[piece].astype(np.int64), piece_at)
    n_tokens, n_fallback = text.rows_sum(sizes[ids], at), text.rows_sum(fallback[ids], at)
    size = sizes[ids]
    place = np.repeat(piece_at[ids], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    row = np.repeat(np.arange(len(n_words)), n_tokens)
    keys = np.sort(row * len(is_byte) + piece[place])
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(keys))).astype(np.float64)
    bits = np.bincount(keys[first] // len(is_byte), weights=times * np.log2(times), minlength=len(n_words))
    some = np.maximum(n_tokens, 1)
    entropy = np.where(n_tokens > 0, np.log2(some) - bits / some, 0.0)

    letters = np.flatnonzero(_LETTER[data])
    per_script = np.bincount(np.repeat(np.arange(len(n_words)), np.diff(byte_at))[letters] * len(SCRIPTS) + _SCRIPT[data[letters]], minlength=len(n_words) * len(SCRIPTS)).reshape(-1, len(SCRIPTS))
    script = np.where(per_script.sum(axis=1) > 0, per_script.argmax(axis=1), len(SCRIPTS) - 1)

    n_repeat = repeated_words(ids, at)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    per_token, share = word_chars / some, n_fallback / some
    band = [bands.get(lang) or bands[SCRIPTS[s]] for lang, s in zip(langs, script)]
    low, high, most, second_low = (np.array([getattr(b, k) for b in band], dtype=np.float64) for k in ("min_chars", "max_chars", "max_fallback", "min_second"))
    per_second = np.full(len(n_words), np.nan) if second is None else word_chars / np.maximum(1, text.rows_sum(second.sizes(distinct)[ids], at))
    least = np.zeros(len(band))
    for b in set(band):
        own = np.array([x is b or x == b for x in band])
        least[own] = b.least_entropy(n_tokens[own])
    fits = (per_token >= low) & (per_token <= high) & (share <= most) & (entropy >= least) & ((per_second >= second_low) | (second is None))
    found = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": repeated_lines(texts), "n_repeat_words": n_repeat,
        "n_tokens": n_tokens, "chars_per_token": per_token, "byte_fallback_share": share, "token_entropy": entropy, "second_chars_per_token": per_second,
        "script": np.array(SCRIPTS)[script], "base_failed": failed, "kept": ~failed & fits,
    }
    return {k: pa.array(v, from_pandas=v.dtype.kind == "f") for k, v in found.items()}


def measure(docs: DataFrame, vocabulary: str = VOCABULARY, second: str | None = SECOND, bands: dict[str, Band] = BANDS, text_col: str = "text", lang_col: str | None = "lang", keep_text: bool = True) -> DataFrame:
    """docs with the measures and verdict of each text; columns of docs by their names are replaced.

    base_failed: fewer than 20 words, or more than 30 % of the words in 8-word windows that come
    twice or more. kept: base_failed is false and the text lies in the band of its language, if
    bands has one, or else of the script most of its letters are in. Null text counts as empty: it
    has no words and fails. Repeated rows are measured alike. Tokens are counted over words, each
    word being tokenised by itself, so that all copies of a word share one encoding. Without a
    second vocabulary its measure is null and bounds nothing.
    """
    model = docs.sparkSession.sparkContext.broadcast(Vocabulary(Path(vocabulary).read_bytes()))
    other = docs.sparkSession.sparkContext.broadcast(None if second is None else ByteVocabulary(Path(second).read_bytes()))
    names = [c for c in docs.columns if c.lower() not in _MEASURES]
    kept = [c for c in names if keep_text or c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch, text_col, CHUNK_BYTES):
                langs = part.column(lang_col).to_pylist() if lang_col in part.schema.names else [None] * part.num_rows
                found = _measure(part.column(text_col), langs, model.value, other.value, bands)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *found.values()], names=[*kept, *found])

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(k, t) for k, t in _MEASURES.items()])
    return map_batches(docs.select(*names), run, schema)
