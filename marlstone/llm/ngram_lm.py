"""Language-model scores from an Elias-Fano bigram trie that is built and queried shard by shard.

Documents become blocks of word numbers with the block's distinct words. Blocks send what they need
to shards: distinct words, then distinct word pairs, each with its count in training documents. A
shard adds up counts, builds its part of the trie and answers every block that asked; blocks then
add up the log-probabilities of their documents. Only distinct words and pairs of blocks are
shuffled, as packed arrays, and no task holds more than a block or a shard.

Words have probability (count - discount) / N; one class of unseen words gets the discounts. Pairs
are smoothed towards that: P(w | h) = (c(hw) + MU P(w)) / (c(h) + MU).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import text
from marlstone.llm.elias_fano import Trie, mapped
from marlstone.llm.labelled import fold
from marlstone.llm.store import Scratch, map_batches

#: Weight of the unigram distribution against a context's count.
MU = 2000.0
#: Text of a block; words and pairs that a shard takes.
BLOCK_BYTES, SHARD_WORDS, SHARD_PAIRS = 8 << 20, 2_000_000, 1_000_000
#: Bits of a context and of a successor in a shard's trie; successors of a context go to 2 ** SPLIT shards.
BITS, SPLIT = 24, 3
#: Steps of stored log10 probabilities, of the word log10 probabilities and the log2 context counts that make them; two bytes hold any context count.
STEP, WORD_STEP, COUNT_STEP = 6000.0, 24.0, 12.0
#: Hashes of the start of a text, as a context, and of its end, as a token.
START, END = np.uint64(0x1234567890ABCDEF), np.uint64(0xFEDCBA0987654321)


def _pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted numbers as differences of equal width; the first byte is the width."""
    d = np.diff(keys, prepend=np.uint64(0)).astype(np.uint64)
    width = max(1, (int(d.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack_sorted(data: bytes) -> np.ndarray:
    width = data[0]
    body = np.frombuffer(data, dtype=np.uint8)[1:].reshape(-1, width)
    out = np.zeros((len(body), 8), dtype=np.uint8)
    out[:, :width] = body
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def _narrow(x: np.ndarray) -> bytes:
    """Unsigned numbers of one, two or four bytes each; the first byte is the width."""
    width = 1 if x.max(initial=0) < 256 else 2 if x.max(initial=0) < 65536 else 4
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _widen(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in text.slices(batch, "text", BLOCK_BYTES):
            tokens, at = text.words(part.column("text"))
            ids, distinct = text.coded(tokens)
            word = np.append(text.hashes(distinct, 4), END)
            order = np.argsort(word)
            place = np.empty(len(word), dtype=np.int64)
            place[order] = np.arange(len(word))
            stream = np.insert(place[ids], at[1:], place[-1])  # an end after each text
            size = np.diff(at) + 1
            train = np.array(part.column("train").to_pylist(), dtype=bool)
            counts = np.bincount(stream[np.repeat(train, size)], minlength=len(word))
            row = {
                "block": [number], "doc_id": [part.column("doc_id").to_pylist()], "train": [train.tolist()], "size": [size.tolist()],
                "n_words": [len(word)], "n_tokens": [len(stream)], "stream": [stream.astype("<u4").tobytes()], "words": [_pack_sorted(word[order])], "counts": [_narrow(counts)],
            }
            number += 1
            yield pa.RecordBatch.from_pydict(row, schema=_BLOCK)


_BLOCK = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("size", pa.list_(pa.int32())), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("stream", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])
_BLOCK_SQL = "block bigint, doc_id array<bigint>, train array<boolean>, size array<int>, n_words bigint, n_tokens bigint, stream binary, words binary, counts binary"


def _dealt(keys: np.ndarray, shard: np.ndarray, shards: int) -> list[np.ndarray]:
    """Places of each shard's keys, in the order of the keys; keys are sorted."""
    order = np.argsort(shard, kind="stable")
    return np.split(order, np.searchsorted(shard[order], np.arange(1, shards)))


def _word_shard(word: np.ndarray, shards: int) -> np.ndarray:
    return (text.mix(word) % np.uint64(shards)).astype(np.int64)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, list]]]:
    """Rows gathered by shard; the rows come sorted by it."""
    shard, rows = None, None
    for batch in batches:
        columns = batch.to_pydict()
        for i, s in enumerate(columns["shard"]):
            if s != shard:
                if rows is not None:
                    yield shard, rows
                shard, rows = s, {c: [] for c in columns}
            for c, values in columns.items():
                rows[c].append(values[i])
    if rows is not None:
        yield shard, rows


def _ask_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "counts"))):
                word, count = _unpack_sorted(words), _widen(counts)
                for s, own in enumerate(_dealt(word, _word_shard(word, shards), shards)):
                    if len(own):
                        yield pa.RecordBatch.from_pydict({"shard": [s], "block": [block], "keys": [_pack_sorted(word[own])], "counts": [_narrow(count[own])]}, schema=pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return run


_ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("answer", pa.binary()), ("totals", pa.list_(pa.int64()))])
_ANSWER_SQL = "block bigint, shard int, answer binary, totals array<bigint>"


def _answers(rows: dict[str, list], shard: int, at: np.ndarray, answer: np.ndarray, totals: list[int] | None) -> pa.RecordBatch:
    parts = [_narrow(answer[a:b]) for a, b in zip(at, at[1:])]
    extra = [] if totals is None else [None]
    return pa.RecordBatch.from_pydict({"block": rows["block"] + extra, "shard": [shard] * (len(parts) + len(extra)), "answer": parts + [None] * len(extra), "totals": [None] * len(parts) + [totals] * len(extra)}, schema=_ANSWER)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each shard's words over all blocks, and a row of totals: tokens, words, words seen once and twice."""
    for shard, rows in _by_shard(batches):
        parts = [_unpack_sorted(x) for x in rows["keys"]]
        at = np.append(0, np.cumsum([len(p) for p in parts]))
        word, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        count = np.bincount(inverse, weights=np.concatenate([_widen(x) for x in rows["counts"]]), minlength=len(word)).astype(np.int64)
        yield _answers(rows, shard, at, count[inverse], [int(count.sum()), int((count > 0).sum()), int((count == 1).sum()), int((count == 2).sum())])


class Corpus:
    """Totals of the training tokens and the word probabilities they give."""

    def __init__(self, tokens: int, words: int, once: int, twice: int, mu: float = MU):
        self.tokens, self.words, self.mu = tokens, words, mu
        self.discount = min(0.9, once / (once + 2 * twice)) if once else 0.5

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.words + 1)))

    def word(self, count: np.ndarray) -> np.ndarray:
        """P(w); of the class of unseen words where count is 0."""
        n = max(self.tokens, 1)
        unseen = self.discount * self.words / n if self.tokens else 1.0
        return np.where(count > 0, (count - self.discount) / n, unseen)


def _merge(words: bytes, answers: list, shards: int) -> np.ndarray:
    """Counts of a block's words from the answers of the shards."""
    word = _unpack_sorted(words)
    out = np.zeros(len(word), dtype=np.int64)
    dealt = _dealt(word, _word_shard(word, shards), shards)
    for a in answers:
        out[dealt[a["shard"]]] = _widen(a["answer"])
    return out


class Pairs:
    """The distinct word pairs of a block, in the order of shard and key; the same each time it is made."""

    def __init__(self, stream: bytes, size: list[int], words: bytes, shards: int):
        word = _unpack_sorted(words)
        self.stream = np.frombuffer(stream, dtype="<u4").astype(np.int64)
        first = np.append(0, np.cumsum(size))[:-1]
        n = len(word) + 1  # the start is the last context
        self.before = np.append(0, self.stream[:-1])
        self.before[first] = n - 1
        pair, inverse = np.unique(self.before * n + self.stream, return_inverse=True)
        self.context, self.word = pair // n, pair % n
        mixed = text.mix(np.append(word, START))
        part = mixed[self.word] >> np.uint64(64 - SPLIT)
        node = text.mix(mixed[self.context] + part * np.uint64(0x9E3779B97F4A7C15))
        key = (node >> np.uint64(64 - BITS) << np.uint64(BITS)) | (text.mix(mixed[self.word]) >> np.uint64(64 - BITS))
        shard = ((node & np.uint64(0xFFFFFFFF)) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((key, shard))
        self.context, self.word, self.key = self.context[order], self.word[order], key[order]
        self.cut = np.searchsorted(shard[order], np.arange(shards + 1))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.of_token = place[inverse]


def _context_counts(counts: np.ndarray, starts: int) -> np.ndarray:
    return np.append(counts, starts)


def _ask_pairs(shards: int, word_shards: int, corpus: Corpus, starts: int):
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("context", pa.binary()), ("word", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = _merge(row["words"], row["answers"], word_shards)
                pairs = Pairs(row["stream"], row["size"], row["words"], shards)
                train = np.repeat(np.array(row["train"], dtype=bool), row["size"])
                local = np.bincount(pairs.of_token[train], minlength=len(pairs.key))
                context = np.rint(COUNT_STEP * np.log2(1 + _context_counts(counts, starts)[pairs.context]))
                word = np.minimum(255, np.rint(-WORD_STEP * np.log10(corpus.word(counts)[pairs.word])))
                for s in np.flatnonzero(np.diff(pairs.cut)):
                    own = slice(pairs.cut[s], pairs.cut[s + 1])
                    yield pa.RecordBatch.from_pydict({"shard": [int(s)], "block": [row["block"]], "keys": [_pack_sorted(pairs.key[own])], "counts": [_narrow(local[own])], "context": [context[own].astype("<u2").tobytes()], "word": [word[own].astype(np.uint8).tobytes()]}, schema=schema)

    return run


def _shard_trie(keys: np.ndarray, count: np.ndarray, context: np.ndarray, word: np.ndarray, mu: float) -> bytes:
    """A shard's trie: pairs seen in training, with their smoothed probabilities in steps of 1 / STEP."""
    seen = count > 0
    h, w = 2 ** (context[seen] / COUNT_STEP) - 1, 10 ** (-word[seen] / WORD_STEP)
    p = np.minimum((count[seen] + mu * w) / (np.maximum(h, count[seen]) + mu), 1.0)
    return Trie.of(keys[seen], np.clip(np.rint(-np.log10(p) * STEP), 0, 65534) + 1, BITS).to_bytes()


def _answer_pairs(mu: float, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            parts = [_unpack_sorted(x) for x in rows["keys"]]
            at = np.append(0, np.cumsum([len(p) for p in parts]))
            key, first, inverse = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
            count = np.bincount(inverse, weights=np.concatenate([_widen(x) for x in rows["counts"]]), minlength=len(key)).astype(np.int64)
            context, word = (np.frombuffer(b"".join(rows[c]), dtype=kind)[first].astype(np.float64) for c, kind in (("context", "<u2"), ("word", np.uint8)))
            data = _shard_trie(key, count, context, word, mu)
            yield _answers(rows, shard, at, Trie.from_buffer(mapped(data)).find(key)[inverse], None)
            if keep:
                yield pa.RecordBatch.from_pydict({"block": [None], "shard": [shard], "answer": [data], "totals": [None]}, schema=_ANSWER)

    return run


def _score(shards: int, word_shards: int, corpus: Corpus, starts: int):
    schema = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = _merge(row["words"], row["answers"], word_shards)
                pairs = Pairs(row["stream"], row["size"], row["words"], shards)
                code = np.zeros(len(pairs.key), dtype=np.int64)
                for a in row["pair_answers"]:
                    code[pairs.cut[a["shard"]] : pairs.cut[a["shard"] + 1]] = _widen(a["answer"])
                h = _context_counts(counts, starts)[pairs.context]
                unseen = np.log10(corpus.mu * corpus.word(counts)[pairs.word] / (h + corpus.mu))
                log_p = np.where(code > 0, -(code - 1) / STEP, unseen)
                at = np.append(0, np.cumsum(row["size"]))
                of = pairs.stream
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_id"], pa.int64()), pa.array(row["train"]), pa.array(np.diff(at)), pa.array(text.rows_sum((counts[of] > 0).astype(np.int64), at)), pa.array(text.rows_sum(corpus.base(counts)[of], at)), pa.array(text.rows_sum(log_p[pairs.of_token], at))], schema=schema)

    return run


def _gathered(answers: DataFrame, name: str) -> DataFrame:
    return answers.where(F.col("block").isNotNull()).groupBy("block").agg(F.collect_list(F.struct("shard", "answer")).alias(name))


def score(docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", mu: float = MU, model_path: str | None = None) -> DataFrame:
    """Scores of each row of docs: doc_id, train, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are runs of characters other than ASCII white space, A-Z lower-cased, and one end after
    each text, null and empty ones too. Rows where train (by default: crc32 fold of 5 isn't 1) is
    true are counted, every row is scored; a null id is scored under null and repeated rows count
    each for themselves. n_known: tokens that training rows have; base_score: log10 probability
    with half a count added to each; score: the trie's. With model_path, the shards of the trie are
    written there as Parquet (shard, answer: bytes for elias_fano.Trie.from_buffer).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-lm")
    train = fold(id_col, 5) != 1 if train is None else train
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    table = f"marlstone_blocks_{scratch.root[-32:]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Buckets let the blocks meet their answers twice without being shuffled.
    map_batches(own, _blocks, _BLOCK_SQL).write.bucketBy(buckets, "block").format("parquet").option("compression", "zstd").option("path", scratch.path("blocks")).saveAsTable(table)
    blocks = spark.table(table)
    size = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.size(F.filter("train", lambda t: t))), F.lit(0)).alias("starts")).first()
    word_shards, shards = size["words"] // SHARD_WORDS + 1, size["tokens"] // SHARD_PAIRS + 1
    asked = map_batches(blocks.select("block", "words", "counts"), _ask_words(word_shards), "shard int, block bigint, keys binary, counts binary")
    counted = scratch.write(map_batches(asked.repartition("shard").sortWithinPartitions("shard"), _count_words, _ANSWER_SQL), "words")
    totals = counted.where(F.col("totals").isNotNull()).select(*[F.coalesce(F.sum(F.get("totals", F.lit(k))), F.lit(0)) for k in range(4)]).first()
    corpus = Corpus(*totals, mu)
    known = _gathered(counted, "answers")
    with_counts = blocks.select("block", "train", "size", "stream", "words").join(known, "block")
    asked = map_batches(with_counts, _ask_pairs(shards, word_shards, corpus, size["starts"]), "shard int, block bigint, keys binary, counts binary, context binary, word binary")
    answered = scratch.write(map_batches(asked.repartition("shard").sortWithinPartitions("shard"), _answer_pairs(mu, model_path is not None), _ANSWER_SQL), "pairs")
    if model_path is not None:
        answered.where(F.col("block").isNull()).select("shard", "answer").write.parquet(model_path)
    whole = blocks.select("block", "doc_id", "train", "size", "stream", "words").join(known, "block").join(_gathered(answered, "pair_answers"), "block")
    out = map_batches(whole, _score(shards, word_shards, corpus, size["starts"]), "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    scores = scratch.write(out.select("doc_id", "train", "n_tokens", "n_known", F.lit(corpus.tokens).cast("bigint").alias("train_tokens"), "base_score", "score"), "scores")
    spark.sql(f"DROP TABLE {table}")
    del blocks, asked, counted, known, with_counts, answered, whole, out
    scratch.drop(("scores",))
    return scores
