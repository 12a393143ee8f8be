"""Phrase collocations by hierarchical pair naming.

Words that occur often enough get ids. On every further level, the ids of two phrases of k - 1
words that begin at neighbouring places make a pair, and each pair that is frequent in the whole
corpus gets an id of its own: that of a phrase of k words. A phrase is frequent only if both its
halves of a pair are, so nothing else is ever counted, and the pair's two ids are pointers to its
parents: following the left ones gives the phrase's beginnings, the right ones its ends, and both
together all phrases inside it.

Texts become blocks of codes once. A block exchanges its distinct pairs, with their counts, for
ids; only the codes of a block and the ids of its own pairs ever meet in a task. Most pairs are
rare, so pairs are first counted by packed 32-bit hashes in shards: a pair whose hash isn't
frequent can't be, and makes no row. That saves work and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm import text as tx
from marlstone.llm.sized import with_totals
from marlstone.llm.store import Scratch, _release, map_batches
from marlstone.workers import ship

#: Text that one block takes at most, unless a single document is longer.
BLOCK_BYTES = 4 << 20
#: Words of all texts for each shard in which hashes of pairs are counted, and hashes that are handed to every task at most (32 MB).
SHARD_WORDS, HEAVY_HASHES = 2 << 20, 4 << 20
#: Salts of the rounds in which phrases of a language are ranked, so that no task ranks them all.
ROUNDS = (1024, 32, 1)

_CUTS = b".,;:!?\x0a\x0b\x0c\x0d"
_KIND = np.zeros(256, dtype=np.uint8)  # 0: of a word, 1: between words, 2: between pieces
_KIND[list(b" \t")] = 1
_KIND[list(_CUTS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_BLOCKS = "kind string, block bigint, codes binary, code int, n bigint"
_WORDS = f"{_BLOCKS}, lang string, word binary"
_PACKED = "kind string, block bigint, codes binary, shard int, start bigint, size bigint, packed binary"
_PACKED_SCHEMA = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("codes", pa.binary()), ("shard", pa.int32()), ("start", pa.int64()), ("size", pa.int64()), ("packed", pa.binary())])
_PACKED_FIELDS = _PACKED_SCHEMA.names
_NAMED = "kind string, block bigint, size bigint, packed binary, id bigint, left bigint, right bigint, a bigint"
_RENAMED = "kind string, block bigint, codes binary, ids binary, shard int, packed binary, size bigint"


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of all texts (binary, A-Z lower-cased), the piece and the text that each is in."""
    data, at = tx.raw(texts)
    spread = np.full(len(data) + len(at), ord("\n"), dtype=np.uint8)  # a cut before each text and at the end
    own = np.ones(len(spread), dtype=bool)
    own[at + np.arange(len(at))] = False
    spread[own] = _LOWER[data]
    kind = _KIND[spread]
    inside = kind == 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    ends_at = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=ends_at[1:])
    out = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends_at), pa.py_buffer(spread[inside])])
    row = np.searchsorted(at + np.arange(len(at)), starts, side="right") - 1
    return out, np.cumsum(kind == 2)[starts], row


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, code, n = np.unique(keys, return_inverse=True, return_counts=True)
    return values, code.reshape(-1).astype(np.int32), n


def _batch(block: int, codes: np.ndarray, n: np.ndarray, names: list[pa.Array], fields: list[str]) -> Iterator[pa.RecordBatch]:
    """A block's row, then a row for each of its distinct names."""
    head = [pa.array(["blocks"]), pa.array([block]), pa.array([codes.tobytes()], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64())]
    columns = ["kind", "block", "codes", "code", "n", *fields]
    yield pa.RecordBatch.from_arrays([*head, *(pa.nulls(1, x.type) for x in names)], names=columns)
    rest = [pa.array(["names"] * len(n), pa.string()), pa.array(np.full(len(n), block)), pa.nulls(len(n), pa.binary()), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)]
    yield pa.RecordBatch.from_arrays([*rest, *names], names=columns)


def _read(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in tx.slices(batch, "text", block_bytes):
                found, piece, row = words(part.column("text"))
                if not len(found):
                    continue
                word, spelt = tx.coded(found)
                lang, langs = tx.coded(part.column("lang"))
                keys, code, n = _distinct(lang[row] * len(spelt) + word)
                place = np.arange(len(code)) + np.cumsum(np.append(0, np.diff(piece) != 0))
                codes = np.full(place[-1] + 1, -1, np.int32)
                codes[place] = code
                names = [langs.take(pa.array(keys // len(spelt))), spelt.take(pa.array(keys % len(spelt))).cast(pa.binary())]
                yield from _batch(block, codes, n, names, ["lang", "word"])
                block += 1

    return run


def _bucket(left: np.ndarray, right: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard and the 32-bit hash of pairs of ids."""
    h = tx.mix(tx.mix(left.astype(np.uint64)) + np.uint64(3) * right.astype(np.uint64))
    return ((h >> np.uint64(32)) % np.uint64(shards)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _neighbours(at: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where two names stand next to each other, the distinct pairs (left * known + right), each place's pair, and counts."""
    both = (at[:-1] >= 0) & (at[1:] >= 0)
    return both, *_distinct(at[:-1][both].astype(np.int64) * known + at[1:][both])


def _renamed(shards: int):
    """A block and the ids of its frequent names: its places by those names, and its pairs' hashes, packed for each shard."""
    schema = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("codes", pa.binary()), ("ids", pa.binary()), ("shard", pa.int32()), ("packed", pa.binary()), ("size", pa.int64())])

    def run(blocks: pa.Table, ids: pa.Table) -> pa.Table:
        if not len(blocks) or not len(ids):
            return schema.empty_table()
        codes = np.frombuffer(blocks.column("codes")[0].as_buffer(), np.int32)
        if "packed" in ids.column_names:
            own, name = np.concatenate([_unpack(p, n, 2) for p, n in zip(ids.column("packed").to_pylist(), ids.column("size").to_pylist())], axis=1)
        else:
            own, name = ids.column("code").to_numpy(), ids.column("id").to_numpy()
        index = np.full(max(int(codes.max()), int(own.max())) + 2, -1, np.int32)  # its last place is for code -1
        index[own] = np.arange(len(own), dtype=np.int32)
        at = index[codes]
        at = at[(at >= 0) | np.append(False, at[:-1] >= 0)]  # one place of a gap will do
        _, keys, _, n = _neighbours(at, len(own))
        shard, value = _bucket(name[keys // len(own)], name[keys % len(own)], shards)
        order = np.lexsort((value, shard))
        shard, value, n = shard[order], value[order], n[order]
        edges = np.searchsorted(shard, np.arange(shards + 1))
        used = np.flatnonzero(np.diff(edges))
        packed = [pa.compress(np.concatenate([np.diff(value[a:b], prepend=0), n[a:b]]).astype(np.uint32).tobytes(), "zstd", asbytes=True) for a, b in zip(edges[used], edges[used + 1])]
        m = len(used)
        head = [pa.array(["blocks"]), pa.array([blocks.column("block")[0].as_py()]), pa.array([at.tobytes()], pa.binary()), pa.array([name.tobytes()], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64())]
        rest = [pa.array(["hashes"] * m, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(used, pa.int32()), pa.array(packed, pa.binary()), pa.array(np.diff(edges)[used])]
        _release()
        return pa.Table.from_arrays([pa.concat_arrays([x, y.cast(x.type)]) for x, y in zip(head, rest)], schema=schema)

    return run


def _heavy(least: int):
    """Of a shard's hashes those that occur least times in all blocks together, packed."""
    schema = pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("values", pa.binary())])

    def run(rows: pa.Table) -> pa.Table:
        values, counts = [], []
        for packed, size in zip(rows.column("packed").to_pylist(), rows.column("size").to_pylist()):
            both = np.frombuffer(pa.decompress(packed, decompressed_size=8 * size, codec="zstd", asbytes=True), np.uint32)
            values.append(np.cumsum(both[:size], dtype=np.int64))
            counts.append(both[size:].astype(np.int64))
        value, code = np.unique(np.concatenate(values), return_inverse=True)
        kept = value[np.bincount(code.reshape(-1), weights=np.concatenate(counts)) >= least].astype(np.uint32)
        _release()
        return pa.Table.from_arrays([pa.array([rows.column("shard")[0].as_py()], pa.int32()), pa.array([len(kept)]), pa.array([kept.tobytes()], pa.binary())], schema=schema)

    return run


def _pack(*columns: np.ndarray) -> bytes:
    return pa.compress(np.concatenate([c.astype(np.int64) for c in columns]).tobytes(), "zstd", asbytes=True)


def _unpack(packed: bytes, size: int, columns: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, decompressed_size=8 * size * columns, codec="zstd", asbytes=True), np.int64).reshape(columns, size)


def _pairs(shards: int, heavy: np.ndarray | None):
    """The next level of each block: codes of its pairs, and the pairs packed for each shard; heavy: the only hashes (shard << 32 | hash, sorted) that count, if known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, codes, ids in zip(batch.column("block").to_pylist(), batch.column("codes"), batch.column("ids")):
                at, name = np.frombuffer(codes.as_buffer(), np.int32), np.frombuffer(ids.as_buffer(), np.int64)
                both, keys, code, n = _neighbours(at, len(name))
                left, right = name[keys // len(name)], name[keys % len(name)]
                shard, value = _bucket(left, right, shards)
                own = np.arange(len(n))
                if heavy is not None:
                    kept = np.isin((shard << 32) | value, heavy)
                    own, left, right, n, shard = own[kept], left[kept], right[kept], n[kept], shard[kept]
                if not len(n):
                    continue
                order = np.argsort(shard, kind="stable")
                new = np.full(len(keys), -1, np.int32)
                new[own[order]] = np.arange(len(order), dtype=np.int32)
                after = np.full(len(both), -1, np.int32)
                after[both] = new[code]
                after = after[(after >= 0) | np.append(False, after[:-1] >= 0)]
                left, right, n, shard = left[order], right[order], n[order], shard[order]
                used, first = np.unique(shard, return_index=True)
                cuts = [*first.tolist(), len(n)]
                rows = [("blocks", block, after.tobytes(), None, None, None, None)]
                rows += [("names", block, None, int(s), a, b - a, _pack(left[a:b], right[a:b], n[a:b])) for s, a, b in zip(used, cuts, cuts[1:])]
                yield pa.RecordBatch.from_pylist([dict(zip(_PACKED_FIELDS, r)) for r in rows], schema=_PACKED_SCHEMA)

    return run


def _namer(least: int, k: int):
    """A shard's pairs of all blocks: those that occur least times get ids; each block's codes and ids, packed, and the pairs by id."""
    schema = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("packed", pa.binary()), ("id", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("a", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        blocks, starts, sizes, shard = (rows.column(c).to_pylist() for c in ("block", "start", "size", "shard"))
        left, right, n = np.concatenate([_unpack(p, s, 3) for p, s in zip(rows.column("packed").to_pylist(), sizes)], axis=1)
        order = np.lexsort((right, left))
        new = np.append(True, (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0))
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        total = np.zeros(int(new.sum()), np.int64)
        np.add.at(total, group, n)
        kept = total >= least
        ids = np.where(kept, (k << 56) + (shard[0] << 32) + np.cumsum(kept) - 1, -1)
        out = []
        at = np.append(0, np.cumsum(sizes))
        for block, start, a, b in zip(blocks, starts, at, at[1:]):
            own = ids[group[a:b]]
            some = np.flatnonzero(own >= 0)
            if len(some):
                out.append(("ids", block, len(some), _pack(start + some, own[some]), None, None, None, None))
        where = order[new]  # a place of each pair
        out += [("level", None, None, None, *row) for row in zip(ids[kept].tolist(), left[where][kept].tolist(), right[where][kept].tolist(), total[kept].tolist())]
        _release()
        return pa.Table.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)

    return run


def _written(scratch: Scratch, df: DataFrame, name: str) -> Callable[[str], DataFrame]:
    """Rows of several kinds written apart in one go; a kind's rows."""
    path = scratch.path(name)
    df.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    return lambda kind: df.sparkSession.read.schema(df.schema).parquet(path).where(F.col("kind") == kind)  # parts meet again, so none may be another's


def _heavy_hashes(scratch: Scratch, hashes: DataFrame, least: int, k: int) -> np.ndarray | None:
    """Hashes of the pairs that may be frequent, sorted; None if they are too many to hand to every task."""
    found = scratch.write(hashes.groupBy("shard").applyInArrow(_heavy(least), "shard int, n bigint, values binary"), f"heavy{k}")
    if (found.agg(F.sum("n")).first()[0] or 0) > HEAVY_HASHES:
        return None
    parts = [(r["shard"] << 32) | np.frombuffer(r["values"], np.uint32).astype(np.int64) for r in found.collect()]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def _named(scratch: Scratch, names: DataFrame, keys: list[str], least: int, k: int) -> DataFrame:
    """Rows (block, code, id, a, first, keys) of the names that occur least times in all blocks together.

    All rows of a name, one from each block that has it, meet in one shuffle and agree on its count
    and id. Its first row has first and the keys; the others don't need them again.
    """
    rows = names.select("block", "code", "n", *keys, F.monotonically_increasing_id().alias("place"))
    same = Window.partitionBy(*keys)
    kept = rows.withColumns({"a": F.sum("n").over(same), "least": F.min("place").over(same)}).where(F.col("a") >= least)
    first = F.col("place") == F.col("least")
    own = (F.col("least") + F.lit(k << 56)).alias("id")  # no id of another level
    return scratch.write(kept.select("block", "code", own, "a", first.alias("first"), *[F.when(first, F.col(c)).alias(c) for c in keys]), f"named{k}")


def frequent_phrases(docs: DataFrame, scratch: Scratch, least: int = 100, longest: int = 5, text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES) -> tuple[list[DataFrame], DataFrame]:
    """Phrases of 1, 2, ... longest words that occur least times, a table for each length, and all words' totals by language.

    Rows (id, lang, words, a, before, after, inside): a counts occurrences; before and after have
    the counts of the phrase's beginnings and ends of 1, 2, ... words; inside has the ids of the
    phrases of two words or more within it.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = _written(scratch, map_batches(rows, _read(block_bytes), _WORDS), "read")
    blocks, names = parts("blocks").select("block", "codes"), parts("names")
    totals = scratch.write(names.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    shards = 1 + (totals.agg(F.sum("n")).first()[0] or 0) // SHARD_WORDS
    none = F.array().cast("array<bigint>")
    named = _named(scratch, names, ["lang", "word"], least, 1)
    level = named.where("first").select("id", "lang", F.array(F.col("word").cast("string")).alias("words"), "a", none.alias("before"), none.alias("after"), none.alias("inside"))
    levels, ids = [scratch.write(level, "level1")], named.select("block", "code", "id")
    for k in range(2, longest + 1):
        renamed = blocks.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_renamed(shards), _RENAMED)
        parts = _written(scratch, renamed, f"renamed{k}")
        del renamed, blocks, ids, names, named
        scratch.drop(keep=("totals", f"renamed{k}", *(f"level{i}" for i in range(1, k))))
        heavy = _heavy_hashes(scratch, parts("hashes").select("shard", "packed", "size"), least, k)
        paired = map_batches(parts("blocks").select("block", "codes", "ids"), _pairs(shards, heavy), _PACKED)
        parts = _written(scratch, paired, f"pairs{k}")
        blocks, names = parts("blocks").select("block", "codes"), parts("names").select("shard", "block", "start", "size", "packed")
        parts = _written(scratch, names.groupBy("shard").applyInArrow(_namer(least, k), _NAMED), f"named{k}")
        ids, named = parts("ids").select("block", "size", "packed"), parts("level").select("id", "left", "right", "a")
        l, r = (levels[-1].select(*[F.col(c).alias(f"{side}_{c}") for c in levels[-1].columns]) for side in ("l", "r"))
        both = named.join(l, F.col("left") == F.col("l_id")).join(r, F.col("right") == F.col("r_id"))
        own = F.array("left", "right") if k > 2 else none
        level = both.select(
            "id", F.col("l_lang").alias("lang"), F.concat("l_words", F.slice("r_words", -1, 1)).alias("words"), "a",
            F.concat("l_before", F.array("l_a")).alias("before"), F.concat("r_after", F.array("r_a")).alias("after"), F.array_distinct(F.concat(own, "l_inside", "r_inside")).alias("inside"),
        )
        levels.append(scratch.write(level, f"level{k}"))
        del parts, paired, level, both
        scratch.drop(keep=("totals", f"pairs{k}", f"named{k}", *(f"level{i}" for i in range(1, k + 1))))
    return levels, totals


def first_of_each(rows: DataFrame, by: str, order: list, k: int, spread: str) -> DataFrame:
    """The first k rows of each value of `by` with their rank, ranked in rounds of fewer and fewer parts."""
    for salts in ROUNDS:
        salt = F.pmod(F.xxhash64(spread), F.lit(salts))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(by, salt).orderBy(*order))).where(F.col("rank") <= k)
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, subsumed_percent: int = 100, per_lang: int = 2000, text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The best phrases of each language: rows (lang, rank, phrase, a, l, r, n, score, cut).

    A-Z are lower-cased, texts cut into pieces at . , ; : ! ? and line ends, pieces into words at
    spaces and tabs. A phrase of 2 to longest words that occurs a >= least times within pieces is a
    candidate. Cut after its first words, it scores floor(1000 * a * n / (l * r)): l and r count
    its two parts, n all words of the language. Its lowest-scoring cut counts (cut: words before
    it; of equal scores the shortest). Candidates inside a longer one that occurs at least
    subsumed_percent as often are dropped. rank orders by score, a (both descending) and phrase.

    Null lang is `und`; null and empty texts have no words; repeated rows count as often as they
    occur. No row for an empty table. Other columns of docs are left behind, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    levels, totals = frequent_phrases(docs, scratch, least, longest, text_col, lang_col, block_bytes)
    wanted = ["id", F.size("words").alias("k"), "lang", "words", "a", "before", "after", "inside"]
    candidates = reduce(DataFrame.unionByName, [level.select(*wanted) for level in levels[1:]])
    longer = None
    for k in range(3, longest + 1):
        own = levels[k - 1].select("a", F.explode("inside").alias("id"))
        longer = own if longer is None else longer.unionByName(own)
    if longer is not None:
        top = longer.groupBy("id").agg(F.max("a").alias("most"))
        candidates = candidates.join(top, "id", "left").where(F.col("most").isNull() | (100 * F.col("most") < subsumed_percent * F.col("a")))
    big = lambda c: f"cast({c} as decimal(20,0))"
    l, r = "element_at(before, j)", "element_at(after, k - j)"
    cuts = f"transform(sequence(1, k - 1), j -> named_struct('score', ({big('a')} * 1000 * {big('n')}) div ({big(l)} * {big(r)}), 'cut', j, 'l', {l}, 'r', {r}))"
    scored = with_totals(candidates, totals, "lang", "n", F.col("id")).withColumn("best", F.array_min(F.expr(cuts)))
    rows = scored.select("lang", F.array_join("words", " ").alias("phrase"), "a", "n", F.col("best.score").alias("score"), F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.cut").cast("bigint").alias("cut"))
    ranked = first_of_each(rows, "lang", [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], per_lang, "phrase")
    kept = scratch.write(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut"), "ranked")
    scratch.drop(keep=("ranked",))
    return kept
