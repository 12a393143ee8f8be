"""Exact n-gram Jaccard self-join and its components, by a token-group matrix.

Every text is the set of its distinct word shingles. Equal sets are one node. Shingles are dealt to
shards that count the nodes of each; those that two nodes or more have go back to their nodes, and
order each set: rare shingles first. Only these can be shared, so a node keeps its repeated shingles
and its number of shingles, and a node with too few of them for any link is done.

Linked sets have a first shared shingle in that order. What stands before it in either set isn't
shared, so its places bound the overlap, and it lies in a short prefix. Nodes are partitioned into
groups of similar sets: each looks up leaders by its prefix shingles, and verified links to leaders
make the groups. The token-group matrix holds the union of each group's prefix shingles, with the
least and greatest set of the members that have one and the best place it takes among them. A node
opens only those larger groups that this bound lets it link with; members of opened groups are bounded
one by one and then verified exactly, the likeliest first: one link settles a node and a group. Groups
that links join are components.

Hot groups cost no more than their members: copies are one node, near copies one group, and a
group stands once for each shingle however many members have it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import text
from marlstone.llm.store import Scratch, map_batches

#: Words of a shingle, and the least similarity in percent.
SHINGLE, PERCENT = 5, 75
#: Buckets of the shingle counts that say how many parts a frequent shingle is dealt into.
BUCKETS = 1 << 20
#: Occurrences of shingles that one task sorts at once.
SHARD = 1_000_000
#: Bits of a shingle's hash.
BITS = 56
#: Text whose shingles are dealt together, and nodes that a task remembers to have dealt.
DEALT_BYTES, SEEN = 4 << 20, 1 << 20
#: Rounds in which nodes try leaders: leaders drawn for a shingle, and leaders that a node tries.
TURNS = ((4, 1), (16, 8))
#: Rounds in which nodes try members of groups that the matrix opens, before they try all that is left: members drawn
#: for a shingle of a group, and members that a node tries.
OPENED = ((32, 32),)
#: Ids of documents that go which are broadcast; more are matched by a shuffled join.
MAX_BROADCAST = 2_000_000
_K = np.uint64(0x9E3779B97F4A7C15)


def _shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all shingles, repeated ones too: 56 bits of hash, and text."""
    tokens, at = text.words(texts)
    ids, distinct = text.coded(tokens)
    h, row, count = text.hashes(distinct, 3)[ids], text.row_of(at), np.diff(at)
    n = max(0, len(ids) - size + 1)
    key = np.full(n, size, dtype=np.uint64)
    for j in range(size):
        key = key * _K + h[j : j + n]
    whole = row[:n] == row[size - 1 : size - 1 + n]
    keys, rows = [text.mix(key[whole])], [row[:n][whole]]
    for length in range(1, size):  # a shorter text is one shingle
        own = np.flatnonzero(count == length)
        short = np.full(len(own), length, dtype=np.uint64)
        for j in range(length):
            short = short * _K + h[at[:-1][own] + j]
        keys.append(text.mix(short))
        rows.append(own)
    return np.concatenate(keys) >> np.uint64(64 - BITS), np.concatenate(rows)


def _sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, and their offsets by text."""
    keys, rows = _shingles(texts, size)
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    new = np.append(True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])) if len(k) else np.zeros(0, bool)
    return k[new], np.searchsorted(r[new], np.arange(len(texts) + 1))


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(BITS - 20)).astype(np.int64)


def bucket_counts(docs: DataFrame, size: int = SHINGLE, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Occurrences of shingles by bucket, where they stand out, and of all shingles together, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for part in text.slices(batch, text_col):
                counts += np.bincount(_bucket(_sets(part.column(text_col), size)[0]), minlength=BUCKETS)
        # What a bucket lacks here is an even share at most: it makes no frequent shingle rare.
        some = np.flatnonzero(counts > 4 + 2 * counts.sum() // BUCKETS)
        out = pa.array(np.append(-1, some)), pa.array(np.append(counts.sum(), counts[some]))
        yield pa.RecordBatch.from_arrays(list(out), names=["bucket", "n"])

    found = map_batches(docs.select(text_col), run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = found.where((F.col("bucket") < 0) | (F.col("n") > SHARD)).toArrow()
    bucket, n = (np.array(found.column(c)) for c in ("bucket", "n"))
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[bucket[bucket >= 0]] = n[bucket >= 0]
    return counts, int(n[bucket < 0].sum())


def _nodes(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each row's set."""
    total = text.rows_sum(text.mix(tokens ^ np.uint64(0xA5A5)).view(np.int64), at).view(np.uint64)
    return text.mix(total ^ text.mix(np.diff(at).astype(np.uint64))).view(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Integers with the bytes of equal place together, so that leading zeros compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _flat(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def _rows(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, node) of each text; without shingles the node is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch, "text"):
                tokens, at = _sets(part.column("text"), size)
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(_nodes(tokens, at), mask=n == 0)], names=["doc_id", "n", "node"])

    return map_batches(docs, run, "doc_id bigint, n bigint, node bigint")


def _gathered(packed: DataFrame, key: str, flush: Callable, schema: str) -> DataFrame:
    """flush applied to the rows of each key together; keys are dealt so that one fits in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            of = np.array(batch.column(key))
            for a in np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []:
                b = a + int(np.searchsorted(of[a:], of[a], side="right"))
                if parts and of[a] != now:
                    yield from flush(parts)
                    parts = []
                now = of[a]
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from flush(parts)

    return map_batches(packed.repartition(key).sortWithinPartitions(key), run, schema)


def _read(parts: list[pa.RecordBatch], column: str) -> list[bytes]:
    return [x for p in parts for x in p.column(column).to_pylist()]


def _repeated(docs: DataFrame, counts, shards: int, size: int, percent: int) -> DataFrame:
    """(node, n, tokens): the nodes that may have a link, and those of their shingles that other nodes have too.

    Shingles go to shards and the repeated ones back, both packed. Shingles of a bucket with more
    than SHARD occurrences are dealt to so many shards more, and are ordered by their bucket's
    count instead of their own; the others by the number of their nodes. tokens are in that order.
    """
    homes = shards // 4 + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, dtype=np.int64)  # nodes that this task has dealt: further copies add nothing
        for batch in batches:
            for part in text.slices(batch, "text", DEALT_BYTES):
                tokens, at = _sets(part.column("text"), size)
                node = _nodes(tokens, at)
                _, first = np.unique(node, return_index=True)
                fresh = np.zeros(len(node), dtype=bool)
                fresh[first] = True
                fresh &= ~np.isin(node, seen) & (np.diff(at) > 0)
                seen = np.concatenate([seen, node[fresh]])
                if len(seen) > SEEN:
                    seen = seen[-SEEN // 2 :]
                row = text.row_of(at)
                mine = fresh[row]
                token, row = tokens[mine], row[mine]
                if not len(token):
                    continue
                salts = (1 + counts.value[_bucket(token)] // SHARD).astype(np.uint64)
                home = (token >> np.uint64(BITS - 32)) * np.uint64(shards) >> np.uint64(32)
                shard = ((home + text.mix(node.view(np.uint64))[row] % salts * _K) % np.uint64(shards)).astype(np.int64)
                order = np.lexsort((token, shard))
                token, row = token[order], row[order]
                cut = np.searchsorted(shard[order], np.arange(shards + 1))
                n = np.diff(at).astype(np.int32)
                out: list[list] = [[], [], [], [], []]
                for s in np.flatnonzero(np.diff(cut)):
                    own, ref = np.unique(row[cut[s] : cut[s + 1]], return_inverse=True)
                    for c, x in zip(out, (s, _planes(np.diff(token[cut[s] : cut[s + 1]], prepend=np.uint64(0))), _planes(ref.astype(np.uint32)), node[own].tobytes(), n[own].tobytes())):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(c, pa.binary()) for c in out[1:]]], names=["shard", "tokens", "refs", "nodes", "sizes"])

    def count(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = [np.frombuffer(x, dtype=np.int64) for x in _read(parts, "nodes")]
        base = np.cumsum([0, *[len(x) for x in nodes]])
        ref = np.concatenate([_flat(x, np.uint32).astype(np.int64) + b for x, b in zip(_read(parts, "refs"), base)])
        token = np.concatenate([np.cumsum(_flat(x, np.uint64), dtype=np.uint64) for x in _read(parts, "tokens")])
        distinct, code = np.unique(np.concatenate(nodes), return_inverse=True)
        n = np.zeros(len(distinct), dtype=np.int32)
        n[code] = np.frombuffer(b"".join(_read(parts, "sizes")), dtype=np.int32)
        code = code[ref]
        order = np.lexsort((code, token))
        token, code = token[order], code[order]
        new = np.append(True, (token[1:] != token[:-1]) | (code[1:] != code[:-1]))
        token, code = token[new], code[new]  # tasks may deal the same node
        first = np.append(True, token[1:] != token[:-1])
        shared = np.diff(np.append(np.flatnonzero(first), len(token)))[np.cumsum(first) - 1]
        hot = counts.value[_bucket(token)]
        keep = (shared > 1) | (hot > SHARD)
        token, code, rank = token[keep], code[keep], np.minimum(np.where(hot > SHARD, hot, shared)[keep], 2**32 - 1).astype(np.uint32)
        part = (text.mix(distinct.view(np.uint64)) % np.uint64(homes)).astype(np.int64)[code]
        order = np.lexsort((code, part))
        token, code, rank = token[order], code[order], rank[order]
        cut = np.searchsorted(part[order], np.arange(homes + 1))
        out: list[list] = [[], [], [], [], [], []]
        for p in np.flatnonzero(np.diff(cut)):
            mine = slice(cut[p], cut[p + 1])
            own, each = np.unique(code[mine], return_counts=True)
            for c, x in zip(out, (p, distinct[own].tobytes(), n[own].tobytes(), _planes(each.astype(np.uint32)), _planes(token[mine]), _planes(rank[mine]))):
                c.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(c, pa.binary()) for c in out[1:]]], names=["part", "nodes", "sizes", "each", "tokens", "ranks"])

    def order(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, n = (np.frombuffer(b"".join(_read(parts, c)), dtype=t) for c, t in (("nodes", np.int64), ("sizes", np.int32)))
        each, token, rank = (np.concatenate([_flat(x, t) for x in _read(parts, c)]) for c, t in (("each", np.uint32), ("tokens", np.uint64), ("ranks", np.uint32)))
        distinct, first, code = np.unique(node, return_index=True, return_inverse=True)
        n, code = n[first], np.repeat(code, each)
        sort = np.lexsort((token, rank, code))
        token, code = token[sort], code[sort]
        new = np.append(True, (token[1:] != token[:-1]) | (code[1:] != code[:-1]))
        token, code = token[new], code[new]
        cut = np.searchsorted(code, np.arange(len(distinct) + 1))
        some = np.flatnonzero(100 * np.diff(cut) >= percent * n.astype(np.int64))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(distinct[some]), pa.array(n[some].astype(np.int64)), pa.array([token[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary())], names=["node", "n", "tokens"])

    dealt = map_batches(docs.select("text"), deal, "shard int, tokens binary, refs binary, nodes binary, sizes binary")
    back = _gathered(dealt, "shard", count, "part int, nodes binary, sizes binary, each binary, tokens binary, ranks binary")
    return _gathered(back, "part", order, "node bigint, n bigint, tokens binary")


def _prefixes(whole: DataFrame, percent: int) -> DataFrame:
    """(token, node, n, rest, pure): the repeated shingles in each node's prefix.

    rest is what stands from there to the set's end, pure the share of the node's shingles that are
    repeated ones: the original of a family of edited copies has most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.array(batch.column("n"))
            sets = [np.frombuffer(x, dtype=np.uint64) for x in batch.column("tokens").to_pylist()]
            shared = np.array([len(x) for x in sets], dtype=np.int64)
            head = np.maximum(0, shared - -(-percent * n // 100) + 1)  # rest is enough for the smallest partner
            if head.sum():
                token = np.concatenate([x[:h] for x, h in zip(sets, head)])
                at = np.append(0, np.cumsum(head))
                rest = np.repeat(shared, head) - (np.arange(len(token)) - np.repeat(at[:-1], head))
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(np.repeat(np.array(batch.column("node")), head)), pa.array(np.repeat(n, head)), pa.array(rest), pa.array(np.repeat(shared / n, head))], names=["token", "node", "n", "rest", "pure"])

    return map_batches(whole, run, "token bigint, node bigint, n bigint, rest bigint, pure double")


def _together(n: Column, m: Column, percent: int) -> Column:
    """Shingles that linked sets of n and m share at least."""
    return F.ceil((n + m) * percent / (100 + percent))


def _possible(percent: int) -> Column:
    """Whether sets n and a_n, whose first shared shingle leaves them rest and a_rest, can be linked."""
    n, m = F.col("n"), F.col("a_n")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least("rest", "a_rest") >= _together(n, m, percent))


def _verified(pairs: DataFrame, whole: DataFrame, scratch: Scratch, percent: int) -> DataFrame | None:
    """Those of the node pairs (a, b) that are linked, by all that they share; None if there are no pairs."""
    pairs = scratch.write(pairs.select("a", "b"), "verified-pairs")
    if pairs.isEmpty():
        return None

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y, n, m) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("x", "y", "n", "m")))):
                both = np.concatenate([np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                linked[i] = 100 * common >= percent * (n + m - common)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(linked)) for c in ("a", "b")], names=["a", "b"])

    joined = pairs.join(whole.select(F.col("node").alias("b"), F.col("tokens").alias("y"), F.col("n").alias("m")), "b").join(whole.select(F.col("node").alias("a"), F.col("tokens").alias("x"), "n"), "a")
    return scratch.write(map_batches(joined.select("a", "b", "x", "y", "n", "m"), links, "a bigint, b bigint"), "verified-links")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) of every node of the edges (a, b): the least node that links reach.

    Least labels pass along edges and then along labels, so chains shrink by half and more in each
    round; every round is written, and the last changes nothing.
    """
    both = scratch.write(edges.union(edges.select("b", "a")).distinct(), "components-edges")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "components-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = scratch.write(labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp")), "components-step")
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        labels = scratch.write(step.join(jump, "comp").select("node", "was", F.least("comp", "next").alias("comp")), "components-labels")
        if labels.where("was <> comp").isEmpty():
            return labels.select("node", "comp")
        labels = labels.select("node", "comp")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows with the group of their node and the number of the group's nodes."""
    if labels is None:
        return rows.withColumns({"comp": F.col("node"), "size": F.lit(1).cast("bigint")})
    sized = labels.join(labels.groupBy("comp").agg(F.count(F.lit(1)).alias("size")), "comp")
    return rows.join(sized, "node", "left").withColumns({"comp": F.coalesce("comp", "node"), "size": F.coalesce("size", F.lit(1))})


def _drawn(rows: DataFrame, by: list[str], turn: int, drawn: int) -> DataFrame:
    """Up to `drawn` nodes of each `by`, the purest of parts that each turn deals anew: (token, a, a_n, a_rest, a_pure, a_comp, a_size)."""
    part = F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(drawn)).alias("part")
    own = [F.col(c).alias(f"a_{c}") for c in ("n", "rest", "pure", "comp", "size")]
    best = F.max(F.struct("pure", F.col("node").alias("a"), *own))
    return rows.groupBy(*by, part).agg(best.alias("l")).select("token", "l.a", *[f"l.a_{c}" for c in ("n", "rest", "pure", "comp", "size")])


def _below() -> Column:
    """Whether a group asks another: the smaller asks the larger, so each two groups meet once."""
    return (F.col("size") < F.col("a_size")) | ((F.col("size") == F.col("a_size")) & (F.col("comp") < F.col("a_comp")))


def _several(rows: DataFrame) -> DataFrame:
    """Shingles in the prefixes of two groups or more."""
    return rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token")


def similar_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (bigint).

    Words are maximal runs of characters other than ASCII white space, A-Z lower-cased; a text's set
    is its distinct shingles of `size` words, or its whole word sequence if it has fewer. Texts
    link when 100 * |intersection| >= percent * |union|; component_id is the least doc_id that
    links reach. Null and empty texts have 0 shingles and are components of their own. Rows that
    repeat an id are linked like any others and each has its row; a null id stays null, counts for
    no least id, and gets null where no other row of its component has one. Sets are compared by
    64-bit fingerprints and 56-bit shingle hashes.
    """
    return _similar_groups(docs, Scratch(docs.sparkSession, "group-join"), size, percent, id_col, text_col)


def _likeliest(pairs: DataFrame, tried: int) -> DataFrame:
    """Of (a, a_pure, b), a row for each shared shingle: for each b the `tried` a that are pure and have most of them."""
    counted = pairs.groupBy("a", "b").agg((F.count(F.lit(1)) * F.max("a_pure")).alias("score"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("score", "a")), False), 1, tried)
    return counted.groupBy("b").agg(best.alias("best")).select("b", F.inline("best")).select("a", "b")


def _tries(grouped: DataFrame, turn: int, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs (a, b): for each node its likeliest leaders of other groups."""
    drawn, tried = TURNS[turn]
    leaders = scratch.write(_drawn(grouped, ["token"], turn, drawn), "leaders")
    pairs = grouped.join(leaders, "token").where(_below() & _possible(percent))
    return _likeliest(pairs.select("a", "a_pure", F.col("node").alias("b")), tried)


def _open(grouped: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """The groups that nodes open by way of the token-group matrix, and the shingles that let them: (node, token, n, rest, a_comp)."""
    matrix = grouped.groupBy("token", F.col("comp").alias("a_comp")).agg(F.max("size").alias("a_size"), F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("rest").alias("best"))
    partner = F.greatest("least_n", F.ceil(F.col("n") * percent / 100))  # the smallest that the group can offer
    fits = (percent * F.col("least_n") <= 100 * F.col("n")) & (percent * F.col("n") <= 100 * F.col("most_n")) & (F.least("rest", "best") >= _together(F.col("n"), partner, percent))
    return grouped.join(scratch.write(matrix, "matrix"), "token").where(_below() & fits).select("node", "token", "n", "rest", "a_comp")


def _members(opened: DataFrame, grouped: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes and members of the groups that they opened: the likeliest, or after the last turn all that can be linked."""
    if turn < len(OPENED):
        drawn, tried = OPENED[turn]
        members = _drawn(grouped, ["token", "comp"], turn, drawn)
    else:
        members = grouped.select("token", F.col("node").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("n", "rest", "pure", "comp")])
    pairs = opened.join(members, ["token", "a_comp"]).where(_possible(percent)).select("a", "a_pure", F.col("node").alias("b"))
    return _likeliest(pairs, tried) if turn < len(OPENED) else pairs.select("a", "b").distinct()


def _similar_groups(docs: DataFrame, scratch: Scratch, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts, total = bucket_counts(docs, size)
    sets = scratch.write(_rows(docs, size), "rows")
    whole = scratch.write(_repeated(docs, docs.sparkSession.sparkContext.broadcast(counts), total // SHARD + 1, size, percent), "whole")
    rows = scratch.write(_prefixes(whole, percent), "prefixes")
    reps = scratch.write(sets.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id")), "nodes")
    kept = ("rows", "whole", "prefixes", "nodes", "edges", "labels")
    scratch.drop(kept)
    # Groups: each node tries its likeliest leaders of larger groups, then the likeliest members of
    # groups that the matrix opens, and at last all members of those that are still open to it.
    edges = labels = None
    for turn in range(len(TURNS) + len(OPENED) + 1):
        grouped = scratch.write(_labelled(rows, labels), "grouped")
        grouped = scratch.write(grouped.join(_several(grouped), "token", "left_semi"), "several")
        if turn < len(TURNS):
            pairs = _tries(grouped, turn, scratch, percent)
        else:
            opened = scratch.write(_open(grouped, scratch, percent), "opened")
            if opened.isEmpty():
                break
            pairs = _members(opened, grouped, turn - len(TURNS), percent)
            del opened
        found = _verified(pairs, whole, scratch, percent)
        del pairs, grouped
        if found is not None and not found.isEmpty():
            edges = scratch.write(found if edges is None else edges.union(found), "edges")
            labels = scratch.write(components(edges, scratch), "labels")
        del found
        scratch.drop(kept)
    if labels is not None:
        of = scratch.write(reps.join(labels, "node"), "of")
        least_id = scratch.write(of.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "least")
        named = scratch.write(reps.join(of.join(least_id, "comp").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id")), "named")
    else:
        named = scratch.write(reps.select("node", F.col("doc_id").alias("component_id")), "named")
    scratch.drop(("rows", "named"))
    return sets.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id isn't the least of their component.

    Rows that repeat the least id stay, and so do rows with a null id. Ids of rows that go are
    broadcast up to MAX_BROADCAST of them; more are matched by a shuffled join.
    """
    scratch = Scratch(docs.sparkSession, "group-join")
    found = _similar_groups(docs, scratch, size, percent, id_col, text_col)
    gone = Scratch(docs.sparkSession, "one-of-each").write(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    del found
    scratch.drop()
    out = F.broadcast(gone) if gone.count() <= MAX_BROADCAST else gone
    return docs.join(out, docs[id_col] == out["__gone"], "left_anti")
