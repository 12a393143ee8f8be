"""Learned operators: held-out accuracy, exact parts against brute force, and awkward rows."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import deobfuscate, fertility, fm_index, gru, mixing, native_lines, nbsvm, ngram_lm, text
from marlstone.llm.elias_fano import EliasFano, Trie, mapped
from marlstone.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"
AWKWARD = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n\t"), (10**6 + 3, "x" * 200000), (10**6 + 3, "x" * 200000), (None, "plain words here"), (10**6 + 4, "!!! ??? 123")]


def _fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def _auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame(AWKWARD, "doc_id bigint, text string").withColumn("lang", F.lit(None).cast("string"))
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").unionByName(odd).withColumns({"score": F.lit(1), "word": F.lit("w")})


def _checked(scored, labels, target, least):
    rows = scored.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).select("score", target).collect()
    score, label = np.array([r["score"] for r in rows]), np.array([r[target] for r in rows])
    assert ((score >= 0) & (score <= 1)).all()
    assert _auc(score, label) >= least


def test_quality(docs, labels):
    out = nbsvm.score(docs, nbsvm.fit(docs, labels))
    assert out.count() == docs.count() and set(out.columns) == set(docs.columns)
    _checked(out, labels, "quality", 0.97)


def test_toxicity(spark, docs, labels):
    model = deobfuscate.fit(docs, labels)
    out = deobfuscate.score(docs, model)
    assert out.count() == docs.count()
    _checked(out, labels, "toxic", 0.75)
    plain = "here is a calm note on the weather and the trains of today"
    cases = [(1, plain + " you idiot and moron"), (2, plain + " you 1d10t and m0r0n"), (3, plain + " you i d i o t and mooooron"), (4, plain)]
    got = {r["doc_id"]: r["score"] for r in deobfuscate.score(spark.createDataFrame(cases, "doc_id bigint, text string"), model).collect()}
    assert min(got[1], got[2], got[3]) > 0.5 > got[4]


@pytest.fixture(scope="module")
def restorer(docs):
    return deobfuscate.Restorer(deobfuscate.char_model(deobfuscate.count_char_grams(docs)))


def _restored(restorer, t):
    rows, vocabulary, word = restorer.restore(pa.array([t]))
    return {vocabulary[int(w)].as_py() for w in word}


def test_words_spaced_out(restorer):
    for t in ("you are a m o r o n", "you i d i o t m o r o n", "y o u a r e a m o r o n", "you m o r o n.", "you (m . o - r . o . n)", "w h a t a n i d i o t a n d w h a t a g r e a t b i g m o r o n", "you m 0 r 0 n!"):
        assert "moron" in _restored(restorer, t), t
    assert "idiot" in _restored(restorer, "you i d i o t m o r o n")


def test_whole_channel_reaches_the_decoder(restorer):
    cases = {"idiot": ("iiddiioott", "1d107", "id10+", "i,d,i,o,t", "1d10t"), "moron": ("moorroonn", "m\\o\\r\\o\\n", "m0r0n", "m.o.r.o.n"), "loser": ("10$3r", "1053r")}
    for word, tokens in cases.items():
        for token in tokens:
            assert word in _restored(restorer, f"you {token} there"), token
    assert "as" in _restored(restorer, "such a$ this") and _restored(restorer, "3.14 1,000 2026") == {"3.14", "1,000", "2026"}


def test_no_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert nbsvm.score(docs, nbsvm.fit(docs, none)).agg(F.countDistinct("score")).first()[0] == 1
    assert deobfuscate.score(docs, deobfuscate.fit(docs, none)).agg(F.countDistinct("score")).first()[0] == 1


def test_char_grams_count_tokens(spark):
    """Counts of all tokens, however rows lie in batches."""
    rows = [(1, "the the the cat"), (2, "the cat, sat"), (3, "- 1d10t"), (4, None), (5, "the")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    words = ["the"] * 5 + ["cat"] * 2 + ["sat"]
    expected = np.bincount(deobfuscate._char_grams(pa.array(words, pa.large_string())), minlength=deobfuscate.SYMBOLS**deobfuscate.ORDER)
    for parts in (1, 5):
        assert (deobfuscate.count_char_grams(docs.repartition(parts)) == expected).all()


def test_viterbi_is_the_best_path():
    """Against all readings of short tokens."""
    counts = np.zeros(deobfuscate.SYMBOLS**deobfuscate.ORDER)
    np.add.at(counts, deobfuscate._char_grams(pa.array([b"idiot", b"toil", b"sail", b"lit"] * 50, pa.large_binary())), 1)
    model = deobfuscate.char_model(counts)

    def readings(token):
        """(letters with repeats marked, cost) of every reading without fillers."""
        out = [((0, 0, 0), 0.0, "")]
        for c in token:
            out = [(((b, d, s), cost + c2 + model[a, b, d, s] + (deobfuscate.KEEP_REPEAT if s == d else 0), w + chr(96 + s))) for (a, b, d), cost, w in out for s, c2 in deobfuscate._means(c)] + [((a, b, d), cost + c2 + deobfuscate.DROP_REPEAT, w) for (a, b, d), cost, w in out for s, c2 in deobfuscate._means(c) if s == d]
        return max(out, key=lambda x: (x[1] + model[x[0] + (0,)], x[2]))[2]

    for token in ("1d10t", "70!1", "5a11", "llit", "t011", "iiit"):
        assert deobfuscate.decode(token, model) == readings(token)


def test_gru_gradient():
    net = gru.Network(["a", "b", "c"])
    pieces, length, _ = gru._pieces(pa.array([b"hello", b"abc", b"z"], pa.large_binary()))
    target = np.array([0, 2, 1])
    _, gradients = net.gradients(pieces, length, target)
    for w, g in zip(net.weights(), gradients):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        was = w[at]
        w[at] = was + 0.01
        high = net.gradients(pieces, length, target)[0]
        w[at] = was - 0.01
        low = net.gradients(pieces, length, target)[0]
        w[at] = was
        assert math.isclose(g[at], (high - low) / 0.02, rel_tol=0.05, abs_tol=1e-4)


def test_language(docs):
    rows = gru.predict(docs, gru.fit(docs)).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["lang"] and _fold(r["doc_id"], 4) == 2]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    for r in rows:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["score"] <= 1


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, bound in ((0, 10), (1, 1), (5, 100), (1000, 1 << 24), (5000, 6000), (20000, 1 << 40)):
        v = np.sort(rng.integers(0, bound, n)).astype(np.uint64)
        e = EliasFano.of(v, bound)
        assert (e.get(np.arange(n)) == v).all()
        q = rng.integers(0, bound, 300).astype(np.uint64)
        assert (e.first_from(q, np.zeros(300, int), np.full(300, n)) == np.searchsorted(v, q)).all()
    keys = np.unique((rng.integers(0, 500, 20000).astype(np.uint64) << np.uint64(24)) | rng.integers(0, 1 << 24, 20000).astype(np.uint64))
    codes, half = rng.integers(1, 65535, len(keys)), np.arange(len(keys)) % 2 == 0
    found = Trie.from_buffer(mapped(Trie.of(keys[half], codes[half], 24).to_bytes())).find(keys)
    assert (found[half] == codes[half]).all() and not found[~half].any()


def test_language_model(spark, tmp_path):
    """Counts and base score exactly, the model's score to the steps of its quantisation."""
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = source.unionByName(spark.createDataFrame(AWKWARD, "doc_id bigint, text string")).withColumn("n_tokens", F.lit(1))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    split = lambda t: [x for x in re.split(r"[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x] + [None]
    word, pair, start = {}, {}, 0
    for i, t in rows:
        if i is None or _fold(i, 5) != 1:
            start += 1
            tokens = split(t)
            for a, b in zip([0, *tokens], tokens):
                word[b] = word.get(b, 0) + 1
                pair[a, b] = pair.get((a, b), 0) + 1
    n, v = sum(word.values()), len(word)
    corpus = ngram_lm.Corpus(n, v, sum(c == 1 for c in word.values()), sum(c == 2 for c in word.values()))
    got = {(r["doc_id"], r["n_tokens"]): r for r in ngram_lm.score(docs, model_path=str(tmp_path / "trie")).collect()}
    assert spark.read.parquet(str(tmp_path / "trie")).count() > 0
    for i, t in rows:
        tokens = split(t)
        r = got[(i, len(tokens))]
        c = np.array([word.get(x, 0) for x in tokens])
        h = np.array([start if a == 0 else word.get(a, 0) for a in [0, *tokens[:-1]]])
        both = np.array([pair.get(x, 0) for x in zip([0, *tokens], tokens)])
        model = np.log10((both + ngram_lm.MU * corpus.word(c)) / (h + ngram_lm.MU))
        assert (r["train_tokens"], r["n_known"]) == (n, int((c > 0).sum()))
        assert math.isclose(r["base_score"], float(np.log10((c + 0.5) / (n + 0.5 * (v + 1))).sum()), rel_tol=1e-9)
        assert abs(r["score"] - model.sum()) <= 0.03 * len(tokens)
    # The classes' probabilities add up to one.
    assert math.isclose(float(corpus.word(np.array(list(word.values()))).sum() + corpus.word(np.array([0]))[0]), 1.0, rel_tol=1e-9)


def test_frequent_contexts_keep_their_counts():
    """Pairs whose context has far more than 2 ** (255 / 12) occurrences in all blocks."""
    word, count, size = np.array([10, 20, 30], dtype=np.uint64), np.array([120_000_000, 40_000, 2_000_000_000]), [400]
    corpus = ngram_lm.Corpus(4_000_000_000, 3, 0, 0)
    stream = np.array([0, 1, 2, 1] * 100)
    row = {"block": 0, "doc_id": [1], "train": [True], "size": size, "stream": stream.astype("<u4").tobytes(), "words": ngram_lm._pack_sorted(word), "answers": [{"shard": 0, "answer": ngram_lm._narrow(count)}]}
    blocks = lambda r: pa.RecordBatch.from_pylist([r])
    asked = list(ngram_lm._ask_pairs(1, 1, corpus, 5_000_000)(iter([blocks(row)])))
    answers = [a for b in ngram_lm._answer_pairs(ngram_lm.MU, False)(iter(asked)) for a in b.to_pylist()]
    pair_answers = [{"shard": a["shard"], "answer": a["answer"]} for a in answers]
    got = next(ngram_lm._score(1, 1, corpus, 5_000_000)(iter([blocks(row | {"pair_answers": pair_answers})]))).to_pylist()[0]["score"]
    before = np.append(3, stream[:-1])
    h = np.append(count, 5_000_000)[before]
    both = np.array([np.count_nonzero((before == a) & (stream == b)) for a, b in zip(before, stream)])
    exact = np.log10((both + ngram_lm.MU * corpus.word(count)[stream]) / (h + ngram_lm.MU)).sum()
    assert abs(got - exact) <= 0.03 * len(stream)


def test_hashes_depend_on_the_word_alone():
    words = [bytes([33 + (i * j) % 90 for j in range(n)]) for i, n in enumerate([0, 1, 2, 63, 64, 65, 66, 130, 5000, 5001] * 7)]
    together = text.hashes(pa.array(words, pa.large_binary()))
    assert all(text.hashes(pa.array([w], pa.large_binary()))[0] == h for w, h in zip(words, together))
    assert len(set(together.tolist())) == len(set(words))


def test_mixing(docs, labels):
    mixer = mixing.fit(docs, labels)
    rows = mixing.apply(docs, mixer).select("doc_id", "n_tokens", "posterior", "rate", "copies").collect()
    assert len(rows) == docs.count()
    n, x, p = np.array([r["n_tokens"] for r in rows]), np.array([r["rate"] for r in rows]), np.array([r["posterior"] for r in rows])
    goal = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    assert (x >= 0).all() and np.allclose(p.sum(axis=1), 1)
    assert np.abs((n * x) @ p / n.sum() - goal).max() < 1e-3
    assert all(r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1) for r in rows)


def _least_squares(n, p, goal):
    """Nonnegative least squares of domain totals, by accelerated projected gradients from rates of 1."""
    a, x = (p * n[:, None]).T, np.ones(len(n))
    y, pace, t = x, 1 / np.linalg.norm(a, 2) ** 2, 1.0
    for _ in range(5000):
        z = np.maximum(0, y - pace * (a.T @ (a @ y - goal)))
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = z, z + (t - 1) / following * (z - x), following
    return x


@pytest.mark.parametrize("shares, reachable", [((0.4, 0.3, 0.2, 0.1), True), ((0.7, 0.1, 0.1, 0.1), True), ((0.97, 0.01, 0.01, 0.01), True), ((1.0, 0.0, 0.0, 0.0), False)])
def test_descent_against_least_squares(docs, shares, reachable):
    """Reachable targets are met as brute-force least squares meets them, zero rates and all; of others the misfit is told."""
    rng = np.random.default_rng(0)
    q, n = rng.dirichlet([0.2] * 4, 300), rng.integers(1, 50, 300)
    frame = docs.sparkSession.createDataFrame([(int(k), v.tolist()) for k, v in zip(n, q)], "n_tokens bigint, posterior array<double>")
    steps = mixing.descend(frame, dict(zip(mixing.DOMAINS, shares)))
    rates, goal = mixing.Mixer([], steps).rates(q), np.array(shares) * n.sum()
    brute = _least_squares(n.astype(float), q, goal)
    off = lambda x: np.abs((n * x) @ q - goal).sum() / n.sum()
    assert (rates >= 0).all() and math.isclose(off(rates), steps.misfit, abs_tol=1e-9)
    if reachable:
        assert off(rates) < mixing.ENOUGH and off(brute) < 10 * mixing.ENOUGH
    else:
        assert 0 < off(brute) < off(rates) and steps.misfit > mixing.ENOUGH and (rates == 0).any()
    assert shares[0] < 0.97 or (rates == 0).any()


@pytest.mark.parametrize("name", ["op1_noisy_channel_toxicity", "op2_elias_fano_lm", "op4_bigru_language", "op5_soft_mixing", "op6_tokeniser_fertility", "op8_nb_svm"])
def test_query_returns_every_document(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and df.columns[0] == "doc_id"


def test_tokens_with_several_readings():
    """Marks that stand for letters without any letter beside them, doubled letters, and odd fillers; no token is cut."""
    counts = np.zeros(deobfuscate.SYMBOLS**deobfuscate.ORDER)
    np.add.at(counts, deobfuscate._char_grams(pa.array([b"ass", b"kill", b"stupid", b"idiot", b"slut", b"hole"] * 200, pa.large_binary())), 1)
    restorer = deobfuscate.Restorer(deobfuscate.char_model(counts))
    for word, tokens in {"ass": ("a55", "@$$", "a$$"), "kill": ("ki11", "k111"), "stupid": ("stuupid",), "idiot": ("id#iot", "id%iot", "i#d#i#o#t"), "slut": ("$1ut",)}.items():
        for token in tokens:
            assert word in _restored(restorer, f"you {token} there"), token
    assert _restored(restorer, "3.14 1,000 2026") == {"3.14", "1,000", "2026"}
    long = "1d10t" * 700
    assert deobfuscate.decode(long, restorer.model).count("idiot") > 650


def test_hinge_loss_is_least():
    """Dual coordinate descent against a brute-force projected gradient of the same dual."""
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(12, rng.integers(1, 7), replace=False)) for _ in range(30)]
    ratio, scale = rng.normal(size=12), np.array([1 / np.sqrt(len(r)) for r in rows])
    y = np.where(rng.random(30) < 0.5, 1.0, -1.0)
    upper = np.full(30, 0.7)
    x = np.zeros((30, 12))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] * scale[i]
    primal = lambda w: 0.5 * w @ w + (upper * np.maximum(0, 1 - y * (x @ w))).sum()
    g = (x * y[:, None]) @ (x * y[:, None]).T
    dual, step = np.zeros(30), 1 / np.linalg.eigvalsh(g)[-1]
    for _ in range(100_000):
        dual = np.clip(dual - step * (g @ dual - 1), 0, upper)
    w = nbsvm.descend(rows, ratio, scale, y, upper)
    assert primal(w) <= primal((x * y[:, None]).T @ dual) * (1 + 1e-2)


def test_gru_reads_long_words_whole():
    """Pieces longer than a pass are cut between characters; shorter ones aren't cut, and order doesn't matter."""
    words = pa.array([("é" * 300).encode(), b"short", ("漢" * 100).encode(), b"", b"x" * 256], pa.large_binary())
    pieces, length, word = gru._pieces(words)
    assert [int(length[word == i].sum()) for i in range(5)] == [600, 5, 300, 0, 256] and (word == 4).sum() == 1
    for p, n in zip(pieces, length):
        bytes(p[:n]).decode()
    net = gru.Network(["a", "b"])
    one = np.concatenate([net.words(words.slice(i, 1)) for i in range(5)])
    assert np.allclose(one, net.words(words), atol=1e-3)


def test_every_language_is_learned(spark):
    """More languages than any fixed number, some in one document only."""
    rows = [(i, f"word{i % 70}a word{i % 70}b word{i % 70}c", f"l{i % 70}") for i in range(100)]
    net = gru.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    assert len(net.languages) == 70


def test_columns_that_clash_by_case(spark, docs, labels):
    own = docs.limit(20).drop("score").withColumns({"Score": F.lit("x"), "N_Words": F.lit(1), "SPANS": F.lit(2), "__ID": F.lit(3), "N_Lines": F.lit(4)})
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {c.lower() for c in nbsvm.score(own, nbsvm.fit(own, none)).columns} >= {"score", "n_words"}
    assert nbsvm.score(own, nbsvm.fit(own, none)).select("score").schema[0].dataType.typeName() == "double"
    kept = native_lines.apply_bitmaps(own, native_lines.keep_bitmaps(own))
    assert kept.select("n_lines").schema[0].dataType.typeName() == "long" and kept.where("__ID = 3").count() == 20
    assert fm_index.scan(own, spark.createDataFrame([(1, "a b")], "item_id bigint, text string")).select("spans").count() == 20
    assert fertility.measure(own).select("n_words").count() == 20


def test_no_table_is_left(spark, sf_dir):
    ngram_lm.score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("marlstone")]


def test_empty_tables_of_learned_operators(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert deobfuscate.score(docs, deobfuscate.fit(docs, none)).count() == nbsvm.score(docs, nbsvm.fit(docs, none)).count() == 0
    assert gru.predict(docs, gru.fit(docs)).count() == mixing.apply(docs, mixing.fit(docs, none)).count() == 0
