"""Operators whose results brute force or SQL gives too, over small rows of every awkward kind."""

import hashlib
import re

import numpy as np
import pytest
from conftest import cells

from marlstone.llm import fertility, fm_index, group_join, native_lines, ngram_lm, warc
from marlstone.llm.oracles import ORACLES
from marlstone.llm.queries import QUERIES
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
LONG = "This line is long enough to be a key of its own, surely"
COMMON = [(i, f"start {i}\n  {LONG} \n{'x' * i}") for i in range(1, 8)]
ODD = [(100, None), (101, ""), (102, "\n\n"), (103, LONG.upper()), (103, LONG.upper()), (None, LONG), (104, "w" * 50000 + "\n" + LONG), (105, "é" * 45), (106, f"{LONG}\n{LONG}\n{LONG}")]


def _lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


@pytest.mark.parametrize("name", ["op3_group_jaccard_join", "op7_warc_index", "op9_line_dedup", "op10_fm_decontamination"])
def test_query_equals_sql(spark, sf_dir, duck, name):
    df, answer = QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(answer.columns)
    assert cells(df.collect(), df.columns) == cells(answer.fetchall(), answer.columns)


def test_lines(spark):
    rows = COMMON + ODD
    docs = spark.createDataFrame([(i, t, 5, "k") for i, t in rows], "doc_id bigint, text string, n_lines int, salt string").repartition(3)
    out = native_lines.apply_bitmaps(docs, native_lines.keep_bitmaps(docs)).collect()
    holders = {}
    for i, t in rows:
        for k in {_lower(x.strip(SPACE)) for x in (t or "").split("\n")}:
            if i is not None and len(k) >= 40:
                holders.setdefault(k, []).append(i)
    top = {k: max(v) for k, v in holders.items() if len(v) >= 5}

    def expect(i, t):
        kept = [x for x in (t or "").split("\n") if i is None or top.get(_lower(x.strip(SPACE)), i) <= i]
        n = len((t or "").split("\n"))
        return i, "\n".join(kept) if t is not None else None, n, n - len(kept)

    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out), key=str)
    assert got == sorted((expect(i, t) for i, t in rows), key=str)
    assert set(out[0].asDict()) == {"doc_id", "text", "salt", "n_lines", "n_dropped"}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert native_lines.apply_bitmaps(docs, native_lines.keep_bitmaps(docs)).count() == 0
    assert group_join.similar_groups(docs).count() == 0
    assert fm_index.scan(docs, spark.createDataFrame([], "item_id bigint, text string")).count() == 0
    assert fertility.measure(docs).count() == 0
    assert ngram_lm.score(docs).count() == 0
    assert warc.archived(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def _shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", _lower(t or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_components(spark):
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, None) for i in (0, 1)] + [(2, ""), (3, "one two"), (4, "ONE two "), (5, "one two three"), (6, " \n\t")]
    for family in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([8, 30, 80, 200]))]
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((1000 - len(rows), " ".join(copy)))
    rows += [rows[-1], (None, rows[-1][1]), (7000, "z" * 100000 + " b c d e f")]
    docs = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], "doc_id bigint, text string, n int, node int").repartition(4)
    sets = [_shingles(t) for _, t in rows]
    reach = list(range(len(rows)))

    def find(x):
        while reach[x] != x:
            x = reach[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                reach[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    expected = sorted(((i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)
    got = sorted((tuple(r) for r in group_join.similar_groups(docs).collect()), key=str)
    assert got == expected
    kept = {r["doc_id"] for r in group_join.one_of_each(docs).collect()}
    assert kept == {c for _, _, c in expected if c is not None} | {None}


def _hits(t, items, size=13):
    split = lambda s: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", _lower(s or ""))
    w, hit, found = split(t), set(), set()
    for name, body in items:
        b = split(body)
        n = min(size, len(b))
        windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block, shard", [(1 << 20, 1 << 20), (30, 1 << 20), (1 << 20, 40)])
def test_fm_index(spark, block, shard):
    item = " ".join(f"a{i}" for i in range(20))
    items = [(7, item), (12, "short one"), (30, None), (31, ""), (32, "a0 a1, A2"), (33, "the the the"), (None, "never"), (12, "second text of twelve")]
    rows = [(1, f"x {item} y"), (2, item.upper() + " " + item), (3, None), (4, ""), (5, "Short-One!"), (6, "the the the the"), (7, " ".join(f"a{i}" for i in range(3, 17))), (7, "second text of twelve"), (8, "q " * 20000 + item), (None, item), (9, "never")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, spans int").repartition(2)
    out = fm_index.scan(docs, spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block, shard_bytes=shard).collect()
    named = [(n, t) for n, t in items if n is not None]
    expected = sorted(((i, *_hits(t, named)) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in out), key=str) == expected
    assert all(sum(s["last"] - s["first"] + 1 for s in r["spans"]) == r["n_hit"] for r in out)


@pytest.mark.parametrize("n, symbols", [(0, 1), (1, 1), (300, 1), (400, 2), (2000, 50), (2000, 100_000)])
def test_fm_index_finds_every_place(n, symbols):
    sequence = np.random.default_rng(n + symbols).integers(1, symbols + 1, n)
    ended = np.append(sequence, 0)
    assert fm_index.suffix_array(ended).tolist() == sorted(range(n + 1), key=lambda i: ended[i:].tolist())
    index = fm_index.FmIndex(sequence, symbols + 1)
    patterns = np.array([sequence[i : i + 3] for i in range(0, n - 3, 7)] + [[1, 1, 1]])
    for pattern, low, high in zip(patterns, *index.search(patterns)):
        places = [i for i in range(n - 2) if (sequence[i : i + 3] == pattern).all()]
        assert sorted(index.locate(np.arange(low, high)).tolist()) == places


def test_rules(spark):
    words = "the quick brown fox jumps over a lazy dog while seven bright stars shine above quiet northern lakes and people walk home slowly"
    rows = [(1, words), (2, None), (3, ""), (4, "a b c d e f g h " * 5), (5, "line one\nline one\n \n \nline one x"), (6, "#*$%&|<> é 漢字 x"), (6, "#*$%&|<> é 漢字 x"), (7, "y" * 30000), (8, words + " " + words)]
    docs = spark.createDataFrame([(i, t, "xx", 1) for i, t in rows], "doc_id bigint, text string, lang string, kept int")
    got = {(r["doc_id"], r["text"]): r for r in fertility.measure(docs).collect()}
    assert fertility.measure(docs).count() == len(rows)
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", t or "") if x]
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        repeat = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if x.strip(SPACE)]
        r = got[(i, t)]
        failed = len(w) < 20 or 100 * len(repeat) > 30 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeat), failed)
        assert not (r["kept"] and failed)
    assert got[(1, words)]["kept"]


def test_fertility_band_rejects(spark):
    glyphs = " ".join(chr(0x12000 + i) * 3 for i in range(60))
    docs = spark.createDataFrame([(1, glyphs), (2, "ab " * 4 + " ".join(f"w{i}" for i in range(30)))], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in fertility.measure(docs, bands=fertility.BANDS | {"other": fertility.Band(max_fallback=0.5)}, lang_col=None).collect()}
    assert rows[1]["byte_fallback_share"] > 0.5 and not rows[1]["base_failed"] and not rows[1]["kept"] and rows[2]["kept"]


def test_production_bands_decide(spark):
    """Documents labelled junk that the base rules pass lie outside the bands; those labelled clean lie inside."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = fertility.measure(docs.select("doc_id", "text", "lang")).where("not base_failed and n_tokens >= 100").join(labels, "doc_id").select("quality", "kept").collect()
    clean, junk = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert len(junk) >= 10 and sum(junk) <= 0.2 * len(junk) and sum(clean) >= 0.99 * len(clean)


def test_warc_round_trip(spark):
    big = "<p>é" + "x" * 1200
    rows = [(1, "http://www.b.example.com/a?q=1#f", big), (2, "https://c.example.org", big), (5, "http://b.example.com:80/a?q=1", big), (3, None, None), (None, "odd url\nwith break", big), (7, "x", ""), (8, "http://b.example.com/", "small"), (9, "http://b.example.com/", "small"), (5, "http://b.example.com:80/a?q=1", big)]
    pages = spark.createDataFrame([(i, u, h, "k") for i, u, h in rows], "page_id bigint, url string, html string, key string").repartition(3)
    got = sorted(((r["page"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archived(pages).collect()), key=str)

    def expect(i, _, h):
        b = (h or "").encode()
        again = h == big and i is not None and i < 5
        return "-" if i is None else str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", "5" if again else None

    assert got == sorted((expect(*r) for r in rows), key=str)


def test_capture_index_blocks(spark, tmp_path, monkeypatch):
    """Keys that run over blocks and parts, and keys that aren't there."""
    pages = spark.createDataFrame([(i % 900, f"http://h{i % 7}.example.com/{i % 900}", f"body {i}") for i in range(1000)], "page_id bigint, url string, html string")
    parts = warc.write(pages, f"file://{tmp_path}/w").persist()
    keys = warc.capture_keys(pages)
    assert warc.look_up(parts, keys).count() == 1000
    assert warc.look_up(parts, keys.select(F.concat("key", F.lit("~")).alias("key"))).count() == 0
    parts.unpersist()


def test_url_keys(spark):
    cases = {"http://WWW.Example.com/A?b": "com,example)/A?b", "https://u@a.b.org:8080/x#y": "org,b,a)/x", "": "", "no scheme": "no%20scheme"}
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", warc.url_key(F.col("u")).alias("k"))
    assert {r["u"]: r["k"] for r in df.collect()} == cases


def test_tokens_against_brute_force(spark):
    """Tokens, characters a token, byte share and entropy, word by word with the tokeniser itself."""
    import math

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=fertility.VOCABULARY)
    texts = ["the quick brown fox the quick", "", None, "naïve 漢字 𓀀𓀁 x", "Ünï cödé  words\n\nand lines", "a" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in fertility.measure(docs, lang_col=None).collect()}
    for i, t in enumerate(texts):
        words = [x for x in re.split(r"[\x20\x09-\x0d]+", t or "") if x]
        tokens = [k for w in words for k in model.encode(w)]
        share = [tokens.count(k) / len(tokens) for k in set(tokens)]
        r = got[i]
        assert r["n_tokens"] == len(tokens)
        assert math.isclose(r["chars_per_token"], sum(map(len, words)) / max(1, len(tokens)), rel_tol=1e-12)
        assert math.isclose(r["byte_fallback_share"], sum(model.IsByte(k) for k in tokens) / max(1, len(tokens)), rel_tol=1e-12)
        assert math.isclose(r["token_entropy"], -sum(p * math.log2(p) for p in share), rel_tol=1e-9, abs_tol=1e-9)
