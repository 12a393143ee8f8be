"""Line dedup in DataFrame operations only.

Keys of lines are hashed; hashes are range-partitioned with a secondary sort by document and
position, and a running window streams the first occurrence of each key over its later ones. What
comes out is a run-length bitmap of kept lines per document; text is touched again only where the
caller asks for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.store import Scratch

#: Characters stripped at both ends of a line.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts into which the lines of one key are dealt by document, so that no task gets a hot key whole.
SALTS = 64


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased and nothing else; texts of ASCII alone take the fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which lines of each document stay: rows (doc_id, text_key, n_lines, n_dropped, kept), one for each document.

    kept is the bitmap, compressed: the kept runs of lines in order, each by its first and last
    line (from 0). text_key is xxhash64 of the text and tells rows apart that share a doc_id; rows
    that share both are one row here.

    A line's key is the line stripped of ASCII white space at both ends with A-Z lower-cased. A key
    of min_chars code points or more that min_docs rows or more hold loses its lines in all rows
    but those of the largest doc_id. Null text is one empty line. Rows with a null doc_id are
    neither counted nor changed, and have no bitmap. Repeated rows count as documents of their own;
    those that share the largest doc_id all keep their lines. Keys are compared by two 64-bit
    hashes. Ids are whole numbers.

    Texts are split and hashed once, into a table in the shared folder that stays there while the
    result is read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    stripped = F.transform(F.col("lines"), lambda x: F.btrim(x, F.lit(STRIPPED)))
    at = F.transform(stripped, lambda x, i: F.struct(i.alias("pos"), x.alias("key")))
    long = F.filter(at, lambda x: F.char_length(x["key"]) >= min_chars)
    hashed = F.transform(long, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(lower_ascii(x["key"])).alias("h1"), F.xxhash64(F.lit(min_docs), lower_ascii(x["key"])).alias("h2")))
    split = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.split(text, "\n", -1).alias("lines"))
    rows = Scratch(docs.sparkSession, "lines").write(split.select("doc_id", "text_key", F.size("lines").alias("n_lines"), hashed.alias("keys")), "hashed")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")

    distinct = F.array_distinct(F.transform("keys", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))
    parts = rows.select("doc_id", salt, F.inline(distinct)).groupBy("h1", "h2", "salt").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
    common = parts.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.collect_list("salt").alias("salts")).where(F.col("n") >= min_docs)
    none = F.lit(None)
    marks = common.select("h1", "h2", F.explode("salts").alias("salt"), "top", none.cast("bigint").alias("doc_id"), none.cast("bigint").alias("text_key"), none.cast("int").alias("pos"))
    lines = rows.select("doc_id", "text_key", salt, F.inline("keys")).select("h1", "h2", "salt", none.cast("bigint").alias("top"), "doc_id", "text_key", "pos")

    # The mark of a common key sorts before its lines; the window hands its top document down the stream.
    stream = marks.unionByName(lines).repartitionByRange("h1", "h2", "salt")
    along = Window.partitionBy("h1", "h2", "salt").orderBy(F.col("doc_id").desc_nulls_first(), F.col("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dropped = stream.withColumn("top", F.first("top").over(along)).where(F.col("doc_id") < F.col("top")).select("doc_id", "text_key", none.cast("int").alias("n_lines"), "pos")
    every = rows.select("doc_id", "text_key", "n_lines", none.cast("int").alias("pos"))
    each = every.unionByName(dropped).groupBy("doc_id", "text_key").agg(F.max("n_lines").alias("n_lines"), F.sort_array(F.collect_set("pos")).alias("pos"))
    return each.select("doc_id", "text_key", F.col("n_lines").cast("bigint").alias("n_lines"), F.size("pos").cast("bigint").alias("n_dropped"), _kept(F.col("pos"), F.col("n_lines")).alias("kept"))


def _kept(pos: Column, n: Column) -> Column:
    """Runs (first, last) of the n lines without those at the sorted positions."""
    edges = F.concat(F.array(F.lit(-1)), pos, F.array(n))
    gaps = F.zip_with(F.slice(edges, 1, F.size(pos) + 1), F.slice(edges, 2, F.size(pos) + 1), lambda a, b: F.struct((a + 1).alias("first"), (b - 1).alias("last")))
    return F.filter(gaps, lambda r: r["first"] <= r["last"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col rewritten to its kept lines, and n_lines and n_dropped (bigint) after its columns.

    Columns of docs by the names n_lines and n_dropped, upper and lower case alike, are replaced;
    no other column can clash. Null text stays null and has one line.
    """
    taken = {c.lower() for c in docs.columns}
    own_id, key, n, own_runs, own_lines = (next(x for x in (name + "_" * k for k in range(len(taken) + 1)) if x not in taken) for name in ("__id", "__key", "__n", "__runs", "__lines"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({own_id: F.col(id_col).cast("bigint"), key: F.xxhash64(text)})
    marks = bitmaps.select(F.col("doc_id").cast("bigint").alias(own_id), F.col("text_key").alias(key), F.col("n_dropped").alias(n), F.col("kept").alias(own_runs))
    joined = keyed.join(marks, [own_id, key], "left").withColumn(own_lines, F.split(text, "\n", -1))
    lines, runs = F.col(own_lines), F.col(own_runs)
    whole = F.coalesce(F.col(n), F.lit(0)) == 0
    parts = F.transform(runs, lambda r: F.slice(lines, r["first"] + 1, r["last"] - r["first"] + 1))
    out = F.when(whole, F.col(text_col)).otherwise(F.array_join(F.flatten(parts), "\n"))
    return joined.withColumns({text_col: out, "n_lines": F.size(lines).cast("bigint"), "n_dropped": F.coalesce(n, F.lit(0)).cast("bigint")}).select(
        *[c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")], "n_lines", "n_dropped"
    )
