"""SpotSigs fingerprints in DataFrame functions alone.

A spot is a common word, or a run of them, and the chain of content words that follows; the set of
a text's spots is its signature. Boilerplate has few common words and so few spots: what a
signature holds is running text. Sets are compared by Jaccard, and a partition by set length says
which sets can't be alike enough before any of them is opened.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.native_lines import lower_ascii

#: Common words that anchor a chain: articles, pronouns, prepositions and auxiliaries of four languages.
ANCHORS = tuple(
    """
    a an and are as at be been but by for from had has have he in is it its not of on or she that the their they this to was were which will with you
    aber als am auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im ist mit nicht sich sie sind und von war wie wir zu zum zur
    au aux avec ce cette dans de du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour qu que qui sa sans se ses son sont sur un une vous
    al como con cual del el ella ellos era esta este fue ha hay las lo los más muy no nos o para pero por se ser sin sobre su sus también una uno y ya
    """.split()
)
#: Content words of a chain.
CHAIN = 3
#: A run of letters, marks and digits; Han and kana characters with which a run begins are words by themselves.
WORD = r"\p{IsHan}|\p{IsHiragana}|\p{IsKatakana}|[\p{L}\p{M}\p{N}]+"
#: Hex digits of a spot in a fingerprint.
DIGITS = 8
#: Ranges of ids at most into which documents are dealt to find each one's next.
RANGES = 8192
_ANCHOR, _GLUE = "\x01", "\x02"  # words hold neither


def _free(columns: list[str], *names: str) -> list[str]:
    """Names like these that no column has, upper and lower case alike."""
    taken = {c.lower() for c in columns}
    return [next(x for x in (f"__{name}" + "_" * k for k in range(len(taken) + 1)) if x not in taken) for name in names]


def with_signature(df: DataFrame, text_col: str, out: str, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """df and `out`: the text's spots, distinct and sorted, each the first hex digits of its MD5.

    A-Z are lower-cased. A chain takes the `chain` content words after an anchor, fewer at the end
    of the text; anchors between them are left out, and anchors next to each other begin one chain.
    A text without an anchor before a content word has a chain from each of its content words; one
    without content words has itself as its only spot, so that equal texts alone are alike. Null is
    an empty text.
    """
    text, words, tokens, spots = _free([*df.columns, out], "text", "words", "tokens", "spots")
    found = F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(WORD), F.lit(0))
    marked = F.transform(F.col(words), lambda w: F.when(w.isin(*anchors), F.concat(F.lit(_ANCHOR), w)).otherwise(w))
    glued = F.regexp_replace(F.array_join(marked, " "), f"{_ANCHOR}([^ ]+) ", f"{_ANCHOR}$1{_GLUE}")  # each anchor sticks to the word after it
    bare = lambda t: F.substring_index(t, _GLUE, -1)
    content = F.filter(F.split(glued, " "), lambda t: (t != "") & ~bare(t).startswith(_ANCHOR))
    chained = F.transform(F.col(tokens), lambda t, i: F.concat_ws(" ", t, *[bare(F.get(F.col(tokens), i + k)) for k in range(1, chain)]))
    anchored = F.filter(F.col(spots), lambda s: s.startswith(_ANCHOR))
    kept = F.when(F.exists(F.col(spots), lambda s: s.startswith(_ANCHOR)), anchored).when(F.size(spots) > 0, F.col(spots)).otherwise(F.array(text))
    hashed = F.transform(kept, lambda s: F.substring(F.md5(s), 1, DIGITS))
    staged = df.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).withColumn(words, found).withColumn(tokens, content).withColumn(spots, chained)
    return staged.withColumn(out, F.sort_array(F.array_distinct(hashed))).drop(text, words, tokens, spots)


def fingerprint(signature: Column) -> Column:
    """The signature as a text: its spots in order, DIGITS hex digits each."""
    return F.array_join(signature, "")


def length_partition(signature: Column, least: float) -> Column:
    """The partition of a set by its length: sets with a Jaccard of `least` or more (below 1) lie in the same one or in neighbours."""
    return F.floor(F.log(F.greatest(F.size(signature), F.lit(1)).cast("double")) / F.lit(-math.log(least)) + 1e-9)


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """The Jaccard of two signatures, 0 where it's below `least`; sets whose lengths rule that out aren't opened. Null is like nothing."""
    short, long = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b)).cast("double")
    jaccard = both / (short + long - both)
    opened = F.when(jaccard >= least, jaccard).otherwise(0.0) if least else jaccard
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).when(long == 0, F.lit(1.0)).when(short < long * least, F.lit(0.0)).otherwise(opened)


def with_next(docs: DataFrame, carried: list[str], id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """docs and `next`: the columns `carried` of the next document by descending id, the first's after the last.

    Rows that share an id are in order of a hash of their text, then of the text. A row with a null
    id has no next (null) and is nobody's. The only document is its own next.

    Documents are dealt once, to ranges of ids with about as many rows each (8 for each shuffle
    partition, RANGES at most); the first of a range also goes, by a copy, to the end of the range
    before. Rows that share an id are put in order by one task.
    """
    spark = docs.sparkSession
    n = ranges or min(RANGES, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    own_id, target, copy, at, tie = _free([*docs.columns, "next"], "id", "target", "copy", "range", "tie")
    borders = docs.agg(F.percentile_approx(id_col, [k / n for k in range(1, n)], 10 * n)).first()[0] if n > 1 else None
    borders = sorted(set(borders or ()))
    steps = [1 << k for k in reversed(range(len(borders).bit_length()))]
    step = lambda found, s: F.when(F.get(F.lit(borders), found + s - 1) <= F.col(id_col), found + s).otherwise(found)
    place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step) if borders else F.lit(0)
    placed = docs.withColumn(at, F.when(F.col(id_col).isNull(), -1 - F.pmod(F.xxhash64(text_col), F.lit(n)).cast("int")).otherwise(place))

    first = placed.where(F.col(id_col).isNotNull()).groupBy(at).agg(F.max(id_col).alias(own_id))
    every = Window.orderBy(at)  # a row for each range
    before = F.coalesce(F.lead(at).over(every), F.min(at).over(Window.partitionBy()))
    heads = first.select(own_id, before.alias(target))
    copies = F.when(F.col(target).isNull(), F.array(F.struct(F.col(at), F.lit(0).alias(copy)))).otherwise(F.array(F.struct(F.col(at), F.lit(0).alias(copy)), F.struct(F.col(target).alias(at), F.lit(1).alias(copy))))
    both = placed.join(F.broadcast(heads), F.col(id_col) == F.col(own_id), "left").withColumn(target, copies).select(*docs.columns, F.inline(target)).withColumn(tie, F.xxhash64(text_col))
    along = Window.partitionBy(at).orderBy(F.col(copy), F.col(id_col).desc(), F.col(tie).desc(), F.col(text_col).desc())
    following = F.lead(F.struct(*carried)).over(along)
    return both.withColumn("next", following).where(F.col(copy) == 0).select(*docs.columns, F.when(F.col(id_col).isNotNull(), F.col("next")).alias("next"))


def compared_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next document's are.

    The edited text has its last third (floor of n_chars / 3 code points) replaced by as many of
    the next document's first code points, or by all if there are fewer (`with_next`). Rows
    (doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next), a row for
    each row of docs; null text is empty; keep_text=False leaves edited's SHA-256 in its place
    (edited_sha256). Without a next document (null id) the last third goes and near_next is 0.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spots = with_signature(rows, "text", "spots").withColumn("spots", F.array_join("spots", " "))  # a text takes less room on the way than an array
    paired = with_next(spots, ["text", "spots"]).withColumn("signature", F.split("spots", " "))
    sized = paired.withColumn("n_chars", F.char_length("text").cast("bigint")).withColumn("third", F.floor(F.col("n_chars") / 3).cast("int"))
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - F.col("third")), F.left(F.coalesce("next.text", F.lit("")), F.col("third")))
    both = with_signature(sized.withColumn("edited", edited).withColumn("next_signature", F.split("next.spots", " ")).drop("text", "next", "spots", "third"), "edited", "edited_signature")
    text = F.col("edited") if keep_text else F.sha2("edited", 256).alias("edited_sha256")
    own, other = F.col("signature"), F.col("edited_signature")
    return both.select("doc_id", "n_chars", text, fingerprint(own).alias("fingerprint"), fingerprint(other).alias("edited_fingerprint"), likeness(own, other).alias("near_edited"), likeness(own, F.col("next_signature")).alias("near_next"))
