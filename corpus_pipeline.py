"""The corpus pipeline: five stages, each working on all that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Between stages the documents are written as Parquet in the shared folder, so an
executor that is lost costs one stage's tasks at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import fertility, fm_index, group_join, mixing, native_lines
from marlstone.llm.store import Scratch


def _apart(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the used ones under private names, so that no operator's column meets one of them; and the way back."""
    private = {c: f"__own{i}" for i, c in enumerate(docs.columns) if c not in used}
    apart = docs.select(*[F.col(f"`{c}`").alias(private.get(c, c)) for c in docs.columns])
    return apart, lambda out: out.select(*[F.col(private.get(c, c)).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their fertility band go."""
    apart, back = _apart(docs, "doc_id", "text", "lang")
    return back(fertility.measure(apart).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common long lines go from all documents but the last that has them; n_chars follows."""
    apart, back = _apart(docs, "doc_id", "text", "n_chars")
    out = native_lines.apply_bitmaps(apart, native_lines.keep_bitmaps(apart))
    return back(out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    apart, back = _apart(docs, "doc_id", "text")
    return back(group_join.one_of_each(apart))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    apart, back = _apart(docs, "doc_id", "text")
    found = fm_index.scan(apart, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return back(found.where(~fm_index.contaminated()))


def mixing_rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the rate and the number of copies that bring domains to their target weights.

    n_tokens, rate and copies come last; columns of docs by those names, upper and lower case alike, give way to them.
    """
    mixer = mixing.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    added = ("n_tokens", "rate", "copies")
    kept = docs.drop(*[c for c in docs.columns if c.lower() in added])
    apart, _ = _apart(kept, "doc_id", "text")
    rated = mixing.apply(apart, mixer).select(*apart.columns, *added)
    return rated.toDF(*kept.columns, *added)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing_rates", mixing_rates),
]

#: The tokeniser verdict and the mixing classifier can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(keep=(name,))  # no later stage reads what came before
    return STAGES[-1][1](spark, docs, sf_dir)
