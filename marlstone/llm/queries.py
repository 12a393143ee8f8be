"""The registered queries of the training-data operators: thin, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import collocations, deobfuscate, fertility, fm_index, group_join, gru, labelled, mixing, native_lines, nbsvm, ngram_lm, spotsigs, vector_codes, warc


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    kept = native_lines.apply_bitmaps(docs, native_lines.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op1_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    scored = deobfuscate.score(docs, deobfuscate.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep_text=False)
    return scored.select("doc_id", (labelled.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngram_lm.score(_docs(spark, sf_dir).select("doc_id", "text"))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_group_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_join.similar_groups(_docs(spark, sf_dir).select("doc_id", "text"))


def op4_bigru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    found = gru.predict(docs.select("doc_id", "text"), gru.fit(docs), keep_text=False)
    return found.select("doc_id", (labelled.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    rated = mixing.apply(docs, mixing.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep_text=False)
    shares = [F.get("posterior", F.lit(k)).alias(mixing.domain_name(d)) for k, d in enumerate(mixing.DOMAINS)]
    return rated.select("doc_id", "n_tokens", *shares, "rate", "copies")


def op6_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = fertility.measure(_docs(spark, sf_dir).select("doc_id", "text", "lang"), keep_text=False)
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return measured.select(*base, "n_tokens", "chars_per_token", "byte_fallback_share", "token_entropy", "script")


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    page = F.when(F.col("page") != "-", F.col("page")).cast("bigint").alias("page_id")
    return back.select(page, "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


def op8_nb_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    scored = nbsvm.score(docs, nbsvm.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep_text=False)
    return scored.select("doc_id", (labelled.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_index.scan(_docs(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), fm_index.contaminated().alias("contaminated"))


def op11_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op12_pair_naming_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_docs(spark, sf_dir).select("text", "lang")).drop("cut")


def op13_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compared_with_next(_docs(spark, sf_dir).select("doc_id", "text"), keep_text=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_noisy_channel_toxicity": op1_noisy_channel_toxicity,
    "op2_elias_fano_lm": op2_elias_fano_lm,
    "op3_group_jaccard_join": op3_group_jaccard_join,
    "op4_bigru_language": op4_bigru_language,
    "op5_soft_mixing": op5_soft_mixing,
    "op6_tokeniser_fertility": op6_tokeniser_fertility,
    "op7_warc_index": op7_warc_index,
    "op8_nb_svm": op8_nb_svm,
    "op10_fm_decontamination": op10_fm_decontamination,
    "op9_line_dedup": op9_line_dedup,
    "op11_annular_codes": op11_annular_codes,
    "op12_pair_naming_collocations": op12_pair_naming_collocations,
    "op13_spotsigs": op13_spotsigs,
}
