"""Registered queries of the training-text operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat_format, decontaminate, divergence, language_id, license_scan, ngram_jaccard, oracles, packing, pii, quality_classifier, quality_rules, simhash, substring_dedup, vector_codes
from .features import id_crc
from .shared import prepare, table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    ruled, rules = quality_rules.quality_rules(docs, trusted)
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return ruled.select("doc_id", *[F.col(rules)[f].alias(f) for f in fields])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, leak = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", f"{leak}.*").select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.col("longest").cast("long").alias("longest_match"),
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored, score = quality_classifier.score_quality(docs, model)
    return scored.select(
        "doc_id",
        (id_crc(F.col("doc_id")) % 5 == 0).alias("held_out"),
        F.col(score).alias("score"),
        (F.col(score) >= quality_classifier.THRESHOLD).cast("int").alias("predicted"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name, _ = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, spans = F.col(name)["base"], F.col(name)["spans"]
    counts = [pii.count_kind(base, k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(base).cast("binary"), 256).alias("base_sha256"), pii.span_text(spans).alias("spans"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit_languages(docs)
    found, name = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (id_crc(F.col("doc_id")) % 3 == 1).alias("held_out"), F.col(name)["lang"].alias("lang_pred"), F.col(name)["score"].alias("score"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.link_quotes(table(spark, sf_dir, "conversations"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_equal")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, _, books = vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_license_scan": op2_license_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_decontamination": op4_decontamination,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_packing": op6_packing,
    "op7_pii": op7_pii,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language_id": op9_language_id,
    "op10_chat_format": op10_chat_format,
    "op11_simhash": op11_simhash,
    "op12_vector_codes": op12_vector_codes,
    "op13_source_divergence": op13_source_divergence,
}

#: SQL where it can express the query and still run on whole tables.
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": oracles.NGRAM_JACCARD,
    "op4_decontamination": oracles.DECONTAMINATION,
    "op8_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op10_chat_format": oracles.CHAT_FORMAT,
    "op12_vector_codes": oracles.VECTOR_CODES,
    "op13_source_divergence": oracles.SOURCE_DIVERGENCE,
}
