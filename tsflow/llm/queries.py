"""Registered queries of this subpackage: thin wrappers that derive the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tsflow.llm import bpe, decontamination, license_scan, line_dedup, ngram_join, pii, quality_rules, simhash_dedup, spelling, suffix_dedup, token_counts, url_filters, whitening
from tsflow.llm.common import documents, tokenizer_path
from tsflow.llm.license_texts import TEMPLATES

TOKEN_LIMIT = 512
PII_KEY = "key of the query"  # a deployment passes its own secret


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = token_counts.token_counts(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    return got.withColumn("over_limit", got.n_tokens > TOKEN_LIMIT)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filters.judge_urls(pages, url_filters.RULES, url_filters.LISTED_LABELS)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir), PII_KEY)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir), TEMPLATES)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(documents(spark, sf_dir), min_docs=10, min_chars=1)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_groups(documents(spark, sf_dir), shingle=3, threshold=2)


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.leaks(documents(spark, sf_dir), benchmark)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeats(documents(spark, sf_dir), length=400)


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir), shingle=3, percent=90)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=8)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir), every=97, min_chars=5, min_count=3)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_url_filters": op2_url_filters,
    "op3_pii": op3_pii,
    "op4_license_scan": op4_license_scan,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_decontamination": op9_decontamination,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_ngram_join": op11_ngram_join,
    "op12_whitening": op12_whitening,
    "op13_spelling_variants": op13_spelling_variants,
}

#: DuckDB SQL; operators without an entry are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op2_url_filters": url_filters.SQL,
    "op5_line_dedup": line_dedup.SQL,
}
