"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, filter_audit, html_text, jaccard_join, lexical_search, license_scan, lm_scoring, mixing, packed_ids, quality_rules, rule_ensemble, substring_dedup, top_k
from .sql import FILTER_SQL, LICENSE_SQL, MIXING_SQL, QUALITY_SQL, SEARCH_SQL, TOP_K_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "bpe.*")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), k=4, percent=85)


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k.search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", "n_chars")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs.select("doc_id", "source", "text")).drop("text")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op11_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


QUERIES = {f.__name__: f for f in (
    op1_packed_ids, op2_substring_dedup, op3_byte_bpe, op4_jaccard_join, op5_top_k, op6_html_text, op7_lm_scoring, op8_mixing,
    op9_license_scan, op10_quality_rules, op11_rule_ensemble, op12_filter_audit, op13_lexical_search)}
ORACLES = {"op5_top_k": TOP_K_SQL, "op8_mixing": MIXING_SQL, "op9_license_scan": LICENSE_SQL, "op10_quality_rules": QUALITY_SQL,
           "op12_filter_audit": FILTER_SQL, "op13_lexical_search": SEARCH_SQL}
