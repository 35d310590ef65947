"""A training-data pipeline over ``documents``: five stages, each one operator of ``admeter.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.  A table
has no order that survives writing and reading, so the mixing stage adds each row's place in the mix, ``mix_slot``, and
``in_mix``, whether the weights hold there; the last stage carries both to the result.

Fixed meaning of edge cases: null and empty texts have no words and go in the first stage, as do all texts below its base
rules; documents without an id are no one's near duplicate and stay; of rows that share an id and a text, all stay but are
cut by the third stage where they share 35 words; null languages and sources are groups of their own; an empty table
gives an empty result; further columns of ``documents``, whatever their names, come through the first four stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admeter.llm import byte_bpe, jaccard_join, mixing, quality_rules, substring_dedup
from admeter.llm.common import saved

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's cutoffs."""
    return quality_rules.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by five-word shingles at 0.8."""
    return jaccard_join.deduplicated(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words or more that stand elsewhere too; ``n_chars`` follows."""
    return substring_dedup.removed(docs.drop("n_chars")).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mix, sources weighted by the square root of their size."""
    return mixing.mixed_order(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text by the byte-level BPE ranks, the sha256 of the bytes that they decode to, and its place in the mix."""
    places = [c for c in ("mix_slot", "in_mix") if c in docs.columns]
    file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encode(docs, file, public_tokenizers.PATTERN)
    back = byte_bpe.decode(ids, file, public_tokenizers.PATTERN)
    return back.select("doc_id", "lang", "source", *places, F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", mixture),
    ("byte_bpe", token_ids),
]

#: SQL can't express the encoding, nor the dedup in useful time.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
