"""One query for each corpus operator, over the whole of its table, and the SQL of those that SQL expresses."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import bpe_chunks, divergence, langid, mixing, near_dedup, pii, quality_crf, token_count, vafile, virtual_slots
from .shared import table


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file; ``TOKENIZER_DIR`` names another folder than the installed one."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_bottom_k_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(table(spark, sf_dir, "documents"), words=2)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual_slots.shard(table(spark, sf_dir, "documents"))


def op8_vafile_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.search(table(spark, sf_dir, "embeddings"))


def op9_bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.digests(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op10_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_line_crf": op2_line_crf,
    "op3_bottom_k_dedup": op3_bottom_k_dedup,
    "op4_language_id": op4_language_id,
    "op5_divergence_rules": op5_divergence_rules,
    "op6_token_counts": op6_token_counts,
    "op7_virtual_slots": op7_virtual_slots,
    "op8_vafile_topk": op8_vafile_topk,
    "op9_bpe_digests": op9_bpe_digests,
    "op10_weak_pii": op10_weak_pii,
}

ORACLES = {"op1_source_mix": mixing.REPORT_SQL, "op8_vafile_topk": vafile.SEARCH_SQL}
