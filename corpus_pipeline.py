"""A corpus pipeline: quality classifier, near-duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of ``documents``, and others that its input has; the last returns each row's ids and digests. What is planned between them goes through
written tables in the shared folder.

Cases: an empty table passes through all stages. A null text is an empty one: it is scored as one empty line, is no one's copy, holds no personal data,
and has no tokens; its row stays null until it is encoded. Rows with a null or repeated id are told apart by their texts. A null source is a source of its
own. A source without words has rate 0, so its documents go in the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sliceworks.llm import bpe_chunks, mixing, near_dedup, pii, quality_crf
from sliceworks.llm.queries import tokenizer_file
from sliceworks.llm.shared import stash, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go."""
    return quality_crf.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles) stays."""
    return near_dedup.keep_one(docs)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kinds' names."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, by their sources' rates."""
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded text."""
    return bpe_chunks.encode_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality), ("near_dedup", dedup), ("pii", redaction), ("source_mix", mixture), ("bpe", encoding)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
