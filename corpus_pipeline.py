"""The corpus pipeline: STAGES over documents, each stage written as Parquet and read again as the next one's input.

Quality rules reject documents, near-dedup keeps the first document of each group (five-word shingles, similarity 0.8),
substring dedup cuts passages of 50 words and more that an earlier document has, personal data gives way to
its kind in brackets, and packing turns the rest into token pieces, with their ids, placed in sequences. All stages but the last return
the columns of ``documents``, further columns of any name included; texts that change get their new length in ``n_chars``.

Defined results: a null, empty or blank text has no 50 words, so the quality rules reject it; where a later stage is
given one, it stays as it is and packs to the end token alone. Repeated rows are judged alike and stay or go together; a row without doc_id is
judged by the rules, never a duplicate of another, and packed like any other. An empty table stays empty.

ORACLE_SQL is None: the verdict of the rules, the field of the personal data and the packing have no SQL form; tests/llm checks
each stage by brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import neardup, packing, pii, quality_rules, substring
from gridloom.llm.shared import cut, read_table


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text passes the base rules and the likelihood ratio; no shuffle."""
    return quality_rules.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not near duplicates of a document with a smaller doc_id."""
    return neardup.keep_first(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; words of repeated passages are cut from the texts."""
    return _measured(substring.remove(docs))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; spans of personal data become their kind in brackets."""
    return _measured(pii.redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id and offset of every token piece."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
