"""A corpus pipeline out of the training-data operators.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
gives a DataFrame, which is written as Parquet and read again as the next one's
``docs``.  All stages but the last keep the columns of ``documents``.

Rows: the first stage drops every document whose text is null or has no letter, and
those that language ID rejects, so later stages see none; texts of any length count
whole; of repeated rows, and of documents that are near duplicates, the third stage
keeps the one of the least doc_id (null ids last); ties go as the operators'
docstrings say.  Extra columns are kept up to the last stage, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxquarry.llm import langid, line_dedup, packing, simhash
from voxquarry.llm.common import bounded_batches, release, staged, staged_so_far


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; learned from their own labelled folds."""
    return langid.confident(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones (five-word shingles, similarity 0.8)."""
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces, packed into sequences."""
    return packing.pack(packing.cut_documents(docs))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("best_fit_packing", pack),
]

#: The language model, fingerprints and tokenizers can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = staged_so_far(spark)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        # The stage before it, and what this one staged on its way, are read no more.
        release(spark, mark, but=docs)
    return docs
