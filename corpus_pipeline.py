"""A training-data pipeline of five corpus operators over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
result as Parquet in the shared folder and reads it again as the next stage's docs.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterglass.llm import bagminhash, exact_dedup, fertility, mixing, sentencepiece_codec
from meterglass.runtime import holding, keep_only, settled, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality rules reject."""
    return fertility.kept_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one stays."""
    return exact_dedup.kept_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, one document stays."""
    return bagminhash.kept_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the fitted mixture keeps; domains are learned from those of them that are labelled."""
    return mixing.mixed_documents(docs, docs, table(spark, sf_dir, "labels"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text."""
    return sentencepiece_codec.sentencepiece_encode(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("sentencepiece", encode)]

#: Tokenisation, learned posteriors and classes of near duplicates are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result; what earlier stages wrote goes once the next one's result is whole. The documents table is read by the first stage alone.

    Null and empty texts fall to the quality rules, as every text of less than 50 words does; rows that repeat, and rows
    without a doc_id, are judged by their texts, and one of equal ones stays; columns other than doc_id and text pass
    through unchanged, whatever their names; empty tables give an empty result, and without labels mixing keeps every document."""
    docs = table(spark, sf_dir, "documents")
    with holding() as own:
        for name, stage in STAGES[:-1]:
            docs = settled(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
            keep_only(docs, own)
        return STAGES[-1][1](spark, docs, sf_dir)
