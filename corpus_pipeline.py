"""Corpus pipeline: classify, remove near duplicates, sanitise, mix and encode.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. ``run`` writes each
stage's result to the cluster's shared folder as Parquet, reads it back for the next, and deletes it when that one is written.

1. quality classifier  documents that are rejected go
2. n-gram join         one document of each class of near duplicates stays
3. PII                 personal data, secrets and disclosing terms are replaced in the text, n_chars follows
4. mixing              each document stands as often as the mix takes it (``taken`` words over its size,
                       rounded so that the schedule's share of a last, partial turn is kept or left whole); ``copy`` numbers its rows
5. piece dropout       doc_id, source and the ids of the text

Defined cases: an empty table goes through as an empty table; other columns of ``documents`` than COLUMNS are left out at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltmesh.llm import mixing, ngram_join, pii, piece_dropout, quality_classifier, queries
from voltmesh.llm.common import new_folder, remove_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier keeps. Null, empty and blank texts are rejected; rows with null or repeated ids are judged by their own texts."""
    return quality_classifier.quality_classifier(docs, table(spark, sf_dir, "labels")).where("keep").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class, its least doc_id (null ids last; of rows equal in id and text any one). Rows without words all stay."""
    return ngram_join.one_of_each(docs).select(*COLUMNS)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with clean texts. Null texts stay null, with a null n_chars; empty ones stay empty."""
    return pii.sanitise(docs, pii.disclosing_terms(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, up to 3 times. Rows without words stand once; a null source is a source of its own; rows with one id are rows of their own."""
    return mixing.mixed_documents(docs).select(*COLUMNS, "copy")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their ids: null for a null text, none for an empty one; copies of a row draw their own dropout."""
    return piece_dropout.encode(docs.select("doc_id", "source", "text", "copy"), queries.vocabulary("piece_bpe_32k.model")).select("doc_id", "source", "ids")


STAGES = [("quality classifier", classify), ("n-gram join", deduplicate), ("pii", sanitise), ("mixing", mix), ("piece dropout", encode)]

#: SQL cannot express the trained model, the hashed join or the merging; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES:
        path = new_folder(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove_folder(spark, before)
        before = path
    return docs
