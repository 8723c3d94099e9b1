"""From raw documents to token ids: five stages, each on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinloom.llm import factorisation, jaccard, mixing, naming, pieces
from opinloom.llm.shared import Work, documents, labels


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects; it learns from those of them that are labelled."""
    return factorisation.good_documents(docs, factorisation.fit(docs, labels(spark, sf_dir)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of identical texts."""
    return naming.distinct_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 in five-word n-grams."""
    return jaccard.one_of_each(docs, width=5, num=8, den=10)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text again."""
    shipped = pieces.ship(spark, public_tokenizers.path("piece_bpe_32k.model"))
    rows = pieces.encoded(docs.select("doc_id", "lang", "source", "text"), shipped, lossless=True)
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "lossless")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixed", mixed), ("tokens", tokens)]

# The classifier and the tokenizer have no SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again."""
    work = Work(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return docs
