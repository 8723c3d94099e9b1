"""Columns of the caller that are named like something inside an operator come through unharmed."""

import pytest
from pyspark.sql import functions as F

from opinloom.llm import factorisation, jaccard, mixing, naming, phrases, privacy, quotes, suffixes, toxicity, whitening
from opinloom.llm.shared import documents, labels

NAMES = """__row own_id own_key own_sha256 copy kept kept_id level name block vector probability rawPrediction prediction margin dense
x_capitals calibrated drawn source_key before bin whole row_key text_key email card phone ip terms __done stays single place runs items
words n_hit gram id component cells x path own quotes thread parts size taken rank score_x""".split()


def widened(df):
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES if n not in df.columns])


def unharmed(rows, replaced=()):
    assert rows
    assert all(r[n] == f"own {n}" for r in rows for n in NAMES if n not in replaced)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, "/root/testdata/sf0.001").limit(60).cache()


@pytest.mark.parametrize("operator", [
    naming.distinct_documents, jaccard.one_of_each, mixing.mixed_documents, privacy.sanitised,
    lambda d: suffixes.decontaminated(d, d.select(F.col("doc_id").alias("item_id"), "text").limit(2)),
])
def test_rows_come_through(docs, operator):
    found = operator(widened(docs))
    assert found.columns == widened(docs).columns
    unharmed(found.collect())
    plain = sorted(map(str, operator(docs).collect()))
    assert sorted(map(str, found.select(*docs.columns).collect())) == plain


def test_added_columns_replace_their_like(spark, docs):
    unharmed(mixing.mixture(widened(docs)).collect(), ("size", "whole"))
    unharmed(suffixes.overlaps(widened(docs), docs.select(F.col("doc_id").alias("item_id"), "text")).collect(), ("n_hit",))
    known = labels(spark, "/root/testdata/sf0.01")
    all_docs = documents(spark, "/root/testdata/sf0.01")
    unharmed(toxicity.scored(widened(docs), toxicity.fit(all_docs, known)).collect())
    unharmed(factorisation.scored(widened(docs), factorisation.fit(all_docs, known)).collect())
    talk = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").limit(30)
    unharmed(quotes.reply_ordered(widened(talk)).collect(), ("thread",))
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(30)
    unharmed(whitening.whitened(widened(vectors)).collect(), ("component",))
    assert phrases.collocations(widened(docs), least=20).columns[0] == "lang"
