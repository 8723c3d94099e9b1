"""Documents, tokens, vocabulary, n-grams and TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinloom.functions.cleaning import clean_text, document
from opinloom.functions.tokens import ngram_range, ngrams, words
from opinloom.operators import terms
from opinloom.operators.features import exact_vectors
from opinloom.queries.registry import LABELLED_SQL, documents, labelled, query
from opinloom.sources.tables import table

SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def clean_sql(text: str) -> str:
    return f"trim(regexp_replace(coalesce({text}, ''), '{SPACE}+', ' ', 'g'))"


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def tf_sql(source: str, name: str = "tf") -> str:
    return f"""{name} AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (
      SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM {source}) GROUP BY ALL)"""


def idf_sql(source: str) -> str:
    return f"""n AS (SELECT count(*) AS n FROM {source}),
    idf AS MATERIALIZED (SELECT term, count(*) AS df, ln((1 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term)"""


_WEIGHTS = """norm AS MATERIALIZED (SELECT doc_id, sqrt(sum(power(tf * idf, 2))) AS norm FROM tf JOIN idf USING (term) GROUP BY doc_id),
weights AS (SELECT doc_id, term, tf, idf, tf * idf / norm AS weight FROM tf JOIN idf USING (term) JOIN norm USING (doc_id))"""


@query(
    f"""SELECT d.doc_id, concat_ws(' ', nullif({strip_sql('text')}, ''), nullif({strip_sql("' ' || lang")}, ''),
      CAST(l.quality AS VARCHAR), nullif({strip_sql("source || chr(160)")}, '')) AS document
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def doc_concat(spark: SparkSession, folder: str) -> DataFrame:
    """Several text columns as one document; blank and missing parts leave no gap."""
    docs = documents(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left")
    parts = (
        F.col("text"), F.concat(F.lit(" "), "lang"), F.col("quality").cast("string"), F.lit("\t "),
        F.concat("source", F.lit(" ")),
    )
    return docs.select("doc_id", document(*parts).alias("document"))


@query(f"WITH {tf_sql('documents')} SELECT doc_id, term, tf FROM tf")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return terms.term_counts(documents(spark, folder), "doc_id", words(F.col("text")))


@query(
    f"""WITH {tf_sql('documents')}
    SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf, row_number() OVER (ORDER BY term) - 1 AS term_index
    FROM tf GROUP BY term"""
)
def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return terms.vocabulary(documents(spark, folder), words(F.col("text")))


@query(f"WITH {tf_sql('documents')}, {idf_sql('documents')} SELECT term, df, round(idf, 6) AS idf FROM idf")
def doc_freq_idf(spark: SparkSession, folder: str) -> DataFrame:
    idf = terms.inverse_document_frequency(documents(spark, folder), words(F.col("text")))
    return idf.withColumn("idf", F.round("idf", 6))


@query(
    f"""WITH {tf_sql('documents')}, {idf_sql('documents')}, {_WEIGHTS}
    SELECT doc_id, term, tf, round(idf, 6) AS idf, round(weight, 6) AS weight FROM weights"""
)
def tfidf_weights(spark: SparkSession, folder: str) -> DataFrame:
    weights = terms.tfidf(documents(spark, folder), "doc_id", words(F.col("text")))
    return weights.select("doc_id", "term", "tf", F.round("idf", 6).alias("idf"), F.round("weight", 6).alias("weight"))


@query(
    f"""WITH t AS (SELECT {tokens_sql('text')} AS w FROM documents)
    SELECT gram, count(*) AS n FROM (
      SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM t)
    GROUP BY gram"""
)
def bigram_counts(spark: SparkSession, folder: str) -> DataFrame:
    return terms.ngram_counts(documents(spark, folder), words(F.col("text")), 2)


@query(
    f"""WITH t AS (SELECT doc_id, {tokens_sql('text')} AS w FROM documents)
    SELECT doc_id, len(w) AS n_tokens, greatest(len(w) - 1, 0) AS n_bigrams, greatest(len(w) - 2, 0) AS n_trigrams,
      len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS n_grams,
      CASE WHEN len(w) > 2 THEN w[len(w) - 2] || ' ' || w[len(w) - 1] || ' ' || w[len(w)] END AS last_trigram
    FROM t"""
)
def ngram_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Number of 1-, 2- and 3-grams per document and its last trigram."""
    tokens = documents(spark, folder).select("doc_id", words(F.col("text")).alias("tokens"))
    grams = tokens.select(
        "doc_id", "tokens", ngrams(F.col("tokens"), 2).alias("two"), ngrams(F.col("tokens"), 3).alias("three"),
        ngram_range(F.col("tokens"), 1, 3).alias("all"),
    )
    return grams.select(
        "doc_id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.size("two").cast("bigint").alias("n_bigrams"),
        F.size("three").cast("bigint").alias("n_trigrams"),
        F.size("all").cast("bigint").alias("n_grams"),
        F.try_element_at("three", F.lit(-1)).alias("last_trigram"),
    )


@query(
    f"""WITH {LABELLED_SQL}, {tf_sql('labelled')}, {idf_sql('labelled')}, {_WEIGHTS},
    scored AS (SELECT polarity_label, term, round(sum(weight), 6) AS score
               FROM weights JOIN labelled USING (doc_id) GROUP BY ALL)
    SELECT polarity_label, CAST(rank AS INT) AS rank, term, score FROM (
      SELECT *, row_number() OVER (PARTITION BY polarity_label ORDER BY score DESC, term) AS rank FROM scored)
    WHERE rank <= 10"""
)
def top_terms_by_polarity(spark: SparkSession, folder: str) -> DataFrame:
    """Ten leading TF-IDF words of each polarity: join, clean, tokenise, weigh, rank."""
    tokens = words(clean_text(F.col("text")))
    weights = terms.tfidf(labelled(spark, folder), "doc_id", tokens, "polarity_label")
    return terms.top_terms(weights, "polarity_label")


def _unpacked(docs: DataFrame, weighting: str) -> DataFrame:
    """Vector entries with their index, the term's place in the alphabetical vocabulary."""
    vectors = exact_vectors(docs, "doc_id", "text", weighting)
    entries = F.arrays_zip(F.col("indices").alias("slot"), F.col("values").alias("value"))
    return vectors.select("doc_id", "size", F.inline(entries))


_SLOTS = """slots AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS slot, count(*) OVER () AS size
  FROM (SELECT DISTINCT term FROM tf))"""


@query(
    f"""WITH {tf_sql('documents')}, {_SLOTS}
    SELECT doc_id, size, slot, CAST(tf AS DOUBLE) AS value FROM tf JOIN slots USING (term)"""
)
def count_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Bag-of-words vectors, unpacked."""
    return _unpacked(documents(spark, folder).select("doc_id", "text"), "count")


@query(
    f"""WITH {LABELLED_SQL}, {tf_sql('labelled')}, {idf_sql('labelled')}, {_WEIGHTS}, {_SLOTS}
    SELECT doc_id, size, slot, round(weight, 6) AS value FROM weights JOIN slots USING (term)"""
)
def tfidf_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """TF-IDF vectors, unpacked."""
    docs = labelled(spark, folder).select("doc_id", "text")
    return _unpacked(docs, "tfidf").withColumn("value", F.round("value", 6))


@query(
    f"""WITH {LABELLED_SQL}, {tf_sql('labelled')}, {idf_sql('labelled')},
    {tf_sql('documents', 'tfall')},
    known AS (SELECT doc_id, term, tf * idf AS w FROM tfall JOIN idf USING (term)),
    norm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM known GROUP BY doc_id)
    SELECT doc_id, count(*) AS n_terms, round(sum(w / norm), 6) AS total FROM known JOIN norm USING (doc_id) GROUP BY doc_id"""
)
def apply_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Weigh all documents with the vocabulary of the labelled ones; unseen terms drop out."""
    tokens = words(F.col("text"))
    idf = terms.fit_idf(labelled(spark, folder), tokens)
    weights = terms.weigh(terms.term_counts(documents(spark, folder), "doc_id", tokens), idf, "doc_id")
    return weights.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("weight"), 6).alias("total")
    )
