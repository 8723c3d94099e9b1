"""Bag-of-words and TF-IDF as long tables.

``tokens`` is a token column or expression. Terms are counted within the row, so counting moves nothing. Document
frequencies need no grouping by document: each document contributes its distinct terms, so only ``term -> count``
partial sums are shuffled. TF-IDF reads the texts once, into a written table of counts by document; the norm needs the
rows of a document together, for which this compact table, not the text, is hashed by document. Where the fitted idf
table is too large to broadcast, the long rows meet it in a shuffled join, whose hot terms adaptive execution divides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinloom.operators.ordering import with_dense_ordinal
from opinloom.operators.sizing import cluster_by
from opinloom.session import written


def _bind(df: DataFrame, tokens: Column | str) -> DataFrame:
    return df.select((F.col(tokens) if isinstance(tokens, str) else tokens).alias("tokens"))


def counted_terms(df: DataFrame, doc: str, tokens: Column | str, *keep: str) -> DataFrame:
    """Each document with its distinct terms and their frequencies, as an array ``terms`` of (term, tf).

    Run lengths of the sorted tokens: linear after the sort, and no token is compared with all others.
    """
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    ordered = df.select(doc, *keep, F.sort_array(tokens).alias("tokens"))
    n, t = F.size("tokens"), F.col("tokens")
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(t, i - 1) != F.get(t, i - 2)))
    found = ordered.select(doc, *keep, "tokens", F.when(n > 0, starts).otherwise(F.array().cast("array<int>")).alias("starts"))
    begin = F.col("starts")
    run = lambda s, i: F.struct(
        F.get(t, s - 1).alias("term"), (F.coalesce(F.get(begin, i + 1), n + 1) - s).cast("long").alias("tf"))
    return found.select(doc, *keep, F.transform(begin, run).alias("terms"))


def term_counts(df: DataFrame, doc: str, tokens: Column | str, *keep: str) -> DataFrame:
    """Term frequency per document: ``doc, *keep, term, tf``; ``doc`` tells documents apart. No shuffle."""
    return _long(counted_terms(df, doc, tokens, *keep), doc, *keep)


def _long(counts: DataFrame, doc: str, *keep: str) -> DataFrame:
    """A row for each counted term.

    The outer form, since for the inner one Spark first filters on the size of the array and computes it twice.
    """
    return counts.select(doc, *keep, F.inline_outer("terms")).where(F.col("term").isNotNull())


def document_frequency(df: DataFrame, tokens: Column | str) -> DataFrame:
    """Number of documents each term occurs in: ``term, df``."""
    return (
        df.select(F.explode(F.array_distinct(tokens)).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def vocabulary(df: DataFrame, tokens: Column | str) -> DataFrame:
    """Every term with its frequencies and its alphabetical index: ``term, df, tf, term_index``.

    Distinct terms and all terms of a document are exploded as one list; the position tells them
    apart, so both frequencies come from one partial aggregation.
    """
    once = F.array_distinct("tokens")
    # Both bound below the generator: there they are computed once per document, not per term.
    bound = _bind(df, tokens).select("tokens", F.size(once).alias("n_distinct"))
    listed = bound.select("n_distinct", F.posexplode_outer(F.concat(once, "tokens")).alias("pos", "term"))
    terms = (
        listed.where(F.col("term").isNotNull())
        .groupBy("term")
        .agg(
            F.count_if(F.col("pos") < F.col("n_distinct")).alias("df"),
            F.count_if(F.col("pos") >= F.col("n_distinct")).alias("tf"),
        )
    )
    return with_dense_ordinal(terms, "term").withColumnRenamed("ordinal", "term_index")


def ngram_counts(df: DataFrame, tokens: Column | str, n: int) -> DataFrame:
    """Corpus frequency of each n-gram: ``gram, n``. Shifted lists are zipped, then exploded."""
    if n < 1:
        raise ValueError("n must be at least 1")
    length = F.greatest(F.size("tokens") - F.lit(n - 1), F.lit(0))
    shifted = [F.slice("tokens", F.lit(i + 1), length).alias(f"w{i}") for i in range(n)]
    grams = _bind(df, tokens).select(F.inline(F.arrays_zip(*shifted)))
    return grams.groupBy(*grams.columns).agg(F.count(F.lit(1)).alias("n")).select(
        F.concat_ws(" ", *grams.columns).alias("gram"), "n"
    )


def smooth_idf(n_documents, df) -> F.Column:
    """ln((1 + n) / (1 + df)) + 1."""
    return F.log((1 + n_documents) / (1 + df)) + 1


def _with_idf(frequencies: DataFrame, n) -> DataFrame:
    return frequencies.withColumn("idf", smooth_idf(n, F.col("df")))


def inverse_document_frequency(df: DataFrame, tokens: Column | str) -> DataFrame:
    """Smoothed inverse document frequency: ``term, df, idf``."""
    return _with_idf(document_frequency(df, tokens), df.agg(F.count(F.lit(1))).scalar())


def fit_idf(df: DataFrame, tokens: Column | str) -> DataFrame:
    """The idf table as a written table: texts are read once for it, and its size is known."""
    return written(inverse_document_frequency(df, tokens), "idf")


def weigh(counts: DataFrame, idf: DataFrame, doc: str) -> DataFrame:
    """L2-normalised tf-idf weights; terms without an idf are dropped, as when applying a fitted vocabulary."""
    joined = counts.join(idf.select("term", "idf"), "term")
    raw = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(raw * raw).over(Window.partitionBy(doc)))
    return joined.withColumn("weight", raw / norm)


def tfidf(df: DataFrame, doc: str, tokens: Column | str, *keep: str) -> DataFrame:
    """Long TF-IDF table: ``doc, *keep, term, tf, idf, weight``; each document has norm 1."""
    counts = written(counted_terms(df, doc, tokens, *keep), "counts")
    frequencies = counts.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = written(_with_idf(frequencies, counts.agg(F.count(F.lit(1))).scalar()), "idf")
    return weigh(_long(cluster_by(counts, doc), doc, *keep), idf, doc)


def top_terms(weights: DataFrame, group: str, k: int = 10, digits: int = 6) -> DataFrame:
    """The k terms with the largest summed weight per group: ``group, rank, term, score``.

    The rank filter lets Spark keep k rows per group and task before the shuffle.
    """
    best = Window.partitionBy(group).orderBy(F.desc("score"), "term")
    return (
        weights.groupBy(group, "term")
        .agg(F.round(F.sum("weight"), digits).alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select(group, "rank", "term", "score")
    )
