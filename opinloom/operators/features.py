"""Feature vectors of texts.

``exact_vectors`` names every entry: its index is the term's place in the alphabetical vocabulary, at any size. The
vocabulary is a table that is joined, so no part of it passes through the driver. Classifiers need vectors of a fixed
width: ``fit_vectorizer`` hashes words into as many slots as asked for, whatever the vocabulary.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, CountVectorizerModel, ElementwiseProduct, HashingTF, Normalizer, SQLTransformer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinloom.functions.tokens import WORD, words
from opinloom.operators import terms
from opinloom.session import written

TOKENS, COUNTS, SCALED, FEATURES = "tokens", "counts", "scaled", "features"


def exact_vectors(df: DataFrame, doc: str, text: str, weighting: str = "tfidf") -> DataFrame:
    """``doc, indices, values`` of each text with words, and ``size``, the number of terms of all texts."""
    _known(weighting)
    tokens = words(F.col(text))
    index = written(terms.vocabulary(df, tokens), "vocabulary")
    if weighting == "count":
        rows = terms.term_counts(df, doc, tokens).select(doc, "term", F.col("tf").cast("double").alias("value"))
    else:
        rows = terms.tfidf(df, doc, tokens).select(doc, "term", F.col("weight").alias("value"))
    placed = rows.join(index.select("term", "term_index"), "term")
    entries = placed.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("term_index", "value"))).alias("entries"))
    size = F.lit(index.count())
    return entries.select(doc, size.alias("size"), F.col("entries.term_index").alias("indices"), F.col("entries.value").alias("values"))


def _known(weighting: str) -> None:
    if weighting not in ("count", "tfidf"):
        raise ValueError("weighting is 'count' or 'tfidf'")


def _tokenizer(text: str) -> SQLTransformer:
    """The words of ``functions.tokens``, as a stage that can be saved."""
    pattern = WORD.replace("\\", "\\\\")
    return SQLTransformer(statement=f"SELECT *, regexp_extract_all(lower(`{text}`), '{pattern}', 0) AS {TOKENS} FROM __THIS__")


def fit_vectorizer(df: DataFrame, text: str, weighting: str, width: int) -> PipelineModel:
    """Fit hashed bag-of-words (``count``) or TF-IDF (``tfidf``) features of a fixed width on a text column.

    No word is left out; words that share a slot share its weight. Of the texts, only document frequencies by slot
    reach the driver: ``width`` numbers.
    """
    _known(weighting)
    if df.select(F.explode(words(F.col(text)))).isEmpty():
        raise ValueError("empty vocabulary")
    if weighting == "count":
        return PipelineModel([_tokenizer(text), HashingTF(inputCol=TOKENS, outputCol=FEATURES, numFeatures=width)])
    counter = HashingTF(inputCol=TOKENS, outputCol=COUNTS, numFeatures=width)
    counts = counter.transform(df.select(words(F.col(text)).alias(TOKENS)))
    # Spark's own idf lacks the added one
    idf = IDF(inputCol=COUNTS, outputCol=SCALED).fit(counts).idf.toArray() + 1
    return PipelineModel([
        _tokenizer(text),
        counter,
        ElementwiseProduct(inputCol=COUNTS, outputCol=SCALED, scalingVec=Vectors.dense(idf)),
        Normalizer(inputCol=SCALED, outputCol=FEATURES, p=2.0),
    ])


def chosen_words(df: DataFrame, text: str, label: str, most: int) -> list[str]:
    """The ``most`` words that tell the labels apart best, by the chi-squared statistic of word and label.

    One count of the texts of each label that hold a word; only the chosen words reach the driver.
    """
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.array_distinct(words(F.col(text))).alias("words"))
    of_label = written(rows.groupBy("label").agg(F.count(F.lit(1)).alias("of_label")), "labels")
    held = rows.select("label", F.explode("words").alias("term")).groupBy("term", "label").agg(F.count(F.lit(1)).alias("n"))
    texts = of_label.agg(F.sum("of_label")).scalar()
    # labels without the word add their share of the expected counts as a whole
    with_word = F.sum("n").over(Window.partitionBy("term"))
    cells = held.withColumn("df", with_word).join(F.broadcast(of_label), "label").withColumn("texts", texts)
    expected = F.col("df") * F.col("of_label") / F.col("texts")
    apart = F.pow(F.col("n") - expected, F.lit(2.0)) / expected - expected
    per_word = cells.groupBy("term").agg(F.sum(apart).alias("apart"), F.first("df").alias("df"), F.first("texts").alias("texts"))
    # the sum over all labels of (n - e)^2 / e, times what the texts without the word add
    score = F.when(F.col("df") == F.col("texts"), 0.0).otherwise((F.col("apart") + F.col("df")) * F.col("texts") / (F.col("texts") - F.col("df")))
    return [r.term for r in per_word.orderBy(score.desc(), "term").limit(most).select("term").collect()]


def fit_chosen_vectorizer(df: DataFrame, text: str, label: str, weighting: str, most: int) -> PipelineModel:
    """Bag-of-words or TF-IDF features with an entry of its own for each chosen word, and none for others."""
    _known(weighting)
    vocabulary = chosen_words(df, text, label, most)
    if not vocabulary:
        raise ValueError("empty vocabulary")
    if weighting == "count":
        return PipelineModel([_tokenizer(text), CountVectorizerModel.from_vocabulary(vocabulary, TOKENS, FEATURES)])
    counter = CountVectorizerModel.from_vocabulary(vocabulary, TOKENS, COUNTS)
    counts = counter.transform(df.select(words(F.col(text)).alias(TOKENS)))
    idf = IDF(inputCol=COUNTS, outputCol=SCALED).fit(counts).idf.toArray() + 1
    return PipelineModel([
        _tokenizer(text), counter, ElementwiseProduct(inputCol=COUNTS, outputCol=SCALED, scalingVec=Vectors.dense(idf)),
        Normalizer(inputCol=SCALED, outputCol=FEATURES, p=2.0),
    ])


def feature_width(vectorizer: PipelineModel) -> int:
    counter = vectorizer.stages[1]
    return len(counter.vocabulary) if isinstance(counter, CountVectorizerModel) else counter.getNumFeatures()


def vector_terms(df: DataFrame, doc: str, vector: str) -> DataFrame:
    """A sparse vector column as long rows ``doc, slot, value``."""
    parts = F.unwrap_udt(vector)
    return df.select(doc, F.inline(F.arrays_zip(parts["indices"].alias("slot"), parts["values"].alias("value"))))
