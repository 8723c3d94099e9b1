"""Word vectors from co-occurrence: a frozen encoder that is learnt from the texts themselves.

Counts of words near each other are made by Spark, for the most frequent words; the matrix of positive pointwise mutual
information, of bounded size, is factorised, and a text is the mean of the vectors of its words.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinloom.functions.tokens import words
from opinloom.session import written

VOCABULARY = 2048  # words with a vector
WINDOW = 4
WIDTH = 32


@dataclass
class Encoder:
    """Vectors by word; texts without any known word have the zero vector."""

    places: dict[str, int]
    vectors: np.ndarray

    def encode(self, tokens: list[str]) -> np.ndarray:
        known = [self.places[t] for t in tokens if t in self.places]
        return self.vectors[known].mean(axis=0) if known else np.zeros(self.vectors.shape[1])


def fit(df: DataFrame, text: str, vocabulary: int = VOCABULARY, window: int = WINDOW, width: int = WIDTH) -> Encoder:
    """An encoder over the ``vocabulary`` most frequent words of all texts (ties by word).

    Pairs at most ``window`` words apart are counted within each text first and summed over texts; at most
    ``vocabulary`` squared counts reach the driver.
    """
    texts = written(df.select(words(F.col(text)).alias("tokens")), "tokens")
    counts = texts.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    chosen = [r.word for r in counts.orderBy(F.desc("n"), "word").limit(vocabulary).select("word").collect()]
    places = {w: i for i, w in enumerate(chosen)}
    if not places:
        return Encoder({}, np.zeros((0, width)))
    # the words that have a place, as numbers in one literal map of bounded size
    numbers = texts.sparkSession.createDataFrame(list(places.items()), "word string, at int")
    rows = texts.withColumn("doc", F.monotonically_increasing_id()).select("doc", F.posexplode("tokens").alias("spot", "word"))
    placed = rows.join(F.broadcast(numbers), "word").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("spot", "at"))).alias("spots"))
    spots = F.col("spots")
    near = F.flatten(F.transform(spots, lambda a, i: F.transform(
        F.filter(F.slice(spots, i + 2, F.lit(window)), lambda b: b["spot"] - a["spot"] <= window),
        lambda b: F.struct(F.least(a["at"], b["at"]).alias("a"), F.greatest(a["at"], b["at"]).alias("b")))))
    pairs = placed.select(F.inline(near)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).toArrow()
    size = len(places)
    matrix = np.zeros((size, size))
    a, b, n = (pairs[c].to_numpy() for c in ("a", "b", "n"))
    np.add.at(matrix, (a, b), n)
    np.add.at(matrix, (b, a), n)
    return Encoder(places, _factors(matrix, width))


def _factors(matrix: np.ndarray, width: int) -> np.ndarray:
    """Leading factors of the positive pointwise mutual information, scaled by the root of their weight."""
    total, of = matrix.sum(), matrix.sum(axis=1)
    expected = np.outer(of, of) / max(total, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        pmi = np.where(matrix > 0, np.log(matrix / expected), 0)
    weight, vector = np.linalg.eigh(np.maximum(pmi, 0))
    best = np.argsort(-np.abs(weight))[:width]
    vectors = vector[:, best] * np.sqrt(np.abs(weight[best]))
    return np.pad(vectors, ((0, 0), (0, max(0, width - len(best)))))


def shipped(encoder: Encoder, spark: SparkSession) -> Callable:
    """What makes the encoder in a Python worker, for ``inference.encode``; sent to each executor once."""
    held = spark.sparkContext.broadcast(encoder)

    def make() -> Callable:
        word = re.compile(r"\w{2,}")  # as in functions.tokens

        def encode(texts: np.ndarray) -> np.ndarray:
            return np.stack([held.value.encode(word.findall((t or "").lower())) for t in texts]).astype(np.float32)

        return encode

    return make
