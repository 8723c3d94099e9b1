"""A toxicity classifier: gradient-boosted trees over dense features of wording, calibrated by isotonic regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinloom.llm.hashing import U, byte_values, mixed, word_bounds, word_hashes
from opinloom.llm.shared import Work, held_out, plain_text, python_tasks, row_unpacked, sliced, text_bytes, with_row
from opinloom.llm.textstats import DIGIT, HIGH, LETTER, LOUD, MARK, SYMBOL, UPPER, byte_class, of_text, per_text

FIT_ROWS = 16000
LEXICON = 4000
STEM_BYTES = 5
NEAR_WORDS = 5
STRONG, WEAK = 4.0, 2.0

# How letters are disguised, and the second person in the languages of the corpus.
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
SECOND_PERSON = (
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner ihr euch euer eure "
    "tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro vuestra"
).split()

FEATURES = [
    "strong", "weak", "strong_share", "weak_share", "strongest", "second_person", "near_second_person", "capitals", "shouted",
    "loud", "marks", "symbols", "disguised", "disguised_hits", "length",
]

_INSIDE = LETTER + DIGIT + HIGH + byte_class("@$*")
_BREAKS = _INSIDE == 0
_PLAIN, _UNDISGUISED = byte_values(), byte_values(DISGUISES)


def _second_person() -> np.ndarray:
    words = [w.encode() for w in SECOND_PERSON]
    ends = np.cumsum([len(w) for w in words])
    return np.sort(word_hashes(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends, _PLAIN))


SECOND = _second_person()


@dataclass
class Words:
    """The words of many texts with their hashes; a stem is the first bytes of a longer word."""

    text: np.ndarray
    whole: np.ndarray
    stem: np.ndarray
    bare: np.ndarray
    shouted: np.ndarray
    odd: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends, before = word_bounds(data, offsets, _BREAKS)
    length = ends - starts
    stems = mixed(word_hashes(data, starts, np.minimum(ends, starts + STEM_BYTES), _PLAIN) + U(1))
    letters = np.r_[0, np.cumsum((LETTER + HIGH)[data])]
    upper = np.r_[0, np.cumsum(UPPER[data])]
    alphabetic = (letters[ends] - letters[starts]) if len(starts) else length
    capital = (upper[ends] - upper[starts]) if len(starts) else length
    return Words(
        of_text(before), word_hashes(data, starts, ends, _PLAIN), np.where(length > STEM_BYTES, stems, U(0)),
        word_hashes(data, starts, ends, _UNDISGUISED), (capital == length) & (length > 1), (alphabetic > 0) & (alphabetic < length))


@dataclass
class Lexicon:
    """Hashes of words and stems, sorted, with the log odds of toxicity of the texts that hold them."""

    hashes: np.ndarray
    weight: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes) or not len(hashes):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.weight[at], 0.0)


def dense_features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    w = words_of(data, offsets)
    count = np.bincount(w.text, minlength=n).astype(np.float64)
    least_one = np.maximum(count, 1)
    plain = np.maximum(lexicon.of(w.whole), lexicon.of(w.stem))
    bare = np.where((w.bare != w.whole) & w.odd, lexicon.of(w.bare), 0.0)
    weight = np.maximum(plain, bare)
    per = lambda values: np.bincount(w.text, weights=values.astype(np.float64), minlength=n)
    strong, weak = per(weight >= STRONG), per(weight >= WEAK)
    strongest = np.zeros(n)
    np.maximum.at(strongest, w.text, weight)
    second = np.isin(w.whole, SECOND)
    at_second, hits = np.flatnonzero(second), np.flatnonzero(weight >= WEAK)
    near = np.zeros(len(w.text), bool)
    if len(at_second):
        place = np.searchsorted(at_second, hits)
        for other in (at_second[np.minimum(place, len(at_second) - 1)], at_second[np.maximum(place - 1, 0)]):
            near[hits[(np.abs(other - hits) <= NEAR_WORDS) & (w.text[other] == w.text[hits])]] = True
    letters = np.maximum(per_text(LETTER[data], offsets), 1)
    return np.stack([
        np.log1p(strong), np.log1p(weak), strong / least_one, weak / least_one, strongest, per(second) / least_one,
        per(near) / least_one, per_text(UPPER[data], offsets) / letters, per(w.shouted) / least_one,
        per_text(LOUD[data], offsets) / size, per_text(MARK[data], offsets) / size, per_text(SYMBOL[data], offsets) / size,
        per(w.odd) / least_one, per(bare >= WEAK) / least_one, np.log1p(count),
    ], axis=1)


def _learnt_lexicon(sample: DataFrame) -> Lexicon:
    """Words and stems that tell toxic texts from others, by their smoothed log odds; the ``LEXICON`` surest ones."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            w = words_of(*text_bytes(batch.column(1)))
            label = batch.column(2).to_numpy()
            for hashes in (w.whole, w.stem):
                seen = hashes != 0
                key = mixed(hashes[seen] + w.text[seen].astype(np.uint64) * U(0x9E3779B97F4A7C15))
                _, first = np.unique(key, return_index=True)
                term, toxic = hashes[seen][first], label[w.text[seen][first]]
                terms, where = np.unique(term, return_inverse=True)
                totals = [np.bincount(where, minlength=len(terms)), np.bincount(where, weights=toxic, minlength=len(terms))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms.view(np.int64)), *[pa.array(t.astype(np.int64)) for t in totals]], ["term", "n", "toxic"])

    counted = sample.select("doc_id", "text", "label").mapInArrow(read, "term long, n long, toxic long")
    counted = counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    rows, toxic = sample.agg(F.count("*"), F.sum("label")).first()
    base = (toxic + 1) / (rows - toxic + 1)
    odds = F.log((F.col("toxic") + 0.1 * base) / (F.col("n") - F.col("toxic") + 0.1) / base)
    ranked = counted.where("toxic >= 2").select("term", odds.alias("odds"), (odds * F.sqrt("toxic")).alias("sure"))
    top = ranked.where(F.col("odds") >= WEAK).orderBy(F.desc("sure"), "term").limit(LEXICON).toArrow()
    hashes, weight = top["term"].to_numpy().view(np.uint64), top["odds"].to_numpy()
    order = np.argsort(hashes)
    return Lexicon(hashes[order], weight[order])


def _with_features(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` with an array of its dense features."""
    shipped = python_tasks(docs.sparkSession).sparkContext.broadcast(lexicon)
    own = [c for c in docs.columns if c != "dense"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            rows = dense_features(*text_bytes(batch.column(own.index("text"))), shipped.value)
            ends = pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32))
            dense = pa.ListArray.from_arrays(ends, pa.array(rows.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, dense], [*own, "dense"])

    schema = docs.select(*own).withColumn("dense", F.array(F.lit(0.0))).schema
    return docs.select(*own).mapInArrow(read, schema)


def _vector(rows: DataFrame) -> DataFrame:
    named = rows.withColumns({f"x_{name}": F.col("dense")[i] for i, name in enumerate(FEATURES)})
    return VectorAssembler(inputCols=[f"x_{name}" for name in FEATURES], outputCol="vector").transform(named)


@dataclass
class Model:
    """The trees and their calibration, or the rate alone where the labels are of one kind only."""

    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    rate: float


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """A model learnt from at most ``rows`` labelled documents, none of them held out, drawn by the hash of their id.

    The lexicon is learnt on two fifths of them, the trees on two, the calibration on one, so that each sees scores of
    texts which the step before has not seen. With labels of one kind only, every text gets their smoothed rate.
    """
    work = Work(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id")
    drawn = known.agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", plain_text().alias("text"))
    # by rank within the label, so that every fifth holds its share of the rarer one
    fold = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")) % 5
    drawn = drawn.withColumn("fold", fold)
    sample = work.table(texts.join(F.broadcast(drawn), "doc_id"), "toxicity-sample")
    n, positive = sample.agg(F.count("*"), F.sum("label")).first()
    positive = positive or 0
    rate = (positive + 1) / (n + 2)
    # every fifth needs rows of both labels
    if positive in (0, n) or sample.groupBy("fold", "label").count().count() < 10:
        return Model(Lexicon(np.zeros(0, np.uint64), np.zeros(0)), None, None, rate)
    lexicon = _learnt_lexicon(sample.where("fold < 2"))
    rows_in = work.table(_vector(_with_features(sample.where("fold >= 2"), lexicon)).select("fold", "vector", "label"), "toxicity-features")
    trees = GBTClassifier(
        featuresCol="vector", labelCol="label", maxIter=30, maxDepth=4, stepSize=0.2, minInstancesPerNode=5, seed=3
    ).fit(rows_in.where("fold < 4").coalesce(4))
    margins = _margin(trees.transform(rows_in.where("fold = 4")))
    calibration = None
    if margins.select("label").distinct().count() == 2:
        calibration = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="calibrated").fit(margins)
    work.drop(sample, rows_in)
    return Model(lexicon, trees, calibration, rate)


def _margin(rows: DataFrame) -> DataFrame:
    return rows.withColumn("margin", vector_to_array("probability")[1])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, the calibrated probability of toxicity; a column of this name is replaced, all others stay.

    A null or empty text is scored by its (zero) features. Repeated rows get equal scores, an empty table stays empty.
    Isotonic steps are flat, so the uncalibrated score still counts for a hundredth: it orders texts within a step.
    """
    rows = with_row(docs, "text", without="text")

    def answer(found: DataFrame, score: Column) -> DataFrame:
        return row_unpacked(found, docs.columns, score.alias("score"), without="text")

    if model.trees is None:
        return answer(rows, F.lit(model.rate))
    rows = _margin(model.trees.transform(_vector(_with_features(rows, model.lexicon))))
    if model.calibration is None:
        return answer(rows, F.col("margin"))
    rows = model.calibration.transform(rows)
    return answer(rows, F.col("calibrated") * 0.99 + F.col("margin") * 0.01)
