"""Distributed fits on the first 90 % of the rows, reports on the rest.

Polarity comes from the labels, the score task predicts the language class of every document.
Solvers have no SQL equivalent; the tests hold floors for their quality.
"""

from __future__ import annotations

from functools import partial

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinloom.operators import metrics, word_vectors
from opinloom.operators.inference import encode_by_length
from opinloom.operators.ordering import split_fraction, with_split
from opinloom.plans import training
from opinloom.queries.evaluation import rounded
from opinloom.queries.registry import LABELLED_SQL, documents, labelled, query
from opinloom.session import written

LANGUAGES = ["de", "en", "es", "fr"]


def language_task(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its language as a score 1..4."""
    score = F.array_position(F.lit(LANGUAGES), F.col("lang")).cast("int")
    return documents(spark, folder).select("doc_id", "text", score.alias("score_label"))


def polarity_task(spark: SparkSession, folder: str) -> DataFrame:
    return labelled(spark, folder).select("doc_id", "text", "polarity_label")


TASKS = {"polarity": (polarity_task, "polarity_label"), "score": (language_task, "score_label")}


def held_out_predictions(spark: SparkSession, folder: str, model: str, task: str, **options) -> DataFrame:
    rows, label = TASKS[task]
    train, test = split_fraction(rows(spark, folder), 0.9, "doc_id")
    fitted = training.fit_text_model(train, "text", label, model, **options)
    return training.predict(fitted, test).select("doc_id", F.col(label).alias("actual"), training.PREDICTED)


def report(predictions: DataFrame) -> DataFrame:
    counts = metrics.confusion(predictions, "actual", training.PREDICTED)
    return rounded(metrics.class_report(counts), "precision", "recall", "f1")


def _text_report(spark: SparkSession, folder: str, model: str, task: str) -> DataFrame:
    return report(held_out_predictions(spark, folder, model, task))


for _task in TASKS:
    for _model in training.TEXT_MODELS:
        _run = partial(_text_report, model=_model, task=_task)
        _run.__name__ = f"{_model}_{_task}"
        query()(_run)


def _encoded_report(spark: SparkSession, folder: str, kind: str, task: str) -> DataFrame:
    """A head on the output of a frozen encoder: mean word vectors, learnt from the co-occurrences of the training rows."""
    rows, label = TASKS[task]
    train, test = split_fraction(rows(spark, folder), 0.9, "doc_id")
    make = word_vectors.shipped(word_vectors.fit(train, "text"), spark)
    encoded = written(encode_by_length(train, "text", make).select("doc_id", "embedding", label), "encoded")
    fitted = training.fit_embedding_model(encoded, "embedding", label, kind)
    predicted = training.predict(fitted, training.embedding_vector(encode_by_length(test, "text", make), "embedding"))
    return report(predicted.withColumnRenamed(label, "actual"))


@query()
def embedding_logreg(spark: SparkSession, folder: str) -> DataFrame:
    """Logistic regression on frozen-encoder output, by language."""
    return _encoded_report(spark, folder, "logreg", "score")


@query()
def embedding_mlp(spark: SparkSession, folder: str) -> DataFrame:
    """Feed-forward head on frozen-encoder output, by language."""
    return _encoded_report(spark, folder, "perceptron", "score")


@query()
def encoded_logreg(spark: SparkSession, folder: str) -> DataFrame:
    """Logistic regression on frozen-encoder output, by polarity."""
    return _encoded_report(spark, folder, "logreg", "polarity")


@query()
def training_curve(spark: SparkSession, folder: str) -> DataFrame:
    """Objective and training accuracy after each step of the linear models and each epoch of the network."""
    train, _ = split_fraction(polarity_task(spark, folder), 0.9, "doc_id")
    curves = [
        training.training_curve(train, "text", "polarity_label", model).select(F.lit(model).alias("model"), "*")
        for model in ("tfidf_logreg", "tfidf_svm", "tfidf_mlp")
    ]
    return curves[0].unionByName(curves[1]).unionByName(curves[2])


@query()
def trained_model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """All eight models of each task, ranked on the same held-out rows; models of one weighting and width share features."""
    compared = None
    for task, (rows, label) in TASKS.items():
        train, test = split_fraction(rows(spark, folder), 0.9, "doc_id")
        shared: dict[tuple[str, int], PipelineModel] = {}
        for model, (weighting, kind) in training.TEXT_MODELS.items():
            key = (weighting, training.WIDTHS[kind])
            if key not in shared:
                shared[key] = training.fit_text_vectorizer(train, "text", model, label)
            fitted = training.fit_text_model(train, "text", label, model, shared[key])
            part = training.predict(fitted, test).select(
                F.lit(task).alias("task"), F.lit(model).alias("model"), F.col(label).alias("actual"), training.PREDICTED
            )
            compared = part if compared is None else compared.unionByName(part)
    ranked = metrics.compare_models(compared, "actual", training.PREDICTED)
    return rounded(ranked, "accuracy", "macro_f1", "weighted_f1")


_TASK_SQL = f"""WITH {LABELLED_SQL}, tasks AS (
  SELECT 'polarity' AS task, doc_id, polarity_label AS label FROM labelled
  UNION ALL SELECT 'score', doc_id, CAST(list_position(['de', 'en', 'es', 'fr'], lang) AS INT) FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY doc_id) <= floor(count(*) OVER (PARTITION BY task) * 0.9::DOUBLE)
  AS training FROM tasks)"""


@query(
    f"""{_TASK_SQL} SELECT task, CASE WHEN training THEN 'train' ELSE 'test' END AS split, label, count(*) AS support
    FROM placed GROUP BY ALL"""
)
def task_support(spark: SparkSession, folder: str) -> DataFrame:
    """Training and held-out rows of each class of each task: what every model report is measured on."""
    parts = [
        with_split(rows(spark, folder), 0.9, "doc_id").groupBy(F.lit(task).alias("task"), "split", F.col(label).alias("label")).agg(
            F.count(F.lit(1)).alias("support"))
        for task, (rows, label) in TASKS.items()
    ]
    return parts[0].unionByName(parts[1])
