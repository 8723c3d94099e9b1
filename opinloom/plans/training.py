"""Fit, apply and evaluate text and embedding classifiers.

A fitted model is one ``PipelineModel`` from the text (or embedding) column to an integer
prediction, with the label list stored as its own stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import IndexToString, SQLTransformer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinloom.contract import FOREST, LOGISTIC, SCORE, SCORES, SEED, SVM, TEXT_COLUMNS
from opinloom.functions.cleaning import document
from opinloom.functions.labels import class_index
from opinloom.operators import classifiers, embedding_bag, forest, newton
from opinloom.operators.blocks import as_blocks
from opinloom.operators.features import FEATURES, feature_width, fit_chosen_vectorizer, fit_vectorizer
from opinloom.operators.inference import encode
from opinloom.operators.metrics import class_report, confusion
from opinloom.operators.ordering import ORDINAL, head_rows, top_fraction
from opinloom.operators.projection import distinct_labels, require_columns, require_range, require_rows
from opinloom.operators.sizing import fit_partitions

PREDICTED = "predicted_label"
# Slots that words are hashed to, by classifier, at any size of the vocabulary. A tree bins every slot of every row,
# and a network has a vector for each slot, so these two take fewer.
WIDTHS = {"logreg": 1 << 16, "svm": 1 << 16, "forest": 1 << 12, "mlp": 1 << 14}
EPOCHS = 25
CHOSEN_WORDS = 1 << 10  # of a forest

# name -> (feature weighting, classifier)
TEXT_MODELS = {
    f"{weighting}_{kind}": (weighting, kind)
    for weighting in ("count", "tfidf")
    for kind in ("logreg", "svm", "forest", "mlp")
}


def with_document(df: DataFrame, into: str = "document") -> DataFrame:
    """The six text columns of a prepared table as one document."""
    require_columns(df, TEXT_COLUMNS)
    return df.withColumn(into, document(*[F.col(c) for c in TEXT_COLUMNS]))


# linear models: loss, inverse penalty, steps, tolerance
LINEAR = {
    "logreg": ("softmax", LOGISTIC["C"], LOGISTIC["max_iter"], LOGISTIC["tol"]),
    "svm": ("squared_hinge", SVM["C"], SVM["max_iter"], SVM["tol"]),
}


def _fit_in_passes(
    ready: DataFrame, kind: str, inputs: int, classes: int, options: dict, curve: bool = False
) -> tuple[Model, list[tuple[float, float]]]:
    """A model that is learnt in passes over blocks of rows, and its objective and training accuracy by step or epoch.

    A network has these only if they are asked for with ``curve``, as they take a pass's work beside its own.
    """
    blocks = as_blocks(ready, FEATURES, classifiers.LABEL).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if kind == "mlp":
            bag = embedding_bag.fit(blocks, inputs, classes, **({"epochs": EPOCHS, "seed": SEED, "curve": curve} | options))
            return embedding_bag.EmbeddingBagModel(bag, FEATURES, classifiers.PREDICTION), bag.history
        loss, C, max_iter, tol = LINEAR[kind]
        fitted = newton.fit(blocks, inputs, classes, loss, **({"C": C, "max_iter": max_iter, "tol": tol} | options))
        return fitted.model(FEATURES, classifiers.PREDICTION, ready.sparkSession), fitted.history
    finally:
        blocks.unpersist()


def _label_stages(labels: list[int]) -> list:
    return [
        IndexToString(inputCol=classifiers.PREDICTION, outputCol="predicted_text", labels=[str(v) for v in labels]),
        SQLTransformer(statement=f"SELECT *, CAST(predicted_text AS INT) AS {PREDICTED} FROM __THIS__"),
    ]


def _ready(features: DataFrame, label: str, labels: list[int]) -> DataFrame:
    """Features and class, dealt to as many tasks as the bytes need, at least one for each core."""
    rows = features.select(FEATURES, class_index(F.col(label), labels).alias(classifiers.LABEL))
    return rows.repartition(fit_partitions(features))


def _fit(features: DataFrame, label: str, labels: list[int], kind: str, inputs: int, options: dict) -> list:
    """Fit on a persisted (spilling) table, so text is vectorised once per fit: a solver runs a job per step over it."""
    ready = _ready(features, label, labels)
    if kind != "forest" and kind != "perceptron":
        return [_fit_in_passes(ready, kind, inputs, len(labels), options)[0], *_label_stages(labels)]
    ready.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, known = ready.select(F.count(F.lit(1)), F.count(classifiers.LABEL)).first()
        if kind == "forest":
            if known < n:
                raise ValueError("a forest needs a label on every row")
            blocks = as_blocks(ready, FEATURES, classifiers.LABEL)
            trees = forest.fit(ready, blocks, FEATURES, n, inputs, len(labels), **(FOREST | {"seed": SEED} | options))
            model = forest.ForestModel(trees, inputs, FEATURES, classifiers.PREDICTION)
        else:
            model = classifiers.perceptron(n, inputs, len(labels), FEATURES, **options).fit(ready)
    finally:
        ready.unpersist()
    return [model, *_label_stages(labels)]


def used_labels(train: DataFrame, label: str) -> list[int]:
    """The sorted labels of the training rows; scores must be in range. Raises if there are none."""
    if label == SCORE:
        require_range(train, label, SCORES[0], SCORES[-1])
    labels = distinct_labels(train, label).first().labels
    if not labels:
        raise ValueError("no labelled rows to learn from")
    return labels


def fit_text_vectorizer(train: DataFrame, text: str, model: str, label: str | None = None) -> PipelineModel:
    """The features of a model, to be shared by all models of its weighting and width.

    With a label, a forest gets the words that tell its classes apart, each with an entry of its own; all others, and a
    forest without, get hashed words.
    """
    weighting, kind = TEXT_MODELS[model]
    if kind == "forest" and label is not None:
        return fit_chosen_vectorizer(train, text, label, weighting, CHOSEN_WORDS)
    return fit_vectorizer(train, text, weighting, WIDTHS[kind])


def fit_text_model(
    train: DataFrame, text: str, label: str, model: str, vectorizer: PipelineModel | None = None, **options
) -> PipelineModel:
    """Fit one of ``TEXT_MODELS`` on a text column and an integer label, on its own or on shared features."""
    kind = TEXT_MODELS[model][1]
    labels = used_labels(train, label)
    vectorizer = vectorizer or fit_text_vectorizer(train, text, model, label)
    inputs = feature_width(vectorizer)
    fitted = _fit(vectorizer.transform(train.select(text, label)), label, labels, kind, inputs, options)
    return PipelineModel([*vectorizer.stages, *fitted])


def training_rows(train: DataFrame, model: str, key: str = ORDINAL, max_rows: int | None = None) -> DataFrame:
    """The first ``max_rows`` rows; by default the published number for an SVM, all for the others."""
    default = SVM["max_rows"] if TEXT_MODELS[model][1] == "svm" else 0
    return head_rows(train, default if max_rows is None else max_rows, key)


def encoded_rows(
    df: DataFrame, text: str, make_encoder: Callable, fraction: float = 1.0, key: str = ORDINAL
) -> DataFrame:
    """All rows, or the first share of them, with their embeddings, ready for a classifier head.

    ``contract.ENCODER_FRACTION`` is the share the published models train on.
    """
    rows = df if fraction == 1 else top_fraction(df, fraction, key)
    return embedding_vector(encode(rows, text, make_encoder), "embedding")


def embedding_vector(df: DataFrame, embedding: str) -> DataFrame:
    return df.withColumn(FEATURES, array_to_vector(F.col(embedding)))


def fit_embedding_model(train: DataFrame, embedding: str, label: str, kind: str = "logreg", **options) -> PipelineModel:
    """Fit a classifier head on frozen-encoder output, an ``array<float>`` column.

    The model starts at the feature vector; see ``embedding_vector``.
    """
    labels = used_labels(train, label)
    width = train.select(F.size(embedding)).first()[0]
    return PipelineModel(_fit(embedding_vector(train, embedding), label, labels, kind, width, options))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The input columns plus the predicted label."""
    return model.transform(df).select(*df.columns, PREDICTED)


def evaluate(model: PipelineModel, test: DataFrame, label: str) -> DataFrame:
    """Per-class report on held-out rows."""
    return class_report(confusion(predict(model, require_rows(test)), label, PREDICTED))


def training_curve(train: DataFrame, text: str, label: str, model: str, vectorizer: PipelineModel | None = None, **options) -> DataFrame:
    """``epoch, objective, accuracy`` on the training rows after each step or epoch of a linear model or network.

    The first row of a linear model (epoch 0) is the start from zero; the last row is that of the fitted model.
    """
    kind = TEXT_MODELS[model][1]
    if kind == "forest":
        raise ValueError("a forest is not learnt in epochs")
    labels = used_labels(train, label)
    vectorizer = vectorizer or fit_text_vectorizer(train, text, model)
    ready = _ready(vectorizer.transform(train.select(text, label)), label, labels)
    _, history = _fit_in_passes(ready, kind, feature_width(vectorizer), len(labels), options, curve=True)
    first = 1 if kind == "mlp" else 0
    rows = [(i, float(v), float(a)) for i, (v, a) in enumerate(history, first)]
    return train.sparkSession.createDataFrame(rows, "epoch int, objective double, accuracy double")
