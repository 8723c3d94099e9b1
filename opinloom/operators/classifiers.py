"""Spark's classifiers with the published defaults; ``n`` is the number of training rows. Linear models: ``newton``; forests: ``forest``."""

from __future__ import annotations

from pyspark.ml.classification import MultilayerPerceptronClassifier

from opinloom.contract import PERCEPTRON, SEED

LABEL, PREDICTION = "class_index", "class_prediction"


def perceptron(
    n: int, inputs: int, classes: int, features: str = "features", hidden: list[int] = PERCEPTRON["hidden"],
    max_iter: int = PERCEPTRON["max_iter"], seed: int = SEED,
):
    """Feed-forward network; needs a bounded input width (hashed or embedded features)."""
    return MultilayerPerceptronClassifier(
        featuresCol=features, labelCol=LABEL, predictionCol=PREDICTION, layers=[inputs, *hidden, classes],
        maxIter=max_iter, seed=seed,
    )
