"""Floors for the registered model queries: better on held-out rows than always naming the largest class."""

import pytest

import __spark_entry__ as entry
from opinloom.plans.training import TEXT_MODELS

FOLDER = "/root/testdata/sf0.01"


def quality(report):
    total = sum(r.support for r in report)
    accuracy = sum(r.recall * r.support for r in report) / total
    largest = max(r.support for r in report) / total
    macro = sum(r.recall for r in report if r.support) / sum(1 for r in report if r.support)
    return accuracy, largest, macro


@pytest.mark.parametrize("name", sorted(TEXT_MODELS))
def test_text_models_learn_the_languages(spark, name):
    accuracy, largest, _ = quality(entry.queries()[f"{name}_score"](spark, FOLDER).collect())
    assert accuracy >= largest + 0.1


@pytest.mark.parametrize("name", ["count_logreg", "tfidf_logreg", "tfidf_svm", "count_mlp", "tfidf_mlp"])
def test_text_models_of_polarity(spark, name):
    accuracy, largest, macro = quality(entry.queries()[f"{name}_polarity"](spark, FOLDER).collect())
    assert accuracy >= largest and macro >= 1 / 3


@pytest.mark.parametrize("name, margin", [("embedding_logreg", 0.2), ("embedding_mlp", 0.2), ("encoded_logreg", 0.0)])
def test_dense_models(spark, name, margin):
    accuracy, largest, _ = quality(entry.queries()[name](spark, FOLDER).collect())
    assert accuracy >= largest + margin
