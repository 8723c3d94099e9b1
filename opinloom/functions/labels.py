"""Score, polarity and class-index rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_score(number: Column) -> Column:
    """A parsed number truncated towards zero."""
    return number.try_cast("int")


def to_polarity(score: Column) -> Column:
    """1 and 2 are negative, 4 and 5 positive, everything else neutral."""
    return F.when(score.isin(1, 2), -1).when(score.isin(4, 5), 1).otherwise(0)


def class_index(label: Column, labels: list[int]) -> Column:
    """Position of the label in the sorted label list; null for an unknown label."""
    position = F.array_position(F.lit(sorted(labels)), label)
    return F.when(position > 0, position - 1).cast("double")


def class_label(index: Column, labels: list[int]) -> Column:
    """The label at a predicted class index."""
    return F.try_element_at(F.lit(sorted(labels)), index.cast("int") + 1)


def argmax(scores: Column) -> Column:
    """Index of the first largest entry of an array of class scores."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("double")
