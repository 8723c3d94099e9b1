"""Renames, column contracts and input checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinloom.functions.cleaning import as_number


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns that exist; others are left alone."""
    return df.withColumnsRenamed(dict(names))


def keep_prefixed(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """The key and every column starting with the prefix."""
    return df.select(key, *[c for c in df.columns if c.startswith(prefix) and c != key])


def ensure_columns(df: DataFrame, columns: Iterable[str], fill: str | float) -> DataFrame:
    """Add the columns that are missing, filled with a constant."""
    return df.withColumns({c: F.lit(fill) for c in columns if c not in df.columns})


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Raise ``KeyError`` naming the columns not found."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {', '.join(missing)}")
    return df


def require_rows(df: DataFrame) -> DataFrame:
    """Raise ``ValueError`` if there are no rows (reads at most one)."""
    if df.isEmpty():
        raise ValueError("no rows to work on")
    return df


def require_range(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Raise ``ValueError`` if a value lies outside the range (one min/max pass)."""
    least, most = label_range(df, column).first()
    if least is not None and (least < low or most > high):
        raise ValueError(f"{column} must be in [{low}, {high}], found [{least}, {most}]")
    return df


def label_range(df: DataFrame, column: str) -> DataFrame:
    """Smallest and largest label."""
    return df.agg(F.min(column).alias("min_label"), F.max(column).alias("max_label"))


def distinct_labels(df: DataFrame, column: str) -> DataFrame:
    """The labels in use, as one sorted array."""
    return df.agg(F.array_sort(F.collect_set(column)).alias("labels"))


def numeric(df: DataFrame, column: str):
    """The column as double whatever its type; null where it holds no number."""
    return as_number(F.col(column), isinstance(df.schema[column].dataType, T.StringType))


def drop_unlabelled(df: DataFrame, label: str) -> DataFrame:
    """Drop rows without a label."""
    return df.na.drop(subset=[label])


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop rows in which every column is null."""
    return df.na.drop(how="all")


def valid_predictions(df: DataFrame, predicted: str, allowed: Iterable[int] | None = None) -> DataFrame:
    """Rows whose prediction is one of the allowed labels (any non-null one by default)."""
    column = F.col(predicted)
    return df.where(column.isNotNull() if allowed is None else column.isin(list(allowed)))
