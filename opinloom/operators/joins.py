"""Left joins of a large fact table to a dimension.

Spark broadcasts a dimension below its own size threshold, without moving the facts. Otherwise both sides are shuffled
on the key, and adaptive execution divides a partition that a hot key makes large: the facts are split, the dimension's
rows of that partition read by each part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Left join on a null-safe key; copies on the right fan out, null keys match null keys."""
    right = dimension.withColumnRenamed(key, "__key")
    return facts.join(right, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")


def has_unique_key(df: DataFrame, key: str) -> bool:
    """Whether no key occurs twice (counts the key column only)."""
    return df.groupBy(key).count().where(F.col("count") > 1).isEmpty()


def left_join_counts(dimension: DataFrame, items: DataFrame, key: str, name: str) -> DataFrame:
    """Attach the number of items per key, 0 where there are none.

    Items are counted before the join, so a hot key meets it as a single row.
    """
    counts = items.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return dimension.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
