"""Query registration and the shared inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinloom.operators.joins import left_join
from opinloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL if there is one."""

    def register(run: Query) -> Query:
        _QUERIES[run.__name__] = run
        if sql is not None:
            _SQL[run.__name__] = sql
        return run

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Shared inputs: documents stand in for reviews, their quality labels for polarity.

LABELLED_SQL = """labelled AS (
  SELECT * FROM (
    SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
           CASE WHEN l.toxic = 1 THEN -1 WHEN l.quality = 0 THEN 0 WHEN l.quality = 1 THEN 1 END AS polarity_label
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
  WHERE polarity_label IS NOT NULL)"""


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def with_polarity(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a polarity, null where they are not labelled."""
    joined = left_join(documents(spark, folder), table(spark, folder, "labels"), "doc_id")
    polarity = F.when(F.col("toxic") == 1, -1).when(F.col("quality") == 0, 0).when(F.col("quality") == 1, 1)
    return joined.select("doc_id", "text", "lang", "source", "n_chars", polarity.alias("polarity_label"))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return with_polarity(spark, folder).na.drop(subset=["polarity_label"])


def order_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as reviews: score from the priority, customer as reviewer."""
    return table(spark, folder, "orders").withColumn("score_label", F.substring("o_orderpriority", 1, 1).cast("int"))


ORDER_REVIEWS_SQL = "rated AS (SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INT) AS score_label FROM orders)"
