"""Descriptive analyses on the star tables and the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinloom.operators import insights
from opinloom.queries.evaluation import rounded
from opinloom.queries.registry import LABELLED_SQL, ORDER_REVIEWS_SQL, labelled, order_reviews, query
from opinloom.sources.tables import table

_ITEMS_SQL = "items AS (SELECT *, CAST(ceil(l_quantity / 10) AS INT) AS score_label FROM lineitem)"
_PER_PART_SQL = f"""{_ITEMS_SQL}, per_part AS (
  SELECT l_partkey, count(*) AS n_reviews, avg(score_label) AS mean_score FROM items GROUP BY 1)"""
_RATED_SQL = f"""{_PER_PART_SQL}, rated AS (
  SELECT p.*, coalesce(a.n, 0) AS n_attachments FROM per_part p LEFT JOIN (
    SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a ON p.l_partkey = a.l_partkey)"""


def item_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as reviews of parts; a score from the quantity."""
    return table(spark, folder, "lineitem").withColumn("score_label", F.ceil(F.col("l_quantity") / 10).cast("int"))


@query(
    """WITH per_part AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1),
    listed AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS category FROM part),
    counts AS (SELECT category, CAST(sum(n) AS BIGINT) AS n_reviews FROM listed JOIN per_part ON p_partkey = l_partkey
               WHERE category <> '' GROUP BY 1)
    SELECT category, n_reviews, round(n_reviews / (SELECT sum(n_reviews) FROM counts), 6) AS share FROM counts"""
)
def category_share(spark: SparkSession, folder: str) -> DataFrame:
    reviews = table(spark, folder, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    shares = insights.category_share(reviews, table(spark, folder, "part"), "p_partkey", "p_name", " ")
    return rounded(shares, "share")


@query(
    f"""WITH {_PER_PART_SQL}
    SELECT CAST(length(bin(n_reviews)) - 1 AS INT) AS magnitude, count(*) AS n_businesses,
      CAST(sum(n_reviews) AS BIGINT) AS n_reviews, round(avg(mean_score), 6) AS mean_score FROM per_part GROUP BY 1"""
)
def popularity_vs_rating(spark: SparkSession, folder: str) -> DataFrame:
    found = insights.popularity_vs_rating(item_reviews(spark, folder), "l_partkey", "score_label")
    return rounded(found, "mean_score")


@query(f"WITH {_PER_PART_SQL} SELECT CASE WHEN stddev_pop(n_reviews) * stddev_pop(mean_score) > 0 THEN round(corr(n_reviews, mean_score), 6) END AS correlation, count(*) AS n_businesses FROM per_part")
def popularity_correlation(spark: SparkSession, folder: str) -> DataFrame:
    found = insights.popularity_correlation(item_reviews(spark, folder), "l_partkey", "score_label")
    return rounded(found, "correlation")


def _bucket_sql(user: str, source: str, sums: str) -> str:
    return f"""per_user AS (SELECT {user}, count(*) AS n, {sums} FROM {source} GROUP BY 1),
    placed AS (SELECT *, CAST(floor((rank() OVER (ORDER BY n) - 1) * 4 / count(*) OVER ()) AS INT) + 1 AS bucket FROM per_user)"""


@query(
    f"""WITH {ORDER_REVIEWS_SQL}, {_bucket_sql("o_custkey", "rated", "sum(score_label) AS total, count(*) FILTER (WHERE score_label <= 2) AS negative")}
    SELECT bucket, count(*) AS n_users, CAST(sum(n) AS BIGINT) AS n_reviews, round(sum(total) / sum(n), 6) AS mean_score,
      round(sum(negative) / sum(n), 6) AS negative_share FROM placed GROUP BY 1"""
)
def heavy_reviewers(spark: SparkSession, folder: str) -> DataFrame:
    found = insights.heavy_reviewers(order_reviews(spark, folder), "o_custkey", "score_label")
    return rounded(found, "mean_score", "negative_share")


@query(
    f"""WITH {_bucket_sql("source", "documents", "sum(n_chars) AS chars")}
    SELECT bucket, count(*) AS n_users, CAST(sum(n) AS BIGINT) AS n_reviews, round(sum(chars) / sum(n), 6) AS mean_length
    FROM placed GROUP BY 1"""
)
def experience_vs_length(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(insights.experience_vs_length(table(spark, folder, "documents"), "source", "n_chars"), "mean_length")


@query(
    """WITH per_user AS (SELECT source, count(*) AS n, avg(n_chars) AS mean_length FROM documents GROUP BY 1)
    SELECT CASE WHEN stddev_pop(n) * stddev_pop(mean_length) > 0 THEN round(corr(n, mean_length), 6) END AS correlation, count(*) AS n_users FROM per_user"""
)
def experience_correlation(spark: SparkSession, folder: str) -> DataFrame:
    found = insights.experience_correlation(table(spark, folder, "documents"), "source", "n_chars")
    return rounded(found, "correlation")


@query(
    f"""WITH {LABELLED_SQL}
    SELECT polarity_label, count(*) AS n_reviews, round(avg(n_chars), 6) AS mean_length,
      quantile_cont(n_chars, 0.5) AS median_length FROM labelled GROUP BY 1"""
)
def length_by_score(spark: SparkSession, folder: str) -> DataFrame:
    found = insights.length_by_score(labelled(spark, folder), "polarity_label", "n_chars")
    return rounded(found, "mean_length")


@query(
    f"""WITH {_RATED_SQL}
    SELECT n_attachments, count(*) AS n_businesses, round(avg(mean_score), 6) AS mean_score FROM rated GROUP BY 1"""
)
def attachments_vs_rating(spark: SparkSession, folder: str) -> DataFrame:
    """Returned items stand in for photos of a part."""
    items = item_reviews(spark, folder)
    photos = items.where(F.col("l_returnflag") == "R")
    return rounded(insights.attachments_vs_rating(items, photos, "l_partkey", "score_label"), "mean_score")


@query(f"WITH {_RATED_SQL} SELECT CASE WHEN stddev_pop(n_attachments) * stddev_pop(mean_score) > 0 THEN round(corr(n_attachments, mean_score), 6) END AS correlation, count(*) AS n_businesses FROM rated")
def attachments_correlation(spark: SparkSession, folder: str) -> DataFrame:
    items = item_reviews(spark, folder)
    photos = items.where(F.col("l_returnflag") == "R")
    return rounded(insights.attachments_correlation(items, photos, "l_partkey", "score_label"), "correlation")
