"""Descriptive analyses of reviews, businesses and reviewers.

Everything is aggregated to one row per business, user or value before any ranking, so a business
or reviewer with a large share of the reviews stays one pre-aggregated row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinloom.functions.labels import to_polarity
from opinloom.operators.joins import left_join_counts
from opinloom.operators.ordering import activity_quartile


def correlation(x: str, y: str) -> Column:
    """Pearson correlation; null where either side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _mean_by_key(reviews: DataFrame, key: str, score: str) -> DataFrame:
    return reviews.groupBy(key).agg(F.count(F.lit(1)).alias("n_reviews"), F.avg(score).alias("mean_score"))


def category_share(reviews: DataFrame, businesses: DataFrame, key: str, categories: str, separator: str) -> DataFrame:
    """Reviews per category and the share of all category mentions.

    Reviews are counted per business first; the join moves one row per business.
    """
    per_business = reviews.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    listed = businesses.select(key, F.explode(F.array_distinct(F.split(categories, separator))).alias("category"))
    counts = (
        listed.where(F.col("category") != "")
        .join(per_business, key)
        .groupBy("category")
        .agg(F.sum("n").alias("n_reviews"))
    )
    total = counts.agg(F.sum("n_reviews")).scalar()
    return counts.withColumn("share", F.col("n_reviews") / total)


def popularity_vs_rating(reviews: DataFrame, key: str, score: str) -> DataFrame:
    """Businesses by review-count magnitude (powers of two): mean rating of each group."""
    per_business = _mean_by_key(reviews, key, score)
    return (
        per_business.groupBy((F.length(F.bin("n_reviews")) - 1).alias("magnitude"))
        .agg(
            F.count(F.lit(1)).alias("n_businesses"),
            F.sum("n_reviews").alias("n_reviews"),
            F.avg("mean_score").alias("mean_score"),
        )
    )


def popularity_correlation(reviews: DataFrame, key: str, score: str) -> DataFrame:
    """Correlation of review count and mean rating over businesses."""
    return _mean_by_key(reviews, key, score).agg(
        correlation("n_reviews", "mean_score").alias("correlation"), F.count(F.lit(1)).alias("n_businesses")
    )


def heavy_reviewers(reviews: DataFrame, user: str, score: str) -> DataFrame:
    """Reviewer activity quartiles: mean score and share of negative reviews."""
    per_user = reviews.groupBy(user).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(score).cast("bigint")).alias("total"),
        F.count_if(to_polarity(F.col(score)) == -1).alias("negative"),
    )
    by_activity = per_user.groupBy("n").agg(
        F.count(F.lit(1)).alias("users"), F.sum("total").alias("total"), F.sum("negative").alias("negative")
    )
    n_reviews = F.sum(F.col("n") * F.col("users"))
    return (
        activity_quartile(by_activity, "n", "users")
        .groupBy("bucket")
        .agg(
            F.sum("users").alias("n_users"),
            n_reviews.alias("n_reviews"),
            (F.sum("total") / n_reviews).alias("mean_score"),
            (F.sum("negative") / n_reviews).alias("negative_share"),
        )
    )


def experience_vs_length(reviews: DataFrame, user: str, length: str) -> DataFrame:
    """Reviewer activity quartiles: mean length of their reviews."""
    per_user = reviews.groupBy(user).agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("chars"))
    by_activity = per_user.groupBy("n").agg(F.count(F.lit(1)).alias("users"), F.sum("chars").alias("chars"))
    n_reviews = F.sum(F.col("n") * F.col("users"))
    return (
        activity_quartile(by_activity, "n", "users")
        .groupBy("bucket")
        .agg(
            F.sum("users").alias("n_users"),
            n_reviews.alias("n_reviews"),
            (F.sum("chars") / n_reviews).alias("mean_length"),
        )
    )


def experience_correlation(reviews: DataFrame, user: str, length: str) -> DataFrame:
    """Correlation over users of their review count and mean review length."""
    per_user = reviews.groupBy(user).agg(F.count(F.lit(1)).alias("n"), F.avg(length).alias("mean_length"))
    return per_user.agg(correlation("n", "mean_length").alias("correlation"), F.count(F.lit(1)).alias("n_users"))


def length_by_score(reviews: DataFrame, score: str, length: str) -> DataFrame:
    """Mean and exact median length per score, from a histogram of lengths per score."""
    histogram = reviews.groupBy(score, length).agg(F.count(F.lit(1)).alias("n"))
    return histogram.groupBy(score).agg(
        F.sum("n").alias("n_reviews"),
        (F.sum(F.col(length) * F.col("n")) / F.sum("n")).alias("mean_length"),
        F.percentile(length, 0.5, F.col("n")).alias("median_length"),
    )


def attachments_vs_rating(reviews: DataFrame, attachments: DataFrame, key: str, score: str) -> DataFrame:
    """Businesses by number of attachments (photos): mean rating of each group."""
    rated = left_join_counts(_mean_by_key(reviews, key, score), attachments, key, "n_attachments")
    return rated.groupBy("n_attachments").agg(
        F.count(F.lit(1)).alias("n_businesses"), F.avg("mean_score").alias("mean_score")
    )


def attachments_correlation(reviews: DataFrame, attachments: DataFrame, key: str, score: str) -> DataFrame:
    """Correlation over businesses of attachment count and mean rating."""
    rated = left_join_counts(_mean_by_key(reviews, key, score), attachments, key, "n_attachments")
    return rated.agg(
        correlation("n_attachments", "mean_score").alias("correlation"), F.count(F.lit(1)).alias("n_businesses")
    )


def aspect_summary(answers: DataFrame, aspects: str) -> DataFrame:
    """Mentions, mean score, positive and negative counts per aspect."""
    return (
        # The outer form keeps Spark from repeating the answer parsing in a filter below the explode.
        answers.select(F.explode_outer(aspects).alias("aspect", "score"))
        .where(F.col("aspect").isNotNull())
        .groupBy("aspect")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("score").alias("mean_score"),
            F.count_if(F.col("score") > 3).alias("positive"),
            F.count_if(F.col("score") < 3).alias("negative"),
        )
    )
