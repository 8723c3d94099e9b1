"""Evaluation of two rule-based predictions, without any training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinloom.operators import metrics
from opinloom.operators.projection import valid_predictions
from opinloom.queries.registry import LABELLED_SQL, labelled, query

_RULES_SQL = f"""{LABELLED_SQL}, ruled AS (
  SELECT doc_id, polarity_label,
    CASE WHEN n_chars < 300 THEN -1 WHEN n_chars < 600 THEN 0 WHEN n_chars < 20000 THEN 1 END AS by_length,
    CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN -1 ELSE 0 END AS by_language
  FROM labelled)"""
_CONFUSION_SQL = f"""{_RULES_SQL}, confusion AS (
  SELECT polarity_label AS actual, by_length AS predicted, count(*) AS n
  FROM ruled WHERE by_length IS NOT NULL GROUP BY ALL)"""
_REPORT_SQL = f"""{_CONFUSION_SQL}, names AS (
  SELECT actual AS label FROM confusion UNION SELECT predicted FROM confusion),
counts AS (SELECT label,
  (SELECT coalesce(sum(n), 0) FROM confusion WHERE actual = label AND predicted = label) AS hit,
  (SELECT coalesce(sum(n), 0) FROM confusion WHERE predicted = label) AS given,
  (SELECT coalesce(sum(n), 0) FROM confusion WHERE actual = label) AS support FROM names),
ratios AS (SELECT label, coalesce(hit / nullif(given, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r, support FROM counts),
report AS (SELECT label, p AS precision, r AS recall, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1,
  CAST(support AS BIGINT) AS support FROM ratios)"""


def ruled(spark: SparkSession, folder: str) -> DataFrame:
    """Polarity guessed from the length (no guess for the longest) and from the language."""
    chars = F.col("n_chars")
    return labelled(spark, folder).select(
        "doc_id",
        "polarity_label",
        F.when(chars < 300, -1).when(chars < 600, 0).when(chars < 20000, 1).alias("by_length"),
        F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", -1).otherwise(0).alias("by_language"),
    )


def _confusion(spark: SparkSession, folder: str) -> DataFrame:
    valid = valid_predictions(ruled(spark, folder), "by_length", [-1, 0, 1])
    return metrics.confusion(valid, "polarity_label", "by_length")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"WITH {_CONFUSION_SQL} SELECT actual, predicted, n FROM confusion")
def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return _confusion(spark, folder)


@query(
    f"""WITH {_REPORT_SQL} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall,
    round(f1, 6) AS f1, support FROM report"""
)
def class_report(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.class_report(_confusion(spark, folder)), "precision", "recall", "f1")


@query(
    f"""WITH {_REPORT_SQL}
    SELECT 'macro avg' AS average, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
      round(avg(f1), 6) AS f1, CAST(sum(support) AS BIGINT) AS support FROM report
    UNION ALL
    SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
      round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
      CAST(sum(support) AS BIGINT) FROM report"""
)
def report_averages(spark: SparkSession, folder: str) -> DataFrame:
    report = metrics.class_report(_confusion(spark, folder))
    return rounded(metrics.report_averages(report), "precision", "recall", "f1")


@query(
    f"""WITH {_RULES_SQL}
    SELECT round(avg(CASE WHEN polarity_label = by_length THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n
    FROM ruled WHERE by_length IS NOT NULL"""
)
def accuracy(spark: SparkSession, folder: str) -> DataFrame:
    valid = valid_predictions(ruled(spark, folder), "by_length")
    return rounded(metrics.accuracy(valid, "polarity_label", "by_length"), "accuracy")


@query(
    f"""WITH {_RULES_SQL}
    SELECT count(*) AS requested_rows, count(*) AS predicted_rows, count(by_length) AS valid_rows,
      round(count(by_length) / count(*), 6) AS valid_rate FROM ruled"""
)
def valid_rate(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.answer_rate(ruled(spark, folder), "by_length"), "valid_rate")


@query(
    f"""WITH {_RULES_SQL}, long AS (
      SELECT 'polarity' AS task, 'length' AS model, polarity_label AS a, by_length AS p FROM ruled WHERE by_length IS NOT NULL
      UNION ALL SELECT 'polarity', 'language', polarity_label, by_language FROM ruled),
    names AS (SELECT DISTINCT task, model, unnest([a, p]) AS label FROM long),
    counts AS (SELECT n.task, n.model, n.label,
      count(*) FILTER (WHERE a = label AND p = label) AS hit, count(*) FILTER (WHERE p = label) AS given,
      count(*) FILTER (WHERE a = label) AS support
      FROM names n JOIN long l ON n.task = l.task AND n.model = l.model GROUP BY ALL),
    ratios AS (SELECT *, coalesce(hit / nullif(given, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall FROM counts),
    f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM ratios),
    s AS (SELECT task, model, sum(hit) / sum(support) AS accuracy, avg(f1) AS macro_f1,
      sum(f1 * support) / sum(support) AS weighted_f1, CAST(sum(support) AS BIGINT) AS n FROM f GROUP BY ALL)
    SELECT task, model, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1,
      n, CAST(row_number() OVER (PARTITION BY task ORDER BY accuracy DESC, macro_f1 DESC, model) AS INT) AS rank FROM s"""
)
def model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Both rules side by side, one confusion count for all."""
    guesses = F.array(
        F.struct(F.lit("length").alias("model"), F.col("by_length").alias("predicted")),
        F.struct(F.lit("language").alias("model"), F.col("by_language").alias("predicted")),
    )
    long = ruled(spark, folder).select(F.lit("polarity").alias("task"), "polarity_label", F.inline(guesses))
    compared = metrics.compare_models(valid_predictions(long, "predicted"), "polarity_label", "predicted")
    return rounded(compared, "accuracy", "macro_f1", "weighted_f1")
