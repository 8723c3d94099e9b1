"""Whole jobs on the star tables: prepare, document, shared features, models, save, load, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinloom.contract import POLARITY, SCORE
from opinloom.operators import metrics
from opinloom.operators.features import fit_vectorizer, vector_terms
from opinloom.operators.projection import require_rows
from opinloom.plans import training
from opinloom.plans.labelling import prediction_output
from opinloom.plans.prepare import prepare, prepare_split
from opinloom.queries.preparation import star_tables
from opinloom.queries.registry import documents, query
from opinloom.queries.evaluation import rounded
from opinloom.queries.text import clean_sql
from opinloom.session import work_path
from opinloom.sources.tables import load_model, save_model, sink_report

_DOCUMENT_SQL = "concat_ws(' ', " + ", ".join(
    f"nullif({clean_sql(c)}, '')"
    for c in ("l_returnflag || ' ' || l_linestatus || '  ' || CAST(l_orderkey AS VARCHAR)", "p_name", "p_type", "p_brand", "s_name")
) + ")"
_STAR_SQL = f"""star AS (SELECT {_DOCUMENT_SQL} AS document, CAST(ceil(l_quantity / 10) AS INT) AS score_label,
    CASE WHEN ceil(l_quantity / 10) IN (1, 2) THEN -1 WHEN ceil(l_quantity / 10) IN (4, 5) THEN 1 ELSE 0 END AS polarity_label
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey)"""


@query(f"WITH {_STAR_SQL} SELECT document, score_label, polarity_label FROM star")
def star_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The six text columns of the prepared table as one document."""
    return training.with_document(prepare(*star_tables(spark, folder))).select("document", "score_label", "polarity_label")


@query()
def star_models(spark: SparkSession, folder: str) -> DataFrame:
    """The main job as a whole: a model for each task on shared features, saved, loaded and reported on held-out rows."""
    train, test = (training.with_document(part) for part in prepare_split(*star_tables(spark, folder)))
    features = training.fit_text_vectorizer(train, "document", "tfidf_logreg")
    compared = None
    for task, label in (("polarity", POLARITY), ("score", SCORE)):
        rows = training.training_rows(train, "tfidf_logreg")
        path = work_path(spark, "model")
        save_model(training.fit_text_model(rows, "document", label, "tfidf_logreg", features), path)
        part = training.predict(load_model(path), require_rows(test)).select(
            F.lit("tfidf_logreg").alias("model"), F.lit(task).alias("task"), F.col(label).alias("actual"), training.PREDICTED)
        compared = part if compared is None else compared.unionByName(part)
    ranked = metrics.compare_models(compared, "actual", training.PREDICTED)
    return rounded(ranked, "accuracy", "macro_f1", "weighted_f1")


@query(
    r"""SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'))) > 0 AS has_words,
      len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS total FROM documents"""
)
def saved_vectorizer(spark: SparkSession, folder: str) -> DataFrame:
    """Hashed counts from a vectorizer that was saved and loaded: no word is lost."""
    docs = documents(spark, folder).select("doc_id", "text")
    path = work_path(spark, "vectorizer")
    save_model(fit_vectorizer(docs, "text", "count", training.WIDTHS["logreg"]), path)
    rows = vector_terms(load_model(path).transform(docs), "doc_id", "features")
    total = rows.groupBy("doc_id").agg(F.sum("value").cast("bigint").alias("total"))
    zero = F.coalesce("total", F.lit(0))
    return docs.join(total, "doc_id", "left").select("doc_id", (zero > 0).alias("has_words"), zero.alias("total"))


def _rule_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """A rule on the review's votes stands in for a model."""
    rows = training.with_document(prepare(*star_tables(spark, folder)))
    rule = F.when(F.col("review_funny") > 0.06, 1).when(F.col("review_funny") < 0.04, -1).otherwise(0)
    return rows.withColumn("predicted_polarity_label", rule)


_RULE_SQL = f"""{_STAR_SQL.replace('FROM lineitem', ', CASE WHEN l_discount > 0.06 THEN 1 WHEN l_discount < 0.04 THEN -1 ELSE 0 END AS predicted_polarity_label, ' + clean_sql("l_returnflag || ' ' || l_linestatus || '  ' || CAST(l_orderkey AS VARCHAR)") + ' AS review_text FROM lineitem')}"""


@query(f"WITH {_RULE_SQL} SELECT predicted_polarity_label, polarity_label, review_text FROM star")
def prediction_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The output rows of a labelling run, written and read back."""
    path = work_path(spark, "predictions")
    prediction_output(_rule_predictions(spark, folder), "predicted_polarity_label", "polarity_label").write.parquet(path)
    return spark.read.parquet(path)


@query(
    f"""WITH {_RULE_SQL}, c AS (SELECT polarity_label AS a, predicted_polarity_label AS p, count(*) AS n FROM star GROUP BY ALL),
    l AS (SELECT DISTINCT unnest([a, p]) AS label FROM c),
    r AS (SELECT label, (SELECT coalesce(sum(n), 0) FROM c WHERE a = label AND p = label) AS hit,
      (SELECT coalesce(sum(n), 0) FROM c WHERE p = label) AS said, (SELECT coalesce(sum(n), 0) FROM c WHERE a = label) AS support FROM l)
    SELECT 'rule' AS title, CAST(label AS VARCHAR) AS label, round(CASE WHEN said = 0 THEN 0 ELSE hit / said END, 6) AS precision,
      round(CASE WHEN support = 0 THEN 0 ELSE hit / support END, 6) AS recall, CAST(support AS BIGINT) AS support FROM r"""
)
def written_report(spark: SparkSession, folder: str) -> DataFrame:
    """The report of a rule's predictions, written as JSON and read back."""
    path = work_path(spark, "report")
    counts = metrics.confusion(_rule_predictions(spark, folder), "polarity_label", "predicted_polarity_label")
    sink_report(counts, path, "rule")
    rows = spark.read.json(path).where(~F.col("label").contains("avg"))
    return rows.select("title", "label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.col("support").cast("bigint"))
