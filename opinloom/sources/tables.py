"""Parquet tables, the train/test sink, fitted models and reports."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinloom.operators.metrics import class_report, render_report, report_averages


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sink_split(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows with a column ``split`` (see ``ordering.with_split``) in one pass below one path, a folder for each part."""
    rows.write.mode(mode).partitionBy("split").parquet(path)


def scan_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def sink_report(confusion_counts: DataFrame, path: str, title: str, mode: str = "errorifexists") -> str:
    """Write the report rows as JSON; the text rendering of its few rows is returned."""
    report = class_report(confusion_counts).cache()
    averages = report_averages(report)
    rows = report.withColumn("label", F.col("label").cast("string")).unionByName(
        averages.withColumnRenamed("average", "label")
    )
    rows.withColumn("title", F.lit(title)).coalesce(1).write.mode(mode).json(path)
    text = render_report(title, report.collect(), averages.collect())
    report.unpersist()
    return text
