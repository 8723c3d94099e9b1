"""Classification quality from one confusion count per model.

The confusion table is the only aggregation over the predictions; everything else works on its at
most ``labels x labels`` rows. ``by`` columns (model, task) evaluate several models in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, actual: str, predicted: str, *by: str) -> DataFrame:
    """``*by, actual, predicted, n``."""
    return df.groupBy(*by, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Share of equal labels; 0 if there are no rows."""
    hit = (F.col(actual) == F.col(predicted)).cast("double")
    return df.agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def _ratio(part, whole):
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def class_report(confusion_counts: DataFrame, *by: str) -> DataFrame:
    """``*by, label, precision, recall, f1, support`` for every true or predicted label; 0/0 is 0."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    none, n = F.lit(0).cast("bigint"), F.col("n")
    seen = F.struct(
        F.col("actual").alias("label"), n.alias("support"), none.alias("given"), hit.alias("hit")
    )
    given = F.struct(
        F.col("predicted").alias("label"), none.alias("support"), n.alias("given"), none.alias("hit")
    )
    totals = (
        confusion_counts.select(*by, F.inline(F.array(seen, given)))
        .groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "given", "hit")])
    )
    precision, recall = _ratio(F.col("hit"), F.col("given")), _ratio(F.col("hit"), F.col("support"))
    return totals.select(*by, "label", precision.alias("precision"), recall.alias("recall"), "support").select(
        *by,
        "label",
        "precision",
        "recall",
        _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"),
        "support",
    )


def report_averages(report: DataFrame, *by: str) -> DataFrame:
    """Macro and weighted averages: ``*by, average, precision, recall, f1, support``."""
    measures = ("precision", "recall", "f1")
    wide = report.groupBy(*by).agg(
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in measures],
        F.sum("support").alias("support"),
    ).where(F.col("support").isNotNull())
    rows = [
        F.struct(
            F.lit(f"{kind} avg").alias("average"),
            *[F.col(f"{kind}_{m}").alias(m) for m in measures],
            F.col("support"),
        )
        for kind in ("macro", "weighted")
    ]
    return wide.select(*by, F.inline(F.array(*rows)))


def summary(confusion_counts: DataFrame, *by: str) -> DataFrame:
    """One row per model: ``*by, accuracy, macro_f1, weighted_f1, n``."""
    report = class_report(confusion_counts, *by)
    return report.groupBy(*by).agg(
        # weighted recall equals accuracy
        _ratio(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("accuracy"),
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.coalesce(F.sum("support"), F.lit(0)).alias("n"),
    )


def compare_models(
    predictions: DataFrame, actual: str, predicted: str, model: str = "model", task: str = "task"
) -> DataFrame:
    """All models of a task ranked by accuracy, then macro F1, then name."""
    best = Window.partitionBy(task).orderBy(F.desc("accuracy"), F.desc("macro_f1"), model)
    scored = summary(confusion(predictions, actual, predicted, task, model), task, model)
    return scored.withColumn("rank", F.row_number().over(best))


def answer_rate(df: DataFrame, predicted: str) -> DataFrame:
    """How many rows were asked for, how many calls came back, and how many gave a valid prediction."""
    answered = F.col("error").isNull() if "error" in df.columns else F.lit(True)
    return df.agg(
        F.count(F.lit(1)).alias("requested_rows"),
        F.count_if(answered).alias("predicted_rows"),
        F.count_if(F.col(predicted).isNotNull()).alias("valid_rows"),
        _ratio(F.count_if(F.col(predicted).isNotNull()), F.count(F.lit(1))).alias("valid_rate"),
    )


def render_report(title: str, classes: list[Row], averages: list[Row]) -> str:
    """The collected report (one row per label) as text with four digits."""
    total = sum(r.support for r in classes)
    correct = sum(r.recall * r.support for r in classes)
    width = max(len("weighted avg"), *(len(str(r.label)) for r in classes)) if classes else len("weighted avg")

    def line(name, row):
        return f"{name:>{width}} {row.precision:>10.4f} {row.recall:>10.4f} {row.f1:>10.4f} {row.support:>10}"

    head = f"{'':>{width}} {'precision':>10} {'recall':>10} {'f1-score':>10} {'support':>10}"
    body = [line(str(r.label), r) for r in sorted(classes, key=lambda r: r.label)]
    share = correct / total if total else 0.0
    tail = [f"{'accuracy':>{width}} {'':>10} {'':>10} {share:>10.4f} {total:>10}"]
    tail += [line(r.average, r) for r in sorted(averages, key=lambda r: r.average)]
    return "\n".join([title, f"Test rows: {total}", f"Accuracy: {share:.4f}", "", head, *body, "", *tail, ""])
