"""Label reviews with a text-completion model and read its answers."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinloom.contract import POLARITIES, POLARITY, POLARITY_WORDS, SCORE
from opinloom.functions.answers import (
    aspect_scores,
    extract_label,
    label_to_polarity,
    object_text,
    overall_score,
    parse_object,
    without_stray_commas,
)
from opinloom.functions.prompts import (
    FEW_SHOT_POLARITY,
    FEW_SHOT_SCORE,
    ZERO_SHOT_POLARITY,
    ZERO_SHOT_SCORE,
    Example,
    chat,
    request,
)
from opinloom.operators.inference import Completer, complete
from opinloom.operators.ordering import ORDINAL, head_rows
from opinloom.operators.projection import require_columns, require_rows, valid_predictions

PROMPT = "prompt"


def polarity_answer(label: int) -> str:
    """The word that reads back as this polarity."""
    return next(word for word, value in POLARITY_WORDS.items() if value == label)


def score_answer(label: int) -> str:
    """The JSON object that reads back as this score; an example names no aspects."""
    return json.dumps({"overall_score": label, "aspects": {}})


def pick_examples(
    labelled: DataFrame, text: str, label: str, key: str = ORDINAL, answer: Callable[[int], str] = polarity_answer
) -> list[Example]:
    """The first non-blank review of each label, as worked examples (one row per label is read).

    ``answer`` words a label as the model is to answer: ``polarity_answer`` or ``score_answer``.
    """
    first = (
        labelled.where((F.trim(text) != "") & F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.min_by(text, key).alias("review"))
        .orderBy(label)
    )
    return [Example(r.review, answer(r[label])) for r in first.collect()]


def _ask(df, text, key, limit, template, examples, make_completer, requests) -> DataFrame:
    rows = require_rows(head_rows(df, limit, key))
    asked = request(template, F.coalesce(F.col(text), F.lit("")), examples)
    return complete(rows.withColumn(PROMPT, chat(asked)), PROMPT, make_completer, requests).drop(PROMPT)


def read_polarity(answered: DataFrame) -> DataFrame:
    """Adds ``predicted_polarity_label``, null where no label was named."""
    label = extract_label(F.col("raw_model_output"))
    return answered.withColumn(
        "predicted_polarity_label", F.when(F.col("error").isNull(), label_to_polarity(label))
    )


def read_scores(answered: DataFrame) -> DataFrame:
    """Adds ``predicted_score_label`` and ``predicted_aspects``."""
    braced = F.when(F.col("error").isNull(), object_text(F.col("raw_model_output")))
    return (
        answered.withColumn("__object", braced)
        .withColumn("__repaired", without_stray_commas(F.col("__object")))
        .withColumn("__parsed", parse_object(F.col("__object"), F.col("__repaired")))
        .withColumn("predicted_score_label", overall_score(F.col("__parsed")))
        .withColumn("predicted_aspects", aspect_scores(F.col("__parsed")))
        .drop("__object", "__repaired", "__parsed")
    )


def label_polarity(
    df: DataFrame,
    make_completer: Callable[[], Completer],
    text: str = "review_text",
    key: str = ORDINAL,
    limit: int = 0,
    examples: Sequence[Example] = (),
    requests: int | None = None,
) -> DataFrame:
    """Zero-shot (few-shot with examples) polarity of all rows, or of the first ``limit`` if one is given.

    The model is asked with the JSON list of a system and a user message. The rows stay dealt as they are, so calls run
    side by side; ``requests`` sets how many.
    """
    require_columns(df, [text, POLARITY])
    template = FEW_SHOT_POLARITY if examples else ZERO_SHOT_POLARITY
    return read_polarity(_ask(df, text, key, limit, template, examples, make_completer, requests))


def label_scores(
    df: DataFrame,
    make_completer: Callable[[], Completer],
    text: str = "review_text",
    key: str = ORDINAL,
    limit: int = 0,
    examples: Sequence[Example] = (),
    requests: int | None = None,
) -> DataFrame:
    """Zero-shot (few-shot with examples) score and aspect scores; see ``label_polarity``."""
    require_columns(df, [text, SCORE])
    template = FEW_SHOT_SCORE if examples else ZERO_SHOT_SCORE
    return read_scores(_ask(df, text, key, limit, template, examples, make_completer, requests))


def valid_polarities(labelled: DataFrame) -> DataFrame:
    return valid_predictions(labelled, "predicted_polarity_label", POLARITIES)


def valid_scores(labelled: DataFrame) -> DataFrame:
    return valid_predictions(labelled, "predicted_score_label")


def prediction_output(labelled: DataFrame, predicted: str, actual: str, text: str = "review_text") -> DataFrame:
    """Prediction, truth and text first; raw answer, error and aspects follow if present."""
    extra = [c for c in ("predicted_aspects", "raw_model_output", "error") if c in labelled.columns]
    return labelled.select(predicted, actual, text, *extra)
