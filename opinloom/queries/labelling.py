"""Prompts, batch encoding, and answers that the tables hold."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinloom.contract import LABELLING_LIMIT
from opinloom.functions import answers, prompts
from opinloom.operators.inference import encode_by_length
from opinloom.operators.insights import aspect_summary as summarise_aspects
from opinloom.operators.metrics import answer_rate
from opinloom.operators.ordering import first_rows
from opinloom.plans.labelling import pick_examples, read_polarity, read_scores, score_answer
from opinloom.queries.evaluation import rounded
from opinloom.queries.registry import LABELLED_SQL, documents, labelled, query
from opinloom.sources.tables import table

def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _prompt_sql(template: prompts.Template, review: str, examples: str = "''") -> str:
    before, after = template.text.split("{review}")
    if "{examples}" in before:
        head, tail = before.split("{examples}")
        return f"{quoted(head)} || {examples} || {quoted(tail)} || {review} || {quoted(after)}"
    return f"{quoted(before)} || {review} || {quoted(after)}"


@query(
    f"""SELECT doc_id, md5({_prompt_sql(prompts.ZERO_SHOT_POLARITY, 'text')}) AS polarity_prompt,
      md5({_prompt_sql(prompts.ZERO_SHOT_SCORE, 'text')}) AS score_prompt FROM documents"""
)
def prompts_zero_shot(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return docs.select(
        "doc_id",
        F.md5(prompts.render(prompts.ZERO_SHOT_POLARITY, F.col("text"))).alias("polarity_prompt"),
        F.md5(prompts.render(prompts.ZERO_SHOT_SCORE, F.col("text"))).alias("score_prompt"),
    )


@query(
    f"""WITH {LABELLED_SQL}, firsts AS (
      SELECT polarity_label, arg_min(text, doc_id) AS review FROM labelled WHERE trim(text) <> '' GROUP BY 1),
    scored AS (SELECT *, 2 + polarity_label AS score FROM firsts),
    shown AS (SELECT
      string_agg('Review: ' || review || chr(10) || 'Sentiment: ' ||
        CASE polarity_label WHEN -1 THEN 'negative' WHEN 0 THEN 'neutral' ELSE 'positive' END || chr(10) || chr(10), '' ORDER BY polarity_label) AS p,
      string_agg('Review: ' || review || chr(10) || 'JSON: {{"overall_score": ' || score || ', "aspects": {{}}}}' || chr(10) || chr(10), '' ORDER BY score) AS s
      FROM scored)
    SELECT doc_id, md5({_prompt_sql(prompts.FEW_SHOT_POLARITY, 'text', '(SELECT p FROM shown)')}) AS polarity_prompt,
      md5({_prompt_sql(prompts.FEW_SHOT_SCORE, 'text', '(SELECT s FROM shown)')}) AS score_prompt FROM documents"""
)
def prompts_few_shot(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts around one worked example per label."""
    known = labelled(spark, folder).withColumn("score_label", F.col("polarity_label") + 2)
    words = pick_examples(known, "text", "polarity_label", "doc_id")
    objects = pick_examples(known, "text", "score_label", "doc_id", score_answer)
    return documents(spark, folder).select(
        "doc_id",
        F.md5(prompts.render(prompts.FEW_SHOT_POLARITY, F.col("text"), words)).alias("polarity_prompt"),
        F.md5(prompts.render(prompts.FEW_SHOT_SCORE, F.col("text"), objects)).alias("score_prompt"),
    )


@query(
    f"""SELECT doc_id, {quoted(prompts.ZERO_SHOT_POLARITY.system)} AS system, md5({_prompt_sql(prompts.ZERO_SHOT_POLARITY, 'text')}) AS prompt,
      {quoted(prompts.ZERO_SHOT_SCORE.system)} AS score_system FROM documents"""
)
def requests_zero_shot(spark: SparkSession, folder: str) -> DataFrame:
    """The requests as the model gets them: read back from their JSON messages."""
    asked, rated = (
        F.from_json(prompts.chat(prompts.request(t, F.col("text"))), "array<struct<role string, content string>>")
        for t in (prompts.ZERO_SHOT_POLARITY, prompts.ZERO_SHOT_SCORE)
    )
    return documents(spark, folder).select("doc_id", asked.alias("asked"), rated.alias("rated")).select(
        "doc_id", F.col("asked")[0]["content"].alias("system"), F.md5(F.col("asked")[1]["content"]).alias("prompt"),
        F.col("rated")[0]["content"].alias("score_system"),
    )


@query(
    f"""SELECT doc_id, {_prompt_sql(prompts.ZERO_SHOT_POLARITY, 'text')} AS prompt
    FROM documents ORDER BY doc_id LIMIT {LABELLING_LIMIT}"""
)
def prompt_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts for the first rows only, the default size of a labelling run."""
    docs = first_rows(documents(spark, folder), LABELLING_LIMIT, "doc_id")
    return docs.select("doc_id", prompts.render(prompts.ZERO_SHOT_POLARITY, F.col("text")).alias("prompt"))


_SAID_SQL = f"""{LABELLED_SQL}, said AS (
  SELECT doc_id, polarity_label, text || chr(10) || CASE
    WHEN polarity_label = -1 THEN 'Not positive: NEGATIVE.'
    WHEN polarity_label = 0 THEN 'neutral'
    WHEN n_chars > 2000 THEN 'positively unnegative'
    ELSE '**Positive**' END AS answer FROM labelled),
read AS (SELECT *, coalesce(list_extract(regexp_extract_all(lower(answer), '\\b(negative|neutral|positive)\\b', 1), -1), 'unknown') AS label FROM said),
predicted AS (SELECT *, CASE label WHEN 'negative' THEN -1 WHEN 'neutral' THEN 0 WHEN 'positive' THEN 1 END
  AS predicted_polarity_label FROM read)"""


def said(spark: SparkSession, folder: str) -> DataFrame:
    """Free-text answers after the whole review text; some name no label."""
    polarity = F.col("polarity_label")
    phrase = (
        F.when(polarity == -1, "Not positive: NEGATIVE.")
        .when(polarity == 0, "neutral")
        .when(F.col("n_chars") > 2000, "positively unnegative")
        .otherwise("**Positive**")
    )
    return labelled(spark, folder).select(
        "doc_id", "polarity_label", F.concat("text", F.lit("\n"), phrase).alias("raw_model_output"),
        F.lit(None).cast("string").alias("error"),
    )


@query(f"WITH {_SAID_SQL} SELECT doc_id, label, predicted_polarity_label FROM predicted")
def extract_label(spark: SparkSession, folder: str) -> DataFrame:
    return read_polarity(said(spark, folder)).select(
        "doc_id", answers.extract_label(F.col("raw_model_output")).alias("label"), "predicted_polarity_label"
    )


@query(
    f"""WITH {_SAID_SQL} SELECT count(*) AS requested_rows, count(*) AS predicted_rows, count(predicted_polarity_label) AS valid_rows,
    round(count(predicted_polarity_label) / count(*), 6) AS valid_rate FROM predicted"""
)
def answer_validity(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(answer_rate(read_polarity(said(spark, folder)), "predicted_polarity_label"), "valid_rate")


# Eight shapes of a JSON answer; s = 1..7 so that some scores are out of range.
_SHAPES_SQL = """shapes AS (
  SELECT doc_id, doc_id % 8 AS shape, 1 + n_chars % 7 AS s, 1 + (n_chars + doc_id) % 6 AS f, text FROM documents),
answered AS (SELECT doc_id, shape, s, f, CASE shape
  WHEN 0 THEN '{"overall_score": ' || s || ', "aspects": {"food": ' || f || ', "price": "2"}}'
  WHEN 1 THEN '```json' || chr(10) || '{"overall_score": ' || s || '.7, "aspects": {"service": ' || f || '}}' || chr(10) || '```'
  WHEN 2 THEN '{"overall_score": "' || s || '", "aspects": {"food": ' || f || ', "price": 9,},}'
  WHEN 3 THEN text || chr(10) || '{"overall_score": ' || s || ', "aspects": ["food"]}' || chr(10) || 'Thanks'
  WHEN 4 THEN '{''overall_score'': ' || s || ', ''aspects'': {''ambience'': ' || f || ', ''price'': None}}'
  WHEN 5 THEN '[{"overall_score": ' || s || '}, {"overall_score": 1}]'
  WHEN 6 THEN text
  ELSE '{"overall_score": "' || s || '.0", "aspects": {"location": true, "food": null}}' END AS answer FROM shapes)"""
_PARSED_SQL = f"""{_SHAPES_SQL}, parsed AS (SELECT doc_id,
  CAST(CASE WHEN shape IN (0, 1, 2, 3, 4) AND s <= 5 THEN s END AS INT) AS predicted_score_label,
  CASE WHEN shape IN (0, 2) AND f <= 5 THEN CAST(f AS INT) END AS food,
  CASE WHEN shape = 1 AND f <= 5 THEN CAST(f AS INT) END AS service,
  CASE WHEN shape = 0 THEN 2 END AS price,
  CASE WHEN shape = 4 AND f <= 5 THEN CAST(f AS INT) END AS ambience,
  CASE WHEN shape = 7 THEN 1 END AS location FROM answered)"""


def answered(spark: SparkSession, folder: str) -> DataFrame:
    """A JSON answer per document: plain, fenced, with stray commas, in prose, as a Python literal,
    a list, no JSON at all, odd value types."""
    docs = documents(spark, folder)
    s = (1 + F.col("n_chars") % 7).cast("string")
    f = (1 + (F.col("n_chars") + F.col("doc_id")) % 6).cast("string")
    shapes = [
        F.concat(F.lit('{"overall_score": '), s, F.lit(', "aspects": {"food": '), f, F.lit(', "price": "2"}}')),
        F.concat(F.lit('```json\n{"overall_score": '), s, F.lit('.7, "aspects": {"service": '), f, F.lit("}}\n```")),
        F.concat(F.lit('{"overall_score": "'), s, F.lit('", "aspects": {"food": '), f, F.lit(', "price": 9,},}')),
        F.concat(F.col("text"), F.lit('\n{"overall_score": '), s, F.lit(', "aspects": ["food"]}\nThanks')),
        F.concat(F.lit("{'overall_score': "), s, F.lit(", 'aspects': {'ambience': "), f, F.lit(", 'price': None}}")),
        F.concat(F.lit('[{"overall_score": '), s, F.lit('}, {"overall_score": 1}]')),
        F.col("text"),
        F.concat(F.lit('{"overall_score": "'), s, F.lit('.0", "aspects": {"location": true, "food": null}}')),
    ]
    answer = F.element_at(F.array(*shapes), (F.col("doc_id") % 8 + 1).cast("int"))
    return read_scores(docs.select("doc_id", answer.alias("raw_model_output"), F.lit(None).cast("string").alias("error")))


@query(f"WITH {_PARSED_SQL} SELECT doc_id, predicted_score_label, food, service, price, ambience, location FROM parsed")
def extract_json_scores(spark: SparkSession, folder: str) -> DataFrame:
    aspects = ("food", "service", "price", "ambience", "location")
    return answered(spark, folder).select(
        "doc_id",
        "predicted_score_label",
        *[F.try_element_at("predicted_aspects", F.lit(a)).alias(a) for a in aspects],
    )


@query(
    f"""WITH {_PARSED_SQL}, long AS (
      SELECT aspect, score FROM (UNPIVOT (SELECT food, service, price, ambience, location FROM parsed)
        ON food, service, price, ambience, location INTO NAME aspect VALUE score))
    SELECT aspect, count(*) AS n, round(avg(score), 6) AS mean_score, count(*) FILTER (WHERE score > 3) AS positive,
      count(*) FILTER (WHERE score < 3) AS negative FROM long GROUP BY 1"""
)
def aspect_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(summarise_aspects(answered(spark, folder), "predicted_aspects"), "mean_score")


@query(
    "SELECT k AS aspect_score, count(*) AS n, max(json) AS sample FROM (SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, "
    "'{\"k\":' || json_extract_string(props, '$.k') || '}' AS json FROM events) WHERE k BETWEEN 1 AND 5 GROUP BY 1"
)
def json_field(spark: SparkSession, folder: str) -> DataFrame:
    """Scores out of a stored JSON field, in range only, and back to JSON."""
    props = F.from_json(F.concat(F.lit('{"aspects": '), "props", F.lit("}")), "aspects map<string, variant>")
    scores = answers.aspect_scores(props)
    found = table(spark, folder, "events").select(scores.alias("scores")).where(F.size("scores") > 0)
    return found.groupBy(F.col("scores")["k"].alias("aspect_score")).agg(
        F.count(F.lit(1)).alias("n"), F.max(answers.aspects_json(F.col("scores"))).alias("sample")
    )


def _shape_encoder() -> Callable:
    """Characters, blanks and line breaks of each text."""

    def encode(texts: np.ndarray) -> np.ndarray:
        return np.array([[len(t or ""), (t or "").count(" "), (t or "").count("\n")] for t in texts], np.float32)

    return encode


@query(
    """SELECT doc_id, CAST(length(text) AS DOUBLE) AS chars,
      CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS blanks,
      CAST(length(text) - length(replace(text, chr(10), '')) AS DOUBLE) AS breaks FROM documents"""
)
def encode_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Every document through the batch encoder, here one that gives three counts, texts of like length together."""
    rows = encode_by_length(documents(spark, folder).select("doc_id", "text"), "text", _shape_encoder)
    named = [F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(("chars", "blanks", "breaks"))]
    return rows.select("doc_id", *named)
