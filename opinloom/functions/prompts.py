"""Prompt rendering for zero-shot and few-shot labelling.

A template holds ``{review}`` and, for few-shot, ``{examples}``; any other wording can be passed in.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinloom.contract import ASPECTS, POLARITY_WORDS, SCORES


@dataclass(frozen=True)
class Example:
    """A worked example shown to the model."""

    review: str
    answer: str


@dataclass(frozen=True)
class Template:
    system: str
    text: str
    example: str = ""


_LABELS = ", ".join(POLARITY_WORDS)
_SCHEMA = '{"overall_score": n, "aspects": {"<aspect>": n}}'
_SCALE = f"n is a whole number from {SCORES[0]} to {SCORES[-1]}"

ZERO_SHOT_POLARITY = Template(
    system=f"You label the sentiment of customer reviews. Answer with one word: {_LABELS}.",
    text="Which sentiment does this customer review express?\n"
    f"Choose one of {_LABELS} and answer with that word only.\n\nReview:\n{{review}}",
)
FEW_SHOT_POLARITY = Template(
    system=ZERO_SHOT_POLARITY.system,
    text="Each customer review below is followed by its sentiment.\n"
    f"Continue with one of {_LABELS} for the last one.\n\n{{examples}}Review: {{review}}\nSentiment:",
    example="Review: {review}\nSentiment: {answer}\n\n",
)
ZERO_SHOT_SCORE = Template(
    system="You rate customer reviews and answer in JSON only.",
    text="Rate this customer review as a whole and by each aspect it mentions.\n"
    f"Aspects: {', '.join(ASPECTS)}. Leave out aspects that are not mentioned.\n"
    f"Answer with {_SCHEMA}, where {_SCALE}.\n\nReview:\n{{review}}",
)
FEW_SHOT_SCORE = Template(
    system=ZERO_SHOT_SCORE.system,
    text="Rate the last customer review as in the examples.\n"
    f"Answer with {_SCHEMA}, where {_SCALE}.\n\n{{examples}}Review: {{review}}\nJSON:",
    example="Review: {review}\nJSON: {answer}\n\n",
)


def request(template: Template, review: Column, examples: Sequence[Example] = ()) -> Column:
    """The whole request to a model: its system text and the prompt, as ``struct<system, prompt>``."""
    return F.struct(F.lit(template.system).alias("system"), render(template, review, examples).alias("prompt"))


def chat(request: Column) -> Column:
    """A request as the JSON list of messages that chat models take."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.to_json(F.array(message("system", request["system"]), message("user", request["prompt"])))


def render(template: Template, review: Column, examples: Sequence[Example] = ()) -> Column:
    """The prompt column: constant text around the review."""
    if examples and not template.example:
        raise ValueError("this template takes no examples")
    shown = "".join(
        template.example.replace("{answer}", e.answer).replace("{review}", e.review) for e in examples
    )
    before, after = template.text.split("{review}")
    return F.concat(F.lit(before.replace("{examples}", shown)), review, F.lit(after))
