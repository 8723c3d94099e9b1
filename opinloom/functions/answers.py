"""Reading labels, scores and aspects out of free-text model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinloom.contract import POLARITY_WORDS

LABEL_WORD = rf"(?<![\p{{L}}\p{{N}}_])({'|'.join(POLARITY_WORDS)})(?![\p{{L}}\p{{N}}_])"
# One candidate wrapped in brackets: text after the object then makes the whole malformed.
ANSWER = "array<struct<overall_score: variant, aspects: map<string, variant>>>"


def extract_label(answer: Column) -> Column:
    """The last whole-word label named in the answer, else ``unknown``."""
    found = F.regexp_extract_all(F.lower(answer), F.lit(LABEL_WORD), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("unknown"))


def label_to_polarity(label: Column) -> Column:
    """-1, 0 or 1; null for anything that is not a label."""
    rule = F.lit(None).cast("int")
    for word, value in POLARITY_WORDS.items():
        rule = F.when(label == word, F.lit(value)).otherwise(rule)
    return rule


# --- fixed values: the braced part of an answer, commas that JSON does not allow ---
BRACED = r"(?s)\{.*\}"
STRAY_COMMA = r",\s*([}\]])"


def object_text(answer: Column) -> Column:
    """From the first opening to the last closing brace; null if there is none.

    Code fences and prose around an object fall away; an answer that is an object as a whole is
    its own longest braced part.
    """
    return F.nullif(F.regexp_extract(answer, BRACED, 0), F.lit(""))


def without_stray_commas(text: Column) -> Column:
    """Drop commas before a closing bracket."""
    return F.regexp_replace(text, STRAY_COMMA, "$1")


def _parse(text: Column, single_quotes: bool) -> Column:
    wrapped = F.concat(F.lit("["), text, F.lit("]"))
    parsed = F.from_json(wrapped, ANSWER, {"allowSingleQuotes": str(single_quotes).lower()})
    return F.when(F.size(parsed) == 1, F.get(parsed, F.lit(0)))


# --- fixed values: the tokens of a Python literal, the parts of its strings, what its names and escapes mean in JSON ---
TOKEN = r"""(?s)'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"|[A-Za-z_]+|[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?|[\{\}\[\](),:]|\s+"""
CHARACTER = r"(?s)\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.|[^\\]"
NAMES = {"True": "true", "False": "false", "None": "null"}
ESCAPES = {"\\'": "'", "\\a": "\\u0007", "\\v": "\\u000b", "\\\n": "", '"': '\\"', "\t": "\\t"}
KEPT_ESCAPES = ['\\"', "\\\\", "\\n", "\\r", "\\t", "\\b", "\\f"]


def _json_character(c: Column) -> Column:
    """A character or escape of a Python string as JSON writes it."""
    rule = F.when(c.isin(*KEPT_ESCAPES) | c.startswith("\\u"), c)
    for python, json in ESCAPES.items():
        rule = rule.when(c == python, F.lit(json))
    rule = rule.when(c.startswith("\\x"), F.concat(F.lit("\\u00"), F.substring(c, 3, 2)))
    return rule.when(c.startswith("\\"), F.concat(F.lit("\\"), c)).otherwise(c)


def _json_token(token: Column) -> Column:
    """A token of a Python literal as JSON writes it; null for a name that Python does not know."""
    inside = F.regexp_extract_all(F.substring(token, 2, F.length(token) - 2), F.lit(CHARACTER), F.lit(0))
    string = F.concat(F.lit('"'), F.array_join(F.transform(inside, _json_character), ""), F.lit('"'))
    rule = F.when(token.startswith("'") | token.startswith('"'), string).when(token == "(", "[").when(token == ")", "]")
    for python, json in NAMES.items():
        rule = rule.when(token == python, F.lit(json))
    number = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, r"^\+", ""), r"^(?<sign>-?)\.", "${sign}0."), r"\.(?![0-9])", ".0")
    return rule.when(token.rlike("^[A-Za-z_]"), F.lit(None)).when(token.rlike(r"^[-+.0-9]"), number).otherwise(token)


def literal_as_json(text: Column) -> Column:
    """A Python literal of dicts, lists, tuples, strings, numbers and the three names as JSON text; null for other text.

    The text is cut into tokens, so quotes, commas and names inside a string are left alone. A comma before a closing
    bracket goes. Brackets around a single value count as a list.
    """
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    known = F.filter(tokens, lambda t: F.trim(F.translate(t, "\t\n\r\f\x0b", "     ")) != "")
    last = lambda t, i: (t == ",") & F.get(known, i + 1).isin("}", "]", ")")
    told = F.transform(F.filter(known, lambda t, i: ~F.coalesce(last(t, i), F.lit(False))), _json_token)
    whole = (F.array_join(tokens, "") == text) & ~F.exists(told, lambda t: t.isNull())
    return F.when(whole, F.array_join(told, " "))


def _parse_literal(text: Column) -> Column:
    return _parse(literal_as_json(text), False)


def parse_object(text: Column, repaired: Column) -> Column:
    """The object as ``struct<overall_score variant, aspects map<string, variant>>``.

    The braced text is tried first, then the same without stray commas; null if neither parses.
    """
    attempts = [attempt for shape in (text, repaired) for attempt in (_parse(shape, False), _parse_literal(shape))]
    return F.coalesce(*attempts)


def clamp_score(value: Column) -> Column:
    """An integer 1..5, truncating fractions; null for anything else."""
    score = F.try_variant_get(value, "$", "int")
    return F.when(score.between(1, 5), score)


def overall_score(parsed: Column) -> Column:
    return clamp_score(parsed["overall_score"])


def aspect_scores(parsed: Column) -> Column:
    """Valid aspect scores; for a repeated key the last value counts. Never null."""
    entries = F.map_entries(parsed["aspects"])
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]
        ),
    )
    scores = F.transform_values(F.map_from_entries(last), lambda _, v: clamp_score(v))
    valid = F.map_filter(scores, lambda _, v: v.isNotNull())
    return F.coalesce(valid, F.from_json(F.lit("{}"), "map<string, int>"))


def aspects_json(aspects: Column) -> Column:
    """The aspect map as a JSON string."""
    return F.to_json(aspects)
