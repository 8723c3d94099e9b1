import ast
import json
import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opinloom.functions import answers, cleaning, labels, prompts, tokens

BLANKS = "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f \x85\xa0     　"


def test_clean_text_edges(column):
    values = [None, "", "a\r\n\nb", "\ta\t b ", "a\xa0b", "x\x1cy", BLANKS, "a  b", "é ü"]
    assert column(values, cleaning.clean_text) == ["", "", "a b", "a b", "a b", "x y", "", "a b", "é ü"]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab.é" + BLANKS, max_size=30), min_size=1, max_size=40))
def test_clean_text_like_python(column, values):
    assert column(values, cleaning.clean_text) == [re.sub(r"\s+", " ", v).strip() for v in values]


def test_strip_only_touches_the_ends(column):
    assert column([" a  b\xa0", "\x1f", None], cleaning.strip) == ["a  b", "", None]


def test_parse_number(column):
    values = ["abc", None, "3.7", "-1.7", "4", "1e3", " 5 ", "3.7d", "1f", "", ".5", "5.", "0x10", "inf", "-Infinity"]
    expected = [None, None, 3.7, -1.7, 4.0, 1000.0, 5.0, None, None, None, 0.5, 5.0, None, float("inf"), float("-inf")]
    assert column(values, cleaning.parse_number) == expected


def test_nan_is_missing(column):
    assert column([1.5, float("nan"), None], lambda c: cleaning.as_number(c, False), "double") == [1.5, None, None]
    assert column(["nan"], lambda c: cleaning.as_number(c, True)) == [None]


def test_na_tokens(column):
    values = ["NA", "None", "null", "N/A", "nan", "", "n/a", "Nanna", "na", None]
    assert column(values, cleaning.na_to_null) == [None] * 7 + ["Nanna", "na", None]


def test_document_drops_blank_parts(spark):
    df = spark.createDataFrame([(" a ", None, "\xa0", "b\n"), ("", "", None, None)], "a string, b string, c string, d string")
    rows = df.select(cleaning.document(*[F.col(c) for c in "abcd"]).alias("d")).collect()
    assert [r.d for r in rows] == ["a b", ""]


def test_words(column):
    text = "L'été à naïve a I x_1 ½½ 10² Good-FOOD"
    assert column([text], tokens.words) == [["été", "naïve", "x_1", "½½", "10²", "good", "food"]]
    decomposed = "café au"
    assert column([decomposed], tokens.words) == [re.findall(r"\b\w\w+\b", decomposed)]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aB_1é½²́ -'", max_size=30), min_size=1, max_size=40))
def test_words_like_python(column, values):
    assert column(values, tokens.words) == [re.findall(r"(?u)\b\w\w+\b", v.lower()) for v in values]


def test_ngrams(column):
    values = [["a", "b", "c"], ["a"], []]
    assert column(values, lambda c: tokens.ngrams(c, 2), "array<string>") == [["a b", "b c"], [], []]
    assert column(values, lambda c: tokens.ngrams(c, 3), "array<string>") == [["a b c"], [], []]
    assert column(values[:1], lambda c: tokens.ngram_range(c, 1, 2), "array<string>") == [["a", "b", "c", "a b", "b c"]]


def test_score_and_polarity(column):
    assert column([3.7, -1.7, 4.0, None], labels.to_score, "double") == [3, -1, 4, None]
    assert column([1, 2, 3, 4, 5, 0, 6, -1, None], labels.to_polarity, "int") == [-1, -1, 0, 1, 1, 0, 0, 0, 0]


def test_class_index_round_trip(column):
    known = [-1, 0, 1]
    assert column([1, -1, 0, 7], lambda c: labels.class_index(c, known), "int") == [2.0, 0.0, 1.0, None]
    assert column([0.0, 2.0, 3.0], lambda c: labels.class_label(c, known), "double") == [-1, 1, None]
    assert column([[0.1, 0.7, 0.7]], labels.argmax, "array<double>") == [1.0]


def test_extract_label(column):
    values = ["positive, no: Negative", "NEUTRAL", "positively", "", "positiveé", "x positive.", None, "no_positive"]
    assert column(values, answers.extract_label) == [
        "negative", "neutral", "unknown", "unknown", "unknown", "positive", "unknown", "unknown"
    ]
    assert column(["negative", "neutral", "positive", "unknown"], answers.label_to_polarity) == [-1, 0, 1, None]


def parsed(column, values):
    def read(c):
        text = answers.object_text(c)
        found = answers.parse_object(text, answers.without_stray_commas(text))
        return F.struct(answers.overall_score(found).alias("score"), answers.aspect_scores(found).alias("aspects"))

    return [(r.score, r.aspects) for r in column(values, read)]


def test_answers(column):
    cases = {
        '{"overall_score": 4, "aspects": {"food": 5}}': (4, {"food": 5}),
        '```json\n{"overall_score": 4}\n```': (4, {}),
        '```JSON {"overall_score": 3, "aspects": {"price": 2}} ```': (3, {"price": 2}),
        'Sure! {"overall_score": 2, "aspects": {"a": 1}} Bye': (2, {"a": 1}),
        '{"overall_score": 4, "aspects": {"food": 5,},}': (4, {"food": 5}),
        "{'overall_score': 4, 'aspects': {'food': True, 'x': None}}": (4, {"food": 1}),
        "{'overall_score': true}": (None, {}),
        '[{"overall_score": 2}]': (2, {}),
        '[{"overall_score": 2}, {"overall_score": 3}]': (None, {}),
        '{"overall_score": 1} and {"overall_score": 2}': (None, {}),
        '{"overall_score": 4}}': (None, {}),
        '{"overall_score": 4, "asp': (None, {}),
        "no json": (None, {}),
        "": (None, {}),
        None: (None, {}),
        '{"overall_score": 4, "aspects": ["food"]}': (4, {}),
        '{"overall_score": 4, "aspects": null}': (4, {}),
        '{"overall_score": 2, "aspects": {"food": 3, "food": 9}}': (2, {}),
        '{"overall_score": 1, "overall_score": 3, "aspects": {"food": 9, "food": 3}}': (3, {"food": 3}),
        '{"aspects": {"a": {"b": 1}, "c": "x", "d": "3", "e": 4.9}}': (None, {"d": 3, "e": 4}),
        "{}": (None, {}),
        '{"overall_score": "it\'s"}': (None, {}),
    }
    found = parsed(column, list(cases))
    assert dict(zip(cases, found)) == cases


def test_clamped_scores(column):
    for text, score in {
        "4": 4, "4.7": 4, '"4"': 4, '"4.0"': None, "true": 1, "null": None, "0": None, "6": None, "[4]": None,
        '" 3 "': 3, "5.99": 5, "-1": None,
    }.items():
        assert parsed(column, [f'{{"overall_score": {text}}}']) == [(score, {})], text


def test_prompts(spark):
    df = spark.createDataFrame([("it's {review} 100%",)], "r string")
    shown = [prompts.Example("good", "positive"), prompts.Example("bad {examples}", "negative")]
    one, few, score = df.select(
        prompts.render(prompts.ZERO_SHOT_POLARITY, F.col("r")),
        prompts.render(prompts.FEW_SHOT_POLARITY, F.col("r"), shown),
        prompts.render(prompts.ZERO_SHOT_SCORE, F.col("r")),
    ).first()
    assert one.endswith("Review:\nit's {review} 100%")
    assert "Review: good\nSentiment: positive\n\nReview: bad {examples}\nSentiment: negative\n\nReview: it's" in few
    assert few.endswith("Sentiment:")
    assert '{"overall_score": n' in score and "cleanliness" in score


def random_literal(rng, depth=0):
    """A Python literal as text, with any quotes, escapes, tuples and closing commas."""
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind == 0:
        return rng.choice(["True", "False", "None"])
    if kind == 1:
        return repr(rng.choice([0, 7, -3, 12345678901, 1.5, -0.25, 1e20, 2.5e-7])) if rng.random() < 0.8 else rng.choice(["+4", ".5", "3.", "-.5"])
    if kind < 5:
        quote = rng.choice("'\"")
        parts = ["a", "Z", " ", "é", "日", ",", ":", "{", "]", "(", "None", "True", "true", ",}", "\\n", "\\t", "\\\\", "\\'", '\\"', "\\x41", "\\u00e9", "\\q", "/", "0"]
        return quote + "".join(rng.choice([*parts, {"'": '"', '"': "'"}[quote]]) for _ in range(rng.randrange(6))) + quote
    inner = [random_literal(rng, depth + 1) for _ in range(rng.randrange(4))]
    space = lambda: rng.choice(["", " ", "\n "])
    if kind == 5:
        return "[" + space() + (", " + space()).join(inner) + ("," if inner and rng.random() < 0.3 else "") + space() + "]"
    if kind == 6:
        return "(" + ",".join(inner) + ("," if len(inner) == 1 else "") + ")"
    items = [f"'k{i}'{space()}:{space()}{v}" for i, v in enumerate(inner)]
    return "{" + (space() + ",").join(items) + (" ," if items and rng.random() < 0.3 else "") + "}"



def test_python_literals_equal_python(column):
    rng = random.Random(11)
    texts = [random_literal(rng) for _ in range(2000)]

    def plain(v):
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v

    found = column(texts, answers.literal_as_json)
    for text, json_text in zip(texts, found, strict=True):
        assert json_text is not None, text
        assert json.loads(json_text) == plain(ast.literal_eval(text)), text
    broken = ["{'a': tru}", "{'a': true}", "{'a': 'b}", "a b c", "{'a': @}", "x = 1", None]
    assert column(broken, answers.literal_as_json) == [None] * len(broken)
