import json
import math
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from opinloom.contract import ENCODER_FRACTION, PREPARED_COLUMNS, USER_SCAN_EXCLUDES
from opinloom.functions.prompts import ZERO_SHOT_POLARITY, Example
from opinloom.operators import word_vectors
from opinloom.operators.features import chosen_words, exact_vectors, feature_width, fit_vectorizer, vector_terms
from opinloom.operators.inference import answered, complete, encode, encode_by_length
from opinloom.operators.ordering import with_scan_ordinal
from opinloom.plans import labelling, training
from opinloom.plans.prepare import prepare, prepare_split
from opinloom.session import work_path
from opinloom.sources import tables
from opinloom.sources.delimited import scan_csv, sink_csv
from opinloom.sources.jsonl import scan_jsonl

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not see the tests folder

REVIEWS = [
    (0, "b1", "u1", "good\r\n food", "5", "2"),
    (1, "b1", None, None, "3.7", "x"),
    (2, None, "u2", " a\xa0b ", "1", None),
    (3, "zz", "u1", "no stars", "n/a", "1"),
    (4, "b2", "u9", "six", "6", "1e1"),
]


@pytest.fixture
def raw(spark):
    reviews = spark.createDataFrame(REVIEWS, "ordinal bigint, business_id string, user_id string, text string, stars string, useful string")
    business = spark.createDataFrame(
        [("b1", " The  Bar", "Bars", 4.5, "10", "{}"), ("b2", None, None, float("nan"), "?", "{}"), (None, "Nowhere", "x", 1.0, "1", "{}")],
        "business_id string, name string, categories string, stars double, review_count string, attributes string",
    )
    users = spark.createDataFrame([("u1", "Ann", 7, 3), (None, "Nobody", 1, 0)], "user_id string, name string, review_count bigint, compliment_hot int")
    return reviews, business, users


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_prepare(spark, raw, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        df = prepare(*raw)
        assert df.columns == ["ordinal", *PREPARED_COLUMNS] and len(PREPARED_COLUMNS) == 33
        found = {r.ordinal: r for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(found) == [0, 1, 2, 4]  # the review without a score is gone
    assert (found[0].review_text, found[0].business_name, found[0].user_name) == ("good food", "The Bar", "Ann")
    assert (found[0].review_useful, found[0].business_review_count, found[0].user_compliment_hot) == (2.0, 10.0, 3.0)
    # null keys match null keys
    assert (found[1].review_text, found[1].user_name, found[1].score_label, found[1].review_useful) == ("", "Nobody", 3, 0.0)
    assert (found[2].review_text, found[2].business_name, found[2].user_name) == ("a b", "Nowhere", "")
    # no match, NaN and bad numbers become 0, a score out of range is neutral
    assert (found[4].business_stars, found[4].business_review_count, found[4].user_review_count) == (0.0, 0.0, 0.0)
    assert (found[4].score_label, found[4].polarity_label, found[4].review_useful, found[4].business_state) == (6, 0, 10.0, "")
    assert [found[i].polarity_label for i in (0, 1, 2)] == [1, 0, -1]
    assert all(v is not None for r in found.values() for v in r)


def test_prepare_split(spark, raw):
    reviews, business, users = raw
    train, test = prepare_split(reviews, business, users, 0.5)
    assert [sorted(r.ordinal for r in part.collect()) for part in (train, test)] == [[0, 1], [2, 4]]
    copies = business.unionByName(business.where("business_id = 'b1'"))  # six rows: 0, 0, 1, 1, 2, 4
    train, test = prepare_split(reviews, copies, users, 0.5)
    assert [sorted(r.ordinal for r in part.collect()) for part in (train, test)] == [[0, 0, 1], [1, 2, 4]]


TEXTS = [
    (i, *pair)
    for i, pair in enumerate(
        [("lovely food and kind staff", 1), ("awful food and rude staff", -1), ("plain food okay staff", 0)] * 12
    )
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id int, text string, label int").cache()


@pytest.mark.parametrize(
    "name, options",
    [
        ("count_logreg", {}), ("tfidf_logreg", {}), ("tfidf_svm", {"max_iter": 20}),
        ("count_forest", {"trees": 10, "depth": 5}), ("tfidf_mlp", {"hidden": (8,)}),
    ],
)
def test_text_models_learn(texts, name, options):
    # few slots: trees draw a square root of them for each split
    narrow = fit_vectorizer(texts, "text", name.split("_")[0], 64)
    model = training.fit_text_model(texts, "text", "label", name, narrow, **options)
    predicted = training.predict(model, texts)
    assert predicted.columns == ["id", "text", "label", "predicted_label"]
    assert predicted.where("label != predicted_label").count() == 0


def test_saved_model_predicts_the_same(spark, texts):
    for name in ("tfidf_mlp", "tfidf_svm", "tfidf_logreg"):
        model = training.fit_text_model(texts, "text", "label", name)
        path = work_path(spark, "model")
        tables.save_model(model, path)
        again = training.predict(tables.load_model(path), texts)
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, training.predict(model, texts).collect()))
    assert {r.label: r.f1 for r in training.evaluate(model, texts, "label").collect()} == {-1: 1.0, 0: 1.0, 1: 1.0}


@pytest.mark.parametrize("name", ["tfidf_logreg", "count_svm", "count_mlp"])
def test_training_curve_ends_at_the_model(texts, name):
    noisy = texts.withColumn("label", F.when(F.col("id") % 7 == 0, -F.col("label")).otherwise(F.col("label")))
    curve = sorted(training.training_curve(noisy, "text", "label", name).collect())
    assert len(curve) > 1 and curve[-1].objective < curve[0].objective
    predicted = training.predict(training.fit_text_model(noisy, "text", "label", name), noisy)
    assert curve[-1].accuracy == pytest.approx(predicted.where("label = predicted_label").count() / len(TEXTS))


def test_chosen_words_tell_labels_apart(texts):
    """The statistic against the table of word and label counts in plain Python."""
    labels, words = [v for *_, v in TEXTS], [set(t.split()) for _, t, _ in TEXTS]

    def statistic(word):
        out, n = 0.0, len(labels)
        for v in set(labels):
            for held in (True, False):
                seen = sum((word in w) == held and x == v for w, x in zip(words, labels, strict=True))
                expected = sum((word in w) == held for w in words) * labels.count(v) / n
                out += (seen - expected) ** 2 / expected if expected else 0
        return out

    expected = sorted(set().union(*words), key=lambda w: (-round(statistic(w), 9), w))
    assert chosen_words(texts, "text", "label", 20) == expected
    narrow = training.fit_text_vectorizer(texts, "text", "count_forest", "label")
    assert feature_width(narrow) == len(expected)


def test_hashing_leaves_no_term_out(texts):
    model = fit_vectorizer(texts, "text", "count", 4)
    counted = vector_terms(model.transform(texts), "id", "features")
    assert counted.agg(F.max("slot")).first()[0] < 4
    assert counted.agg(F.sum("value")).first()[0] == sum(len(t.split()) for _, t, _ in TEXTS)
    weighed = vector_terms(fit_vectorizer(texts, "text", "tfidf", 4).transform(texts), "id", "features")
    norms = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("n")).collect()
    assert all(math.isclose(r.n, 1.0) for r in norms)


def test_vector_slots_are_alphabetical_in_any_layout(spark):
    rows = [(i, " ".join(f"w{(i * k) % 37:02d}" for k in range(1, 9))) for i in range(60)]
    docs = spark.createDataFrame(rows, "id int, text string")
    found = [sorted(map(str, exact_vectors(part, "id", "text", "count").collect())) for part in (docs, docs.repartition(5, "text"))]
    assert found[0] == found[1]
    vocabulary = sorted({w for _, t in rows for w in t.split()})
    first = exact_vectors(docs, "id", "text", "count").where("id = 1").first()
    assert [vocabulary[i] for i in first.indices] == sorted(set(rows[1][1].split())) and first.size == len(vocabulary)


def test_models_share_their_features(texts):
    features = training.fit_text_vectorizer(texts, "text", "tfidf_logreg")
    for name in ("tfidf_logreg", "tfidf_svm"):
        model = training.fit_text_model(texts, "text", "label", name, features)
        assert model.stages[0].uid == features.stages[0].uid
        assert training.predict(model, texts).where("label != predicted_label").count() == 0


def test_bad_inputs(texts):
    with pytest.raises(ValueError):
        fit_vectorizer(texts, "text", "other", 4)
    with pytest.raises(ValueError):
        exact_vectors(texts, "id", "text", "other")
    with pytest.raises(ValueError, match="vocabulary"):
        fit_vectorizer(texts.withColumn("text", F.lit("a ! b")), "text", "count", 4)
    with pytest.raises(ValueError, match="no labelled rows"):
        training.fit_text_model(texts.where("id < 0"), "text", "label", "count_logreg")
    with pytest.raises(ValueError, match=r"\[1, 5\]"):
        training.fit_text_model(texts.withColumnRenamed("label", "score_label"), "text", "score_label", "count_logreg")
    with pytest.raises(ValueError):
        model = training.fit_text_model(texts, "text", "label", "count_logreg", max_iter=2)
        training.evaluate(model, texts.where("id < 0"), "label")


def test_embedding_heads(spark):
    rows = [(i, [float(i % 2), float(i % 3 == 0), 0.5], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, embedding array<float>, label int")
    for kind, options in (("logreg", {}), ("perceptron", {"hidden": [6]})):
        model = training.fit_embedding_model(df, "embedding", "label", kind, **options)
        predicted = training.predict(model, training.embedding_vector(df, "embedding"))
        assert predicted.where("label != predicted_label").count() == 0


def fussy():
    calls = []

    def answer(prompt):
        calls.append(prompt)
        if "boom" in prompt:
            raise RuntimeError("no answer")
        return '{"overall_score": 5, "aspects": {"food": 4}}' if "JSON" in prompt else "I say positive"

    return answer


def test_labelling(spark):
    rows = [(2, "fine", 1, 5), (0, "boom", -1, 1), (1, None, 0, 3), (3, "late", 1, 5)]
    df = spark.createDataFrame(rows, "ordinal int, review_text string, polarity_label int, score_label int")
    found = {r.ordinal: r for r in labelling.label_polarity(df, fussy, limit=3).collect()}
    assert sorted(found) == [0, 1, 2]
    assert (found[0].raw_model_output, found[0].error, found[0].predicted_polarity_label) == ("__ERROR__: no answer", "no answer", None)
    assert found[1].predicted_polarity_label == 1
    assert labelling.valid_polarities(labelling.label_polarity(df, fussy, limit=0, requests=2)).count() == 3
    shown = [Example("x", '{"overall_score": 1}')]
    scored = labelling.label_scores(df, fussy, limit=0, examples=shown)
    output = labelling.prediction_output(scored, "predicted_score_label", "score_label")
    assert output.columns == ["predicted_score_label", "score_label", "review_text", "predicted_aspects", "raw_model_output", "error"]
    kept = labelling.valid_scores(output).collect()
    assert [(r.predicted_score_label, r.predicted_aspects) for r in kept] == [(5, {"food": 4})] * 3
    assert output.where("error is not null").first().predicted_aspects == {}
    with pytest.raises(KeyError):
        labelling.label_polarity(df.drop("polarity_label"), fussy)
    with pytest.raises(ValueError):
        labelling.label_polarity(df.where("ordinal > 9"), fussy)


def test_examples_skip_blank_texts(spark):
    rows = [(0, " ", 1), (1, "first", 1), (2, "second", 1), (3, "bad", -1), (4, None, 0)]
    df = spark.createDataFrame(rows, "ordinal int, review_text string, label int")
    shown = labelling.pick_examples(df, "review_text", "label")
    assert shown == [Example("bad", "negative"), Example("first", "positive")]
    objects = labelling.pick_examples(df.withColumn("label", F.col("label") + 3), "review_text", "label", answer=labelling.score_answer)
    assert objects == [Example("bad", '{"overall_score": 2, "aspects": {}}'), Example("first", '{"overall_score": 4, "aspects": {}}')]


def test_example_answers_read_back_to_their_labels(spark):
    said = [(labelling.polarity_answer(v), labelling.score_answer(s), v, s) for v in (-1, 0, 1) for s in range(1, 6)]
    df = spark.createDataFrame([(*r, None) for r in said], "word string, object string, v int, s int, error string")
    words = labelling.read_polarity(df.withColumnRenamed("word", "raw_model_output"))
    assert words.where("not (predicted_polarity_label <=> v)").count() == 0
    objects = labelling.read_scores(df.withColumnRenamed("object", "raw_model_output"))
    assert objects.where("not (predicted_score_label <=> s)").count() == 0


def test_the_model_gets_the_system_text(spark):
    df = spark.createDataFrame([(1, "fine", 1)], "ordinal int, review_text string, polarity_label int")

    def echo():
        return lambda prompt: prompt

    asked = json.loads(labelling.label_polarity(df, echo).first().raw_model_output)
    assert [m["role"] for m in asked] == ["system", "user"]
    assert asked[0]["content"] == ZERO_SHOT_POLARITY.system and asked[1]["content"].endswith("fine")


def test_completer_is_made_once_per_task(spark, tmp_path):
    def make():
        import uuid

        (tmp_path / uuid.uuid4().hex).write_text("")
        return lambda p: p.upper()

    df = spark.createDataFrame([(str(i),) for i in range(500)], "p string").coalesce(1)
    assert complete(df, "p", make).where("raw_model_output != upper(p)").count() == 0
    assert len(list(tmp_path.iterdir())) <= 2


def test_encode_keeps_rows_and_order_of_values(spark):
    def make():
        import numpy as np

        return lambda texts: np.array([[len(t), t.count("a")] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([("banana",), ("x",)], "t string")
    assert sorted((r.t, r.embedding) for r in encode(df, "t", make).collect()) == [("banana", [6.0, 3.0]), ("x", [1.0, 0.0])]


def test_encode_by_length_equals_plain_encoding(spark):
    rows = [(i, "alpha beta " * (i % 17) + f"gamma delta{i % 5}") for i in range(200)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "i int, t string").repartition(3)
    encoder = word_vectors.fit(df, "t", vocabulary=8, width=4)
    assert len(encoder.places) == 8 and encoder.vectors.shape == (8, 4)
    found = {r.i: r.embedding for r in encode_by_length(df, "t", word_vectors.shipped(encoder, spark), batch_size=16).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        known = [encoder.vectors[encoder.places[w]] for w in (t or "").split() if w in encoder.places]
        assert found[i] == pytest.approx(sum(known) / len(known) if known else [0] * 4, abs=1e-6)


def test_word_vectors_count_each_pair_once(spark):
    df = spark.createDataFrame([("aa bb cc aa",), ("bb zz zz zz zz zz aa",), (None,)], "t string")
    encoder = word_vectors.fit(df, "t", vocabulary=10, window=2, width=3)
    order = list(encoder.places)
    near = {("aa", "bb"): 2, ("aa", "cc"): 2, ("bb", "cc"): 1, ("bb", "zz"): 2, ("zz", "zz"): 7, ("aa", "zz"): 2}
    matrix = np.zeros((4, 4))
    for (a, b), n in near.items():
        matrix[order.index(a), order.index(b)] += n
        matrix[order.index(b), order.index(a)] += n
    assert np.allclose(np.abs(encoder.vectors), np.abs(word_vectors._factors(matrix, 3)))
    assert word_vectors.fit(df.where("t is null"), "t").encode(["aa"]).tolist() == [0.0] * word_vectors.WIDTH


def test_a_prompt_is_asked_once_over_all_runs(spark, tmp_path):
    calls, store = tmp_path / "calls", work_path(spark, "answers")
    calls.mkdir()
    df = spark.createDataFrame([(i, f"prompt {i % 30}" if i else None) for i in range(90)], "i int, p string")

    def make(fails):
        def build():
            import uuid

            def answer(prompt):
                if prompt in fails:
                    raise RuntimeError("not now")
                (calls / uuid.uuid4().hex).write_text(prompt)
                return prompt.upper()

            return answer

        return build

    def asked():
        return sorted(f.read_text() for f in calls.iterdir())

    first = answered(df, "p", make({"prompt 7"}), store, requests=4)
    assert set(first.columns) == {"i", "p", "error", "raw_model_output"}
    rows = first.collect()
    assert len(rows) == 90 and {r.p for r in rows if r.error} == {"prompt 7"}
    prompts = sorted({"", *(f"prompt {i}" for i in range(30))})
    assert asked() == sorted(set(prompts) - {"prompt 7"})
    rows = answered(df, "p", make(set()), store, requests=4).collect()
    assert all(r.error is None and r.raw_model_output == (r.p or "").upper() for r in rows)
    assert asked() == prompts


def test_a_killed_run_repeats_no_finished_task(spark, tmp_path):
    calls, store = tmp_path / "calls", work_path(spark, "answers")
    calls.mkdir()
    df = spark.createDataFrame([(f"prompt {i}",) for i in range(40)], "p string")

    def make(dies):
        def build():
            import os
            import time
            import uuid

            def answer(prompt):
                if dies and prompt == "prompt 13":
                    time.sleep(4)
                    os._exit(1)
                (calls / uuid.uuid4().hex).write_text(prompt)
                return prompt

            return answer

        return build

    with pytest.raises(Exception):  # noqa: B017
        answered(df, "p", make(True), store, requests=1).collect()
    kept = {r.raw_model_output for r in spark.read.parquet(store).collect()}
    assert len(kept) > 20
    before = sorted(f.read_text() for f in calls.iterdir())
    assert {r.raw_model_output for r in answered(df, "p", make(False), store, requests=1).collect()} == {f"prompt {i}" for i in range(40)}
    again = sorted(f.read_text() for f in calls.iterdir())
    assert len(again) - len(before) == 40 - len(kept)


def test_training_and_encoded_rows(spark):
    df = spark.range(30).select(F.col("id").alias("ordinal"), F.lit("abc").alias("t"))
    assert training.training_rows(df, "tfidf_svm", max_rows=7).count() == 7
    assert training.training_rows(df, "tfidf_svm").count() == training.training_rows(df, "tfidf_logreg").count() == 30

    def make():
        import numpy as np

        return lambda texts: np.array([[len(t)] for t in texts], dtype=np.float32)

    assert training.encoded_rows(df, "t", make).count() == 30
    rows = training.encoded_rows(df, "t", make, ENCODER_FRACTION).collect()
    assert sorted(r.ordinal for r in rows) == [0, 1, 2] and rows[0].embedding == [3.0]


def test_raw_files_to_prepared(spark, tmp_path):
    """JSON lines to CSV to the prepared table, in file order."""
    files = {
        "r": [{"business_id": "b", "user_id": "u", "stars": s, "text": f"t,{i}\n\"q\""} for i, s in enumerate([5, 3, 1, 4])],
        "b": [{"business_id": "b", "name": "Bar", "state": "NA"}],
        "u": [{"user_id": "u", "name": "None", "friends": "x, y", "fans": 3}],
    }
    tables_read = {}
    for name, objects in files.items():
        path = tmp_path / f"{name}.jsonl"
        path.write_text("\n\n".join(json.dumps(o) for o in objects))
        raw = scan_jsonl(spark, str(path), exclude=USER_SCAN_EXCLUDES if name == "u" else ())
        out = work_path(spark, "csv")
        sink_csv(raw, out)
        tables_read[name] = scan_csv(spark, out, raw.schema, na_tokens=True)
    prepared = prepare(with_scan_ordinal(tables_read["r"]), tables_read["b"], tables_read["u"])
    found = prepared.orderBy("ordinal").collect()
    assert [(r.review_text, r.score_label, r.polarity_label) for r in found] == [
        ('t,0 "q"', 5, 1), ('t,1 "q"', 3, 0), ('t,2 "q"', 1, -1), ('t,3 "q"', 4, 1)
    ]
    # a state "NA" and a user "None" read as missing
    assert {(r.business_name, r.business_state, r.user_name, r.user_fans) for r in found} == {("Bar", "", "", 3.0)}


def test_with_document(spark):
    row = ("good", "Bar", "", "Rome", None, "Ann")
    df = spark.createDataFrame([row], ", ".join(f"{c} string" for c in PREPARED_COLUMNS[:6]))
    assert training.with_document(df).first().document == "good Bar Rome Ann"
    with pytest.raises(KeyError):
        training.with_document(df.drop("user_name"))


def test_an_encoder_gets_few_texts_as_python_objects(spark):
    import gc

    def make():
        def encode(texts):
            texts = list(texts)
            return [[float(len(t or "")), float(sum(1 for o in gc.get_objects() if type(o).__name__ == "Series"))] for t in texts]

        return encode

    df = spark.range(300).select(F.when(F.col("id") > 0, F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("t"), "id").coalesce(1)
    rows = encode(df, "t", make, batch_size=16).collect()
    assert [r.embedding[0] for r in sorted(rows, key=lambda r: r.id)] == [float(i) for i in range(300)]
    # no pandas column of the whole Arrow batch
    assert {r.embedding[1] for r in rows} == {0.0}
