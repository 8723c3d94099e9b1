import numpy as np
import pytest

from opinloom.llm import factorisation, hashing, toxicity
from opinloom.llm.queries import QUERIES
from opinloom.llm.shared import documents, labels

FOLDER = "/root/testdata/sf0.1"
EDGES = [(1, None, None, "x"), (2, "", 0, "x"), (3, "word " * 60000, None, "x"), (3, "you IDIOT! l0ser", 9, "x"), (3, "you IDIOT! l0ser", 9, "x"), (None, "\n\n", 2, "x")]
SCHEMA = "doc_id long, text string, n_chars long, score string"


def held_out_quality(spark, found, label, cut):
    rows = found.join(labels(spark, FOLDER), "doc_id").where("held_out").select("score", "predicted", label).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in rows)
    good = [r.score for r in rows if r[label]]
    bad = [r.score for r in rows if not r[label]]
    ranked = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    right = np.mean([r.predicted == r[label] for r in rows])
    return ranked, right, len(good), len(bad)


def test_quality_on_held_out_rows(spark):
    ranked, right, good, bad = held_out_quality(spark, QUERIES["op1_quality_classifier"](spark, FOLDER), "quality", 0.3)
    assert ranked > 0.97 and right > max(good, bad) / (good + bad) + 0.05


def test_toxicity_on_held_out_rows(spark):
    ranked, right, good, bad = held_out_quality(spark, QUERIES["op7_toxicity"](spark, FOLDER), "toxic", 0.5)
    assert ranked > 0.95 and right > max(good, bad) / (good + bad) + 0.03


def test_linear_time_score_equals_all_pairs():
    rng = np.random.default_rng(0)
    width, words = 16, 1 << factorisation.WORD_BITS
    machine = factorisation.Machine(0.3, rng.normal(0, 0.1, words + width), rng.normal(0, 0.1, (words + width, 3)), np.zeros(width), np.ones(width))
    raw = rng.normal(0, 1, (2, width))
    row, slot, value = np.array([0, 0, 1]), np.array([3, 70, 3]), np.array([0.5, 0.2, 1.0])
    got = machine.score(raw, row, slot, value)
    for i in range(2):
        x = np.zeros(words + width)
        x[slot[row == i]] = value[row == i]
        x[words:] = np.clip(raw[i], -5, 5)
        at = np.flatnonzero(x)
        pairs = sum(machine.factors[a] @ machine.factors[b] * x[a] * x[b] for k, a in enumerate(at) for b in at[:k])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(0.3 + x @ machine.weights + pairs))))


@pytest.mark.parametrize("known", [[], [(1, 1)], [(1, 1), (2, 1)], [(1, None)]])
def test_edges_and_labels_of_one_kind(spark, known):
    docs = spark.createDataFrame(EDGES, SCHEMA)
    marked = spark.createDataFrame(known, "doc_id long, quality int")
    machine = factorisation.fit(docs, marked)
    found = factorisation.scored(docs, machine)
    assert found.columns == ["doc_id", "text", "n_chars", "score", "predicted"]
    rows = found.collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert factorisation.scored(docs.limit(0), machine).collect() == []
    toxic = toxicity.scored(docs, toxicity.fit(docs, marked, "quality"))
    assert len(toxic.collect()) == len(EDGES)


def test_edges_with_fitted_models(spark):
    docs, marked = documents(spark, "/root/testdata/sf0.01"), labels(spark, "/root/testdata/sf0.01")
    edges = spark.createDataFrame(EDGES, SCHEMA)
    scores = [r.score for r in factorisation.scored(edges, factorisation.fit(docs, marked)).collect()]
    assert len(scores) == len(EDGES) and all(0 <= s <= 1 for s in scores)
    rows = toxicity.scored(edges, toxicity.fit(docs, marked)).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)


def test_dense_features_see_disguise_and_address():
    lexicon = toxicity.Lexicon(*_lexicon(["loser"], [5.0]))
    texts = [b"you are a l0ser", b"a loser there is one two three four you", b"nothing here", b""]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    rows = [dict(zip(toxicity.FEATURES, r, strict=True)) for r in toxicity.dense_features(data, offsets, lexicon)]
    assert rows[0]["disguised_hits"] > 0 and rows[0]["near_second_person"] > 0 and rows[0]["strong"] > 0
    assert rows[1]["strong"] > 0 and rows[1]["near_second_person"] == 0 and rows[1]["disguised"] == 0
    assert rows[2]["weak"] == rows[3]["weak"] == 0


def _lexicon(words, weights):
    data = "".join(words).encode()
    ends = np.cumsum([len(w) for w in words])
    return hashing.word_hashes(np.frombuffer(data, np.uint8), ends - [len(w) for w in words], ends), np.array(weights)
