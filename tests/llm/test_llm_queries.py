import re

import pytest

import corpus_pipeline
from compare import connect, differences
from conftest import SMALL
from opinloom.llm import factorisation, jaccard, mixing, naming
from opinloom.llm.queries import QUERIES, SQL
from opinloom.llm.shared import documents, labels
from test_jaccard import brute


@pytest.mark.parametrize("name", sorted(SQL))
@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_query_matches_its_sql(spark, name, folder):
    assert differences(QUERIES[name](spark, folder), connect(folder), SQL[name]) == ""


def test_all_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))


def test_near_duplicates_of_the_documents(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, SMALL).collect()]
    assert sorted([tuple(r) for r in QUERIES["op2_ngram_jaccard_join"](spark, SMALL).collect()], key=str) == brute(rows, 3, 90, 100)


def test_stages_against_plain_python(spark):
    """Every stage on the kept rows of the one before."""
    docs = documents(spark, SMALL)
    known = labels(spark, SMALL)
    good = corpus_pipeline.quality(spark, docs, SMALL)
    scores = {r.doc_id: r.predicted for r in factorisation.scored(docs, factorisation.fit(docs, known)).collect()}
    rows = good.collect()
    assert good.columns == docs.columns
    assert sorted(r.doc_id for r in rows) == sorted(d for d, p in scores.items() if p == 1)
    frame = spark.createDataFrame(rows, docs.schema)
    last = {}
    for r in rows:
        last[r.text] = max(r.doc_id, last.get(r.text, r.doc_id))
    single = corpus_pipeline.exact(spark, frame, SMALL)
    assert single.columns == docs.columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(last.values())
    left = [r for r in rows if last[r.text] == r.doc_id]
    frame = spark.createDataFrame(left, docs.schema)
    apart = corpus_pipeline.near(spark, frame, SMALL)
    stay = {r[0] for r in brute([(r.doc_id, r.text) for r in left], 5, 8, 10) if r[0] == r[2]}
    assert apart.columns == docs.columns and {r.doc_id for r in apart.collect()} == stay
    frame = spark.createDataFrame([r for r in left if r.doc_id in stay], docs.schema)
    mix = corpus_pipeline.mixed(spark, frame, SMALL)
    plan = mixing.mixture(frame).collect()
    mixed = mix.collect()
    assert mix.columns == docs.columns
    assert sum(len(r.text.split()) for r in mixed) == pytest.approx(sum(r.whole * r.size + r.part for r in plan))
    out = corpus_pipeline.tokens(spark, spark.createDataFrame(mixed, docs.schema), SMALL).collect()
    assert len(out) == len(mixed) and all(r.lossless and r.n_tokens == len(r.ids) for r in out)


def test_pipeline_runs_and_answers_alike(spark):
    first, second = (corpus_pipeline.run(spark, SMALL).select("doc_id", "n_tokens").collect() for _ in range(2))
    assert sorted(map(tuple, first)) == sorted(map(tuple, second)) and first
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mixed", "tokens"]
    assert jaccard and naming
