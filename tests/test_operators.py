import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from opinloom.functions.tokens import words
from opinloom.operators import insights, joins, metrics, ordering, projection, terms
from opinloom.session import work_path


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- projections ----------------------------------------------------------


def test_column_contract(spark):
    df = spark.createDataFrame([(1, 2)], "text int, keep int")
    named = projection.rename(df, {"text": "review_text", "gone": "x"})
    assert named.columns == ["review_text", "keep"]
    assert projection.ensure_columns(named, ["keep", "new"], 0.0).columns == ["review_text", "keep", "new"]
    wide = spark.createDataFrame([(1, 2, 3, 4)], "business_id int, business_a int, b int, business_c int")
    assert projection.keep_prefixed(wide, "business_id", "business_").columns == ["business_id", "business_a", "business_c"]
    with pytest.raises(KeyError, match="gone"):
        projection.require_columns(df, ["text", "gone"])
    with pytest.raises(ValueError):
        projection.require_rows(df.where("text > 5"))
    with pytest.raises(ValueError, match=r"\[1, 1\]"):
        projection.require_range(df, "text", 2, 5)
    assert projection.require_range(df.where("text > 5"), "text", 2, 5).count() == 0


def test_null_filters(spark):
    df = spark.createDataFrame([(1, None), (None, None), (None, "x")], "label int, b string")
    assert projection.drop_unlabelled(df, "label").count() == 1
    assert projection.drop_empty(df).count() == 2
    assert projection.valid_predictions(df, "label", [-1, 0]).count() == 0
    assert projection.valid_predictions(df, "label").count() == 1
    assert projection.distinct_labels(spark.createDataFrame([(1,), (-1,), (1,)], "l int"), "l").first().labels == [-1, 1]


# --- joins ----------------------------------------------------------------


def brute_left_join(left, right):
    out = []
    for k, *l in left:
        matches = [r for r in right if r[0] == k]
        out += [(k, *l, *m[1:]) for m in matches] or [(k, *l, None)]
    return sorted(out, key=str)


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_left_join_semantics(spark, threshold):
    """Unmatched key, null key on both sides, duplicate right key; shuffled and broadcast."""
    left = [("a", 1), ("b", 2), (None, 3), ("z", 4), ("a", 5)]
    right = [("a", "x"), ("a", "y"), ("b", "w"), (None, "n"), ("q", "u")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        joined = joins.left_join(
            spark.createDataFrame(left, "k string, n int"), spark.createDataFrame(right, "k string, v string"), "k"
        )
        assert joined.columns == ["k", "n", "v"]
        assert rows(joined) == brute_left_join(left, right)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_join_with_a_hot_key_reads_each_side_once(spark):
    """Without broadcasts, on the executed plan: the hot partition is divided, and no input is read twice."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        path = work_path(spark, "facts")
        spark.range(60000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("n")).write.parquet(path)
        facts = spark.read.parquet(path)
        dim = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
        joined = joins.left_join(facts, dim, "k")
        assert rows(joined) == rows(facts.join(dim, "k", "left").select("k", "n", "v"))
        plan = joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("FileScan parquet") == 1 and "skew=true" in plan
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_star_join_reads_facts_once_without_broadcasts(spark):
    from opinloom.plans.prepare import prepare
    from opinloom.queries.preparation import star_tables

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        prepared = prepare(*star_tables(spark, SMALL))
        prepared.collect()
        plan = prepared._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    # line items twice, for the row numbers and the rows; each dimension once
    assert sum("lineitem.parquet" in x for x in scans) <= 2
    assert sum("part.parquet" in x for x in scans) == sum("supplier.parquet" in x for x in scans) == 1


def test_unique_keys(spark):
    even = spark.range(3000).withColumnRenamed("id", "k")
    assert joins.has_unique_key(even, "k") and not joins.has_unique_key(even.union(even), "k")


def test_counts_attach_zero(spark):
    dim = spark.createDataFrame([("a",), ("b",)], "k string")
    items = spark.createDataFrame([("a",), ("a",), ("c",)], "k string")
    assert rows(joins.left_join_counts(dim, items, "k", "n")) == [("a", 2), ("b", 0)]


# --- order ----------------------------------------------------------------


@pytest.mark.parametrize("n, expected", [(0, 0), (1, 0), (9, 8), (10, 9), (11, 9)])
def test_split_sizes(spark, n, expected):
    df = spark.range(n).select((F.col("id") * 1_000_003 + 17).alias("ordinal"))
    train, test = ordering.split_fraction(df, 0.9)
    assert (train.count(), test.count()) == (expected, n - expected)
    keys = [r.ordinal for r in train.collect()] + [r.ordinal for r in test.collect()]
    assert sorted(keys) == [i * 1_000_003 + 17 for i in range(n)]
    assert not train.collect() or max(train.collect()) <= min(test.collect())


def test_split_with_copies_and_gaps(spark):
    keys = [5] * 7 + [9_000_000_000] * 5 + [-3] + [12] * 4
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "ordinal bigint, v int")
    for n in (0, 1, 3, 8, 12, 14, 17, 18):
        first, rest = ordering.split_at(df, n)
        a, b = [tuple(r) for r in first.collect()], [tuple(r) for r in rest.collect()]
        assert len(a) == min(n, len(keys)) and sorted(a + b) == sorted((k, i) for i, k in enumerate(keys))
        assert sorted(k for k, _ in a) == sorted(keys)[: len(a)]


def test_split_keeps_null_keys_last(spark):
    keys = [3, None, 1, None, 2]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "ordinal bigint, v int")
    for n in range(6):
        first, rest = (sorted((r.ordinal for r in part.collect()), key=str) for part in ordering.split_at(df, n))
        assert len(first) == n and sorted(first + rest, key=str) == sorted(keys, key=str)
        assert [k for k in first if k] == [1, 2, 3][: min(n, 3)]


def test_split_between_copies_with_maps(spark):
    df = spark.createDataFrame([(1, {"a": 1, "b": 2}), (1, {"a": 2}), (1, None), (2, {})], "ordinal bigint, m map<string,int>")
    first, rest = ordering.split_at(df, 2)
    assert first.count() == rest.count() == 2
    assert rows(first) == rows(ordering.split_at(df.repartition(3), 2)[0])
    both = ordering.with_split(df, 0.5)
    assert sorted(r.split for r in both.collect()) == ["test", "test", "train", "train"]


def test_heads(spark):
    df = spark.range(20).withColumnRenamed("id", "ordinal")
    assert ordering.head_rows(df, 0).count() == 20 == ordering.head_rows(df, -1).count() == ordering.head_rows(df, 99).count()
    assert [r.ordinal for r in ordering.first_rows(ordering.head_rows(df, 3), 5).collect()] == [0, 1, 2]
    assert ordering.top_fraction(df, 1e-9).count() == 1
    assert ordering.top_fraction(df, 1).count() == 20
    for bad in (0, 1.1, -1):
        with pytest.raises(ValueError):
            ordering.top_fraction(df, bad)
    mixed = [r.ordinal for r in ordering.shuffled(df, 67).collect()]
    assert sorted(mixed) == list(range(20)) != mixed
    assert mixed == [r.ordinal for r in ordering.shuffled(df, 67).collect()]


def test_file_ordinal_over_many_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(path)
    found = ordering.read_with_ordinal(spark, path).collect()
    assert sorted((r.id, r.ordinal) for r in found) == [(i, i) for i in range(1000)]


def test_ordinal_follows_the_key_when_a_task_writes_many_files(spark):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "50")
    try:
        found = ordering.with_dense_ordinal(spark.range(5000).withColumnRenamed("id", "k"), "k").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert sorted((r.k, r.ordinal) for r in found) == [(i, i) for i in range(5000)]


def test_dense_ordinal(spark):
    df = spark.createDataFrame([("b",), ("é",), ("a",), ("ab",)], "t string")
    assert rows(ordering.with_dense_ordinal(df, "t")) == [("a", 0), ("ab", 1), ("b", 2), ("é", 3)]


def test_activity_quartile_keeps_ties_together(spark):
    histogram = spark.createDataFrame([(1, 6), (2, 1), (5, 1)], "n int, users int")
    found = {r.n: r.bucket for r in ordering.activity_quartile(histogram, "n", "users").collect()}
    assert found == {1: 1, 2: 4, 5: 4}


# --- terms ----------------------------------------------------------------

DOCS = [(1, "good food good"), (2, "bad food"), (3, "good service"), (4, "! a")]


def test_idf_example(spark):
    docs = spark.createDataFrame(DOCS[:3], "id int, text string")
    idf = {r.term: (r.df, r.idf) for r in terms.inverse_document_frequency(docs, words(F.col("text"))).collect()}
    assert idf["good"][0] == 2 and math.isclose(idf["good"][1], 1.287682, abs_tol=1e-6)
    assert math.isclose(idf["bad"][1], math.log(4 / 2) + 1)


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_tfidf_by_hand(spark, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        docs = spark.createDataFrame(DOCS, "id int, text string")
        found = terms.tfidf(docs, "id", words(F.col("text"))).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    n = len(DOCS)
    bags = {i: Counter(w for w in t.split() if len(w) > 1) for i, t in DOCS}
    df = Counter(w for b in bags.values() for w in b)
    for i, bag in bags.items():
        raw = {w: c * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in bag.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        got = {r.term: r.weight for r in found if r.id == i}
        assert got.keys() == raw.keys()
        assert all(math.isclose(got[w], raw[w] / norm) for w in raw)


def test_vocabulary_and_ngrams(spark):
    docs = spark.createDataFrame(DOCS, "id int, text string")
    vocab = terms.vocabulary(docs, words(F.col("text")))
    assert rows(vocab.select("term_index", "term", "df", "tf")) == [
        (0, "bad", 1, 1), (1, "food", 2, 2), (2, "good", 2, 3), (3, "service", 1, 1)
    ]
    assert rows(terms.ngram_counts(docs, words(F.col("text")), 2)) == [
        ("bad food", 1), ("food good", 1), ("good food", 1), ("good service", 1)
    ]
    assert rows(terms.term_counts(docs, "id", words(F.col("text")))) == [
        (1, "food", 1), (1, "good", 2), (2, "bad", 1), (2, "food", 1), (3, "good", 1), (3, "service", 1)
    ]


def test_terms_are_counted_without_a_shuffle(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = terms.term_counts(docs, "doc_id", words(F.col("text")))
    counts.collect()
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()


def test_top_terms(spark):
    weights = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (1, "a", 0.1), (2, "c", 1.0), (1, "d", 0.5)], "g int, term string, weight double")
    assert rows(terms.top_terms(weights, "g", 2)) == [(1, 1, "a", 0.6), (1, 2, "b", 0.5), (2, 1, "c", 1.0)]


# --- metrics --------------------------------------------------------------


def report(spark, pairs):
    df = spark.createDataFrame(pairs, "a int, p int")
    return metrics.class_report(metrics.confusion(df, "a", "p"))


def test_report_by_hand(spark):
    # 0 is never predicted, 3 is never true
    found = {r.label: r for r in report(spark, [(1, 1), (1, 1), (1, 2), (2, 2), (0, 1), (2, 3)]).collect()}
    assert sorted(found) == [0, 1, 2, 3]
    assert (found[1].precision, found[1].recall, found[1].support) == (2 / 3, 2 / 3, 3)
    assert (found[2].precision, found[2].recall, found[2].f1) == (0.5, 0.5, 0.5)
    assert (found[0].precision, found[0].recall, found[0].f1, found[0].support) == (0.0, 0.0, 0.0, 1)
    assert (found[3].precision, found[3].recall, found[3].support) == (0.0, 0.0, 0)


def test_averages_and_accuracy(spark):
    pairs = [(1, 1), (1, 1), (1, 2), (2, 2), (0, 1), (2, 3)]
    df = spark.createDataFrame(pairs, "a int, p int")
    averages = {r.average: r for r in metrics.report_averages(report(spark, pairs)).collect()}
    assert averages["weighted avg"].support == 6
    assert math.isclose(averages["macro avg"].recall, (2 / 3 + 0.5) / 4)
    accuracy = metrics.accuracy(df, "a", "p").first()
    assert (accuracy.accuracy, accuracy.n) == (0.5, 6)
    assert math.isclose(averages["weighted avg"].recall, accuracy.accuracy)
    assert metrics.confusion(df, "a", "p").agg(F.sum("n")).first()[0] == 6
    assert math.isclose(metrics.summary(metrics.confusion(df, "a", "p")).first().accuracy, 0.5)


def test_empty_and_single_class(spark):
    empty = spark.createDataFrame([], "a int, p int")
    assert tuple(metrics.accuracy(empty, "a", "p").first()) == (0.0, 0)
    assert metrics.class_report(metrics.confusion(empty, "a", "p")).count() == 0
    assert metrics.report_averages(metrics.class_report(metrics.confusion(empty, "a", "p"))).count() == 0
    assert tuple(metrics.answer_rate(empty, "p").first()) == (0, 0, 0, 0.0)
    only = report(spark, [(1, 1), (1, 1)]).first()
    assert (only.precision, only.recall, only.f1, only.support) == (1.0, 1.0, 1.0, 2)


def test_model_ranking_and_text(spark):
    data = [("t", "good", 1, 1), ("t", "good", 2, 2), ("t", "bad", 1, 2), ("t", "bad", 2, 2), ("u", "bad", 1, 1)]
    ranked = metrics.compare_models(spark.createDataFrame(data, "task string, model string, a int, p int"), "a", "p")
    assert {(r.task, r.model): r["rank"] for r in ranked.collect()} == {("t", "good"): 1, ("t", "bad"): 2, ("u", "bad"): 1}
    classes = report(spark, [(1, 1), (-1, 1)])
    text = metrics.render_report("Title", classes.collect(), metrics.report_averages(classes).collect())
    lines = text.splitlines()
    assert lines[0] == "Title" and lines[2] == "Accuracy: 0.5000"
    assert "0.5000" in next(l for l in lines if l.lstrip().startswith("1 "))
    assert any("weighted avg" in l for l in lines)


# --- insights -------------------------------------------------------------


def test_insights_by_hand(spark):
    reviews = spark.createDataFrame(
        [("u1", "b1", 1, 10), ("u1", "b1", 2, 20), ("u1", "b2", 5, 40), ("u2", "b2", 5, 5)],
        "user string, business string, score int, length int",
    )
    businesses = spark.createDataFrame([("b1", "Bars, Food"), ("b2", "Food, Food"), ("b3", None)], "business string, categories string")
    shares = insights.category_share(reviews, businesses, "business", "categories", r",\s*")
    assert rows(shares) == [("Bars", 2, 2 / 6), ("Food", 4, 4 / 6)]
    heavy = insights.heavy_reviewers(reviews, "user", "score").collect()
    assert sorted((r.bucket, r.n_users, r.n_reviews, r.negative_share) for r in heavy) == [(1, 1, 1, 0.0), (3, 1, 3, 2 / 3)]
    lengths = {r.score: (r.mean_length, r.median_length) for r in insights.length_by_score(reviews, "score", "length").collect()}
    assert lengths[5] == (22.5, 22.5)
    photos = spark.createDataFrame([("b1",)], "business string")
    assert rows(insights.attachments_vs_rating(reviews, photos, "business", "score")) == [(0, 1, 5.0), (1, 1, 1.5)]
    same = spark.createDataFrame([("a", 1), ("b", 3)], "business string, score int")
    assert insights.popularity_correlation(same, "business", "score").first().correlation is None
    aspects = spark.createDataFrame([({"food": 5, "price": 1},), ({"food": 3},), ({},)], "m map<string,int>")
    assert rows(insights.aspect_summary(aspects, "m")) == [("food", 2, 4.0, 1, 0), ("price", 1, 1.0, 0, 1)]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257])
def test_every_epoch_is_a_permutation(spark, n):
    rows = ordering.epoch_orders(spark.range(n).withColumnRenamed("id", "ordinal"), 3, seed=5).collect()
    orders = [[r.position for r in sorted(rows, key=lambda r: r.ordinal) if r.epoch == e] for e in range(3)]
    assert all(sorted(o) == list(range(n)) for o in orders)
    if n > 200:
        assert orders[0] != orders[1] != orders[2]
        # neighbours are scattered and most rows leave their place
        for o in orders:
            assert sum(abs(a - b) == 1 for a, b in zip(o, o[1:], strict=False)) < n / 10
            assert sum(i == p for i, p in enumerate(o)) < n / 10
    again = ordering.epoch_orders(spark.range(n).withColumnRenamed("id", "ordinal"), 3, seed=5).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_places_of_an_epoch_are_computed_for_many_rows_at_once(spark):
    rows = spark.range(7).select(F.when(F.col("id") < 6, F.col("id")).alias("ordinal"))

    def place(at, keys, n):
        for pair, draw in keys:
            other = (pair - at) % n
            mixed = (max(at, other) % ((1 << 31) - 1) + draw) * draw % ((1 << 31) - 1)
            at = other if ((mixed >> 7) + mixed) % 2 else at
        return at

    for n in (6, 1 << 40):
        placed = rows.select("ordinal", ordering.permuted(F.col("ordinal"), n, 5, 1).alias("place"))
        keys = ordering.round_keys(5, 1)
        assert {r.ordinal: r.place for r in placed.collect()} == {None: None} | {i: place(i, keys, n) for i in range(6)}
    orders = ordering.epoch_orders(spark.range(9).withColumnRenamed("id", "ordinal"), 3, seed=5)
    assert orders.columns == ["ordinal", "epoch", "position"]
    # a lambda would be interpreted round by round
    assert "lambdafunction" not in orders._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_a_large_file_get_their_ordinal_where_they_are_read(spark):
    path = work_path(spark, "one_file")
    spark.range(100).coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # as if the table were large
    try:
        placed = ordering.read_with_ordinal(spark, path)
        assert "SortMergeJoin" not in placed._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, placed.collect())) == [(i, i) for i in range(100)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
