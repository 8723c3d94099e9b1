from collections import Counter, defaultdict

import pytest

from opinloom.llm import mixing

SCHEMA = "doc_id long, source string, text string, n_chars long, target string, whole string"


def filled(sizes, weights, share, epochs):
    """Targets by giving excess away again and again."""
    keys = sorted(sizes)
    w = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    full, target = set(), {}
    while True:
        rest = share * sum(sizes.values()) - sum(epochs * sizes[k] for k in full)
        free = [k for k in keys if k not in full]
        if not free:
            return {k: epochs * sizes[k] for k in keys}
        target = {k: rest * w[k] / sum(w[x] for x in free) for k in free}
        over = {k for k in free if target[k] >= epochs * sizes[k]}
        if not over:
            return target | {k: epochs * sizes[k] for k in full}
        full |= over


@pytest.mark.parametrize("sizes", [[10, 500, 40, 7, 3000], [100, 100, 100], [0, 5, 900], [0, 0]])
def test_targets_and_taken_words(spark, sizes):
    rows, doc = [], 0
    for s, size in enumerate(sizes):
        left = size
        while left:
            n = min(left, 1 + (doc * 7) % 23)
            rows.append((doc, f"s{s}", " ".join(f"w{i}" for i in range(n)), None, "x", "y"))
            doc, left = doc + 1, left - n
    rows += [(9000, "s0", None, 1, "", ""), (9001, "s0", " \n", 2, "", "")] if not sizes[0] else []
    plan = mixing.mixture(spark.createDataFrame(rows, SCHEMA)).collect()
    total, taken, target = defaultdict(int), defaultdict(int), {}
    for r in plan:
        total[r.source] += r.size
        taken[r.source] += r.whole * r.size + r.part
        target[r.source] = r.target
        assert 0 <= r.part <= r.size and r.whole * r.size + r.part <= 2 * r.size
    expected = filled(dict(total), mixing.WEIGHTS, mixing.SHARE, mixing.EPOCHS)
    for source, wanted in expected.items():
        assert target[source] == pytest.approx(wanted)
        assert abs(taken[source] - wanted) <= 1


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, "a b c", 5, "", ""), (1, None, "d e", 3, "", ""), (1, None, "d e", 3, "", ""), (2, "", "f", 1, "", ""), (3, "z", None, None, "", "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    first = sorted(map(str, mixing.mixture(frame).collect()))
    assert first == sorted(map(str, mixing.mixture(frame.repartition(3)).collect()))
    assert len(first) == 5
    assert mixing.mixture(spark.createDataFrame([], SCHEMA)).collect() == []


def test_mixed_documents_are_whole_and_near_their_targets(spark):
    rows = [(i, f"s{i % 2}", " ".join(["word"] * (1 + i % 9)), 5 * (1 + i % 9) - 1, "", "") for i in range(200)]
    frame = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.mixture(frame).collect()
    out = mixing.mixed_documents(frame).collect()
    texts = {r[0]: r[2] for r in rows}
    assert all(r.text == texts[r.doc_id] for r in out)
    assert all(r.n_chars == len(r.text) for r in out)
    times = Counter(r.doc_id for r in out)
    assert all(times[r.doc_id] == r.whole + (2 * r.part >= r.size) for r in plan)
    for source in ("s0", "s1"):
        taken = sum(len(r.text.split()) for r in out if r.source == source)
        assert abs(taken - next(r.target for r in plan if r.source == source)) <= 9 / 2 + 1
