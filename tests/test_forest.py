"""The forest against splits found by trying all of them, and its passes by level."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from opinloom.operators import forest
from opinloom.operators.blocks import as_blocks
from opinloom.session import work_path

BINS, CLASSES = 8, 3


def tried(code, label, weight, features, min_leaf):
    """The best gain of one node by trying every feature and bin, the first of equal ones."""
    counts = lambda kept: np.bincount(label[kept], weight[kept], CLASSES)
    gini = lambda c: 1 - ((c / c.sum()) ** 2).sum()
    whole, best = counts(np.ones(len(label), bool)), (0.0, -1, 0)
    for slot, f in enumerate(features):
        for b in range(BINS - 1):
            left, right = counts(code[:, f] <= b), counts(code[:, f] > b)
            if min(left.sum(), right.sum()) >= min_leaf:
                gain = gini(whole) - left.sum() / whole.sum() * gini(left) - right.sum() / whole.sum() * gini(right)
                if gain > best[0] + 1e-12:
                    best = (gain, slot, b)
    return best


@pytest.mark.parametrize("min_leaf", [1, 2, 9])
def test_best_splits_equal_all_tried(min_leaf):
    rng = np.random.default_rng(min_leaf)
    cells, expected = [], []
    for node in range(40):
        rows, some = rng.integers(1, 30), 4
        code = rng.integers(0, BINS, (rows, 6)) * (rng.random((rows, 6)) < 0.5)
        label, weight, features = rng.integers(0, CLASSES, rows), rng.integers(1, 4, rows), rng.permutation(6)[:some]
        for r in range(rows):
            cells += [(node, (s * BINS + code[r, f]) * CLASSES + label[r], weight[r]) for s, f in enumerate(features) if code[r, f]]
            cells.append((node, some * BINS * CLASSES + label[r], weight[r]))
        gain, slot, b = tried(code, label, weight, features, min_leaf)
        right = code[:, features[slot]] > b if slot >= 0 else np.zeros(rows, bool)
        expected.append((slot, b, *np.bincount(label[~right], weight[~right], CLASSES), *np.bincount(label[right], weight[right], CLASSES)))
    node, cell, n = np.array(cells)[rng.permutation(len(cells))].T
    nodes, best, high, left, right = forest.best_splits(node, cell, n, 4, BINS, CLASSES, min_leaf)
    assert nodes.tolist() == list(range(40))
    assert [tuple(map(int, r)) for r in np.c_[best, high, left, right]] == [tuple(map(int, r)) for r in expected]


def test_drawn_features_differ():
    for inputs, some in ((1024, 32), (9, 3), (4, 2), (2, 2), (1, 1)):
        found = forest.drawn(500, inputs, some, [1, 2, 3])
        assert found.shape == (500, some) and all(len(set(r)) == some for r in found.tolist())
        assert set(found.ravel().tolist()) == set(range(inputs))


def test_cuts_lie_between_values():
    assert forest._cuts_of(np.array([1.0, 3.0]), np.array([2.0, 2.0]), 10, 31).tolist() == [0.5, 2.0]
    assert forest._cuts_of(np.array([-1.0, 3.0]), np.array([5.0, 5.0]), 10, 31).tolist() == [1.0]
    assert len(forest._cuts_of(np.arange(1.0, 1001), np.ones(1000), 1000, 31)) == 31


@pytest.fixture(scope="module")
def labelled(spark):
    """Class 0 to 2 by two features, with dense rows, rows that list little and an empty one."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        v = np.round(rng.normal(size=5), 3) * (rng.random(5) < 0.8)
        rows.append((i, Vectors.dense(v) if i % 3 else Vectors.sparse(5, {k: float(v[k]) for k in range(5) if v[k]}), float((v[1] > 0) + (v[3] > 0.2))))
    rows.append((400, Vectors.sparse(5, {}), 0.0))
    return spark.createDataFrame(rows, ["id", "features", "class_index"])


def grown(rows, **options):
    given = {"trees": 20, "depth": 30, "min_leaf": 1, "seed": 67} | options
    blocks = as_blocks(rows.repartition(3), "features", "class_index")
    return forest.fit(rows, blocks, "features", rows.count(), 5, CLASSES, **given)


def test_forest_takes_one_pass_for_a_level(labelled, monkeypatch):
    """Passes are as many as levels, however many nodes; Spark's forest needs more, the more nodes there are."""
    passes, splits = [], forest._splits
    monkeypatch.setattr(forest, "_splits", lambda *given: passes.append(1) or splits(*given))
    trees = grown(labelled, depth=6, trees=40)
    assert len(passes) <= 6 and len(trees.feature) > 400


def test_forest_learns_and_saves(spark, labelled):
    model = forest.ForestModel(grown(labelled), 5, "features", "found")
    rows = model.transform(labelled)
    assert rows.columns == [*labelled.columns, "rawPrediction", "probability", "found"]
    found = sorted(rows.collect())
    assert sum(r.found == r.class_index for r in found) > 0.97 * len(found)
    assert all(r.rawPrediction.toArray().sum() == pytest.approx(20) and r.probability.toArray().argmax() == r.found for r in found)
    path = work_path(spark, "model")
    model.save(path)
    assert sorted(forest.ForestModel.load(path).transform(labelled).collect()) == found


def test_forest_without_depth_names_the_largest_class(labelled):
    trees = grown(labelled, depth=0, trees=3)
    largest = labelled.groupBy("class_index").count().orderBy(F.desc("count")).first().class_index
    assert len(trees.feature) == 3 and (trees.share.argmax(axis=1) == largest).all()
