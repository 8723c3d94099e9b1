import tracemalloc

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from opinloom.operators import blocks, embedding_bag, newton


def table(spark, n=150, width=12, classes=3, seed=1, partitions=4):
    """Sparse rows with one dense and one empty row among them, as blocks, and the same as a matrix."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, width)) < 0.3, rng.normal(size=(n, width)), 0)
    x[0], x[1] = rng.normal(size=width), 0
    y = (x @ rng.normal(size=(width, classes)) + rng.normal(size=(n, classes))).argmax(axis=1)
    rows = [(Vectors.dense(r) if i == 0 else Vectors.sparse(width, [(j, v) for j, v in enumerate(r) if v]), int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    frame = spark.createDataFrame(rows, ["features", "y"]).repartition(partitions)
    return blocks.as_blocks(frame, "features", "y"), frame, x, y


def dense_hinge(x, y, k, C):
    """Plain Newton steps on the dense problem."""
    a, side = np.column_stack([x, np.ones(len(x))]), np.where(y == k, 1.0, -1.0)
    w = np.zeros(a.shape[1])
    value = lambda v: 0.5 * v @ v + C * (np.maximum(0, 1 - side * (a @ v)) ** 2).sum()
    for _ in range(100):
        gap = np.maximum(0, 1 - side * (a @ w))
        active = a[gap > 0]
        step = np.linalg.solve(np.eye(len(w)) + 2 * C * active.T @ active, w - 2 * C * a.T @ (side * gap))
        t = 1.0
        while value(w - t * step) > value(w) and t > 1e-9:
            t /= 2
        w = w - t * step
    return value(w)


@pytest.mark.parametrize("C", [0.1, 1.0, 30.0])
def test_squared_hinge_reaches_the_dense_optimum(spark, C):
    held, _, x, y = table(spark)
    fitted = newton.fit(held, 12, 3, "squared_hinge", C=C, tol=1e-6, gain=1e-9)
    best = sum(dense_hinge(x, y, k, C) for k in range(3))
    assert best <= fitted.history[-1][0] * (1 + 1e-9) and fitted.history[-1][0] <= best * (1 + 1e-3)
    values = [v for v, _ in fitted.history]
    assert values == sorted(values, reverse=True)
    margins = x @ fitted.weights + fitted.constant
    assert fitted.history[-1][1] == pytest.approx((margins.argmax(axis=1) == y).mean())


def test_softmax_has_no_gradient_left_and_saves_as_a_spark_model(spark):
    held, frame, x, y = table(spark, seed=2)
    fitted = newton.fit(held, 12, 3, "softmax", C=2.0, tol=1e-7, gain=0)
    z = x @ fitted.weights + fitted.constant
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    assert np.abs(fitted.weights + 2 * x.T @ p).max() < 1e-4 and np.abs(p.sum(axis=0)).max() < 1e-4
    named = fitted.model("features", "p", spark).transform(frame).collect()
    assert [int(r.p) for r in named] == [int((r.features.toArray() @ fitted.weights + fitted.constant).argmax()) for r in named]


def test_sums_over_many_tasks_are_added_in_levels(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FAN_IN", 3)
    monkeypatch.setattr(blocks, "PIECE", 5)
    held, _, x, y = table(spark, partitions=20)

    def partial(parts):
        out = np.zeros(13)
        for rows in parts:
            out[:12] += rows.transposed_times(np.ones((len(rows), 1)), 12)[:, 0]
            out[12] += len(rows)
        return out

    assert np.allclose(blocks.summed(held, partial, 13, 20), [*x.sum(axis=0), len(y)])


def test_the_driver_gets_the_sum_alone(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PIECE", 5)
    held, frame, x, y = table(spark, partitions=20)
    received, kind = [], type(frame)
    collect = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda df: received.append(collect(df)) or received[-1])
    assert np.allclose(blocks.summed(held, lambda parts: sum(r.transposed_times(np.ones((len(r), 1)), 12)[:, 0] for r in parts), 12, 20), x.sum(axis=0))
    assert [t.num_rows for t in received] == [3]


def test_products_equal_dense_ones():
    rng = np.random.default_rng(5)
    x = np.where(rng.random((40, 9)) < 0.2, rng.normal(size=(40, 9)), 0)
    x[0] = x[-1] = 0
    row, index = np.nonzero(x)
    rows = blocks.Rows(np.r_[0, np.cumsum((x != 0).sum(axis=1))], index.astype(np.int32), x[row, index], np.zeros(40, int))
    w, side = rng.normal(size=(9, 3)), rng.normal(size=(40, 3))
    assert np.allclose(rows.times(w), x @ w) and np.allclose(rows.transposed_times(side, 9), x.T @ side)
    used, some = rows.dense(9)
    assert np.allclose(some, x[:, used]) and not np.delete(x, used, axis=1).any()


def test_bag_scores_many_rows_in_little_memory():
    rng = np.random.default_rng(6)
    n, held, inputs = 3000, 300, 2000
    rows = blocks.Rows(np.arange(0, n * held + 1, held), rng.integers(0, inputs, n * held).astype(np.int32), rng.random(n * held), np.zeros(n, int))
    bag = embedding_bag.Bag.made(inputs, 3, 1, 32, (8,))
    tracemalloc.start()
    try:
        p = bag.probabilities(rows)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert p.shape == (n, 3) and np.allclose(p[7:9], bag.probabilities(rows.part(7, 9)))
    assert most < 30 << 20


def test_bag_gradients_equal_differences():
    rng = np.random.default_rng(3)
    rows = blocks.Rows(np.array([0, 2, 2, 5]), np.array([0, 3, 1, 3, 3]), rng.random(5) + 0.1, np.array([0, 1, 1]))
    bag = embedding_bag.Bag.made(4, 2, 1, 3, (5,))
    bag.arrays = [x + rng.normal(0, 0.1, x.shape) for x in bag.arrays]  # no unit at its kink

    def loss(arrays):
        p = embedding_bag.Bag(arrays, []).probabilities(rows)
        return -np.log(p[np.arange(3), rows.label]).mean()

    before = [x.copy() for x in bag.arrays]
    squares = [x.copy() for x in bag.squares]
    embedding_bag.DROPPED, dropped = 0.0, embedding_bag.DROPPED
    embedding_bag.DECAY, decay = 0.0, embedding_bag.DECAY
    try:
        bag.step(rows, np.random.default_rng(0))
    finally:
        embedding_bag.DROPPED, embedding_bag.DECAY = dropped, decay
    for i, (old, square) in enumerate(zip(before, squares, strict=True)):
        grad = np.sqrt(np.maximum(bag.squares[i] - square, 0))
        for at in np.ndindex(old.shape):
            moved = [x.copy() for x in before]
            moved[i][at] += 1e-6
            up = loss(moved)
            moved[i][at] -= 2e-6
            assert grad[at] == pytest.approx(abs(up - loss(moved)) / 2e-6, abs=1e-5)


def test_bag_learns_alike_on_every_run(spark):
    held, _, x, y = table(spark, seed=4)
    first, second = (embedding_bag.fit(held, 12, 3, epochs=6, seed=1, width=8, hidden=(8,)) for _ in range(2))
    assert all((a == b).all() for a, b in zip(first.arrays, second.arrays, strict=True))
    assert first.history[-1][0] < first.history[0][0] and len(first.history) == 6
    all_rows = blocks.Rows(np.arange(0, 150 * 12 + 1, 12), np.tile(np.arange(12), 150), x.ravel(), y)
    assert first.history[-1][1] == pytest.approx((first.probabilities(all_rows).argmax(axis=1) == y).mean())


@pytest.mark.parametrize("loss", ["squared_hinge", "softmax"])
@pytest.mark.parametrize(("at_hand", "apart"), [(1 << 20, 0.3), (0, 1.0), (0, 0.0)])
def test_products_read_only_rows_that_bend_the_loss(spark, monkeypatch, loss, at_hand, apart):
    monkeypatch.setattr(newton, "AT_HAND", at_hand)
    monkeypatch.setattr(newton, "KEPT_APART", apart)
    held, _, x, y = table(spark, seed=7)
    rng = np.random.default_rng(8)
    w, v = 3 * rng.normal(size=(13, 3)), rng.normal(size=(13, 3))
    a = np.column_stack([x, np.ones(len(x))])
    z, u = a @ w, a @ v
    if loss == "squared_hinge":
        side = 2 * (1 - np.where(y[:, None] == np.arange(3), 1, -1) * z > 0) * u
    else:
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        side = p * (u - (p * u).sum(axis=1, keepdims=True))
    passes = newton._Passes(held, loss, 12, 3)
    bent, entries = passes.gradient(w)[4]
    assert entries == (x != 0).sum() and bent <= entries
    run = newton.summed
    read = []
    monkeypatch.setattr(newton, "summed", lambda *given: read.append(1) or run(*given))
    with passes.hessian(w, bent, entries) as product:
        assert np.allclose(product(v), a.T @ side)
    assert read == ([] if at_hand else [1])


def test_passes_send_blocks_in_small_batches(spark, monkeypatch):
    held, frame, x, y = table(spark)
    limits, kind, before = [], type(frame), spark.conf.get(blocks.BATCH_LIMIT)
    collect = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda df: limits.append(spark.conf.get(blocks.BATCH_LIMIT)) or collect(df))
    blocks.summed(held, lambda parts: sum(len(r) for r in parts), 1, 4)
    with newton._Passes(held, "softmax", 12, 3).hessian(np.zeros((13, 3)), 1, 1):
        pass
    assert limits == [str(blocks.BATCH_BYTES)] * 2 and spark.conf.get(blocks.BATCH_LIMIT) == before


def test_bag_without_a_curve_is_the_same_in_fewer_looks(spark, monkeypatch):
    held = table(spark, seed=4)[0].persist()
    run, passes = embedding_bag.summed, []
    monkeypatch.setattr(embedding_bag, "summed", lambda *given: passes.append(1) or run(*given))
    with_curve, plain = (embedding_bag.fit(held, 12, 3, epochs=3, seed=1, width=8, hidden=(8,), curve=c) for c in (True, False))
    held.unpersist()
    assert all((a == b).all() for a, b in zip(with_curve.arrays, plain.arrays, strict=True))
    assert len(passes) == 4 + 3 and len(with_curve.history) == 3 and not plain.history
