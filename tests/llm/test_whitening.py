import math

import numpy as np
import pytest

from opinloom.llm import whitening


def test_bidiagonal_keeps_singular_values():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 8, 40):
        a = rng.normal(size=(n, n))
        d, u, v = whitening.bidiagonal(a)
        b = np.diag(d) + np.diag(u, 1) if n > 1 else np.diag(d)
        assert np.allclose(v.T @ v, np.eye(n)) and np.allclose(np.abs(np.linalg.svd(b)[1]), np.linalg.svd(a)[1])
        assert np.allclose(b.T @ b, v.T @ a.T @ a @ v)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64, 120])
def test_dqds_is_accurate_for_small_values_too(n):
    rng = np.random.default_rng(n)
    d, u = rng.uniform(0.5, 2, n) * 10.0 ** rng.integers(-6, 3, n), rng.uniform(0.1, 1, n - 1) * 10.0 ** rng.integers(-6, 1, n - 1)
    found = whitening.dqds(d, u)
    b = np.diag(d) + np.diag(u, 1) if n > 1 else np.diag(d)
    expected = np.linalg.svd(b)[1]
    assert np.allclose(found, expected, rtol=1e-9, atol=1e-14 * expected[0])


def test_dqds_of_zeros_and_equal_values():
    assert whitening.dqds(np.zeros(3), np.zeros(2)).tolist() == [0, 0, 0]
    assert np.allclose(whitening.dqds(np.ones(5), np.zeros(4)), 1)
    b = np.diag([1.0, 0, 2, 3]) + np.diag([1.0, 1, 1], 1)
    assert np.allclose(whitening.dqds(np.array([1.0, 0, 2, 3]), np.ones(3)), np.linalg.svd(b)[1], atol=1e-7)


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [3, 3, 3, 1, 1], [1, 1 - 1e-9, 1 - 2e-9, 0.5, 0], [2, 0, 0, 0, 0], [0] * 5])
def test_principal_directions(values):
    rng = np.random.default_rng(3)
    q, p = np.linalg.qr(rng.normal(size=(5, 5)))[0], np.linalg.qr(rng.normal(size=(5, 5)))[0]
    a = q @ np.diag(np.array(values, float)) @ p.T
    found, v = whitening.principal(a, 5)
    assert len(found) == sum(x > 0 for x in values)
    assert np.allclose(found, [x for x in values if x > 0], rtol=1e-12)
    assert np.allclose(v.T @ v, np.eye(len(found)), atol=1e-9)
    assert np.allclose(a.T @ a @ v, v * found**2, atol=1e-9)


def expected(rows, most):
    """The contract in plain numpy and Python integers."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), object)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s).astype(float) / n
    e, w = np.linalg.eigh(centred.T @ centred / n)
    order = [i for i in np.argsort(e)[::-1] if e[i] > 1e-9 * e.max()][:most]
    out = {}
    for i, x in kept:
        apart = n * np.array(x, object) - s
        project = (apart.astype(float) / n) @ w[:, order] / np.sqrt(e[order])
        out[i] = (sum(int(a) ** 2 for a in apart), project, e[order] / e.sum())
    return n, out


def check(rows, found, most):
    n, out = expected(rows, most)
    by_row = {}
    for r in found:
        by_row.setdefault(r.vec_id, []).append(r)
    assert by_row.keys() == out.keys()
    signs = None
    for i, (deviation, project, explained) in out.items():
        mine = sorted(by_row[i], key=lambda r: r.component)
        assert [r.component for r in mine] == list(range(1, len(project) + 1))
        assert {r.deviation for r in mine} == {deviation} and {r.n for r in mine} == {n}
        assert np.allclose([r.explained for r in mine], explained, rtol=1e-9)
        assert np.allclose(np.abs([r.whitened for r in mine]), np.abs(project), atol=1e-6)
        if signs is None and min(np.abs(project)) > 1e-3:
            signs = np.sign(project) * np.sign([r.whitened for r in mine])
        if signs is not None:
            assert np.allclose([r.whitened for r in mine], project * signs, atol=1e-6)
    assert max(r.identity_error for r in found) < 1e-9


SCHEMA = "vec_id long, embedding array<float>, n string, x int, __row int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "own", 1, 2) for i, v in rows], SCHEMA)


def test_against_plain_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 24)) * rng.uniform(0.2, 4, 24)
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [(2000, None), (2001, [])]
    rows += [(2002, [None] + rows[1][1][1:]), (2003, [float("nan")] + rows[1][1][1:]), (2004, [float("-inf")] + rows[1][1][1:])]
    rows += [(None, rows[5][1])]
    found = whitening.whitened(frame(spark, rows).repartition(9)).collect()
    assert found[0].x == 1 and found[0]["__row"] == 2
    check(rows, found, 16)


def test_few_rows_have_few_components(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.5, 2.0, -3.0]), (3, [1.0, 2.0, 3.0])]
    found = whitening.whitened(frame(spark, rows)).collect()
    assert {r.component for r in found} == {1} and len(found) == 3
    check(rows, found, 16)
    assert whitening.whitened(frame(spark, rows[:1])).collect() == []
    assert whitening.whitened(frame(spark, [])).collect() == []
    with pytest.raises(ValueError, match="length"):
        whitening.whitened(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_large_numbers_stay_exact(spark):
    rows = [(i, [1e7 * i, float(i * i)]) for i in range(40)]
    found = whitening.whitened(frame(spark, rows)).collect()
    n, out = expected(rows, 16)
    assert {r.vec_id: r.deviation for r in found} == {i: d if d < 1 << 63 else None for i, (d, _, _) in out.items()}


def test_embeddings_of_the_smallest_set(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check(rows, whitening.whitened(table).collect(), 16)
