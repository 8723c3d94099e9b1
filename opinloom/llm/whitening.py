"""Whitening of embeddings from the singular values of their centred rows.

The rows of a fit list are centred and reduced block by block to triangular factors, which are joined in a tree until
one of a row's width is left. Householder reflections make it bidiagonal; its singular values come from the dqds
iteration, which keeps small ones as accurate as large ones, and its singular vectors from twisted factorisations.
Only sums and triangular factors (width x width) leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinloom.llm.shared import Work, python_tasks, row_unpacked, with_row

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
BLOCK_ROWS = 1_024
FAN_IN = 16
EPS = np.finfo(float).eps


# The small dense part: matrices of a row's width.


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and right factor ``v`` of a square matrix, by Householder reflections.

    ``r = u b v^T`` with orthogonal ``u``, which nothing here needs.
    """
    a = r.astype(float).copy()
    n = len(a)
    v = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        """The unit vector of the reflection that leaves only the first entry of ``x``."""
        if not np.any(x[1:]):
            return None
        h = x / np.abs(x).max()
        h[0] += math.copysign(np.linalg.norm(h), h[0])
        return h / np.linalg.norm(h)

    for k in range(n):
        h = reflector(a[k:, k])
        if h is not None:
            a[k:, k:] -= 2 * np.outer(h, h @ a[k:, k:])
        h = reflector(a[k, k + 1 :]) if k + 2 < n else None
        if h is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ h, h)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ h, h)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, float] | None:
    """One dqds transform; None if the shift went beyond the smallest value. Also the last and the least ``d``."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    least = d
    for k in range(n - 1):
        if d < 0:
            return None
        new_q[k] = d + e[k]
        if new_q[k] == 0:
            return None
        ratio = q[k + 1] / new_q[k]
        new_e[k] = e[k] * ratio
        d = d * ratio - shift
        least = min(least, d)
    if d < 0:
        return None
    new_q[-1] = d
    return new_q, new_e, d, least


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Singular values of an upper bidiagonal matrix, largest first, by the differential qd iteration with shifts."""
    values: list[float] = []
    blocks = [(list(map(float, diagonal**2)), list(map(float, upper**2)), 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        step, tries = 0.0, 0
        while q:
            n = len(q)
            if n == 1:
                values.append(moved + q[0])
                break
            small = [k for k in range(n - 1) if e[k] <= (EPS * EPS) * (q[k] + q[k + 1] + moved) or e[k] <= EPS * EPS * moved]
            if small:
                k = small[-1]
                if k == n - 2:
                    values.append(moved + q[-1])
                    q, e = q[:-1], e[:-1]
                else:
                    blocks.append((q[: k + 1], e[:k], moved))
                    q, e = q[k + 1 :], e[k + 1 :]
                step = 0.0
                continue
            if min(q) == 0:  # a zero on the diagonal: an unshifted transform moves it to the end
                q, e = _zero_moved(q, e)
                continue
            done = _step(q, e, step)
            tries = 0 if done else tries + 1
            if done is None:
                step = step / 4 if tries < 4 else 0.0
                done = _step(q, e, 0.0) if step == 0.0 else None
                if done is None:
                    continue
                moved_by = 0.0
            else:
                moved_by = step
            q, e, last, least = done
            moved += moved_by
            # a lower bound of the smallest value, from the ends of the array
            gap = e[-1] if e else 0.0
            step = max(0.0, min(least, last) - math.sqrt(max(0.0, gap * last))) if least > 0 else 0.0
            if step >= least:
                step = 0.75 * least
    return np.sqrt(np.sort(np.array(values))[::-1])


def _zero_moved(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The same singular values with a zero of the diagonal at the end, by one transform of the product."""
    n = len(q)
    b = np.diag(np.sqrt(q)) + np.diag(np.sqrt(e), 1)
    for _ in range(2):
        b = np.linalg.qr(b.T)[1]
    d, u = np.diag(b) ** 2, np.diag(b, 1) ** 2
    k = int(np.argmin(d))
    d[k] = 0.0
    if k < n - 1:
        u[k] = 0.0
    if k > 0 and u[k - 1] < EPS * d.max():
        u[k - 1] = 0.0
    return d.tolist(), u.tolist()


def twisted_vector(diagonal: np.ndarray, upper: np.ndarray, value: float, start: int | None = None) -> np.ndarray:
    """The right singular vector of a bidiagonal matrix for one singular value.

    ``b^T b - value^2`` is factorised from the top and from the bottom; where the two meet with the smallest remainder,
    the vector has a large entry, and the others follow from it by multiplications alone.
    """
    n, s = len(diagonal), value * value
    d, off = diagonal**2, diagonal[:-1] * upper
    d[1:] += upper**2
    tiny = EPS * EPS * max(s, float(d.max(initial=0)), 1e-290)
    down, up = np.empty(n), np.empty(n)
    down[0] = d[0] - s
    for k in range(1, n):
        pivot = down[k - 1] if abs(down[k - 1]) > tiny else math.copysign(tiny, down[k - 1])
        down[k] = d[k] - s - off[k - 1] ** 2 / pivot
    up[-1] = d[-1] - s
    for k in range(n - 2, -1, -1):
        pivot = up[k + 1] if abs(up[k + 1]) > tiny else math.copysign(tiny, up[k + 1])
        up[k] = d[k] - s - off[k] ** 2 / pivot
    r = int(np.argmin(np.abs(down + up - (d - s)))) if start is None else start
    z = np.zeros(n)
    z[r] = 1.0
    for k in range(r - 1, -1, -1):
        pivot = down[k] if abs(down[k]) > tiny else math.copysign(tiny, down[k])
        z[k] = -off[k] * z[k + 1] / pivot
    for k in range(r + 1, n):
        pivot = up[k] if abs(up[k]) > tiny else math.copysign(tiny, up[k])
        z[k] = -off[k - 1] * z[k - 1] / pivot
    return z / np.linalg.norm(z)


def _blocks(diagonal: np.ndarray, upper: np.ndarray) -> list[tuple[int, int]]:
    """Parts of a bidiagonal matrix between off-diagonal entries that are zero to working precision."""
    size = max(float(np.abs(diagonal).max(initial=0)), float(np.abs(upper).max(initial=0)))
    cuts = [0, *(np.flatnonzero(np.abs(upper) <= EPS * size) + 1).tolist(), len(diagonal)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def principal(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values of ``r`` and their right singular vectors as columns, ``most`` at most.

    Vectors of values that lie close together are made orthogonal to each other; where that leaves too little of one,
    it is taken up again from another twist. Values that are zero to working precision have no direction.
    """
    diagonal, upper, v = bidiagonal(r)
    pairs = []
    for a, b in _blocks(diagonal, upper):
        found = dqds(diagonal[a:b], upper[a : b - 1])
        for place, value in enumerate(found):
            pairs.append((float(value), a, b, place, found))
    pairs.sort(key=lambda p: -p[0])
    largest = pairs[0][0] if pairs else 0.0
    values, vectors = [], []
    for value, a, b, _, _ in pairs[:most]:
        if value <= len(r) * EPS * largest or value == 0:
            break
        close = [z for z, w in zip(vectors, values, strict=True) if w - value <= 1e-3 * value]
        d, u = diagonal[a:b], upper[a : b - 1]
        z = np.zeros(len(diagonal))
        for start in (None, *range(b - a)):
            z[:] = 0
            z[a:b] = twisted_vector(d.copy(), u, value, start)
            kept = 1.0
            for _ in range(2):
                for other in close:
                    z -= other * (other @ z)
                kept *= np.linalg.norm(z)
                z /= np.linalg.norm(z) or 1.0
            if kept > 0.1:
                break
        values.append(value)
        vectors.append(z)
    if not values:
        return np.zeros(0), np.zeros((len(r), 0))
    directions = v @ np.array(vectors).T
    largest_entry = np.abs(directions).argmax(axis=0)
    return np.array(values), directions * np.sign(directions[largest_entry, np.arange(len(values))])


# The distributed part.


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    """Rows of 64-bit integers held as bytes."""
    _, _, data = column.buffers()
    if data is None or not len(column):
        return np.zeros((0, width), np.int64)
    return np.frombuffer(data, np.int64)[column.offset * width : (column.offset + len(column)) * width].reshape(-1, width)


def _integer_rows(rows: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is whole and finite, with ``x``, its integers as bytes, and ``width``."""
    whole = F.forall("cells", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = with_row(rows, F.col(vector).cast("array<double>").alias("cells")).where((F.size("cells") > 0) & whole)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(1)
            values = np.floor(SCALE * cells.flatten().to_numpy(zero_copy_only=False)).astype(np.int64) + SHIFT
            sizes = cells.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *(8 * sizes.astype(np.int64))], dtype=np.int32)
            x = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([batch.column(0), x], ["__row", "x"])

    schema = kept.select("__row", F.lit(b"").alias("x")).schema
    return kept.mapInArrow(read, schema)


def _per_block(rows: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in rows:
        for first in range(0, batch.num_rows, BLOCK_ROWS):
            yield _numbers(batch.column(batch.schema.get_field_index("x")).slice(first, BLOCK_ROWS), width)


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, np.int64)
        for block in _per_block(batches, width):
            n, total = n + len(block), total + block.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))], ["n", "total"])

    parts = fit.select("x").mapInArrow(read, "n long, total array<long>")
    whole = F.col("value").cast("decimal(38,0)")
    by_dimension = parts.select("n", F.posexplode("total").alias("dimension", "value")).groupBy("dimension").agg(
        F.sum(whole).alias("total"), F.sum("n").alias("n"))
    rows = sorted(by_dimension.collect())
    return (int(rows[0].n), [int(r.total) for r in rows]) if rows else (0, [0] * width)


def _centre(x: np.ndarray, n: int, sums: np.ndarray, exact: list[int]) -> np.ndarray:
    """``x - S/n``, taken as whole numbers ``n x - S`` first where these fit 64 bits."""
    if len(x) and n * int(np.abs(x).max()) + max(map(abs, exact)) >= 1 << 62:
        whole = np.array([s // n for s in exact], np.int64)
        return (x - whole) - np.array([(s % n) / n for s in exact])
    return (n * x - sums) / n


def _factors(fit: DataFrame, width: int, n: int, exact: list[int], work: Work) -> np.ndarray:
    """The triangular factor of all centred rows, joined from those of the tasks in a tree."""
    sums = np.array(exact, object) if max(map(abs, exact)) >= 1 << 63 else np.array(exact, np.int64)

    def joined(blocks: Iterator[np.ndarray]) -> np.ndarray:
        r = np.zeros((0, width))
        for block in blocks:
            r = np.linalg.qr(np.concatenate([r, block]), mode="r")
        return r

    def given(r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.astype(float).tobytes()], pa.binary())], ["r"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = joined(_centre(x, n, sums, exact).astype(float) for x in _per_block(batches, width))
        if len(r):
            yield given(r)

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = joined(np.frombuffer(x.as_py(), float).reshape(-1, width) for batch in batches for x in batch.column(0))
        if len(r):
            yield given(r)

    factors = work.table(fit.select("x").mapInArrow(first, "r binary"), "factors")
    while (left := factors.count()) > FAN_IN:
        nearer = work.table(factors.repartition(math.ceil(left / FAN_IN)).mapInArrow(further, "r binary"), "factors")
        work.drop(factors)
        factors = nearer
    r = joined(np.frombuffer(row.r, float).reshape(-1, width) for row in factors.collect())
    work.drop(factors)
    return np.concatenate([r, np.zeros((max(0, width - len(r)), width))])


def _identity_error(fit: DataFrame, width: int, n: int, exact: list[int], directions: np.ndarray) -> float:
    """The largest entry by which the covariance of the whitened fit list differs from the identity."""
    k = directions.shape[1]
    sums = np.array(exact)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for x in _per_block(batches, width):
            w = _centre(x, n, sums, exact).astype(float) @ directions
            total[0] += w.sum(axis=0)
            total[1:] += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["total"])

    rows = fit.select("x").mapInArrow(read, "total array<double>").select(F.posexplode("total").alias("at", "value"))
    total = np.array([r.value for r in sorted(rows.groupBy("at").agg(F.sum("value").alias("value")).collect())]).reshape(k + 1, k) / n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


def whitened(vectors: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Every row with a whole, finite vector, once for each component: the columns of ``vectors`` and
    ``component, n, deviation, whitened, explained, identity_error``.

    Entries become integers ``floor(64 c) + 1000000``; the fit list holds each distinct vector once. Rows whose vector is
    null, empty or holds a null or a number that is not finite are left out; repeated rows get equal answers; further
    columns stay, those named like an added one are replaced. Components without variance do not exist, so there may be
    fewer than ``most``, and none for an empty table or a single distinct vector. A deviation beyond 64 bits is null.
    Vectors of different lengths have no common covariance: ValueError.
    """
    work = Work(python_tasks(vectors.sparkSession))
    rows = work.table(_integer_rows(vectors, vector), "vectors")
    fit = work.table(rows.select("x").distinct(), "fit")
    widths = fit.agg(F.min(F.length("x")), F.max(F.length("x"))).first()
    if widths[0] != widths[1]:
        raise ValueError("vectors differ in length")
    width = (widths[0] or 8) // 8
    n, exact = _sums(fit, width)
    values, directions = np.zeros(0), np.zeros((width, 0))
    trace = 1.0
    if n:
        r = _factors(fit, width, n, exact, work)
        values, directions = principal(r, most)
        trace = float((r**2).sum())
    spread = directions * (math.sqrt(n) / values if len(values) else 1.0)
    error = _identity_error(fit, width, n, exact, spread) if len(values) else 0.0
    explained, sums = values**2 / trace, np.array(exact)
    k = len(values)

    def deviation(x: np.ndarray) -> list[int | None]:
        far = n * int(np.abs(x).max(initial=0)) + max(map(abs, exact))
        if far < 1 << 62:
            apart = n * x - sums
            if int(np.abs(apart).max(initial=0)) ** 2 * width < 1 << 62:
                return (apart * apart).sum(axis=1).tolist()
        whole = [sum((n * int(c) - s) ** 2 for c, s in zip(row, exact, strict=True)) for row in x]
        return [d if d < 1 << 63 else None for d in whole]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(first, BLOCK_ROWS)
                x = _numbers(part.column(1), width)
                w = _centre(x, n, sums, exact).astype(float) @ spread
                at = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(deviation(x), pa.int64()).take(at), pa.array(w.ravel()), pa.array(np.tile(explained, len(x)))],
                    ["__row", "component", "deviation", "whitened", "explained"])

    schema = rows.select("__row", F.lit(1).alias("component"), F.lit(1).cast("long").alias("deviation"), F.lit(1.0).alias("whitened"),
                         F.lit(1.0).alias("explained")).schema
    for field in schema:
        field.nullable = True
    work.drop(fit)
    answers = (rows if k else rows.limit(0)).mapInArrow(read, schema)
    return row_unpacked(answers, vectors.columns, "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained",
                        F.lit(error).alias("identity_error"))
