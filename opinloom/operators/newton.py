"""Linear classifiers by a truncated Newton method: squared hinge loss and multinomial logistic loss.

Every step is a pass over the distributed rows. Newton directions come from conjugate gradients, scaled by the diagonal
of the Hessian, whose products with the Hessian are passes as well; the step size comes from one pass that tries several.
All classes are solved at once. Products read only the rows where the loss bends, if these are a small part: few of them
are fetched by the driver, which then needs no pass for a product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import DataFrame

from opinloom.operators.blocks import BLOCK_ROWS, Rows, read_blocks, small_batches, summed

STEPS = 0.5 ** np.arange(8)
AT_ONCE = 1 << 19  # entries that are multiplied together: these and their products stay in a core's cache
MOST_PRODUCTS = 12
AT_HAND = 1 << 20  # entries of rows that the driver holds for products of its own
KEPT_APART = 0.3  # of all entries, up to which rows that bend the loss are kept apart for a direction
LEAST_BEND = 1e-12  # second derivative by a margin, below which a row does not bend the loss
LEAST_GAIN = 1e-3  # of the objective, below which a step is the last
FORCING = 0.1  # of a gradient, the residual that a direction may leave


class SquaredHinge:
    """One class against the rest: ``C * sum max(0, 1 - y z)^2``; the constant input is penalised like any other."""

    separate, constant_penalty = True, 1.0

    @staticmethod
    def _gap(z: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = np.where(label[:, None] == np.arange(z.shape[1]), 1.0, -1.0)
        return np.maximum(0, 1 - y * z), y

    @classmethod
    def loss(cls, z: np.ndarray, label: np.ndarray) -> np.ndarray:
        return (cls._gap(z, label)[0] ** 2).sum(axis=0)

    @classmethod
    def slope(cls, z: np.ndarray, label: np.ndarray) -> np.ndarray:
        gap, y = cls._gap(z, label)
        return -2 * y * gap

    @classmethod
    def curvature(cls, z: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The second derivative by each margin alone."""
        return 2.0 * (cls._gap(z, label)[0] > 0)

    #: What the second derivative needs of a row.
    state = curvature

    @staticmethod
    def curved(state: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The second derivative times a change of the margins."""
        return state * u


class Softmax:
    """``C * sum -log p(label)`` over all classes together; the constant input carries no penalty."""

    separate, constant_penalty = False, 0.0

    @staticmethod
    def _log_sum(z: np.ndarray) -> np.ndarray:
        top = z.max(axis=1)
        return top + np.log(np.exp(z - top[:, None]).sum(axis=1))

    @classmethod
    def loss(cls, z: np.ndarray, label: np.ndarray) -> np.ndarray:
        return np.array([(cls._log_sum(z) - z[np.arange(len(z)), label]).sum()])

    @classmethod
    def slope(cls, z: np.ndarray, label: np.ndarray) -> np.ndarray:
        p = np.exp(z - cls._log_sum(z)[:, None])
        p[np.arange(len(z)), label] -= 1
        return p

    @classmethod
    def state(cls, z: np.ndarray, label: np.ndarray) -> np.ndarray:
        return np.exp(z - cls._log_sum(z)[:, None])

    @staticmethod
    def curved(p: np.ndarray, u: np.ndarray) -> np.ndarray:
        return p * (u - (p * u).sum(axis=1, keepdims=True))

    @classmethod
    def curvature(cls, z: np.ndarray, label: np.ndarray) -> np.ndarray:
        p = cls.state(z, label)
        return p * (1 - p)


LOSSES = {"squared_hinge": SquaredHinge, "softmax": Softmax}


@dataclass
class Fit:
    """Weights (inputs x classes), constants, and objective and training accuracy at the start and after each step."""

    weights: np.ndarray
    constant: np.ndarray
    history: list[tuple[float, float]] = field(default_factory=list)

    def model(self, features: str, prediction: str, spark) -> LogisticRegressionModel:
        """The class of the largest margin, as a model that Spark can save."""
        matrix = DenseMatrix(self.weights.shape[1], self.weights.shape[0], self.weights.T.ravel(order="F"))
        context = spark.sparkContext
        made = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
            f"linear_{id(self):x}", _py2java(context, matrix), _py2java(context, Vectors.dense(self.constant)), self.weights.shape[1], True)
        return LogisticRegressionModel(made).setFeaturesCol(features).setPredictionCol(prediction)


def _bends(curvature: np.ndarray) -> np.ndarray:
    return (curvature > LEAST_BEND).any(axis=1)


def _products(loss: type, inputs: int, parts: Iterator[Rows], v: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """The product of the Hessian of a part's loss; rows without a state are looked at from ``w``."""
    out = np.zeros_like(v)
    for rows in parts:
        state = rows.state.reshape(len(rows), -1) if w is None else loss.state(rows.times(w[:-1]) + w[-1], rows.label)
        side = loss.curved(state, rows.times(v[:-1]) + v[-1])
        out[:-1] += rows.transposed_times(side, inputs)
        out[-1] += side.sum(axis=0)
    return out


class _Passes:
    """Passes over the blocks for one loss; weights travel as a broadcast that is gone after its pass."""

    def __init__(self, blocks: DataFrame, loss: str, inputs: int, classes: int):
        self.blocks, self.loss, self.inputs, self.classes = blocks, LOSSES[loss], inputs, classes
        self.context, self.tasks = blocks.sparkSession.sparkContext, blocks.rdd.getNumPartitions()
        self.k = classes if self.loss.separate else 1

    def _run(self, part: Callable, size: int, *arrays: np.ndarray, blocks: DataFrame | None = None) -> np.ndarray:
        shipped = self.context.broadcast(arrays)
        try:
            return summed(self.blocks if blocks is None else blocks, lambda parts: part(parts, *shipped.value), size, self.tasks, AT_ONCE)
        finally:
            shipped.destroy()

    def gradient(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, tuple[float, float]]:
        """Losses, gradient and diagonal of the Hessian of the summed loss, the share of rows named rightly, and the entries
        of rows that bend the loss and of all rows.
        """
        loss, inputs, k = self.loss, self.inputs, self.k

        def part(parts: Iterator[Rows], w: np.ndarray) -> np.ndarray:
            total, grad, bend = np.zeros(k + 4), np.zeros_like(w), np.zeros_like(w)
            for rows in parts:
                z = rows.times(w[:-1]) + w[-1]
                total[:k] += loss.loss(z, rows.label)
                slope, curvature = loss.slope(z, rows.label), loss.curvature(z, rows.label)
                bent = np.diff(rows.begin)[_bends(curvature)].sum()
                total[k:] += (z.argmax(axis=1) == rows.label).sum(), len(rows), bent, len(rows.index)
                grad[:-1] += rows.transposed_times(slope, inputs)
                grad[-1] += slope.sum(axis=0)
                bend[:-1] += replace(rows, value=rows.value**2).transposed_times(curvature, inputs)
                bend[-1] += curvature.sum(axis=0)
            return np.concatenate([total, grad.ravel(), bend.ravel()])

        out = self._run(part, k + 4 + 2 * w.size, w)
        grad, bend = out[k + 4 :].reshape(2, *w.shape)
        return out[:k], grad, bend, out[k] / max(out[k + 1], 1), tuple(out[k + 2 : k + 4])

    def _bent(self, shipped: Broadcast) -> DataFrame:
        """The rows that bend the loss at the weights in ``shipped``, in blocks with their state."""
        loss = self.loss

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = shipped.value
            for rows in read_blocks(batches, AT_ONCE):
                z = rows.times(w[:-1]) + w[-1]
                at = np.flatnonzero(_bends(loss.curvature(z, rows.label)))
                state = loss.state(z, rows.label)[at]
                for first in range(0, len(at), BLOCK_ROWS):
                    part = rows.taken(at[first : first + BLOCK_ROWS])
                    cells = (part.begin.astype(np.int64), part.index, part.value, part.label, state[first : first + BLOCK_ROWS])
                    yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], ["begin", "index", "value", "label", "state"])

        return self.blocks.mapInArrow(read, "begin binary, index binary, value binary, label binary, state binary")

    @contextmanager
    def hessian(self, w: np.ndarray, bent: float, entries: float) -> Iterator[Callable]:
        """The product with the Hessian of the summed loss at ``w``.

        Rows that do not bend the loss add nothing. A few that do are held by the driver, a part of all rows is kept apart
        for as long as it is needed, and if most rows bend all are read.
        """
        part = partial(_products, self.loss, self.inputs)
        if bent > max(AT_HAND, KEPT_APART * entries):
            yield lambda v: self._run(part, w.size, v, w).reshape(w.shape)
            return
        shipped = self.context.broadcast(w)
        rows = self._bent(shipped)
        try:
            if bent <= AT_HAND:
                with small_batches(rows.sparkSession):
                    held = list(read_blocks(iter(rows.toArrow().to_batches()), AT_ONCE))
                yield partial(part, held)
            else:
                rows.persist(StorageLevel.MEMORY_AND_DISK)
                yield lambda v: self._run(part, w.size, v, blocks=rows).reshape(w.shape)
        finally:
            rows.unpersist()
            shipped.destroy()

    def along(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Losses at each of ``STEPS`` along a direction."""
        loss, k = self.loss, self.k

        def part(parts: Iterator[Rows], w: np.ndarray, v: np.ndarray) -> np.ndarray:
            out = np.zeros((len(STEPS), k))
            for rows in parts:
                z, u = rows.times(w[:-1]) + w[-1], rows.times(v[:-1]) + v[-1]
                out += [loss.loss(z + t * u, rows.label) for t in STEPS]
            return out

        return self._run(part, len(STEPS) * k, w, v).reshape(len(STEPS), k)


def fit(blocks: DataFrame, inputs: int, classes: int, loss: str, C: float = 1.0, tol: float = 1e-3, max_iter: int = 50,
        gain: float = LEAST_GAIN) -> Fit:
    """Minimise ``0.5 |w|^2 + C * loss`` over rows in ``blocks``.

    Ends when the gradient is ``tol`` of what it was at zero or a step gains less than ``gain`` of the objective;
    ``max_iter`` bounds the Newton steps. The last row of the history is that of the result.
    """
    passes = _Passes(blocks, loss, inputs, classes)
    penalty = np.ones((inputs + 1, 1))
    penalty[-1] = passes.loss.constant_penalty
    # separate problems have their own sums, a joint one a single sum over all classes
    over = (lambda a: a.sum(axis=0)) if passes.loss.separate else (lambda a: a.sum(keepdims=True).ravel())
    w, history, first = np.zeros((inputs + 1, classes)), [], None
    while True:
        losses, slope, bend, right, bent = passes.gradient(w)
        value = 0.5 * over(penalty * w * w) + C * losses
        history.append((float(value.sum()), float(right)))
        gradient = penalty * w + C * slope
        size = np.sqrt(over(gradient**2))
        first = size if first is None else first
        open_ = size > tol * np.maximum(first, 1e-300)
        gained = len(history) < 2 or history[-2][0] - history[-1][0] > gain * history[-1][0]
        if not open_.any() or not gained or len(history) > max_iter:
            return Fit(w[:-1], w[-1], history)
        with passes.hessian(w, *bent) as product:
            direction = _direction(product, gradient * open_, penalty, np.maximum(penalty + C * bend, 1e-12), C, over)
        tried = np.array([0.5 * over(penalty * (w + t * direction) ** 2) for t in STEPS]) + C * passes.along(w, direction)
        w = w + np.where(tried.min(axis=0) < value, STEPS[tried.argmin(axis=0)], 0.0) * direction


def _direction(
    product: Callable, gradient: np.ndarray, penalty: np.ndarray, diagonal: np.ndarray, C: float, over: Callable
) -> np.ndarray:
    """Conjugate gradients for the Newton equations, each problem until its residual is a tenth of its gradient."""
    found, residual = np.zeros_like(gradient), -gradient
    search = residual / diagonal
    square = over(residual * search)
    goal = FORCING**2 * square
    for _ in range(MOST_PRODUCTS):
        if (square <= goal).all():
            break
        curved = penalty * search + C * product(search)
        bend = over(search * curved)
        length = np.where((square > goal) & (bend > 0), square / np.where(bend > 0, bend, 1), 0.0)
        found = found + length * search
        residual = residual - length * curved
        following = over(residual * residual / diagonal)
        search = residual / diagonal + np.where(square > 0, following / np.where(square > 0, square, 1), 0.0) * search
        square = np.where(length > 0, following, np.minimum(square, goal))
    return found
