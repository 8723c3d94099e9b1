"""A classifier that sums learnt word vectors by weight and passes the sum through dense layers.

The table of word vectors is shared by all tasks. In each epoch every task starts from the same weights, takes small
steps over its own rows that touch only the words they hold, and the results are averaged by rows, piece by piece of
the table. A lost task is run again from the same weights and gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.ml import Model
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinloom.operators.blocks import Rows, summed

WIDTH, HIDDEN = 32, (64, 32)
BATCH, RATE, DROPPED, DECAY = 32, 0.05, 0.3, 1e-4


@dataclass
class Bag:
    """Word vectors, dense layers, and what a training step needs besides: summed squared gradients of each."""

    arrays: list[np.ndarray]
    squares: list[np.ndarray]
    history: list[tuple[float, float]] = field(default_factory=list)

    @staticmethod
    def made(inputs: int, classes: int, seed: int, width: int, hidden: tuple[int, ...]) -> Bag:
        rng = np.random.default_rng(seed)
        sizes = [width, *hidden, classes]
        arrays = [rng.normal(0, 0.3, (inputs, width))]
        for a, b in zip(sizes[:-1], sizes[1:], strict=True):
            arrays += [rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)]
        return Bag(arrays, [np.full(x.shape, 1e-2) for x in arrays])

    def packed(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.arrays, *self.squares)])

    @staticmethod
    def unpacked(numbers: np.ndarray, shapes: list[tuple[int, ...]]) -> Bag:
        """A bag of its own out of ``packed``, by the shapes of its arrays."""
        out, at = [], 0
        for shape in shapes * 2:
            size = int(np.prod(shape))
            out.append(numbers[at : at + size].reshape(shape).copy())
            at += size
        return Bag(out[: len(shapes)], out[len(shapes) :])

    def forward(self, rows: Rows, kept: np.ndarray | float = 1.0) -> list[np.ndarray]:
        """The words of a few rows, their weights as a dense matrix, their vectors, the sum of these and every layer's output.

        Weights of a row are scaled to length one.
        """
        word, x = rows.dense(len(self.arrays[0]))
        x /= np.maximum(np.sqrt(np.bincount(rows.row, rows.value**2, len(rows))), 1e-12)[:, None]
        vectors = self.arrays[0].take(word, axis=0)
        out = [word, x, vectors, (x @ vectors) * kept]
        layers = len(self.arrays) // 2
        for i in range(layers):
            z = out[-1] @ self.arrays[1 + 2 * i] + self.arrays[2 + 2 * i]
            out.append(np.maximum(z, 0) if i + 1 < layers else z)
        return out

    def scores(self, rows: Rows) -> np.ndarray:
        """The last layer's output for any number of rows."""
        few = [self.forward(rows.part(i, min(i + BATCH, len(rows))))[-1] for i in range(0, len(rows), BATCH)]
        return np.concatenate([np.zeros((0, self.arrays[-1].size)), *few])

    def probabilities(self, rows: Rows) -> np.ndarray:
        z = self.scores(rows)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def step(self, rows: Rows, rng: np.random.Generator) -> None:
        """One step over a batch: dense gradients for the layers, those of the words that occur for the table."""
        kept = (rng.random((len(rows), self.arrays[0].shape[1])) >= DROPPED) / (1 - DROPPED)
        word, x, vectors, *out = self.forward(rows, kept)
        z = out[-1]
        side = np.exp(z - z.max(axis=1, keepdims=True))
        side /= side.sum(axis=1, keepdims=True)
        side[np.arange(len(rows)), rows.label] -= 1
        side /= len(rows)
        for i in reversed(range(len(self.arrays) // 2)):
            w, below = 1 + 2 * i, out[i]
            grads = (below.T @ side + DECAY * self.arrays[w], side.sum(axis=0))
            side = (side @ self.arrays[w].T) * ((below > 0) if i else kept)
            for at, grad in zip((w, w + 1), grads, strict=True):
                self.squares[at] += grad**2
                self.arrays[at] -= RATE * grad / np.sqrt(self.squares[at])
        # most of a step's time: in place, and no row of the table fetched twice
        grad = x.T @ side
        squares = self.squares[0].take(word, axis=0)
        squares += grad * grad
        self.squares[0][word] = squares
        grad *= RATE
        grad /= np.sqrt(squares, out=squares)
        vectors -= grad
        self.arrays[0][word] = vectors


def fit(
    blocks: DataFrame, inputs: int, classes: int, epochs: int, seed: int, width: int = WIDTH, hidden: tuple[int, ...] = HIDDEN,
    curve: bool = True
) -> Bag:
    """A bag learnt in ``epochs`` rounds; its history has mean loss and accuracy of the averaged weights after each.

    Without ``curve`` it is the same bag without a history, which takes a look at every row in every round, and one more round.
    """
    context, tasks = blocks.sparkSession.sparkContext, blocks.rdd.getNumPartitions()
    bag = Bag.made(inputs, classes, seed, width, hidden)
    start, shapes, history = bag.packed(), [x.shape for x in bag.arrays], []
    for epoch in range(epochs + curve):
        shipped = context.broadcast(start)

        def partial(parts: Iterator[Rows], shipped: Broadcast = shipped, epoch: int = epoch, last: bool = epoch == epochs) -> np.ndarray:
            own = Bag.unpacked(shipped.value, shapes)
            rng = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
            loss, right, n = 0.0, 0, 0
            before = Bag.unpacked(shipped.value, shapes) if curve else None
            for rows in parts:
                n += len(rows)
                if curve:
                    p = before.probabilities(rows)
                    loss -= np.log(np.maximum(p[np.arange(len(rows)), rows.label], 1e-300)).sum()
                    right += (p.argmax(axis=1) == rows.label).sum()
                order = rng.permutation(len(rows))
                for first in range(0, 0 if last else len(rows), BATCH):
                    own.step(rows.taken(order[first : first + BATCH]), rng)
            return np.r_[loss, right, n, n * own.packed()]

        out = summed(blocks, partial, 3 + len(start), tasks)
        shipped.destroy()
        n = max(out[2], 1)
        if epoch and curve:
            history.append((float(out[0] / n), float(out[1] / n)))
        start = out[3:] / n if out[2] and epoch < epochs else start
    done = Bag.unpacked(start, shapes)
    done.history = history
    return done


class EmbeddingBagModel(Model, HasFeaturesCol, HasPredictionCol, MLReadable, MLWritable):
    """Adds the class a bag finds most likely."""

    def __init__(self, bag: Bag | None = None, features: str = "features", prediction: str = "prediction"):
        super().__init__()
        self.bag = bag
        self._set(featuresCol=features, predictionCol=prediction)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shipped = dataset.sparkSession.sparkContext.broadcast(self.bag.arrays)

        @F.pandas_udf("double")
        def predict(indices: pd.Series, values: pd.Series) -> pd.Series:
            bag = Bag(shipped.value, [])
            index = [np.arange(len(v)) if i is None else i for i, v in zip(indices, values, strict=True)]
            begin = np.r_[0, np.cumsum([len(i) for i in index])].astype(np.int64)
            rows = Rows(begin, np.concatenate([*index, np.zeros(0)]).astype(np.int64), np.concatenate([*values, np.zeros(0)]), np.zeros(len(index), int))
            return pd.Series(bag.scores(rows).argmax(axis=1).astype(float))

        cells = F.unwrap_udt(self.getFeaturesCol())
        return dataset.withColumn(self.getPredictionCol(), predict(cells["indices"], cells["values"]))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: EmbeddingBagModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        rows = [(i, list(x.shape), x.astype(np.float64).tobytes()) for i, x in enumerate(self.model.bag.arrays)]
        spark.createDataFrame(rows, "at int, shape array<int>, numbers binary").write.parquet(f"{path}/arrays")


class _Reader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> EmbeddingBagModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        rows = sorted(spark.read.parquet(f"{path}/arrays").collect())
        model = self.kind(Bag([np.frombuffer(r.numbers, np.float64).reshape(r.shape) for r in rows], []))
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
