"""Training rows as blocks of sparse matrices, and sums over all of them.

Solvers that need a pass over all rows for each step read them as Arrow batches of compressed rows, compute in numpy and
give one partial result a task. Partial results are cut into pieces and added piece by piece, in levels, so that no task
ever holds more than a bounded number of them; the driver gets the sum alone, whatever the number of tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_ROWS = 512
AT_ONCE = 1 << 21  # entries that a pass multiplies together
FAN_IN = 32  # partial results that are added in one place
PIECE = 1 << 14  # numbers in a piece of a partial result
BATCH_BYTES = 1 << 23  # of blocks that are sent to a Python worker at once; both sides hold them
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@dataclass
class Rows:
    """Compressed sparse rows with their class, and numbers of a solver for each row, one row after the other, if it adds them."""

    begin: np.ndarray
    index: np.ndarray
    value: np.ndarray
    label: np.ndarray
    state: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.label)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.begin))

    def times(self, weights: np.ndarray) -> np.ndarray:
        """The product with a matrix (inputs x columns), by column, as long plain arrays are handled fastest."""
        out = np.zeros((len(self), weights.shape[1]))
        some = np.flatnonzero(np.diff(self.begin))
        if len(some):
            index, begin = self.index.astype(np.intp), self.begin[some]
            for k in range(weights.shape[1]):
                cells = np.ascontiguousarray(weights[:, k]).take(index)
                cells *= self.value
                out[some, k] = np.add.reduceat(cells, begin)
        return out

    def transposed_times(self, sides: np.ndarray, inputs: int) -> np.ndarray:
        """The product of the transpose with a matrix (rows x columns)."""
        index, size = self.index.astype(np.intp), np.diff(self.begin)
        out = np.empty((inputs, sides.shape[1]))
        for k in range(sides.shape[1]):
            cells = np.repeat(sides[:, k], size)
            cells *= self.value
            out[:, k] = np.bincount(index, cells, inputs)
        return out

    def dense(self, inputs: int) -> tuple[np.ndarray, np.ndarray]:
        """The inputs that occur, in order, and a dense matrix over them; for a few rows."""
        found, place = np.zeros(inputs, bool), np.empty(inputs, np.intp)
        found[self.index] = True
        used = np.flatnonzero(found)
        place[used] = np.arange(len(used))
        size = (len(self), len(used))
        return used, np.bincount(self.row * size[1] + place[self.index], self.value, size[0] * size[1]).reshape(size)

    def part(self, first: int, last: int) -> Rows:
        a, b = self.begin[first], self.begin[last]
        return Rows(self.begin[first : last + 1] - a, self.index[a:b], self.value[a:b], self.label[first:last])

    def taken(self, at: np.ndarray) -> Rows:
        size = np.diff(self.begin)[at]
        begin = np.r_[0, np.cumsum(size)]
        entry = np.repeat(self.begin[at] - begin[:-1], size) + np.arange(begin[-1])
        return Rows(begin, self.index[entry], self.value[entry], self.label[at])

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        sizes = np.concatenate([np.diff(p.begin) for p in parts])
        return Rows(np.r_[0, np.cumsum(sizes)], *(np.concatenate([getattr(p, c) for p in parts]) for c in ("index", "value", "label")),
                    None if parts[0].state is None else np.concatenate([p.state for p in parts]))


def as_blocks(rows: DataFrame, vector: str, label: str) -> DataFrame:
    """``begin, index, value, label`` as bytes, for blocks of rows; dense vectors have every index."""
    cells = F.unwrap_udt(vector)
    given = rows.select(cells["indices"].alias("indices"), cells["values"].alias("values"), F.col(label).cast("int").alias("label"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                indices, values, labels = batch.slice(first, BLOCK_ROWS).columns
                size = values.value_lengths().to_numpy(zero_copy_only=False)
                begin = np.r_[0, np.cumsum(size)].astype(np.int64)
                if indices.null_count:
                    index = np.concatenate([np.arange(n) if i is None else np.array(i) for i, n in zip(indices.to_pylist(), size, strict=True)])
                else:
                    index = indices.flatten().to_numpy(zero_copy_only=False)
                cells = (begin, index.astype(np.int32), values.flatten().to_numpy(zero_copy_only=False), labels.to_numpy().astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], ["begin", "index", "value", "label"])

    return given.mapInArrow(read, "begin binary, index binary, value binary, label binary")


def read_blocks(batches: Iterator[pa.RecordBatch], at_once: int = AT_ONCE) -> Iterator[Rows]:
    """The blocks of a task, joined to parts of a bounded number of entries."""
    parts, held = [], 0
    for batch in batches:
        for at in range(batch.num_rows):
            cells = (np.frombuffer(c[at].as_buffer(), k) for c, k in zip(batch.columns, (np.int64, np.int32, np.float64, np.int32, np.float64), strict=False))
            parts.append(Rows(*cells))
            held += len(parts[-1].index)
            if held >= at_once:
                yield Rows.joined(parts)
                parts, held = [], 0
    if parts:
        yield Rows.joined(parts)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that move blocks to and from Python in small batches: a block is a large row, so Spark's 64 MiB are much for a core."""
    before = spark.conf.get(BATCH_LIMIT, None)
    spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_LIMIT)
        else:
            spark.conf.set(BATCH_LIMIT, before)


def _added(parts: list[bytes]) -> bytes:
    total = np.frombuffer(parts[0], np.float64).copy()
    for p in parts[1:]:
        total += np.frombuffer(p, np.float64)
    return total.tobytes()


def summed(
    blocks: DataFrame, partial: Callable[[Iterator[Rows]], np.ndarray], size: int, tasks: int, at_once: int = AT_ONCE
) -> np.ndarray:
    """The sum over the ``tasks`` partitions of ``partial``, which makes ``size`` numbers of the rows of a task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        result = np.asarray(partial(read_blocks(batches, at_once)), np.float64).ravel()
        pieces = [result[i : i + PIECE].tobytes() for i in range(0, size, PIECE)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], ["piece", "part"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"piece": table["piece"][:1], "part": pa.array([_added(table["part"].to_pylist())], pa.binary())})

    kind = "piece int, part binary"
    parts = blocks.mapInArrow(read, kind)
    # the driver adds few small results itself
    while tasks > (1 if size > PIECE else FAN_IN):
        tasks = math.ceil(tasks / FAN_IN)
        salt = F.pmod(F.monotonically_increasing_id().bitwiseXOR(F.shiftrightunsigned(F.monotonically_increasing_id(), 33)), F.lit(tasks))
        parts = parts.withColumn("salt", salt).groupBy("piece", "salt").applyInArrow(add, kind)
    total = np.zeros(size)
    with small_batches(blocks.sparkSession):
        sums = parts.toArrow().to_pylist()
    for row in sums:
        piece = np.frombuffer(row["part"], np.float64)
        total[row["piece"] * PIECE : row["piece"] * PIECE + len(piece)] += piece
    return total
