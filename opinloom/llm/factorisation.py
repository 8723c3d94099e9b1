"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinloom.llm.hashing import U
from opinloom.llm.shared import held_out, plain_text, python_tasks, sliced, text_bytes
from opinloom.llm.textstats import CONTINUED, per_text, structure

WORD_BITS = 13
RANK = 8
FIT_ROWS = 8000
EPOCHS = 10
BATCH = 256
RATE = 0.01
DECAY = 1e-5
KEEP_SCORE = 0.3


def features(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Dense features of each text, and its hashed words as (text, slot, value), scaled to length one."""
    dense, hashes, text = structure(data, offsets)
    chars = np.diff(offsets) - per_text(CONTINUED[data], offsets)
    declared = np.where(np.isnan(n_chars), chars, n_chars)
    dense = np.column_stack([dense, np.log1p(np.maximum(declared, 0)), np.abs(declared - chars) / np.maximum(chars, 1)])
    key, count = np.unique((text.astype(np.int64) << WORD_BITS) | (hashes >> U(64 - WORD_BITS)).astype(np.int64), return_counts=True)
    row, value = key >> WORD_BITS, np.log1p(count)
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=len(offsets) - 1))
    return dense, row, key & ((1 << WORD_BITS) - 1), value / norm[row]


@dataclass
class Machine:
    """Bias, weights and factors; words first, dense features after them, standardised and cut to five deviations."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray

    def dense(self, raw: np.ndarray) -> np.ndarray:
        return np.clip((raw - self.mean) / self.deviation, -5, 5)

    def score(self, raw: np.ndarray, row: np.ndarray, slot: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Probabilities in time linear in the features: the pairwise terms are half of (sum v x)^2 - sum (v x)^2."""
        n, words = len(raw), 1 << WORD_BITS
        x = self.dense(raw)
        total = self.bias + x @ self.weights[words:] + np.bincount(row, weights=value * self.weights[slot], minlength=n)
        for f in range(self.factors.shape[1]):
            v = self.factors[:, f]
            vx = value * v[slot]
            sums = x @ v[words:] + np.bincount(row, weights=vx, minlength=n)
            squares = (x * x) @ (v[words:] ** 2) + np.bincount(row, weights=vx * vx, minlength=n)
            total += 0.5 * (sums * sums - squares)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _constant(rate: float) -> Machine:
    width = 16
    bias = float(np.log(rate / (1 - rate)))
    size = (1 << WORD_BITS) + width
    return Machine(bias, np.zeros(size), np.zeros((size, RANK)), np.zeros(width), np.ones(width))


def fitted(raw: np.ndarray, row: np.ndarray, slot: np.ndarray, value: np.ndarray, label: np.ndarray, seed: int = 5) -> Machine:
    """Logistic loss, minimised by Adam over seeded mini-batches."""
    n, words = len(raw), 1 << WORD_BITS
    rate = (label.sum() + 1) / (n + 2)
    if n == 0 or label.min() == label.max():
        return _constant(rate)
    machine = _constant(rate)
    machine.mean, machine.deviation = raw.mean(axis=0), np.maximum(raw.std(axis=0), 1e-6)
    dense = machine.dense(raw).astype(np.float32)
    rng = np.random.default_rng(seed)
    size = words + raw.shape[1]
    w = np.zeros((size, RANK + 1), np.float32)
    w[:, 1:] = rng.normal(0, 0.02, (size, RANK))
    first, second, bias, step = np.zeros_like(w), np.zeros_like(w), machine.bias, 0
    begin = np.searchsorted(row, np.arange(n + 1))
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            rows = order[at : at + BATCH]
            x = np.zeros((len(rows), size), np.float32)
            for i, r in enumerate(rows):
                x[i, slot[begin[r] : begin[r + 1]]] = value[begin[r] : begin[r + 1]]
            x[:, words:] = dense[rows]
            xw, square = x @ w, x * x
            sums = xw[:, 1:]
            margin = bias + xw[:, 0] + 0.5 * ((sums * sums).sum(1) - (square @ (w[:, 1:] ** 2)).sum(1))
            slope = ((1 / (1 + np.exp(-np.clip(margin, -30, 30)))) - label[rows]).astype(np.float32) / len(rows)
            grad = np.empty_like(w)
            grad[:, 0] = x.T @ slope
            grad[:, 1:] = x.T @ (slope[:, None] * sums) - (square.T @ slope)[:, None] * w[:, 1:]
            grad += DECAY * w
            step += 1
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad * grad
            w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            bias -= RATE * float(slope.sum()) * 10
    machine.bias, machine.weights, machine.factors = bias, w[:, 0].astype(np.float64), w[:, 1:].astype(np.float64)
    return machine


def _with_features(docs: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            raw, row, slot, value = features(*text_bytes(batch.column(1)), _numbers(batch.column(2)))
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            parts = [pa.array([a[s:e].tobytes() for s, e in zip(ends, ends[1:], strict=False)], pa.binary()) for a in (slot.astype(np.uint16), value.astype(np.float32))]
            dense = pa.array([r.tobytes() for r in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), dense, *parts], ["doc_id", "label", "dense", "slots", "values"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(read, f"doc_id {kind}, label int, dense binary, slots binary, values binary")


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _declared(docs: DataFrame) -> Column:
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("double").alias("__n_chars")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> Machine:
    """A machine learnt from at most ``rows`` labelled documents, none of them held out, drawn by the hash of their id.

    Of rows that share a drawn id one is learnt from. What reaches the driver is six bytes for each distinct word of a
    drawn row. With labels of one kind only, every text gets their smoothed rate; with none, one half.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id")
    drawn = known.agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    python_tasks(docs.sparkSession)
    texts = docs.select("doc_id", plain_text().alias("text"), _declared(docs))
    sample = _with_features(texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "__n_chars", "label"))
    cells = F.struct("dense", "slots", "values", "label")
    got = sample.groupBy("doc_id").agg(F.min(cells).alias("cells")).orderBy("doc_id").select("cells.*").toArrow().combine_chunks()
    if not got.num_rows:
        return _constant(0.5)
    label = got["label"].to_numpy().astype(np.float32)
    dense, slots, values = (_joined(got[c], kind) for c, kind in (("dense", np.float64), ("slots", np.uint16), ("values", np.float32)))
    row = np.repeat(np.arange(got.num_rows), pc.binary_length(got["slots"]).to_numpy() // 2)
    del got
    return fitted(dense.reshape(len(label), -1), row, slots, values, label)


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers of all cells of a column of bytes, in one piece."""
    return np.concatenate([np.frombuffer(text_bytes(chunk)[0].tobytes(), kind) for chunk in column.chunks])


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; columns of these names are replaced.

    A null or blank text has no words and is scored by its statistics; a null or absent ``n_chars`` counts as right.
    Repeated rows get equal scores, an empty table stays empty. Texts are scored whole, in slices of bounded size.
    """
    shipped = python_tasks(docs.sparkSession).sparkContext.broadcast(machine)
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    given = docs.select(*own, _declared(docs))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chars = own.index("text"), len(own)
        for batch in sliced(batches, "text"):
            score = shipped.value.score(*features(*text_bytes(batch.column(at)), _numbers(batch.column(chars))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:chars], pa.array(score)], [*own, "score"])

    schema = docs.select(*own).withColumn("score", F.lit(0.0)).schema
    return given.mapInArrow(read, schema).withColumn("predicted", (F.col("score") >= KEEP_SCORE).cast("int"))


def good_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """The documents predicted to be of good quality, with their own columns."""
    return scored(docs, machine).where(F.col("predicted") == 1).select(*[c for c in docs.columns])
