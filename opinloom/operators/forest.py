"""A random forest that grows all trees level by level, one pass over the rows for a level.

Values are put into bins once. The rows stay where they are, each with its place in every tree, which a pass moves one
level down. A pass counts, for each open node and each of the features drawn for it, the classes by bin; only cells of
rows above the lowest bin are made, so a small node has no more of them than its rows have values. The cells of a node
meet in one task, which picks the split; the driver gets the splits alone. A tree therefore takes at most ``depth``
passes, whatever the number of its nodes. Bins, draws, gains, and what becomes of equal leaves are those of Spark's forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, StorageLevel, TaskContext
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinloom.operators.blocks import Rows, read_blocks
from opinloom.session import written

AT_ONCE = 1 << 18  # values that are put into bins together
CELLS = 1 << 20  # of a block of rows as a dense matrix
HELD = 1 << 21  # cells that a task holds before it adds those alike
LARGE = 96  # rows of a block at one node, from which on they are counted by column
DEALT = 1 << 22  # drawn rows of open nodes whose cells one task splits
SAMPLED = 10_000  # rows whose values set the bins, as in Spark's forest
BLOCK = "begin binary, index binary, code binary, label binary, weight binary, place binary"
KINDS = dict(begin=np.int64, index=np.int32, code=np.uint8, label=np.int32, weight=np.uint8, place=np.int32)


def _cuts_of(value: np.ndarray, count: np.ndarray, sampled: float, most: int) -> np.ndarray:
    """At most ``most`` cuts between the sampled values of a feature, of which those that are not listed are 0."""
    zeros = sampled - count.sum()
    if zeros > 1e-9 * sampled:
        value, count = np.r_[0.0, value], np.r_[zeros, count]
    value, back = np.unique(value, return_inverse=True)
    count = np.bincount(back, count)
    middle = (value[:-1] + value[1:]) / 2
    if len(middle) <= most:
        return middle
    cuts, upto, stride = [], np.cumsum(count), sampled / (most + 1)
    goal = stride
    for at in range(1, len(value)):
        if abs(upto[at - 1] - goal) < abs(upto[at] - goal):
            cuts.append(middle[at - 1])
            goal += stride
    return np.array(cuts[:most])


def bin_cuts(rows: DataFrame, vector: str, inputs: int, n: int, bins: int, seed: int) -> list[np.ndarray]:
    """Between which values the bins of each feature lie: at most ``bins - 1`` cuts for each reach the driver."""
    share = min(1.0, max(bins * bins, SAMPLED) / n)
    sample = rows if share == 1 else rows.sample(share, seed)
    sampled, most = share * n, bins - 1
    cells = F.unwrap_udt(vector)
    slots = F.coalesce(cells["indices"], F.sequence(F.lit(0), F.size(cells["values"]) - 1))
    listed = sample.select(F.inline(F.arrays_zip(slots.alias("slot"), cells["values"].alias("value")))).where("value != 0")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            slot, value, n = (c.to_numpy() for c in pa.Table.from_batches(held).sort_by("slot").columns)
            begins = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
            cuts = [_cuts_of(value[a:b], n[a:b].astype(float), sampled, most) for a, b in zip(begins, [*begins[1:], len(slot)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(slot[begins]), pa.array(cuts, pa.list_(pa.float64()))], ["slot", "cuts"])

    counted = listed.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))
    found = counted.repartition("slot").mapInArrow(cut, "slot int, cuts array<double>")
    out = [np.zeros(0)] * inputs
    for row in found.toArrow().to_pylist():
        out[row["slot"]] = np.array(row["cuts"], np.float64)
    return out


@dataclass
class Block:
    """Rows in bins, and by tree (trees x rows) how often a row is in its bag and at which open node it is, or -1."""

    begin: np.ndarray
    index: np.ndarray
    code: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    place: np.ndarray

    def dense(self, absent: np.ndarray) -> np.ndarray:
        """The bin of every feature, ``absent`` for those that a row does not list."""
        out = np.tile(absent, (len(self.label), 1))
        out[np.repeat(np.arange(len(out)), np.diff(self.begin)), self.index] = self.code
        return out

    def batch(self) -> pa.RecordBatch:
        cells = [np.ascontiguousarray(getattr(self, c), k).tobytes() for c, k in KINDS.items()]
        return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], list(KINDS))

    @staticmethod
    def read(batches: Iterator[pa.RecordBatch], trees: int) -> Iterator[Block]:
        for batch in batches:
            for at in range(batch.num_rows):
                cells = {c: np.frombuffer(batch[c][at].as_buffer(), k) for c, k in KINDS.items()}
                cells |= {c: cells[c].reshape(trees, -1) for c in ("weight", "place")}
                yield Block(**cells)


def _binned(blocks: DataFrame, cuts: Broadcast, inputs: int, trees: int, seed: int) -> DataFrame:
    """Blocks of rows in bins at the root of each tree whose bag they are in; a bag draws every row by a Poisson law."""
    most = max(1, CELLS // inputs)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.array([len(c) for c in cuts.value])
        # one sorted list for all features: a feature's own cuts lie between its bounds
        start, flat = np.cumsum(size) - size, np.concatenate(cuts.value)
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for joined in read_blocks(batches, AT_ONCE):
            if not np.isfinite(joined.value).all():
                raise ValueError("features must be finite")
            for first in range(0, len(joined), most):
                rows = joined.part(first, min(first + most, len(joined)))
                low, high = start[rows.index], start[rows.index] + size[rows.index]
                while (open_ := low < high).any():  # bisection of all values at once
                    middle = (low + high) // 2
                    above = open_ & (flat[np.where(open_, middle, 0)] < rows.value)
                    low, high = np.where(above, middle + 1, low), np.where(open_ & ~above, middle, high)
                weight = np.minimum(rng.poisson(1.0, (trees, len(rows))), 255).astype(np.uint8)
                place = np.where(weight > 0, np.arange(trees)[:, None], -1)
                yield Block(rows.begin, rows.index, low - start[rows.index], rows.label, weight, place).batch()

    return blocks.mapInArrow(read, BLOCK)


def drawn(nodes: int, inputs: int, some: int, key: list[int]) -> np.ndarray:
    """``some`` different features for each of ``nodes`` nodes: draws that hold one twice are drawn again."""
    rng = np.random.default_rng(key)
    if 2 * some > inputs:
        return rng.permuted(np.tile(np.arange(inputs, dtype=np.int32), (nodes, 1)), axis=1)[:, :some]
    out, again = np.empty((nodes, some), np.int32), np.arange(nodes)
    while len(again):
        out[again] = rng.integers(0, inputs, (len(again), some), np.int32)
        ordered = np.sort(out[again], axis=1)
        again = again[(ordered[:, 1:] == ordered[:, :-1]).any(axis=1)]
    return out


def _moved(state: DataFrame, splits: Broadcast, absent: Broadcast, trees: int) -> DataFrame:
    """Every row one level further down: by the feature, cut and open children of the node it is at."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, cut, children = splits.value
        for block in Block.read(batches, trees):
            bins, place = block.dense(absent.value), np.full_like(block.place, -1)
            for t in range(trees):
                row = np.flatnonzero(block.place[t] >= 0)
                at = block.place[t, row]
                row, at = row[feature[at] >= 0], at[feature[at] >= 0]
                place[t, row] = children[at, (bins[row, feature[at]] > cut[at]).astype(np.intp)]
            block.place = place
            yield block.batch()

    return state.mapInArrow(read, BLOCK)


def _added(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _cells(state: DataFrame, absent: Broadcast, firsts: np.ndarray, level: int, some: int, bins: int, classes: int, seed: int) -> DataFrame:
    """``node, cell, n``: rows of a task by open node, drawn feature, bin and class; a further feature holds them all."""
    trees, a_node = len(firsts) - 1, (some + 1) * bins * classes

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs, held, size = len(absent.value), [], 0
        features: dict[int, np.ndarray] = {}

        def counted(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            dense = block.dense(absent.value)
            by_feature, many = np.ascontiguousarray(dense.T), len(dense)
            for t in range(trees):
                row = np.flatnonzero(block.place[t] >= 0)
                if not len(row):
                    continue
                if t not in features:
                    features[t] = drawn(firsts[t + 1] - firsts[t], inputs, some, [seed, level, t]).astype(np.min_scalar_type(inputs))
                node, label, weight = block.place[t, row].astype(np.int64), block.label, block.weight[t].astype(np.int64)
                keys, ns = [node * a_node + some * bins * classes + label[row]], [weight[row]]
                size = np.bincount(node - firsts[t])
                for k in np.flatnonzero(size >= LARGE):  # whole columns, as long plain arrays are handled fastest
                    columns = by_feature[features[t][k]]
                    cell = np.flatnonzero((columns != 0) & (block.place[t] == firsts[t] + k))
                    slot, at = np.divmod(cell, many)
                    keys.append((firsts[t] + k) * a_node + (slot * bins + columns.ravel()[cell]) * classes + label[at])
                    ns.append(weight[at])
                small = size[node - firsts[t]] < LARGE
                row, node = row[small], node[small]
                code = dense.ravel().take(features[t][node - firsts[t]] + row[:, None] * inputs)
                cell = np.flatnonzero(code != 0)
                at, slot = np.divmod(cell, some)
                keys.append(node[at] * a_node + (slot * bins + code.ravel()[cell]) * classes + label[row[at]])
                ns.append(weight[row[at]])
                yield _added(np.concatenate(keys), np.concatenate(ns))

        def out() -> Iterator[pa.RecordBatch]:
            key, n = _added(*(np.concatenate(part) for part in zip(*held, strict=True)))
            for i in range(0, len(key), 1 << 18):
                node, cell = np.divmod(key[i : i + (1 << 18)], a_node)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(cell.astype(np.int32)), pa.array(n[i : i + (1 << 18)])], ["node", "cell", "n"])

        for block in Block.read(batches, trees):
            for part in counted(block):
                held.append(part)
                size += len(part[0])
                if size > HELD:
                    held = [_added(*(np.concatenate(p) for p in zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if 2 * size > HELD:
                        yield from out()
                        held, size = [], 0
        if held:
            yield from out()

    return state.mapInArrow(read, "node long, cell int, n long")


def gini(counts: np.ndarray) -> np.ndarray:
    return 1 - ((counts / np.maximum(counts.sum(axis=1), 1)[:, None]) ** 2).sum(axis=1)


def best_splits(node: np.ndarray, cell: np.ndarray, n: np.ndarray, some: int, bins: int, classes: int, min_leaf: int) -> tuple[np.ndarray, ...]:
    """The nodes, with the drawn feature that each gains most by, the highest bin of its left side and both sides' classes.

    The first of equal gains is taken, by feature and bin. A node without a split has feature -1 and all on its left.
    """
    key, n = _added(node * ((some + 1) * bins * classes) + cell, n)
    group, kind = np.divmod(key, classes)  # of node, feature and bin
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    counts = np.zeros((len(first), classes), np.int64)
    counts[np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1, kind] = n
    pair, bin_ = np.divmod(group[first], bins)
    of, slot = np.divmod(pair, some + 1)
    whole = slot == some
    nodes, totals = of[whole], counts[whole]
    pair, bin_, of, slot, counts = pair[~whole], bin_[~whole], of[~whole], slot[~whole], counts[~whole]
    best, high, right = np.full(len(nodes), -1), np.zeros(len(nodes), np.int64), np.zeros_like(totals)
    if len(pair):
        # each bin that holds rows may begin the right side, which has it and the feature's higher bins
        starts = np.r_[True, pair[1:] != pair[:-1]]
        upto = np.cumsum(counts, axis=0)
        ends = np.r_[np.flatnonzero(starts)[1:], len(pair)] - 1
        above = upto[ends[np.cumsum(starts) - 1]] - upto + counts
        at = np.searchsorted(nodes, of)
        below = totals[at] - above
        a, b = below.sum(axis=1), above.sum(axis=1)
        gain = gini(totals)[at] - a / (a + b) * gini(below) - b / (a + b) * gini(above)
        gain[(a < min_leaf) | (b < min_leaf) | (gain <= 0)] = -1
        begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        top = np.maximum.reduceat(gain, begins)
        span = np.cumsum(np.r_[True, of[1:] != of[:-1]]) - 1
        hit = np.flatnonzero((gain == top[span]) & (gain > 0))
        hit = hit[np.r_[True, of[hit][1:] != of[hit][:-1]][: len(hit)]]
        best[at[hit]], right[at[hit]] = slot[hit], above[hit]
        high[at[hit]] = np.where(starts[hit], 0, bin_[hit - 1])
    return nodes, best, high, totals - right, right


def _splits(
    cells: DataFrame, tasks: int, some: int, bins: int, classes: int, min_leaf: int, whole: bool
) -> tuple[np.ndarray, ...]:
    """``best_splits`` of the open nodes that have one, or of the whole level, by node."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            found = best_splits(*(table[c].to_numpy() for c in ("node", "cell", "n")), some, bins, classes, min_leaf)
            nodes, best, high, left, right = (a if whole else a[found[1] >= 0] for a in found)
            for i in range(0, len(nodes), 1 << 16):
                part = slice(i, i + (1 << 16))
                sides = [pa.array([*map(bytes, side[part])], pa.binary()) for side in (left, right)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(best[part]), pa.array(high[part]), *sides], ["node", "best", "high", "below", "above"])

    found = cells.repartition(tasks, "node").mapInArrow(read, "node long, best long, high long, below binary, above binary").toArrow()
    order = np.argsort(found["node"].to_numpy())
    sides = [np.frombuffer(bytearray().join(found[c].to_pylist()), np.int64).reshape(-1, classes)[order] for c in ("below", "above")]
    return (*(found[c].to_numpy()[order] for c in ("node", "best", "high")), *sides)


@dataclass
class Trees:
    """Nodes of all trees, of which the first are the roots: feature (-1: a leaf), cut, left child, share of each class.

    A row goes left where its value is at most the cut; the right child follows the left one.
    """

    trees: int
    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    share: np.ndarray

    def votes(self, rows: Rows, inputs: int) -> np.ndarray:
        """The sum over all trees of the shares of the classes at a row's leaf."""
        out = [np.zeros((0, self.share.shape[1]))]
        for first in range(0, len(rows), many := max(1, (CELLS >> 1) // inputs)):
            part = rows.part(first, min(first + many, len(rows)))
            value = np.zeros((len(part), inputs))
            value[part.row, part.index] = part.value
            node = np.tile(np.arange(self.trees), len(part))
            walker = np.flatnonzero(self.feature[node] >= 0)
            while len(walker):
                at = node[walker]
                node[walker] = at = self.child[at] + (value[walker // self.trees, self.feature[at]] > self.cut[at])
                walker = walker[self.feature[at] >= 0]
            out.append(self.share[node].reshape(len(part), self.trees, -1).sum(axis=1))
        return np.concatenate(out)


def _finished(trees: int, feature: np.ndarray, cut: np.ndarray, child: np.ndarray, counts: np.ndarray, levels: list[int]) -> Trees:
    """The grown trees, where two leaves that name the same class become one, from the last level up."""
    named = counts.argmax(axis=1)
    for first, end in reversed([*zip(levels[:-1], levels[1:], strict=True)]):
        inner = first + np.flatnonzero(feature[first:end] >= 0)
        left = child[inner]
        alike = (feature[left] < 0) & (feature[left + 1] < 0) & (named[left] == named[left + 1])
        feature[inner[alike]] = -1
    kept = np.zeros(len(feature), bool)
    kept[:trees] = True
    for first, end in zip(levels[:-1], levels[1:], strict=True):
        inner = first + np.flatnonzero((feature[first:end] >= 0) & kept[first:end])
        kept[child[inner]] = kept[child[inner] + 1] = True
    child = np.where(feature >= 0, (np.cumsum(kept) - 1)[child], 0)
    share = counts / np.maximum(counts.sum(axis=1), 1)[:, None]
    return Trees(trees, feature[kept], cut[kept], child[kept], share[kept])


def fit(
    rows: DataFrame, blocks: DataFrame, vector: str, n: int, inputs: int, classes: int, trees: int, depth: int, min_leaf: int,
    seed: int, max_bins: int = 32,
) -> Trees:
    """Trees on bags of the ``n`` rows, which are also in ``blocks``; a node draws a square root of the features."""
    context = rows.sparkSession.sparkContext
    bins, some = min(max_bins, max(n, 2), 256), math.ceil(math.sqrt(inputs))
    cuts = bin_cuts(rows, vector, inputs, n, bins, seed)
    bounds, absent = context.broadcast(cuts), context.broadcast(np.array([np.searchsorted(c, 0.0) for c in cuts], np.uint8))
    # as a table: the plan of a later level then holds no shuffle, and stays short
    shipped, state = [bounds, absent], written(_binned(blocks, bounds, inputs, trees, seed), "forest")
    before, tasks = state, max(context.defaultParallelism, state.rdd.getNumPartitions())
    # arrays of a level: feature, cut, left child, classes; an open node is one that may still split
    made = [[np.full(trees, -1, np.int32), np.zeros(trees), np.zeros(trees, np.int64), np.zeros((trees, classes), np.int64)]]
    open_, tree, levels, bagged = np.arange(trees), np.arange(trees), [0, trees], n * trees
    try:
        for level in range(max(depth, 1)):
            firsts = np.searchsorted(tree, np.arange(trees + 1))
            cells = _cells(state, absent, firsts, level, some, bins, classes, seed)
            node, best, high, left, right = _splits(cells, max(tasks, math.ceil(bagged / DEALT)), some, bins, classes, min_leaf, level == 0)
            before.unpersist()  # the pass has filled the next one
            if level == 0:
                made[0][3][node] = left + right
            of = best >= 0 if depth else np.zeros(len(node), bool)
            node, best, high, left, right = (a[of] for a in (node, best, high, left, right))
            if not len(node):
                break
            bounds_of = np.searchsorted(firsts, node, "right") - 1
            feature, cut = np.full(len(open_), -1, np.int32), np.zeros(len(open_), np.uint8)
            for t in np.unique(bounds_of):
                its = bounds_of == t
                features = drawn(firsts[t + 1] - firsts[t], inputs, some, [seed, level, t])
                feature[node[its]] = features[node[its] - firsts[t], best[its]]
            cut[node] = high
            at = open_[node] - levels[-2]
            made[-1][0][at] = feature[node]
            made[-1][1][at] = [cuts[f][c] for f, c in zip(feature[node], high, strict=True)]
            made[-1][2][at] = levels[-1] + 2 * np.arange(len(node))
            counts = np.stack([left, right], axis=1).reshape(-1, classes)
            made.append([np.full(len(counts), -1, np.int32), np.zeros(len(counts)), np.zeros(len(counts), np.int64), counts])
            levels.append(levels[-1] + len(counts))
            mixed = (counts > 0).sum(axis=1) > 1
            if level + 1 == depth or not mixed.any():
                break
            open_, tree = levels[-2] + np.flatnonzero(mixed), np.repeat(tree[node], 2)[mixed]
            bagged = int(counts[mixed].sum())
            children = np.full((len(feature), 2), -1, np.int32)
            children[node] = np.where(mixed, np.cumsum(mixed) - 1, -1).reshape(-1, 2)
            shipped.append(context.broadcast((feature, cut, children)))
            before, state = state, _moved(state, shipped[-1], absent, trees).persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        before.unpersist()
        state.unpersist()
        for s in shipped:  # kept until now, as a lost block is made again from the first
            s.destroy()
    return _finished(trees, *(np.concatenate(parts) for parts in zip(*made, strict=True)), levels)


class ForestModel(Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, MLReadable, MLWritable):
    """Adds the votes of the trees, the probabilities they make, and the class with the most."""

    def __init__(self, trees: Trees | None = None, inputs: int = 0, features: str = "features", prediction: str = "prediction"):
        super().__init__()
        self.trees, self.inputs = trees, inputs
        self._set(featuresCol=features, predictionCol=prediction)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shipped, inputs = dataset.sparkSession.sparkContext.broadcast(self.trees), self.inputs

        @F.pandas_udf("array<double>")
        def votes(indices: pd.Series, values: pd.Series) -> pd.Series:
            index = [np.arange(len(v)) if i is None else i for i, v in zip(indices, values, strict=True)]
            begin = np.r_[0, np.cumsum([len(i) for i in index])].astype(np.int64)
            rows = Rows(begin, np.concatenate([*index, np.zeros(0)]).astype(np.int64), np.concatenate([*values, np.zeros(0)]), np.zeros(len(index), int))
            return pd.Series([*shipped.value.votes(rows, inputs)])

        cells = F.unwrap_udt(self.getFeaturesCol())
        raw, most = F.col("__votes"), F.array_max("__votes")
        # no votes where all bags are empty
        share = F.transform(raw, lambda v: F.coalesce(F.try_divide(v, F.aggregate(raw, F.lit(0.0), lambda a, b: a + b)), F.lit(0.0)))
        return dataset.withColumn("__votes", votes(cells["indices"], cells["values"])).withColumns({
            self.getRawPredictionCol(): array_to_vector(raw), self.getProbabilityCol(): array_to_vector(share),
            self.getPredictionCol(): (F.array_position(raw, most) - 1).cast("double"),
        }).drop("__votes")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark, trees = self.sparkSession, self.model.trees
        DefaultParamsWriter.saveMetadata(self.model, path, spark, {"trees": trees.trees, "inputs": self.model.inputs})
        nodes = pa.table({
            "node": np.arange(len(trees.feature)), "feature": trees.feature, "cut": trees.cut, "child": trees.child,
            "share": pa.array([*trees.share], pa.list_(pa.float64())),
        })
        spark.createDataFrame(nodes).write.parquet(f"{path}/nodes")


class _Reader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> ForestModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        nodes = spark.read.parquet(f"{path}/nodes").toArrow().sort_by("node")
        arrays = [nodes[c].to_numpy() for c in ("feature", "cut", "child")]
        model = self.kind(Trees(metadata["trees"], *arrays, np.array(nodes["share"].to_pylist())), metadata["inputs"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
