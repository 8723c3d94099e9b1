"""Row order as data: ordinals, positional splits and heads.

An ordinal costs no shuffle for a Parquet table (file offset + row index). Positional filters
look up the key at the cut position in a few narrow passes and become a plain comparison with a
literal, which Parquet row-group statistics can use.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinloom.session import work_path

ORDINAL = "ordinal"
BINS = 4096


def read_with_ordinal(spark: SparkSession, path: str, part_files: bool = False) -> DataFrame:
    """A Parquet table with its dense 0-based row number in file order.

    Files are ordered by path, or by part number for a table Spark has written in order.
    The running total goes over one row per file. These few rows are broadcast, as Spark takes them to be as large as the
    table and would send all rows of a file to one task.
    """
    table = spark.read.parquet(path)
    rows = table.select("*", "_metadata.file_path", "_metadata.row_index")
    part = F.regexp_extract("file_path", r"part-(\d+)-[^/]*$", 1).cast("bigint")
    # a task that writes several files gives them one part number and rising names
    order = [part, F.col("file_path")] if part_files else [F.col("file_path")]
    in_order = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("file_path")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("file_path", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("offset"))
    )
    return (
        rows.join(F.broadcast(offsets), "file_path")
        .withColumn(ORDINAL, F.col("offset") + F.col("row_index"))
        .drop("file_path", "row_index", "offset")
    )


def with_dense_ordinal(df: DataFrame, *keys: str) -> DataFrame:
    """The rows sorted by a unique key with a dense 0-based ordinal.

    One range-partitioned sort, written to the shared folder: the written files fix the order, so
    a lost executor cannot change the numbering.
    """
    path = work_path(df.sparkSession, "sorted")
    df.orderBy(*keys).write.parquet(path)
    return read_with_ordinal(df.sparkSession, path, part_files=True)


def with_scan_ordinal(scan: DataFrame) -> DataFrame:
    """Rows of a CSV or JSON-lines scan with their dense ordinal in file order.

    Text files hold no row index, so the rows are sorted once by file, split and place in the split
    (a scan always gives a split the same row numbers) and written to the shared folder.
    """
    place = ["__file", "__start", "__row"]
    path = work_path(scan.sparkSession, "scanned")
    scan.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__row"),
    ).orderBy(*place).drop(*place).write.parquet(path)
    return read_with_ordinal(scan.sparkSession, path, part_files=True)


def key_bounds(df: DataFrame, key: str) -> tuple[int, int, int, int]:
    """Smallest key, largest key, number of rows and of rows whose key is known."""
    return tuple(df.agg(F.min(key), F.max(key), F.count(F.lit(1)), F.count(key)).first())


def key_at(
    df: DataFrame, key: str, position: int, bounds: tuple[int, int, int, int] | None = None
) -> tuple[int, int] | None:
    """The integer key at a 0-based position and how many rows come before that key.

    Histogram refinement: each pass counts at most ``BINS`` bins of the key range that is left.
    Null if there are not that many rows, or if the position lies among the null keys, which come last.
    """
    low, high, rows, known = bounds or key_bounds(df, key)
    if position < 0 or position >= known:
        return None
    before = 0
    while low < high:
        width = math.ceil((high - low + 1) / BINS)
        bins = (
            df.where(F.col(key).between(low, high))
            .groupBy(F.expr(f"(`{key}` - {low}) div {width}").alias("bin"))
            .count()
            .collect()
        )
        for chosen, n in sorted(bins):
            if before + n > position:
                low, high = low + chosen * width, min(high, low + (chosen + 1) * width - 1)
                break
            before += n
    return low, before


def _content(df: DataFrame, key: str) -> list:
    """An order of rows that share a key; a map, which has no order, counts as its JSON with sorted entries."""

    def comparable(field) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.MapType):
            return F.to_json(F.array_sort(F.map_entries(column)))
        return column if not _holds_map(field.dataType) else F.to_json(column)

    return [comparable(f) for f in df.schema.fields if f.name != key]


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _holds_map(kind.elementType)


def _in_first(df: DataFrame, rows: int, total: int, key: str, cut: tuple[int, int] | None) -> DataFrame:
    """The rows with a boolean ``__first``: whether they are among the first ``rows`` by key, null keys last."""
    column = F.col(key)
    if rows <= 0 or rows >= total:
        return df.withColumn("__first", F.lit(rows > 0))
    if cut is None:
        value, before = None, df.where(column.isNotNull()).count()
        tied, sooner = column.isNull(), column.isNotNull()
    else:
        value, before = cut
        tied, sooner = column == value, column < value
    if before == rows:
        return df.withColumn("__first", F.coalesce(sooner, F.lit(False)))
    tied = F.coalesce(tied, F.lit(False))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*_content(df, key)))
    level = df.where(tied).withColumn("__place", place).withColumn("__first", F.col("__place") <= rows - before)
    others = df.where(~tied).withColumn("__first", F.coalesce(sooner, F.lit(False)))
    return others.unionByName(level.drop("__place"))


def with_split(
    df: DataFrame, fraction: float, key: str = ORDINAL, positions: DataFrame | None = None, least: int = 0
) -> DataFrame:
    """The rows with ``split``: ``train`` for the first ``int(n * fraction)`` (at least ``least``), else ``test``.

    Rows sharing the key at the cut (copies of one row made by a join) are ordered by their content, so that both
    parts have exactly the right size; null keys come last. ``positions`` may name a cheaper DataFrame with the same
    keys to look the cut up in.
    """
    counted = df if positions is None else positions
    bounds = key_bounds(counted, key)
    rows = max(least, int(bounds[2] * fraction))
    placed = _in_first(df, rows, bounds[2], key, key_at(counted, key, rows, bounds))
    return placed.withColumn("split", F.when(F.col("__first"), "train").otherwise("test")).drop("__first")


def _parts(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return placed.where("__first").drop("__first"), placed.where("not __first").drop("__first")


def split_at(df: DataFrame, rows: int, key: str = ORDINAL) -> tuple[DataFrame, DataFrame]:
    """The first ``rows`` rows by key, and the rest; see ``with_split``."""
    bounds = key_bounds(df, key)
    return _parts(_in_first(df, rows, bounds[2], key, key_at(df, key, rows, bounds)))


def split_fraction(
    df: DataFrame, fraction: float, key: str = ORDINAL, positions: DataFrame | None = None, least: int = 0
) -> tuple[DataFrame, DataFrame]:
    """The first ``int(n * fraction)`` rows (at least ``least``), and the rest; see ``with_split``."""
    counted = df if positions is None else positions
    bounds = key_bounds(counted, key)
    rows = max(least, int(bounds[2] * fraction))
    return _parts(_in_first(df, rows, bounds[2], key, key_at(counted, key, rows, bounds)))


def head_rows(df: DataFrame, rows: int, key: str = ORDINAL) -> DataFrame:
    """The first rows by key; zero or a negative number means all."""
    return df if rows <= 0 else split_at(df, rows, key)[0]


def top_fraction(df: DataFrame, fraction: float, key: str = ORDINAL) -> DataFrame:
    """The first ``max(1, int(n * fraction))`` rows by key."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    return split_fraction(df, fraction, key, least=1)[0]


def first_rows(df: DataFrame, rows: int, key: str = ORDINAL) -> DataFrame:
    """The first few rows by key, in order (a top-k, not a full sort)."""
    return df.orderBy(key).limit(rows)


def shuffled(df: DataFrame, seed: int, key: str = ORDINAL) -> DataFrame:
    """A reproducible random row order: sorted by a seeded hash of the key."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


ROUNDS = 24
_PRIME = (1 << 31) - 1


def round_keys(seed: int, epoch: int) -> list[tuple[int, int]]:
    """For each round of an epoch's permutation what pairs the places and what draws a bit for each pair."""
    rng = random.Random(f"{seed}:{epoch}")
    return [(rng.randrange(_PRIME), rng.randrange(1, _PRIME)) for _ in range(ROUNDS)]


def permuted(ordinal: Column, n: int, seed: int, epoch: int) -> Column:
    """The place of an ordinal below ``n`` in the order of an epoch: a keyed bijection, so nothing is sorted or moved.

    Each round pairs every place with another and swaps a pair if a bit drawn for it says so, which is its own inverse;
    so any number of rounds permutes, for any ``n``.
    """
    keys, size = round_keys(seed, epoch), max(n, 1)

    @F.arrow_udf("long")
    def place(ordinals: pa.Array) -> pa.Array:
        known = ordinals.is_valid().to_numpy(zero_copy_only=False)
        at = ordinals.fill_null(0).to_numpy(zero_copy_only=False)
        for pair, draw in keys:
            other = (pair - at) % size
            mixed = (np.maximum(at, other) % _PRIME + draw) * draw % _PRIME
            at = np.where(((mixed >> 7) + mixed) & 1 == 1, other, at)
        return pa.array(at, pa.int64(), mask=~known)

    return place(ordinal.cast("long"))


def epoch_orders(df: DataFrame, epochs: int, seed: int, key: str = ORDINAL) -> DataFrame:
    """Every row once for each epoch, with ``epoch`` (from 0) and ``position``; ``key`` is a dense 0-based ordinal.

    Only the number of rows is read beforehand. A training job takes an epoch's rows by ranges of ``position``.
    """
    n = df.count()
    places = {f"__place_{e}": permuted(F.col(key), n, seed, e) for e in range(epochs)}
    placed = F.array(*[F.struct(F.lit(e).alias("epoch"), F.col(name).alias("position")) for e, name in enumerate(places)])
    return df.withColumns(places).select(*df.columns, F.inline(placed))


def activity_quartile(histogram: DataFrame, value: str, count: str, buckets: int = 4) -> DataFrame:
    """Bucket each value of a histogram by its percent rank among all counted rows.

    ``histogram`` has one row per distinct value; rows with equal value share a bucket. For an
    activity count the distinct values grow only with the square root of the number of rows.
    """
    below = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    total = histogram.agg(F.sum(count)).scalar()
    rank = F.coalesce(F.sum(count).over(below), F.lit(0))
    return histogram.withColumn("bucket", (F.floor(rank * buckets / total) + 1).cast("int"))
