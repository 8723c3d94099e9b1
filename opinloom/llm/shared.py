"""What the operators share: work tables in the shared folder, batches of text, word rules."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinloom.session import work_path

WORD_BREAKS = " \t\n\x0b\f\r"
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def python_tasks(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, if they run beside the driver."""
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [known.get("PYTHONPATH"), root]))
    return spark


class Work:
    """Tables of one job below the shared folder, each of which can be dropped when nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = python_tasks(spark), {}

    def table(self, df: DataFrame, purpose: str) -> DataFrame:
        """The rows as a written table: computed once, without lineage, readable after the loss of an executor."""
        path = work_path(self.spark, purpose)
        df.write.parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(read)] = (path, read)
        return read

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for read in tables:
            path, _ = self.paths.pop(id(read))
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def plain_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array, without Python."""
    spaced = F.trim(F.translate(text, WORD_BREAKS, " " * len(WORD_BREAKS)))
    return F.array_remove(F.split(spaced, " ", -1), "")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the rows that no fit may see."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins and ends; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of about ``most`` bytes of text (one row at least), which bounds a task's memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def with_row(docs: DataFrame, *needed: Column | str, without: str | None = None) -> DataFrame:
    """The caller's columns, but for one if asked, as a struct ``__row`` beside what an operator needs: no names can clash."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != without]).alias("__row"), *needed)


def row_unpacked(df: DataFrame, columns: list[str], *new: Column | str, without: str | None = None) -> DataFrame:
    """The caller's columns out of ``__row`` and then the operator's; a caller's column of such a name is replaced.

    The column ``without`` is taken from the operator's table, at its old place.
    """
    added = df.select(*new).columns if new else []
    own = [F.col(c) if c == without else F.col("__row").getField(c).alias(c) for c in columns if c not in added]
    return df.select(*own, *new)
