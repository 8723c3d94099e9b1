"""CSV scans and sinks; Parquet is the exchange format inside the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinloom.functions.cleaning import na_to_null

_QUOTING = {"header": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}


def scan_csv(
    spark: SparkSession, path: str, schema: T.StructType, na_tokens: bool = False, multi_line: bool = True
) -> DataFrame:
    """A CSV file with quoted line breaks; a leading byte-order mark is skipped.

    ``na_tokens`` reads the usual missing-value spellings in string columns as null. A file whose
    values hold no line breaks can be split over tasks with ``multi_line=False``; otherwise
    parallelism comes from the number of files.
    """
    reader = spark.read.schema(schema).options(**_QUOTING, enforceSchema="false")
    df = reader.option("multiLine", multi_line).csv(path)
    if not na_tokens:
        return df
    text = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: na_to_null(F.col(c)) for c in text})


def sink_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header and minimal quoting; text is written as it is, with its blanks and line breaks."""
    df.write.mode(mode).options(
        **_QUOTING, ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false"
    ).csv(path)
