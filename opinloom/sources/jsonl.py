"""JSON-lines scans."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinloom.session import written


def first_line_schema(spark: SparkSession, path: str, exclude: tuple[str, ...] = ()) -> T.StructType:
    """The keys of the first line as string columns (nested values stay JSON text)."""
    line = spark.read.text(path).first()
    if line is None or not line.value.strip():
        raise ValueError(f"no header line in {path}")
    return T.StructType([T.StructField(k, T.StringType()) for k in json.loads(line.value) if k not in exclude])


def scan_jsonl(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    exclude: tuple[str, ...] = (),
    strict: bool = False,
) -> DataFrame:
    """One object per line; blank lines are skipped, missing keys are null, extra keys ignored.

    ``strict`` raises on a key the schema does not have. A line that is no JSON object fails the
    job, as silently dropping it would lose a row.
    """
    schema = schema or first_line_schema(spark, path, exclude)
    if not strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).where(F.trim("value") != "")
    extra = F.array_except(F.json_object_keys("value"), F.lit(schema.fieldNames()))
    checked = F.when(
        F.size(extra) > 0, F.raise_error(F.concat(F.lit("unexpected keys: "), F.array_join(extra, ", ")))
    ).otherwise(F.col("value"))
    return lines.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def scan_jsonl_with_rejects(
    spark: SparkSession, path: str, schema: T.StructType | None = None, exclude: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """Good rows, and ``file, line, reason`` of the lines that are none; good and rejected lines are all that are not blank.

    The lines are read and parsed once, into a table in the shared folder that both results read their part of. A line
    is rejected if it is no JSON object, is cut off, or holds a value that its column's type cannot take.
    """
    schema = schema or first_line_schema(spark, path, exclude)
    corrupt = "__corrupt"
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    wide = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    parsed = lines.withColumn("row", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}))
    is_object = F.ltrim("value").startswith("{")
    # in a list, text after the object makes the whole malformed, and a second object another element
    listed = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]")))
    single = listed.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    reason = F.when(~is_object, "not an object").when(~single, "not JSON").when(
        F.col("row").isNull() | F.col(f"row.{corrupt}").isNotNull(), "wrong type")
    judged = parsed.select(reason.alias("reason"), "file", F.when(reason.isNotNull(), F.col("value")).alias("line"),
                           F.when(reason.isNull(), F.col("row")).alias("row"))
    kept = written(judged, "scanned")
    good = kept.where(F.col("reason").isNull()).select(*[F.col("row").getField(f.name).alias(f.name) for f in schema.fields])
    return good, kept.where(F.col("reason").isNotNull()).select("file", "line", "reason")


def sink_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path, ignoreNullFields=False)
