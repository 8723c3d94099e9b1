"""Batch inference with caller-supplied models: text completion and text encoding."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.model_cache import ModelCache
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinloom.contract import ENCODER_BATCH, ERROR_PREFIX
from opinloom.session import written

Completer = Callable[[str], str]


def complete(
    df: DataFrame, prompt: str, make_completer: Callable[[], Completer], requests: int | None = None
) -> DataFrame:
    """Adds ``raw_model_output`` and ``error`` by one call per row.

    ``make_completer`` runs once per task (it may open a client). A failed call keeps its row: the
    message goes to both columns, and the row then parses to nothing. ``requests`` bounds how many
    tasks call the model at a time.
    """
    added = [T.StructField(name, T.StringType()) for name in ("raw_model_output", "error")]
    schema = T.StructType([*df.schema.fields, *added])

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        completer = make_completer()

        def answer(text: str) -> tuple[str, str | None]:
            try:
                return completer(text), None
            except Exception as failure:  # any failure of the caller's model is data here
                return f"{ERROR_PREFIX}{failure}", str(failure)

        for batch in batches:
            results = [answer(text) for text in batch[prompt]]
            yield batch.assign(
                raw_model_output=pd.Series([r[0] for r in results], index=batch.index, dtype=object),
                error=pd.Series([r[1] for r in results], index=batch.index, dtype=object),
            )

    source = df if requests is None else df.repartition(requests)
    return source.mapInPandas(call, schema)


def answered(
    df: DataFrame, prompt: str, make_completer: Callable[[], Completer], store: str, requests: int = 64
) -> DataFrame:
    """``df`` with ``raw_model_output`` and ``error``, where every different prompt is asked once over all runs.

    ``store`` is the path of an append-only table of answers by hash of the prompt. Prompts it does not hold are dealt to
    small tasks of about ``requests`` calls; each task's answers join the store as soon as it ends, also if the job fails
    later, so a run that is started again asks only what is left. Failed calls are not stored. A null prompt counts as
    empty.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(prompt), F.lit(""))
    asked = df.select(F.sha2(text, 256).alias("prompt_hash"), text.alias("prompt")).groupBy("prompt_hash").agg(F.first("prompt").alias("prompt"))
    kind = "prompt_hash string, raw_model_output string"
    stored = spark.read.schema(kind).parquet(store) if _exists(spark, store) else spark.createDataFrame([], kind)
    left = written(asked.join(stored, "prompt_hash", "left_anti"), "prompts")
    tasks = -(-left.count() // requests)
    if tasks:
        calls = complete(left.repartition(tasks, "prompt_hash"), "prompt", make_completer).where(F.col("error").isNull())
        calls.select("prompt_hash", "raw_model_output").write.mode("append").option(
            "mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(store)
        stored = spark.read.schema(kind).parquet(store)
    # two runs at once may both have asked a prompt
    once = stored.groupBy("prompt_hash").agg(F.min("raw_model_output").alias("raw_model_output"))
    error = F.when(F.col("raw_model_output").isNull(), F.lit("no answer"))
    joined = df.withColumn("prompt_hash", F.sha2(text, 256)).join(once, "prompt_hash", "left").drop("prompt_hash")
    return joined.withColumn("error", error).withColumn("raw_model_output", F.coalesce("raw_model_output", F.lit(f"{ERROR_PREFIX}no answer")))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def encode_by_length(
    df: DataFrame, text: str, make_encoder: Callable, into: str = "embedding", batch_size: int = ENCODER_BATCH
) -> DataFrame:
    """Adds an embedding like ``encode``, with texts of like length in one batch, so none waits for a much longer one.

    Rows are sorted by the power of two of their length within each partition, which moves nothing between tasks.
    """
    bucket = F.ceil(F.log2(F.length(F.coalesce(F.col(text), F.lit(""))) + 1))
    return encode(df.withColumn("__bucket", bucket).sortWithinPartitions("__bucket").drop("__bucket"), text, make_encoder, into, batch_size)


def encode(
    df: DataFrame, text: str, make_encoder: Callable, into: str = "embedding", batch_size: int = ENCODER_BATCH
) -> DataFrame:
    """Adds an ``array<float>`` embedding; the encoder is loaded once per Python worker.

    Texts stay in Arrow until their batch is encoded, so a worker holds ``batch_size`` of them as Python objects.
    """
    name = uuid.uuid4()

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def encoder(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = ModelCache.get(name)
        if not model:
            model = make_encoder()
            ModelCache.add(name, model)
        for given in texts:
            for first in range(0, len(given), batch_size):
                batch = given.slice(first, batch_size).to_numpy(zero_copy_only=False)
                vectors = [np.asarray(v, np.float32) for v in model(batch)]
                if len(vectors) != len(batch):
                    raise ValueError(f"the encoder gave {len(vectors)} embeddings for {len(batch)} texts")
                yield pa.array(vectors, pa.list_(pa.float32()))

    return df.withColumn(into, encoder(F.col(text)))
