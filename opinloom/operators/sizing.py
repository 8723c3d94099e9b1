"""Decisions by size: partition counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

PARTITION_BYTES = 128 << 20


UNKNOWN = 1 << 60


def _known(size: int) -> int | None:
    """Spark gives a table of unknown size the largest number."""
    return size if size < UNKNOWN else None


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate for the result, None if there is none."""
    plan = getattr(df, "_jdf", None)
    return None if plan is None else _known(int(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))


def input_bytes(df: DataFrame) -> int | None:
    """Size of all tables a plan reads; unlike the estimate it does not multiply at a join."""
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return None
    leaves = plan.queryExecution().optimizedPlan().collectLeaves()
    return _known(sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())))


def needed_partitions(*inputs: DataFrame) -> int:
    """Partitions of about 128 MiB of input, at least the session's shuffle partitions."""
    configured = int(inputs[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, *[math.ceil((input_bytes(df) or 0) / PARTITION_BYTES) for df in inputs])


def size_shuffles(*inputs: DataFrame) -> int:
    """Raise the session's shuffle partitions to fit the inputs of a job; adaptive execution merges small ones."""
    partitions = needed_partitions(*inputs)
    inputs[0].sparkSession.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return partitions


def cluster_by(df: DataFrame, key: str) -> DataFrame:
    """Hash rows by a unique key, with more partitions than configured if the input needs them."""
    partitions = needed_partitions(df)
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, key) if partitions > configured else df.repartition(key)


def fit_partitions(df: DataFrame) -> int:
    """Partitions for the table a model is fitted on: by its bytes, at least one for each core."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil((input_bytes(df) or 0) / PARTITION_BYTES))
