"""Round trips through the sources and sinks, written below the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinloom.operators.ordering import with_scan_ordinal, with_split
from opinloom.queries.registry import query
from opinloom.session import work_path
from opinloom.sources.delimited import scan_csv, sink_csv
from opinloom.sources.jsonl import scan_jsonl, scan_jsonl_with_rejects, sink_jsonl
from opinloom.sources.tables import scan_split, sink_split, table


@query("SELECT doc_id, text, nullif(lang, 'nan') AS lang, n_chars FROM documents")
def csv_exchange(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their quotes, commas and line breaks to CSV and back."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "n_chars")
    path = work_path(spark, "csv")
    sink_csv(docs, path)
    return scan_csv(spark, path, docs.schema, na_tokens=True)


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_exchange(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations to JSON lines and back, keys checked."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    path = work_path(spark, "jsonl")
    sink_jsonl(turns, path)
    return scan_jsonl(spark, path, turns.schema, strict=True)


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def jsonl_first_line_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Columns from the keys of the first line, without the excluded ones."""
    path = work_path(spark, "jsonl")
    sink_jsonl(table(spark, folder, "customer"), path)
    return scan_jsonl(spark, path, exclude=("c_acctbal", "c_mktsegment"))


@query(
    """SELECT CASE WHEN place <= floor(total * 0.9::DOUBLE) THEN 'train' ELSE 'test' END AS split, count(*) AS n,
      round(sum(o_totalprice), 2) AS price
    FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS place, count(*) OVER () AS total FROM orders) GROUP BY 1"""
)
def split_exchange(spark: SparkSession, folder: str) -> DataFrame:
    """Both parts of a positional split written to one partitioned table and read back."""
    path = work_path(spark, "split")
    sink_split(with_split(table(spark, folder, "orders"), 0.9, "o_orderkey"), path)
    parts = [scan_split(spark, path, s).withColumn("split", F.lit(s)) for s in ("train", "test")]
    both = parts[0].unionByName(parts[1])
    return both.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price")
    )


@query("SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders")
def scan_ordinal(spark: SparkSession, folder: str) -> DataFrame:
    """Row numbers in file order for a CSV table of several files."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    path = work_path(spark, "csv")
    sink_csv(orders.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey"), path)
    return with_scan_ordinal(scan_csv(spark, path, orders.schema))


@query(
    """WITH lines AS (SELECT o_orderkey, o_custkey, '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || '}' AS line FROM orders)
    SELECT CASE o_orderkey % 50 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'not an object' WHEN 2 THEN 'wrong type' END AS reason,
      CASE o_orderkey % 50 WHEN 0 THEN left(line, length(line) - 3) WHEN 1 THEN '[' || line || ']'
        WHEN 2 THEN '{"o_orderkey":"no number","o_custkey":' || o_custkey || '}' END AS line,
      CASE WHEN o_orderkey % 50 > 2 THEN o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 50 > 2 THEN o_custkey END AS o_custkey FROM lines"""
)
def jsonl_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as JSON lines, every fiftieth cut off, in a list or with a word for a number: good rows and rejected lines."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"))
    line, kind = F.to_json(F.struct("*")), F.col("o_orderkey") % 50
    bad = F.to_json(F.struct(F.lit("no number").alias("o_orderkey"), "o_custkey"))
    planted = F.when(kind == 0, F.expr("left(line, length(line) - 3)")).when(kind == 1, F.concat(F.lit("["), "line", F.lit("]"))).when(kind == 2, bad).otherwise(F.col("line"))
    path = work_path(spark, "jsonl")
    orders.withColumn("line", line).select(planted.alias("value")).write.text(path)
    good, rejects = scan_jsonl_with_rejects(spark, path, orders.schema)
    return good.select(F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("line"), "*").unionByName(
        rejects.select("reason", "line"), allowMissingColumns=True)
