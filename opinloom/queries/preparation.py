"""Preparation: cleaning, coercion, the star join, ordinals and positional splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinloom.contract import NUMERIC_COLUMNS, POLARITY, SCORE, SEED, TEXT_COLUMNS
from opinloom.functions import cleaning
from opinloom.functions.labels import class_index, class_label, to_polarity, to_score
from opinloom.operators import ordering, projection
from opinloom.operators.joins import left_join
from opinloom.plans.prepare import prepare, prepare_with_split
from opinloom.queries.registry import (
    LABELLED_SQL,
    ORDER_REVIEWS_SQL,
    documents,
    labelled,
    order_reviews,
    query,
)
from opinloom.queries.text import clean_sql
from opinloom.sources.tables import table

_GIVEN = {
    "review_text": clean_sql("l_returnflag || ' ' || l_linestatus || '  ' || CAST(l_orderkey AS VARCHAR)"),
    "business_name": clean_sql("p_name"),
    "business_categories": clean_sql("p_type"),
    "business_city": clean_sql("p_brand"),
    "user_name": clean_sql("s_name"),
    "review_useful": "CAST(l_linenumber AS DOUBLE)",
    "review_funny": "l_discount",
    "review_cool": "l_tax",
    "business_stars": "coalesce(CAST(p_size AS DOUBLE), 0)",
    "business_review_count": "coalesce(p_retailprice, 0)",
    "user_review_count": "coalesce(CAST(s_nationkey AS DOUBLE), 0)",
    "user_average_stars": "coalesce(s_acctbal, 0)",
}
_POLARITY_SQL = "CASE WHEN {0} IN (1, 2) THEN -1 WHEN {0} IN (4, 5) THEN 1 ELSE 0 END"
_STARS_SQL = "CAST(ceil(l_quantity / 10) AS INT)"


def star_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Line items as reviews of parts by suppliers, under the raw column names."""
    items = ordering.read_with_ordinal(spark, f"{folder}/lineitem.parquet")
    reviews = items.select(
        "ordinal",
        F.col("l_partkey").alias("business_id"),
        F.col("l_suppkey").alias("user_id"),
        F.concat("l_returnflag", F.lit(" "), "l_linestatus", F.lit("  "), F.col("l_orderkey").cast("string")).alias("text"),
        F.ceil(F.col("l_quantity") / 10).cast("double").alias("stars"),
        F.col("l_linenumber").alias("useful"),
        F.col("l_discount").alias("funny"),
        F.col("l_tax").alias("cool"),
    )
    business = table(spark, folder, "part").select(
        F.col("p_partkey").alias("business_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("categories"),
        F.col("p_brand").alias("city"),
        F.col("p_size").alias("stars"),
        F.col("p_retailprice").alias("review_count"),
    )
    users = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("user_id"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("review_count"),
        F.col("s_acctbal").alias("average_stars"),
    )
    return reviews, business, users


@query(
    "SELECT "
    + ", ".join(f"{_GIVEN.get(c, chr(39) * 2)} AS {c}" for c in TEXT_COLUMNS)
    + ", "
    + ", ".join(f"{_GIVEN.get(c, 'CAST(0 AS DOUBLE)')} AS {c}" for c in NUMERIC_COLUMNS)
    + f", {_STARS_SQL} AS {SCORE}, {_POLARITY_SQL.format(_STARS_SQL)} AS {POLARITY}"
    + " FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey"
)
def prepared_star(spark: SparkSession, folder: str) -> DataFrame:
    """The prepared table: two left joins, contract columns, cleaning, coercion, labels."""
    return prepare(*star_tables(spark, folder)).drop("ordinal")


@query(
    f"""WITH {ORDER_REVIEWS_SQL}, placed AS (
      SELECT score_label, {_POLARITY_SQL.format('score_label')} AS polarity_label, c_acctbal, n_name,
             row_number() OVER (ORDER BY o_orderkey) - 1 < floor(count(*) OVER () * 0.9::DOUBLE) AS training
      FROM rated LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_custkey = n_nationkey)
    SELECT CASE WHEN training THEN 'train' ELSE 'test' END AS split, score_label, polarity_label,
           count(*) AS n, round(sum(coalesce(c_acctbal, 0)), 2) AS balance,
           count(n_name) AS named
    FROM placed GROUP BY ALL"""
)
def prepared_split(spark: SparkSession, folder: str) -> DataFrame:
    """Positional 90/10 split of a prepared table (orders of customers, most without a match)."""
    orders = order_reviews(spark, folder)
    reviews = orders.select(
        F.col("o_orderkey").alias("ordinal"),
        F.col("o_custkey").alias("business_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("text"),
        F.substring("o_orderpriority", 1, 1).alias("stars"),
    )
    business = table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("business_id"), F.col("n_name").alias("name"))
    users = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("average_stars"))
    return prepare_with_split(reviews, business, users).groupBy("split", "score_label", "polarity_label").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("user_average_stars"), 2).alias("balance"),
        F.count_if(F.col("business_name") != "").alias("named"),
    )


@query(f"SELECT doc_id, {clean_sql('text')} AS cleaned FROM documents")
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", cleaning.clean_text(F.col("text")).alias("cleaned"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS status,
      coalesce(TRY_CAST(event_type AS DOUBLE), 0) AS type_number,
      coalesce(value, 0) AS value_number,
      CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) / 10 AS k_number,
      CAST(trunc(CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) / 10) AS INT) AS k_score
    FROM events"""
)
def coerce_numeric(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers kept as text, words where numbers should be, missing-value spellings."""
    raw = table(spark, folder, "events").select(
        "event_id",
        "event_type",
        F.when(F.col("event_type") == "error", "N/A").otherwise(F.col("event_type")).alias("status"),
        F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")).alias("value"),
        (F.regexp_extract("props", r"(\d+)", 1).cast("double") / 10).cast("string").alias("k"),
    )
    k = projection.numeric(raw, "k")
    return raw.select(
        "event_id",
        cleaning.na_to_null(F.col("status")).alias("status"),
        F.coalesce(projection.numeric(raw, "event_type"), F.lit(0.0)).alias("type_number"),
        F.coalesce(projection.numeric(raw, "value"), F.lit(0.0)).alias("value_number"),
        k.alias("k_number"),
        to_score(k).alias("k_score"),
    )


@query(
    f"""WITH {ORDER_REVIEWS_SQL}
    SELECT {_POLARITY_SQL.format('score_label')} AS polarity_label, count(*) AS n FROM rated GROUP BY 1"""
)
def polarity_counts(spark: SparkSession, folder: str) -> DataFrame:
    reviews = order_reviews(spark, folder).select(to_polarity(F.col("score_label")).alias("polarity_label"))
    return reviews.groupBy("polarity_label").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {ORDER_REVIEWS_SQL}
    SELECT string_agg(DISTINCT CAST(score_label AS VARCHAR), ',' ORDER BY CAST(score_label AS VARCHAR)) AS labels,
           min(score_label) AS min_label, max(score_label) AS max_label FROM rated"""
)
def label_overview(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct labels and label range, after the range check."""
    reviews = projection.require_range(order_reviews(spark, folder), "score_label", 1, 5)
    return reviews.agg(
        F.array_join(F.array_sort(F.collect_set("score_label")), ",").alias("labels"),
        F.min("score_label").alias("min_label"),
        F.max("score_label").alias("max_label"),
    )


@query(
    f"""WITH {LABELLED_SQL}
    SELECT doc_id, CAST(polarity_label + 1 AS DOUBLE) AS class_index, polarity_label AS back FROM labelled"""
)
def label_index(spark: SparkSession, folder: str) -> DataFrame:
    """Labels to class indexes and back."""
    docs = labelled(spark, folder)
    labels = projection.distinct_labels(docs, "polarity_label").first().labels
    indexed = docs.select("doc_id", class_index(F.col("polarity_label"), labels).alias("class_index"))
    return indexed.withColumn("back", class_label(F.col("class_index"), labels))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders")
def file_ordinal(spark: SparkSession, folder: str) -> DataFrame:
    """Row numbers in file order, without a shuffle of the rows."""
    return ordering.read_with_ordinal(spark, f"{folder}/orders.parquet").select("o_orderkey", "ordinal")


@query(f"WITH {LABELLED_SQL} SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM labelled")
def dense_ordinal(spark: SparkSession, folder: str) -> DataFrame:
    """Dense row numbers by key for the rows a filter left."""
    return ordering.with_dense_ordinal(labelled(spark, folder).select("doc_id"), "doc_id")


_PLACED_SQL = f"""WITH {ORDER_REVIEWS_SQL}, placed AS (
  SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS total FROM rated)"""


def _order_part(part: DataFrame, *keys: str) -> DataFrame:
    return part.groupBy(*keys, "score_label").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")
    )


_PART_SQL = "score_label, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key"


@query(
    f"""{_PLACED_SQL} SELECT CASE WHEN place < floor(total * 0.9::DOUBLE) THEN 'train' ELSE 'test' END AS split,
    {_PART_SQL} FROM placed GROUP BY 1, 2"""
)
def split_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _order_part(ordering.with_split(order_reviews(spark, folder), 0.9, "o_orderkey"), "split")


@query(f"{_PLACED_SQL} SELECT {_PART_SQL} FROM placed WHERE place < 1000 GROUP BY 1")
def head_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _order_part(ordering.head_rows(order_reviews(spark, folder), 1000, "o_orderkey"))


@query(f"{_PLACED_SQL} SELECT {_PART_SQL} FROM placed WHERE place < greatest(1, floor(total * 0.1::DOUBLE)) GROUP BY 1")
def head_fraction(spark: SparkSession, folder: str) -> DataFrame:
    return _order_part(ordering.top_fraction(order_reviews(spark, folder), 0.1, "o_orderkey"))


@query(
    """SELECT l_returnflag, l_linestatus, p_brand, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL"""
)
def salted_join(spark: SparkSession, folder: str) -> DataFrame:
    """The left join of a fact table, safe against a hot key."""
    items = table(spark, folder, "lineitem").withColumnRenamed("l_partkey", "part")
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("part"), "p_brand")
    joined = left_join(items, parts, "part")
    return joined.groupBy("l_returnflag", "l_linestatus", "p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue")
    )


def _epoch_sql(epoch: int) -> str:
    """SQL of ``ordering.permuted``: a nested query for each round."""
    rows = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders"
    for pair, draw in ordering.round_keys(SEED, epoch):
        paired = f"SELECT *, (({pair} - place) % n + n) % n AS other FROM ({rows})"
        mixed = f"SELECT *, ((greatest(place, other) % 2147483647 + {draw}) * {draw}) % 2147483647 AS mixed FROM ({paired})"
        rows = f"SELECT o_orderkey, n, CASE WHEN ((mixed >> 7) + mixed) % 2 = 1 THEN other ELSE place END AS place FROM ({mixed})"
    return f"SELECT {epoch} AS epoch, place AS position, o_orderkey FROM ({rows})"


@query(" UNION ALL ".join(_epoch_sql(epoch) for epoch in range(3)))
def epoch_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The order of all rows in each of three epochs."""
    rows = ordering.read_with_ordinal(spark, f"{folder}/orders.parquet").select("o_orderkey", "ordinal")
    return ordering.epoch_orders(rows, 3, SEED).select("epoch", "position", "o_orderkey")
