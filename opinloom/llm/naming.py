"""Exact duplicates by deterministic naming of blocks: equal texts, and only these, get the same identity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinloom.llm.shared import Work, plain_text, row_unpacked, with_row

BLOCK_BYTES = 4096
GROUPS = 1 << 16
SALTS = 64
KEY = ["doc_id", "text_sha256", "n_blocks"]


def _named(rows: DataFrame, *content: str) -> DataFrame:
    """Replaces the content columns by ``name``, an integer that equal contents share and others do not.

    Contents are sorted and numbered within groups by their hash. First each group is cut by the row into salts, where
    copies collapse to one row; the distinct contents of the salts are then numbered together. Both readers of the
    first sort need the same columns, so its exchange, the only one with all contents, runs once.
    """
    # never null: else Spark filters the two readers differently
    group = F.coalesce(F.pmod(F.xxhash64(*content), F.lit(GROUPS)), F.lit(0))
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id", "text_sha256", "pos"), F.lit(SALTS)), F.lit(0))
    order = Window.partitionBy("group", "salt").orderBy(*content, *KEY, "pos")
    same = F.lit(True)
    for c in content:
        same = same & F.lag(c).over(order).eqNullSafe(F.col(c))
    fresh = (F.row_number().over(order) == 1) | ~same
    dealt = rows.withColumns({"group": group, "salt": salt}).repartition("group", "salt")
    local = dealt.withColumn("fresh", fresh).withColumn("local", F.sum(F.col("fresh").cast("long")).over(order))
    together = Window.partitionBy("group").orderBy(*content)
    name = F.shiftleft("group", 40) + F.dense_rank().over(together)
    names = local.where("fresh").select("group", "salt", "local", *content).withColumn("name", name)
    kept = [c for c in rows.columns if c not in content]
    return local.join(names.select("group", "salt", "local", "name"), ["group", "salt", "local"]).select(*kept, "name")


def _blocks(text: Column) -> Column:
    """The text's UTF-8 bytes in blocks of a fixed size, the last one shorter; one empty block for an empty text."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.octet_length(text) - 1), F.lit(BLOCK_BYTES))
    return F.transform(starts, lambda s: F.substring(F.col("bytes"), s + 1, F.lit(BLOCK_BYTES)))


def duplicates(docs: DataFrame, work: Work | None = None) -> DataFrame:
    """Each row with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of its group of identical texts.

    Nothing is normalised; null counts as the empty text, whose rows form one group. The largest doc_id of a group
    stays (a null id only if all are null). Of repeated rows, equal in id and text, one is kept. Other columns are not
    read. An empty table gives an empty result. Identity rests on compared bytes: hashes only deal out the work.

    Names of blocks are paired until one is left: a text of b blocks takes ceil(log2 b) further rounds over integers.
    """
    work = work or Work(docs.sparkSession)
    text = plain_text()
    cut = docs.select("doc_id", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), text.cast("binary").alias("bytes"))
    cut = cut.select("doc_id", "text_sha256", _blocks(F.col("text")).alias("blocks"))
    rows = cut.select("doc_id", "text_sha256", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("pos", "block"))
    first = work.table(_named(rows, "block"), "names")
    most = first.agg(F.max("n_blocks")).first()[0] or 1
    current, ends = first.where(F.col("n_blocks") > 1), []
    tables = []
    for level in range(1, math.ceil(math.log2(most)) + 1):
        left, right = (F.max(F.when(F.col("pos") % 2 == side, F.col("name"))) for side in (0, 1))
        pairs = current.groupBy(*KEY, F.shiftright("pos", 1).alias("half")).agg(left.alias("left"), right.alias("right"))
        named = work.table(_named(pairs.withColumnRenamed("half", "pos"), "left", "right"), "names")
        tables.append(named)
        one = F.col("n_blocks") <= (1 << level)
        ends.append(named.where(one).select("doc_id", "text_sha256", F.lit(level).alias("level"), "name"))
        current = named.where(~one)
    short = first.where(F.col("n_blocks") == 1).select("doc_id", "text_sha256", F.lit(0).alias("level"), "name")
    if ends:
        long = first.where((F.col("n_blocks") > 1) & (F.col("pos") == 0)).select("doc_id", "text_sha256")
        end = ends[0]
        for e in ends[1:]:
            end = end.unionByName(e)
        end = end.withColumnsRenamed({"doc_id": "end_id", "text_sha256": "end_sha256"})
        at = long["doc_id"].eqNullSafe(end["end_id"]) & (long["text_sha256"] == end["end_sha256"])
        short = short.unionByName(long.join(end, at).select("doc_id", "text_sha256", "level", "name"))
    named = work.table(short, "identities")
    work.drop(first, *tables)
    groups = named.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    found = named.join(groups, ["level", "name"])
    once = F.row_number().over(Window.partitionBy("level", "name", "doc_id").orderBy("text_sha256")) == 1
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & once).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all columns of ``docs``, whatever their names."""
    kept = duplicates(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha256"))
    rows = with_row(docs, F.col("doc_id").alias("own_id"), F.sha2(plain_text().cast("binary"), 256).alias("own_sha256"))
    at = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_sha256") == F.col("kept_sha256"))
    repeated = Window.partitionBy("own_id", "own_sha256").orderBy(F.lit(0))
    single = rows.join(kept, at, "left_semi").withColumn("copy", F.row_number().over(repeated)).where(F.col("copy") == 1)
    return row_unpacked(single, docs.columns)
