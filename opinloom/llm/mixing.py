"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinloom.llm.shared import plain_text, row_unpacked, words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
EPOCHS = 2.0
SEED = 17
BIN_DIGITS = 3


def water_levels(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """Adds ``target`` to a table with a row per source (``source_key``, ``source_size``).

    Sources weigh ``weights`` in turn, in order of their key, and divide ``share`` of all sizes. Where a target passes
    ``epochs`` times its source, the excess goes to the others by weight. Sorted by the level at which a source is
    full, the full ones are a prefix, so the common level of the rest is the first one that does not fill its source.
    The windows run over one row per source.
    """
    n = F.row_number().over(Window.orderBy("source_key")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (n % len(weights) + 1).cast("int"))
    full = F.col("source_size") * F.lit(epochs)
    order = Window.orderBy("fills_at", "source_key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sources.withColumn("weight", weight).withColumn("full", full).withColumn("fills_at", F.col("full") / F.col("weight"))
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", left / F.sum("weight").over(from_here))
    open_level = F.when(F.col("level") * F.col("weight") < F.col("full"), F.struct("fills_at", "source_key", "level"))
    first = levels.withColumn("first", F.min(open_level).over(everything))
    target = F.when(F.col("first").isNull(), F.col("full")).otherwise(F.least("full", F.col("first.level") * F.col("weight")))
    return first.select("source_key", "source_size", target.alias("target"))


def _planned(docs: DataFrame, weights: tuple, share: float, epochs: float, seed: int, kept: list[str] | None = None) -> DataFrame:
    """``__row`` of every row, its columns or those ``kept``, with what ``mixture`` adds."""
    text = plain_text()
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    key = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))
    row = F.struct(*[docs[f"`{c}`"] for c in kept or docs.columns]).alias("__row")
    sized = docs.select(row, "doc_id", F.size(words(text)).cast("long").alias("size"), key.alias("source_key"), drawn.alias("drawn"))
    sized = sized.withColumn("bin", F.substring("drawn", 1, BIN_DIGITS))
    bins = sized.select("source_key", "bin", "size").groupBy("source_key", "bin").agg(F.sum("size").alias("bin_size"))
    levels = water_levels(bins.groupBy("source_key").agg(F.sum("bin_size").alias("source_size")), weights, share, epochs)
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    levels = levels.withColumn("whole", rate)
    levels = levels.withColumn("more", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5))
    earlier = Window.partitionBy("source_key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = bins.withColumn("before", F.coalesce(F.sum("bin_size").over(earlier), F.lit(0))).join(levels, "source_key")
    upto = Window.partitionBy("source_key", "bin").orderBy("drawn", "doc_id", "size")
    joined = sized.join(placed.drop("bin_size"), ["source_key", "bin"])
    reached = F.col("before") + F.sum("size").over(upto.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    part = F.greatest(F.lit(0), F.least("size", F.col("more") - reached))
    return joined.withColumn("part", part).select("__row", "size", "source_size", "target", "whole", "part")


def mixture(
    docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED
) -> DataFrame:
    """Every row of ``docs`` with ``size``, ``source_size``, ``target``, ``whole`` and ``part``.

    The mix takes a document ``whole`` times, and ``part`` of its words once more. Documents follow each other in an
    order drawn from the seed and doc_id; the fractional repetition takes them until the target is reached, so one
    document per source at most is taken in part, and a source's words come within one word of its target. A null or
    blank text has size 0 and is never taken; null sources form one source, the last; null ids are drawn as the empty
    id; repeated rows are separate documents. An empty table stays empty. Further columns stay, whatever their names;
    those named like a new one are replaced.

    Sums run per source and bin of the drawn order (4096 bins a source), so a source with a third of all rows is
    divided evenly; the exact order matters only within a bin.
    """
    planned = _planned(docs, weights, share, epochs, seed)
    return row_unpacked(planned, docs.columns, "size", "source_size", "target", "whole", "part")


def taken_words(
    docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row: the words the mix takes, repeats counted; see ``mixture``.

    No text is moved.
    """
    planned = _planned(docs, weights, share, epochs, seed, ["doc_id"])
    taken = F.col("whole") * F.col("size") + F.col("part")
    return planned.select("__row.doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(
    docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED
) -> DataFrame:
    """The mix itself: each document, whole, as often as it is taken; all columns kept, whatever their names.

    The one document a source that ``mixture`` takes in part is taken once more if that brings the source nearer to its
    target (a tie counts as nearer), and left otherwise; no text is cut. Texts without words are never taken.
    """
    plan = _planned(docs, weights, share, epochs, seed)
    times = F.col("whole") + F.when(2 * F.col("part") >= F.col("size"), 1).otherwise(0)
    taken = plan.where((F.col("size") > 0) & (times > 0)).select("__row", F.explode(F.array_repeat(F.lit(True), times.cast("int"))))
    return row_unpacked(taken, docs.columns)


SIZES_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

MIXTURE_SQL = f"""
sized AS (
  SELECT doc_id, {SIZES_SQL}::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' END || coalesce(source, '') AS source_key,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS drawn
  FROM documents),
sources AS (SELECT source_key, sum(size)::BIGINT AS source_size FROM sized GROUP BY source_key),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source_key) - 1) % 3 + 1)::INT] AS weight,
         source_size * {EPOCHS}::DOUBLE AS filled FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () * {SHARE}::DOUBLE
             - coalesce(sum(filled) OVER (ORDER BY filled / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY filled / weight, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
open_level AS (
  SELECT level FROM levels WHERE level * weight < filled ORDER BY filled / weight, source_key LIMIT 1),
targets AS (
  SELECT source_key, source_size,
         CASE WHEN (SELECT count(*) FROM open_level) = 0 THEN filled
              ELSE least(filled, (SELECT level FROM open_level) * weight) END AS target FROM levels),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
reached AS (
  SELECT s.*, r.source_size, r.target, r.whole, floor(target - whole * source_size + 0.5)::BIGINT AS more,
         sum(size) OVER (PARTITION BY s.source_key ORDER BY drawn, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS before
  FROM sized s JOIN rates r ON s.source_key = r.source_key)
"""
