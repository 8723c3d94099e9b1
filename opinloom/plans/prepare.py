"""Raw review, business and user tables to one labelled table, split by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinloom.contract import (
    BUSINESS_NAMES,
    NUMERIC_COLUMNS,
    POLARITY,
    PREPARED_COLUMNS,
    REVIEW_NAMES,
    SCORE,
    TEXT_COLUMNS,
    TRAIN_FRACTION,
    USER_NAMES,
)
from opinloom.functions.cleaning import clean_text
from opinloom.functions.labels import to_polarity, to_score
from opinloom.operators.joins import has_unique_key, left_join
from opinloom.operators.ordering import ORDINAL, split_fraction, with_split
from opinloom.operators.projection import (
    drop_unlabelled,
    ensure_columns,
    keep_prefixed,
    numeric,
    rename,
    require_columns,
)


def labelled_reviews(reviews: DataFrame) -> DataFrame:
    """Renamed reviews with an integer score; reviews without one are dropped before any join."""
    renamed = require_columns(rename(reviews, REVIEW_NAMES), [ORDINAL, SCORE])
    return drop_unlabelled(renamed.withColumn(SCORE, to_score(numeric(renamed, SCORE))), SCORE)


def _coerced(df: DataFrame) -> DataFrame:
    """Clean the contract's text columns and coerce its numeric ones, as far as present."""
    return df.withColumns({
        **{c: clean_text(F.col(c)) for c in TEXT_COLUMNS if c in df.columns},
        **{c: F.coalesce(numeric(df, c), F.lit(0.0)) for c in NUMERIC_COLUMNS if c in df.columns},
    })


def prepare(reviews: DataFrame, business: DataFrame, users: DataFrame) -> DataFrame:
    """The 33 prepared columns plus the ordinal of the review.

    ``reviews`` carries a unique ``ordinal`` (see ``ordering.read_with_ordinal``). Dimensions are
    cleaned before the joins, once per business and user instead of once per review; what a review
    without a match misses is filled afterwards.
    """
    businesses = _coerced(keep_prefixed(rename(business, BUSINESS_NAMES), "business_id", "business_"))
    people = _coerced(keep_prefixed(rename(users, USER_NAMES), "user_id", "user_"))
    merged = left_join(_coerced(labelled_reviews(reviews)), businesses, "business_id")
    merged = left_join(merged, people, "user_id")
    merged = ensure_columns(ensure_columns(merged, TEXT_COLUMNS, ""), NUMERIC_COLUMNS, 0.0)
    return merged.select(
        ORDINAL,
        *[F.coalesce(c, F.lit("")).alias(c) for c in TEXT_COLUMNS],
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in NUMERIC_COLUMNS],
        SCORE,
        to_polarity(F.col(SCORE)).alias(POLARITY),
    ).select(ORDINAL, *PREPARED_COLUMNS)


def _cut_of(reviews: DataFrame, business: DataFrame, users: DataFrame, prepared: DataFrame) -> DataFrame:
    """Where to look the cut up: with unique dimension keys the joins keep the positions, so in the reviews alone."""
    unique = has_unique_key(business, "business_id") and has_unique_key(users, "user_id")
    return labelled_reviews(reviews) if unique else prepared


def prepare_split(
    reviews: DataFrame, business: DataFrame, users: DataFrame, fraction: float = TRAIN_FRACTION
) -> tuple[DataFrame, DataFrame]:
    """Prepared training and test rows, cut by review position; the filter applies below the joins."""
    prepared = prepare(reviews, business, users)
    return split_fraction(prepared, fraction, positions=_cut_of(reviews, business, users, prepared))


def prepare_with_split(
    reviews: DataFrame, business: DataFrame, users: DataFrame, fraction: float = TRAIN_FRACTION
) -> DataFrame:
    """The prepared rows with a column ``split`` of ``train`` and ``test``: both parts in one pass."""
    prepared = prepare(reviews, business, users)
    return with_split(prepared, fraction, positions=_cut_of(reviews, business, users, prepared))
