"""Word tokens and n-grams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed value: a word is two or more letters, digits or underscores -----
WORD = r"[\p{L}\p{N}_]{2,}"


def words(text: Column) -> Column:
    """Lower-cased words in reading order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring tokens joined by a blank; empty if there are fewer.

    Shifted slices are zipped, so no lambda captures the token array.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    length = F.greatest(F.size(tokens) - F.lit(n - 1), F.lit(0))
    shifted = [F.slice(tokens, F.lit(i + 1), length) for i in range(n)]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat_ws(" ", x, y)), shifted)


def ngram_range(tokens: Column, low: int, high: int) -> Column:
    """All n-grams with ``low <= n <= high``."""
    return F.concat(*[ngrams(tokens, n) for n in range(low, high + 1)])
