"""Text clean-up and tolerant number parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinloom.contract import NA_TOKENS

# --- fixed values: Unicode white space, incl. the information separators ---
SPACE_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

_DIGITS = r"(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
NUMBER = rf"^ *[+-]?{_DIGITS} *$"
PADDED_NUMBER = rf"^{SPACE_CLASS}*[+-]?({_DIGITS}|(?i:inf|infinity)){SPACE_CLASS}*$"


def strip(text: Column) -> Column:
    """Remove white space at both ends, NBSP and control separators included."""
    return F.regexp_replace(text, rf"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def clean_text(text: Column) -> Column:
    """Null becomes the empty string, white-space runs one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), rf"{SPACE_CLASS}+", " "))


def na_to_null(text: Column) -> Column:
    """Read the usual missing-value spellings as null."""
    return F.when(~text.isin(NA_TOKENS), text)


def parse_number(text: Column) -> Column:
    """A string as double, null where it is no number.

    The pattern guards against spellings only the JVM takes for numbers (``3.7d``).
    """
    padded = F.when(text.rlike(PADDED_NUMBER), strip(text).try_cast("double"))
    return F.when(text.rlike(NUMBER), text.try_cast("double")).otherwise(padded)


def as_number(column: Column, is_text: bool) -> Column:
    """A string, boolean or numeric column as double; NaN counts as missing."""
    value = parse_number(column) if is_text else column.cast("double")
    return F.when(~F.isnan(value), value)


def document(*columns: Column) -> Column:
    """Join the non-blank columns with one blank each."""
    return F.concat_ws(" ", *[F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit("")) for c in columns])
