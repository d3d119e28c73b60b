"""Text keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thousands separators: commas between digit groups of two or three, the last of three.
_THOUSANDS = r"(?<=\d),(?=(?:\d{2,3},)*\d{3}(?!\d))"
#: A run of letters and digits; a decimal point between digits belongs to it.
_WORD = r"[\p{L}\p{N}]+(?:(?<=\d)\.(?=\d)[\p{L}\p{N}]+)*"
_SIGNED = r"[₹$%]|(?<![\p{L}\p{N}])[-−](?=\d)|" + _WORD


def plain_key(text: Column) -> Column:
    """Lower case, each run of characters that are neither letters nor digits as one space, trimmed; null is ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def words(text: Column) -> Column:
    """The words of a text in order, in lower case, numbers without thousands separators; null has none."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _THOUSANDS, ""), F.lit(_WORD), F.lit(0))


def words_and_signs(text: Column) -> Column:
    """As ``words``, with the signs ₹ $ % and a minus that stands directly before a number and follows no word."""
    found = F.regexp_extract_all(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _THOUSANDS, ""), F.lit(_SIGNED), F.lit(0))
    return F.transform(found, lambda w: F.when(w == "−", "-").otherwise(w))
