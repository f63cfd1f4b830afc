"""Words of a text as a column, by built-in functions alone."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of code points that are no ASCII letter or digit, and of those that are no ASCII letter; all others are parts of words.
NO_LETTER_OR_DIGIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_LETTER = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """text with A-Z, and nothing else, lower-cased; null is empty. Texts of ASCII alone, where lower() means the same, take the faster way."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def words(lowered: Column, between: str) -> Column:
    """What lies between matches of `between`, in order."""
    return F.array_remove(F.split(lowered, between), "")
