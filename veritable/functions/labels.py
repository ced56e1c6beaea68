"""Label vocabularies and their numeric form."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritable.functions.hashing import as_column

# The words that mean "fake", the union of the vocabularies in use.
FAKE_WORDS = ("fake", "synthetic", "full_synthetic", "1", "tampered", "true")

WHITESPACE = " \t\r\n\f\x0b"


def strip(c: Column | str) -> Column:
    """Trim every kind of ASCII whitespace on both ends."""
    return F.trim(as_column(c), F.lit(WHITESPACE))


def normalize_label(
    c: Column | str, vocabulary: Iterable[str] = FAKE_WORDS, numeric: bool = False
) -> Column:
    """`fake` or `real`; text by vocabulary (any case, trimmed), integers by `== 1`."""
    c = as_column(c)
    fake = (c == 1) if numeric else F.lower(strip(c)).isin(*vocabulary)
    return F.when(fake, F.lit("fake")).otherwise(F.lit("real"))


def label_to_int(c: Column | str) -> Column:
    """1 for `fake` in any case, 0 for everything else, null included."""
    return F.coalesce((F.lower(strip(c)) == "fake").cast("int"), F.lit(0))
