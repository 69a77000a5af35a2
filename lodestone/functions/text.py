"""Text functions as column expressions, with the meaning that Python's string methods have."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without outer whitespace of any kind (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """The stretches between whitespace; an empty array for an empty text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def tokenize(c: Column) -> Column:
    """Markup signs to spaces, lower case, runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(c, r"[*_`#]", " ")), F.lit("[a-z0-9]+"), F.lit(0))


def any_of(c: Column, needles: list[str] | tuple[str, ...]) -> Column:
    """Whether the text contains one of the needles as they stand."""
    out = F.lit(False)
    for needle in needles:
        out = out | F.contains(c, F.lit(needle))
    return out


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)
