"""Column expressions shared by the native operators: ASCII lower-casing and letter/digit words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the plain function where the text is all ASCII."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """The text's words in order; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(lower_ascii(text), F.lit("")), SEPARATORS), "")
