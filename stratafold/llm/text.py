"""Tokenisation shared by the corpus operators, as Spark columns and as Python patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between the words of lower-cased text; anything else belongs to a word.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: White space between the words of the size and shingle contracts.
BLANK = r"[\x20\x09-\x0D]+"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII text takes the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def words(text: Column) -> Column:
    """The words of lower-cased whole text; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP), "")


def n_blank_words(text: Column) -> Column:
    """Number of maximal runs of non-blank characters; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")).cast("long")
