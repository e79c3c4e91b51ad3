"""Column expressions shared by the text operators; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space that separates words: blank, tab, \n, \v, \f, \r.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: ASCII except digits and a-z, for texts whose A-Z is lower-cased already.
NOT_WORD_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as make it unlike every column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII takes the byte-wise built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def space_words(text: Column) -> Column:
    """Maximal runs of characters other than SPACE; null and blank texts give an empty array."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN, -1))


def plain_words(text: Column) -> Column:
    """Maximal runs of a-z, digits and non-ASCII characters of the A-Z-lower-cased text; null gives an empty array."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD_RUN, -1)
    return F.filter(parts, lambda w: w != "")
