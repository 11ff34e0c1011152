"""Column expressions that the corpus operators share. Words are maximal runs of `[^\\x20\\x09-\\x0D]`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spaced(text: Column) -> Column:
    """text with every white space as a plain space; empty for null."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES[1:]:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def words(text: Column) -> Column:
    """Array of the words of text; empty for null or blank text. Splitting at one plain character avoids Java's regular expressions."""
    return F.array_remove(F.split(spaced(text), " "), "")


def word_count(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    return F.size(words(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hex_number(digest: Column, at: int, digits: int) -> Column:
    """Part of a hexadecimal digest as a long; at most 15 digits."""
    return F.conv(F.substring(digest, at, digits), 16, 10).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0))
