"""Word counts by built-in functions; words are runs of ``[^\\x20\\x09-\\x0D]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"


def blanks_as_spaces(text: Column) -> Column:
    """Byte-wise replacements, which cost little where a blank does not occur."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS[1:]:
        out = F.replace(out, F.lit(blank), F.lit(" "))
    return out


def words_of(text: Column) -> Column:
    """The words in order; none for a null text."""
    return F.array_remove(F.split(blanks_as_spaces(text), " "), "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")
