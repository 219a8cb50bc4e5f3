"""Strings that arrays hold as bytes or characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_string(value: Column, pad: str) -> Column:
    """A fixed-width string by its pad rule: all are cut at the first NUL, and `space` loses trailing spaces."""
    cut = F.substring_index(value, "\0", 1)
    return F.rtrim(cut) if pad == "space" else cut


def characters(value: Column, width: int) -> Column:
    """A string as `width` one-character strings; past its end the empty string."""
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.substring(value, i, F.lit(1)))


def joined(index: Column, character: Column) -> Column:
    """Aggregate: the characters of a row in the order of their index, cut at the first NUL and without trailing blanks."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(index.alias("i"), character.alias("c")))), lambda x: x["c"])
    return F.rtrim(F.substring_index(F.array_join(ordered, ""), "\0", 1))


def folded(values: Column) -> Column:
    """A list of one value as that value alone, longer ones as they are: (single, several)."""
    return F.struct(F.when(F.size(values) == 1, F.element_at(values, 1)).alias("single"), F.when(F.size(values) != 1, values).alias("several"))
