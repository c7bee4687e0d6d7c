"""The four senses of empty that the data has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty_text(c: Column) -> Column:
    return c.isNull() | (c == "")


def empty_number(c: Column) -> Column:
    """Zero counts as empty."""
    return c.isNull() | (c == 0)


def empty_list(c: Column) -> Column:
    return c.isNull() | (F.size(c) == 0)


def truthy(c: Column) -> Column:
    """Of a boolean: true only."""
    return F.coalesce(c, F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))
