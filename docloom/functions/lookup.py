"""Small literal lookups and tests for missing values."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(mapping: dict, key: Column) -> Column:
    """The mapped value, or null for an unknown key."""
    table = F.create_map(*map(F.lit, chain.from_iterable(mapping.items())))
    return F.try_element_at(table, key)


def has_text(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def has_number(value: Column) -> Column:
    """Zero counts as missing."""
    return F.coalesce(value != 0, F.lit(False))


def has_items(value: Column) -> Column:
    """For arrays and maps."""
    return F.coalesce(F.size(value) > 0, F.lit(False))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value bound to a name: it is worked out once, not at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
