"""Slices with negative indexes, clamped; bytes of texts and elements of arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bounds(n: Column, start: Column, stop: Column) -> tuple[Column, Column]:
    """First place (from 1) and number of an inclusive slice of ``n`` items."""
    first = F.greatest(F.when(start < 0, n + start).otherwise(start), F.lit(0))
    last = F.least(F.when(stop < 0, n + stop).otherwise(stop), n - 1)
    return (first + 1).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int")


def byte_range(text: Column, start: int, stop: int) -> Column:
    """Bytes start..stop, both included, from the end if negative."""
    data = F.encode(text, "UTF-8")
    first, count = _bounds(F.octet_length(text), F.lit(start), F.lit(stop))
    return F.call_function("substring", data, first, count)


def array_range(items: Column, start: int, stop: int) -> Column:
    first, count = _bounds(F.size(items), F.lit(start), F.lit(stop))
    return F.slice(items, first, count)


def array_at(items: Column, index: int) -> Column:
    """Element at an index, from the end if negative; null outside."""
    return F.get(items, F.lit(index) if index >= 0 else F.size(items) + index)


def without_first(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.slice(items, 2, F.size(items))).otherwise(items)


def without_last(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.slice(items, 1, F.size(items) - 1)).otherwise(items)
