"""Tokens of log texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Distinct lower-cased runs of letters, numbers, _ and -, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_-]+"), lambda t: t != "")))
