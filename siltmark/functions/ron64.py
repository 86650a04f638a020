"""Base-64 numbers as text: encode, decode, order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the 64 digits in their order.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz~"


def encode(n: Column) -> Column:
    """Shortest base-64 text of a number from 0 to 2^63 - 1; null for a negative one."""
    n = n.cast("bigint")
    # from the highest of eleven digits to the lowest
    digits = F.transform(F.sequence(F.lit(60), F.lit(0), F.lit(-6)), lambda k: _digit(n, k))
    text = F.ltrim(F.array_join(digits, ""), F.lit("0"))
    return F.when(n >= 0, F.when(text == "", "0").otherwise(text))


def _digit(n: Column, shift: Column) -> Column:
    place = F.call_function("shiftright", n, shift).bitwiseAND(F.lit(63).cast("bigint"))
    return F.call_function("substring", F.lit(DIGITS), place.cast("int") + 1, F.lit(1))


def decode(text: Column) -> Column:
    """Number of a base-64 text of up to 2^63 - 1; null if it is greater, empty or has a foreign character."""
    digits = F.filter(F.split(text, ""), lambda c: c != "")
    value = F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, c: a * 64 + (F.instr(F.lit(DIGITS), c) - 1))
    return F.when(text.rlike("^(?:[0-9A-Z_a-z~]{1,10}|[0-7][0-9A-Z_a-z~]{10})$"), value)
