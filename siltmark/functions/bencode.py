"""Bencoded values as JSON text."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _parse(data: bytes) -> object:
    """The value that ``data`` holds and nothing else: whole numbers, byte strings, lists and dictionaries, at any depth."""
    stack: list[list] = []  # open lists and dictionaries: [items, whether a dictionary]
    at = 0
    while True:
        head = data[at : at + 1]
        if head in (b"l", b"d"):
            stack.append([[], head == b"d"])
            at += 1
            continue
        if head == b"e" and stack:
            items, keyed = stack.pop()
            if keyed and (len(items) % 2 or not all(isinstance(k, str) for k in items[::2])):
                raise ValueError(data)
            value: object = dict(zip(items[::2], items[1::2], strict=True)) if keyed else items
            at += 1
        elif head == b"i":
            end = data.index(b"e", at)
            value = int(data[at + 1 : end])
            at = end + 1
        else:
            colon = data.index(b":", at)
            size = int(data[at:colon])
            at = colon + 1 + size
            if size < 0 or at > len(data):
                raise ValueError(data)
            value = data[colon + 1 : at].decode("utf-8", "replace")
        if not stack:
            if at != len(data):
                raise ValueError(data)
            return value
        stack[-1][0].append(value)


@F.udf(StringType(), useArrow=True)
def _json(data):
    try:
        return None if data is None else json.dumps(_parse(bytes(data)), ensure_ascii=False)
    except ValueError:
        return None


def to_json(data: Column) -> Column:
    """JSON text of a bencoded value (binary); null if it is not one. Bytes that are not UTF-8 are replaced."""
    return _json(data)
