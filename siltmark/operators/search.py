"""Log search over inverted indexes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.functions.tokens import tokens


def haystack() -> Column:
    return F.concat_ws(" ", "message", "source", "level")


def postings(logs: DataFrame) -> DataFrame:
    """Index entries: index (day, level, source, term), key, id. One pass over the logs; no shuffle."""
    entry = lambda index, key: F.struct(F.lit(index).alias("index"), key.alias("key"))
    fixed = F.array(entry("day", F.to_date("ts").cast("string")), entry("level", F.col("level")), entry("source", F.col("source")))
    terms = F.transform(tokens(haystack()), lambda t: entry("term", t))
    return logs.select("id", F.explode(F.concat(fixed, terms)).alias("e")).select("e.index", "e.key", "id")


def buckets(index: DataFrame) -> DataFrame:
    """Size of every bucket and the ids at its ends."""
    return index.groupBy("index", "key").agg(F.count_distinct("id").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def add(index: DataFrame, more: DataFrame, removed: DataFrame) -> DataFrame:
    """The index after an increment: new entries joined, entries of removed ids dropped."""
    return index.unionByName(more).distinct().join(removed.select("id"), "id", "left_anti").select("index", "key", "id")


def search(logs: DataFrame, index: DataFrame, text: str = "", **equal: str) -> DataFrame:
    """Logs that have every token of ``text`` and equal the given day, level or source; newest first.

    The wanted buckets are read in one pass over the index; an id that all of them hold is a candidate, and every
    candidate is then checked against its own fields. Without conditions all logs are found; an unknown bucket has none.
    """
    # letters, digits, _ and - make up a token, as in tokens()
    wanted = sorted({t for t in re.split(r"[^\w-]+", text.lower()) if t})
    found, buckets_ = logs, [*equal.items(), *(("term", t) for t in wanted)]
    if buckets_:
        hit = F.lit(False)
        for name, value in buckets_:
            hit = hit | ((F.col("index") == name) & (F.col("key") == value))
        ids = index.where(hit).groupBy("id").agg(F.count_distinct("index", "key").alias("n")).where(F.col("n") == len(set(buckets_))).select("id")
        found = found.join(ids, "id", "left_semi")
    for t in wanted:
        found = found.where(F.contains(F.lower(haystack()), F.lit(t)))
    for name, value in equal.items():
        field = F.to_date("ts").cast("string") if name == "day" else F.col(name)
        found = found.where(field == value)
    return found.orderBy(F.desc("ts"), "id")
