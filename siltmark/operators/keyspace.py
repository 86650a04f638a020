"""Typed keyspace commands as folds over a command log: last writes, counters, lists, maps, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counters(commands: DataFrame) -> DataFrame:
    """Value of each key: the last SET and all increments after it (0 before any). Rows: key, seq, cmd, n.

    Two grouped passes; the last SET of a key is pre-aggregated and joined back, so a busy key is not gathered.
    """
    reset = commands.where("cmd = 'SET'").groupBy("key").agg(F.max(F.struct("seq", "n")).alias("s"))
    after = commands.where("cmd = 'INCR'").join(reset, "key", "left").where(F.col("s").isNull() | (F.col("seq") > F.col("s.seq")))
    grown = after.groupBy("key").agg(F.sum("n").alias("g"))
    return reset.join(grown, "key", "full_outer").select("key", (F.coalesce("s.n", F.lit(0)) + F.coalesce("g", F.lit(0))).alias("value"))


def appended(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Text of each key after appending in order."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(key).agg(parts.alias("_p")).select(key, F.array_join(F.transform("_p", lambda p: F.coalesce(p[text], F.lit(""))), "").alias("value"))


def fold_list(commands: DataFrame) -> DataFrame:
    """List of each key after its pushes and pops in order. Rows: key, seq, cmd (LPUSH RPUSH LPOP RPOP), item."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "cmd", "item")))

    def apply(a: Column, c: Column) -> Column:
        n = F.size(a)
        return (
            F.when(c["cmd"] == "LPUSH", F.concat(F.array(c["item"]), a))
            .when(c["cmd"] == "RPUSH", F.concat(a, F.array(c["item"])))
            .when(n == 0, a)
            .when(c["cmd"] == "LPOP", F.slice(a, 2, F.greatest(n, F.lit(1))))
            .otherwise(F.slice(a, 1, F.greatest(n - 1, F.lit(0))))
        )

    empty = F.array().cast("array<bigint>")
    return commands.groupBy("key").agg(ordered.alias("c")).select("key", F.aggregate("c", empty, apply).alias("items"))


def fields(rows: DataFrame) -> DataFrame:
    """Latest value of every (key, field), without fields whose last command deletes. Rows: key, field, seq, value, gone."""
    last = rows.groupBy("key", "field").agg(F.max(F.struct("seq", "value", "gone")).alias("v"))
    return last.where("not v.gone").select("key", "field", "v.value")


def ttl(keys: DataFrame, now: Column) -> DataFrame:
    """Remaining milliseconds of each key: -2 expired or missing, -1 without expiry. Rows: key, set_at, ttl_ms (or null)."""
    left = remaining(now)
    return keys.select("key", F.when(F.col("ttl_ms").isNull(), -1).when(left <= 0, -2).otherwise(left).cast("bigint").alias("ttl"))


def remaining(now: Column) -> Column:
    """Milliseconds that a key (set_at, ttl_ms) has left; null if it does not expire."""
    return F.col("ttl_ms") - (F.unix_millis(now) - F.unix_millis("set_at"))


def unexpired(keys: DataFrame, now: Column) -> DataFrame:
    """Keys that have not expired: what reads may see, and what a sweep leaves."""
    return keys.where(F.col("ttl_ms").isNull() | (remaining(now) > 0))


def sweep(keys: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The keys that stay, and those that have expired."""
    return unexpired(keys, now), keys.where(remaining(now) <= 0)


def lookup(keys: DataFrame, wanted: DataFrame, now: Column, *columns: str) -> DataFrame:
    """For each wanted key its columns, null where it is missing or expired, and whether it was found."""
    return wanted.select("key").distinct().join(unexpired(keys, now).select("key", *columns, F.lit(True).alias("found")), "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def running_groups(rows: DataFrame, key: str, order: str, reset: Column) -> DataFrame:
    """Number of resets up to each row of its key: the segment that a sequential fold is in."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("segment", F.sum(reset.cast("int")).over(w))
