"""Peer statistics and hash-chain routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Address ranges that are not public, as (network, prefix length).
SPECIAL = ((0x0A000000, 8), (0xAC100000, 12), (0xC0A80000, 16), (0x7F000000, 8), (0xE0000000, 4))


def is_special(ip: Column) -> Column:
    """Private, loopback and multicast addresses."""
    out = F.lit(False)
    for net, length in SPECIAL:
        mask = ((1 << length) - 1) << (32 - length)
        out = out | (ip.bitwiseAND(F.lit(mask)) == F.lit(net))
    return out


def locate(peers: DataFrame, ranges: DataFrame, bits: int = 16) -> DataFrame:
    """Peers (ip) joined with the narrowest range (first, last, ...) that holds them; peers outside all are dropped.

    Ranges are entered under every ``bits``-bit prefix that they touch, so this is an equi-join on the prefix with an
    exact filter; no nested loop.
    """
    shift = 32 - bits
    entered = ranges.withColumn("_p", F.explode(F.sequence(F.shiftright("first", shift), F.shiftright("last", shift))))
    met = peers.withColumn("_p", F.shiftright("ip", shift)).join(entered, "_p").where("ip between first and last")
    best = met.groupBy("ip").agg(F.min_by(F.struct(*[c for c in ranges.columns if c not in ("first", "last")]), F.struct(F.col("last") - F.col("first"), F.col("first"))).alias("r"))
    return best.select("ip", "r.*")


def shares(df: DataFrame, name: str) -> DataFrame:
    """Count and percentage of all rows of each name; nulls count only in the total."""
    total = F.broadcast(df.agg(F.count("*").alias("_t")))
    counts = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    return counts.crossJoin(total).select(name, "n", F.round(F.lit(100.0) * F.col("n") / F.col("_t"), 4).alias("percent"))


def client_name(raw: Column) -> Column:
    """First word of a client text, 'Unknown' without one."""
    first = F.substring_index(F.trim(F.regexp_replace(F.regexp_replace(raw, "[/_]", " "), r"\s+", " ")), " ", 1)
    return F.when(raw.isNull() | (first == ""), "Unknown").otherwise(first)


def row_shares(counts: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Each cell over its row's sum; a row of zeros stays zero."""
    total = F.sum(value).over(Window.partitionBy(row))
    return counts.select(row, column, F.round(F.coalesce(F.try_divide(F.col(value), F.nullif(total, F.lit(0))), F.lit(0.0)), 6).alias("share"))


def sample_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.median(value), 6).alias("median"), F.max(value).alias("max"), F.count(value).alias("n"))


def hash_chain(df: DataFrame, value: str, length: int) -> DataFrame:
    """Rows (.., step, hash): the value's SHA-256 taken 1 to ``length`` times, each of the text before."""
    chain, h = [], F.col(value)
    for _ in range(length):
        h = F.sha2(h, 256)
        chain.append(h)
    return df.select("*", F.posexplode(F.array(*chain)).alias("_s", "hash")).withColumn("step", (F.col("_s") + 1).cast("bigint")).drop("_s")


def hour_key(key: Column, ts: Column) -> Column:
    return F.sha2(F.concat(key, F.date_format(F.date_trunc("HOUR", ts.cast("timestamp")), "yyyy-MM-dd HH")), 256)


def forward(chains: DataFrame, messages: DataFrame, length: int) -> DataFrame:
    """The peer that each message (id, hash) goes to, and the hash that it carries on.

    ``chains``: peer, step, hash of stored chains. A message names A(i + 1); it goes to the peer that announced A(i),
    of those on several chains to the one nearest. Messages for the first hash of a chain are for the peer itself;
    those on no chain go nowhere.
    """
    back = chains.select("peer", (F.col("step") + 1).alias("step"), F.col("hash").alias("onward"))
    known = chains.where(F.col("step") <= length).join(back, ["peer", "step"], "left")
    best = messages.join(known, "hash").groupBy("id").agg(F.min_by(F.struct("peer", "onward"), F.struct("step", "peer")).alias("to"))
    return best.select("id", "to.peer", "to.onward")


def announced(stored_chains: DataFrame, announcements: DataFrame) -> DataFrame:
    """Announcements (id, hash, step) that are taken: those without a stored hash of as few steps or fewer."""
    known = stored_chains.groupBy("hash").agg(F.min("step").alias("_known"))
    return announcements.join(known, "hash", "left").where(F.col("_known").isNull() | (F.col("_known") > F.col("step"))).drop("_known")
