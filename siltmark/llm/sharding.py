"""Sharding by sampled splitters: near-equal bytes in every shard, without a global sort in one place.

Records are ordered by a key that keeps equal texts together. A size-weighted sample of keys gives quantile
boundaries; records are dealt into the ranges between them, ranges that turn out overfull are subdivided, and
running sums inside the ranges, shifted by the sums of the ranges before, give every record's exact place.
Only keys and sizes travel, never texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltmark.sources.durable import stored

SHARDS = 16
#: Records that a range should hold, largest number of ranges, and sampled keys for each range.
RANGE_ROWS, MAX_RANGES, KEYS_PER_RANGE = 50_000, 20_000, 40
#: A range of more than so many times its share is subdivided, in at most so many rounds.
OVERFULL, ROUNDS = 2.0, 6


def _assign(keyed: DataFrame, cuts: list[int]) -> DataFrame:
    """Add ``part``: the number of boundaries that are not above the key."""
    bounds = np.array(sorted(set(cuts)), np.int64)

    @F.pandas_udf("int")
    def part(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), "right").astype(np.int32))

    return keyed.withColumn("part", part("key"))


def _sample(keyed: DataFrame, total: float, wanted: int, salt: int) -> list[int]:
    """About ``wanted`` keys, each record drawn with a chance in proportion to its size, by a hash of its key."""
    chance = F.pmod(F.xxhash64("key", "doc_id", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    return [r[0] for r in keyed.where(chance < F.col("size") * F.lit(wanted / max(total, 1.0))).select("key").limit(4 * wanted + 100).collect()]


def _quantiles(keys: list[int], parts: int) -> list[int]:
    keys = sorted(keys)
    return [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []


def shard_by_bytes(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Deal all rows into ``shards`` of near-equal bytes.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law ('bytes'), shard, slot (from 0 without
    gaps in each shard), grown_shard (null under this law). A record goes where the middle of its bytes falls when
    all records stand in a row, so a shard differs from the mean by less than one record. Equal texts stand side by
    side and share a shard, except where a boundary falls inside the group. Null text: no bytes. Null ids come
    first among equal texts; repeated rows get slots of their own. Other columns are ignored; an empty table gives
    no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # 36 bits of the text's hash, then 27 of the id's: a text that very many records share can still be divided
    high = F.conv(F.substring(F.md5(text), 1, 9), 16, 10).cast("bigint")
    low = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 6), 16, 10).cast("bigint")
    keyed = documents.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.shiftleft(high, 24) + low).alias("key"),
    )
    keyed = stored(keyed, "keyed")
    rows, total = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = int(min(MAX_RANGES, max(1, -(-rows // RANGE_ROWS))))
    share = max(rows / ranges, 1.0)
    cuts = _quantiles(_sample(keyed, float(total), ranges * KEYS_PER_RANGE, 0), ranges) if ranges > 1 else []
    for salt in range(1, ROUNDS):
        counts = _assign(keyed, cuts).groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()
        over = [r for r in counts if r["n"] > OVERFULL * share]
        if not over or ranges == 1:
            break
        pieces = sum(-(-int(r["n"]) // int(share)) for r in over)
        inside = _assign(keyed, cuts).where(F.col("part").isin([r["part"] for r in over]))
        inside = inside.withColumn("size", F.lit(1))  # an overfull range is divided by records, which is what it has too many of
        more = _quantiles(_sample(inside, float(sum(r["n"] for r in over)), pieces * KEYS_PER_RANGE, salt), pieces)
        if not set(more) - set(cuts):
            break
        cuts = sorted(set(cuts) | set(more))
    dealt = _assign(keyed, cuts)
    order = Window.partitionBy("part").orderBy("key", F.col("doc_id").asc_nulls_first())
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.select("*", F.row_number().over(order).alias("_row"), F.sum("size").over(upto).alias("_upto"))
    placed = stored(placed, "placed")
    # one row for each range: at most MAX_RANGES and what subdivision adds
    sums = {r["part"]: (r["n"], r["b"]) for r in placed.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}
    row_shift, byte_shift = np.zeros(max(sums, default=0) + 1, np.int64), np.zeros(max(sums, default=0) + 1, np.int64)
    n = b = 0
    for part in range(len(row_shift)):
        row_shift[part], byte_shift[part] = n, b
        more_n, more_b = sums.get(part, (0, 0))
        n, b = n + more_n, b + more_b

    @F.pandas_udf("bigint")
    def rows_before(part: pd.Series) -> pd.Series:
        return pd.Series(row_shift[part.to_numpy()])

    @F.pandas_udf("bigint")
    def bytes_before(part: pd.Series) -> pd.Series:
        return pd.Series(byte_shift[part.to_numpy()])

    middle = 2 * (F.col("_upto") + bytes_before("part")) - F.col("size")
    shard = F.least(F.floor(middle.cast("decimal(38,0)") * shards / F.lit(max(2 * total, 1)).cast("decimal(38,0)")), F.lit(shards - 1)).cast("int")
    placed = placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("_row") - 1 + rows_before("part")).alias("_place"))
    placed = stored(placed, "sharded")
    first = {r["shard"]: r["p"] for r in placed.groupBy("shard").agg(F.min("_place").alias("p")).collect()}
    begin = F.element_at(F.array(*[F.lit(int(first.get(s, 0))).cast("bigint") for s in range(shards)]), F.col("shard") + 1)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_place") - begin).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Write whole records into ``path``, a folder for each shard, in slot order inside each file; returns the places.

    Records are matched to places by doc_id, which must be a key here.
    """
    places = stored(shard_by_bytes(documents, shards), "places")
    named = places.select(F.col("doc_id").alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    records = documents.join(named, documents["doc_id"].eqNullSafe(F.col("_id"))).drop("_id")
    records = records.repartition("_shard", F.floor(F.col("_slot") / RANGE_ROWS)).sortWithinPartitions("_shard", "_slot")
    records.drop("_slot").withColumnRenamed("_shard", "shard").write.partitionBy("shard").parquet(path)
    return places


#: The CRC-32 table by its rule, and DuckDB SQL with the rows of shard_by_bytes(documents).
ORACLE = """
WITH RECURSIVE t0 AS (SELECT b, b AS c, 0 AS k FROM (SELECT unnest(range(256))::BIGINT AS b) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t0 WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM t0 WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
h AS (SELECT x, hex(encode(x)) AS hx FROM (SELECT DISTINCT x FROM d)),
c AS (SELECT x, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(x)), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295) AS text_crc32 FROM h, crc),
k AS (SELECT doc_id, x, strlen(x) + 1 AS size, ('0x' || substr(md5(x), 1, 9))::BIGINT * 16777216 + ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 6))::BIGINT AS key FROM d),
o AS (SELECT *, sum(size) OVER w AS upto, row_number() OVER w AS rn, sum(size) OVER () AS total FROM k WINDOW w AS (ORDER BY key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, least(((2 * upto - size) * 16) // (2 * total), 15)::INTEGER AS shard FROM o)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, (rn - min(rn) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM s JOIN c USING (x)
"""
