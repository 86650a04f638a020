"""Queries over versioned key-value logs, their files and their recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltmark.operators import versioned
from siltmark.plans.registry import Registry
from siltmark.sources.tables import KV_LOG_SQL, kv_log, table

R = Registry()
_LATEST = "SELECT key, max(\"offset\") AS \"offset\", arg_max(value, \"offset\") AS value FROM kv_log {where} GROUP BY key HAVING NOT arg_max(is_tombstone, \"offset\")"


@R.query(f"WITH {KV_LOG_SQL} {_LATEST.format(where='')}")
def kv_latest(spark, d):
    return versioned.latest(kv_log(spark, d))


@R.query(f"WITH {KV_LOG_SQL} {_LATEST.format(where='WHERE \"offset\" <= 4999')}")
def kv_asof(spark, d):
    return versioned.latest(kv_log(spark, d), as_of=4999)


@R.query(f"WITH {KV_LOG_SQL} {_LATEST.format(where="WHERE key >= 'user/10' AND key < 'user/20'")}")
def kv_range(spark, d):
    return versioned.latest(kv_log(spark, d), start="user/10", end="user/20")


@R.query(
    f"""WITH {KV_LOG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key, "offset" < 6000 ORDER BY "offset" DESC) AS rn FROM kv_log)
SELECT key, "offset", value, is_tombstone FROM r WHERE "offset" >= 6000 OR (rn = 1 AND NOT is_tombstone)"""
)
def kv_keep_versions(spark, d):
    return versioned.keep_versions(kv_log(spark, d), 6000).select("key", "offset", "value", "is_tombstone")


@R.query(
    f"""WITH {KV_LOG_SQL}, u AS (SELECT * FROM kv_log WHERE "offset" % 3 = 0 UNION ALL SELECT * FROM kv_log WHERE "offset" % 3 <> 0)
SELECT key, max("offset") AS "offset", arg_max(value, "offset") AS value FROM u GROUP BY key HAVING NOT arg_max(is_tombstone, "offset")"""
)
def kv_merge_sources(spark, d):
    log = kv_log(spark, d)
    return versioned.latest(versioned.merge(log.where("offset % 3 = 0"), log.where("offset % 3 <> 0")))


@R.query(
    """WITH c AS (SELECT o_orderkey, o_totalprice * 2 AS o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN 'delete' ELSE 'put' END AS op FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 10 = 0
UNION ALL SELECT o_orderkey + 100000000, o_totalprice, 'put' FROM orders WHERE o_orderkey % 97 = 0)
SELECT o_orderkey, o_totalprice FROM orders o WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.o_orderkey = o.o_orderkey) UNION ALL SELECT o_orderkey, o_totalprice FROM c WHERE op <> 'delete'"""
)
def kv_put_del_merge(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    op = F.when(F.col("o_orderkey") % 7 == 0, "delete").otherwise("put")
    changes = orders.where("o_orderkey % 7 = 0 or o_orderkey % 10 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), op.alias("op"))
    fresh = orders.where("o_orderkey % 97 = 0").select((F.col("o_orderkey") + 100_000_000).alias("o_orderkey"), "o_totalprice", F.lit("put").alias("op"))
    return versioned.upsert(orders, changes.unionByName(fresh), "o_orderkey")


_FILES_SQL = """f AS (SELECT 'a' || o_orderkey // 700 AS file, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY ALL),
g AS (SELECT 'b' || o_orderkey // 900 AS file, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY ALL)"""


def _files(spark, d, letter, width):
    orders = table(spark, d, "orders")
    return orders.groupBy(F.concat(F.lit(letter), F.floor(F.col("o_orderkey") / width).cast("string")).alias("file")).agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@R.query(f"WITH {_FILES_SQL} SELECT f.file, count(*) AS n_overlaps FROM f JOIN g ON f.first <= g.last AND g.first <= f.last GROUP BY f.file")
def sst_overlap(spark, d):
    pairs = versioned.overlaps(_files(spark, d, "a", 700), _files(spark, d, "b", 900), 1000)
    return pairs.groupBy("file").agg(F.count("*").alias("n_overlaps"))


@R.query(
    f"""WITH {_FILES_SQL}, n AS (SELECT f.file, f.first, count(*) AS n FROM f JOIN g ON f.first <= g.last AND g.first <= f.last GROUP BY ALL)
SELECT arg_max(file, n * 100000000000 + first) AS file, max(n) AS n_overlaps FROM n"""
)
def sst_pick(spark, d):
    """The file with most overlaps below; of equals the last in key order."""
    files = _files(spark, d, "a", 700)
    counts = versioned.overlaps(files, _files(spark, d, "b", 900), 1000).groupBy("file").agg(F.count("*").alias("n")).join(files, "file")
    return counts.agg(F.max_by("file", F.struct("n", "first")).alias("file"), F.max("n").alias("n_overlaps"))


_EDITS_SQL = "e AS (SELECT event_id AS edit_id, CASE WHEN event_type IN ('click', 'error') THEN 'remove' ELSE 'add' END AS op, user_id % 7 AS level, 'f' || event_id % 211 AS file, CAST(round(value * 100) AS BIGINT) AS file_size FROM events)"


def _edits(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("edit_id"),
        F.when(F.col("event_type").isin("click", "error"), "remove").otherwise("add").alias("op"),
        (F.col("user_id") % 7).alias("level"),
        F.concat(F.lit("f"), (F.col("event_id") % 211).cast("string")).alias("file"),
        F.round(F.col("value") * 100).cast("bigint").alias("file_size"),
    )


@R.query(f"WITH {_EDITS_SQL} SELECT file, arg_max(level, edit_id) AS level, arg_max(file_size, edit_id) AS file_size FROM e GROUP BY file HAVING arg_max(op, edit_id) = 'add'")
def manifest_fold(spark, d):
    return versioned.live_files(_edits(spark, d))


@R.query(
    f"""WITH {_EDITS_SQL}, l AS (SELECT file, arg_max(level, edit_id) AS level, arg_max(file_size, edit_id) AS s FROM e GROUP BY file HAVING arg_max(op, edit_id) = 'add'),
w AS (SELECT level, sum(file_size) AS written FROM e WHERE op = 'add' GROUP BY level)
SELECT level, count(l.file) AS n_files, CAST(coalesce(sum(s), 0) AS BIGINT) AS n_bytes, CAST(any_value(written) AS BIGINT) AS written, round(any_value(written) / nullif(coalesce(sum(s), 0), 0), 6) AS write_amp FROM w LEFT JOIN l USING (level) GROUP BY level"""
)
def level_metrics(spark, d):
    edits = _edits(spark, d)
    live = versioned.live_files(edits).groupBy("level").agg(F.count("*").alias("n_files"), F.sum("file_size").alias("n_bytes"))
    written = edits.where("op = 'add'").groupBy("level").agg(F.sum("file_size").alias("written"))
    out = written.join(live, "level", "left").na.fill(0, ["n_files", "n_bytes"])
    return out.select("level", "n_files", "n_bytes", "written", F.round(F.col("written") / F.nullif("n_bytes", F.lit(0)), 6).alias("write_amp"))


@R.query(f"WITH {KV_LOG_SQL} SELECT kind, count(*) AS n, max(\"offset\") AS last_offset FROM kv_log WHERE \"offset\" < (SELECT max(\"offset\") FROM kv_log WHERE kind = 'signup') GROUP BY kind")
def wal_recover(spark, d):
    return versioned.committed(kv_log(spark, d), "signup").groupBy("kind").agg(F.count("*").alias("n"), F.max("offset").alias("last_offset"))


@R.query(f"WITH {KV_LOG_SQL} SELECT key, \"offset\", value FROM kv_log WHERE \"offset\" >= 7000 AND kind <> 'signup' AND \"offset\" < (SELECT max(\"offset\") FROM kv_log WHERE kind = 'signup')")
def wal_scan(spark, d):
    """Committed records from an offset on; the marker rows themselves are not records."""
    return versioned.committed(kv_log(spark, d), "signup").where("offset >= 7000 and kind <> 'signup'").select("key", "offset", "value")


@R.query(
    f"""WITH {KV_LOG_SQL}, s AS (SELECT "offset" // 512 AS segment, min("offset") AS first_offset, max("offset") AS last_offset, count(*) AS n FROM kv_log GROUP BY 1)
SELECT * FROM s WHERE last_offset >= 3000"""
)
def wal_truncate(spark, d):
    """Segments that stay when all entirely below an offset are dropped."""
    segments = kv_log(spark, d).groupBy(F.floor(F.col("offset") / 512).alias("segment")).agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.count("*").alias("n"))
    return segments.where("last_offset >= 3000")


@R.query(f"WITH {KV_LOG_SQL} SELECT \"offset\", hex(encode(key)) || '00' || lpad(upper(to_hex(9223372036854775807 - \"offset\")), 16, '0') AS internal_key FROM kv_log")
def internal_keys(spark, d):
    return kv_log(spark, d).select("offset", versioned.internal_key(F.col("key"), F.col("offset")).alias("internal_key"))


@R.query(f"WITH {KV_LOG_SQL}, s AS (SELECT key, max(\"offset\") AS o FROM kv_log WHERE kind = 'view' GROUP BY key) SELECT min(o) AS horizon, count(*) AS n_snapshots FROM s")
def snapshot_horizon(spark, d):
    """Oldest live snapshot, which is how far compaction may collapse versions."""
    live = kv_log(spark, d).where("kind = 'view'").groupBy("key").agg(F.max("offset").alias("o"))
    return live.agg(F.min("o").alias("horizon"), F.count("*").alias("n_snapshots"))


@R.query(f"""WITH {KV_LOG_SQL}, w AS (SELECT 'user/' || c_custkey AS key FROM customer), l AS (SELECT key, arg_max(value, "offset") AS value, arg_max(is_tombstone, "offset") AS gone FROM kv_log GROUP BY key)
SELECT w.key, l.key IS NOT NULL AS contained, CASE WHEN NOT gone THEN value END AS value FROM w LEFT JOIN l ON l.key = w.key""")
def kv_lookup(spark, d):
    """Point lookups of a set of keys."""
    wanted = table(spark, d, "customer").select(F.concat(F.lit("user/"), F.col("c_custkey").cast("string")).alias("key"))
    return versioned.lookup(kv_log(spark, d), wanted)


_LEVELS_SQL = """v AS (SELECT 'b' || o_orderkey // 900 AS file, 1 AS level, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY ALL UNION ALL
SELECT 'c' || o_orderkey // 250, 2, min(o_orderkey), max(o_orderkey) FROM orders WHERE o_orderkey % 9 < 7 GROUP BY ALL UNION ALL SELECT 'e' || o_orderkey // 5000, 3, min(o_orderkey), max(o_orderkey) FROM orders WHERE o_orderkey > 4000 GROUP BY ALL)"""


@R.query(
    f"""WITH {_LEVELS_SQL}, p AS (SELECT a.file, any_value(a.first) AS first, any_value(a.last) AS last FROM v a LEFT JOIN v b ON b.level = 2 AND a.first <= b.last AND b.first <= a.last WHERE a.level = 1 GROUP BY a.file ORDER BY count(b.file) DESC, a.file LIMIT 1),
h AS (SELECT v.* FROM v, p WHERE v.level > 1 AND v.first <= p.last AND v.last >= p.first), d AS (SELECT count(*) = 0 AS drop_tombstones FROM h WHERE level > 2)
SELECT file, level, role, drop_tombstones FROM (SELECT file, 1 AS level, 'input' AS role FROM p UNION ALL SELECT file, level, 'target' FROM h WHERE level = 2), d"""
)
def compaction_pick(spark, d):
    """Files that compacting level 1 merges."""
    orders = table(spark, d, "orders")
    files = lambda df, letter, width, level: df.groupBy(F.concat(F.lit(letter), F.floor(F.col("o_orderkey") / width).cast("string")).alias("file")).agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last")).withColumn("level", F.lit(level))
    every = files(orders, "b", 900, 1).unionByName(files(orders.where("o_orderkey % 9 < 7"), "c", 250, 2)).unionByName(files(orders.where("o_orderkey > 4000"), "e", 5000, 3))
    return versioned.compaction(every, 1, 1000)


QUERIES, ORACLES = R.queries, R.oracles
