"""Adapters: the stored tables seen as a versioned log, a change history, mergeable operations and so on.

Every adapter is a lazy DataFrame; column pruning and filters reach the parquet scan through it. The *_SQL strings
define the same views for DuckDB, as items of a WITH list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned key-value log: key, offset (unique, grows with time), value, is_tombstone, kind."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("key"),
        F.col("event_id").alias("offset"),
        "value",
        (F.col("event_type") == "error").alias("is_tombstone"),
        F.col("event_type").alias("kind"),
    )


KV_LOG_SQL = "kv_log AS (SELECT 'user/' || user_id AS key, event_id AS \"offset\", value, event_type = 'error' AS is_tombstone, event_type AS kind FROM events)"


def crdt_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mergeable operations: obj, field, rev (negative: removed), src, val. Revisions collide on purpose."""
    rev = F.col("event_id") % 50 + 1
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("obj"),
        F.col("event_type").alias("field"),
        F.when(F.col("event_id") % 11 == 0, -rev).otherwise(rev).alias("rev"),
        (F.col("event_id") % 7).alias("src"),
        F.round(F.col("value") * 100).cast("bigint").alias("val"),
    )


CRDT_OPS_SQL = """crdt_ops AS (SELECT user_id AS obj, event_type AS field, CASE WHEN event_id % 11 = 0 THEN -(event_id % 50 + 1) ELSE event_id % 50 + 1 END AS rev,
event_id % 7 AS src, CAST(round(value * 100) AS BIGINT) AS val FROM events)"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet log with gaps: src, seq (from 0 in each source), event_id. One packet in thirteen is missing."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("event_id")
    numbered = table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), (F.row_number().over(order) - 1).cast("bigint").alias("seq"), "event_id")
    return numbered.where("event_id % 13 <> 0")


PACKETS_SQL = "packets AS (SELECT * FROM (SELECT user_id AS src, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_id FROM events) WHERE event_id % 13 <> 0)"


def numstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change history: commit, author, email, path, added, deleted, ts. Binary changes have no counts."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_name")
    binary = F.col("l_orderkey") % 29 == 0
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey)
    author = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    return joined.select(
        F.col("l_orderkey").alias("commit"),
        author.alias("author"),
        F.when(F.col("o_custkey") % 17 == 0, author).otherwise(F.concat(author, F.lit("@Org"), (F.col("o_custkey") % 9).cast("string"), F.lit(".example "))).alias("email"),
        F.when(F.col("p_partkey") % 23 == 0, F.col("p_brand")).otherwise(F.concat_ws("/", "p_type", "p_brand", F.regexp_replace("p_name", " ", "_"))).alias("path"),
        F.when(~binary, F.col("l_quantity").cast("int").cast("bigint")).alias("added"),
        F.when(~binary, F.col("l_linenumber").cast("bigint")).alias("deleted"),
        F.col("o_orderdate").alias("ts"),
    )


NUMSTAT_SQL = """numstat AS (SELECT l_orderkey AS "commit", 'c' || o_custkey AS author, CASE WHEN o_custkey % 17 = 0 THEN 'c' || o_custkey ELSE 'c' || o_custkey || '@Org' || o_custkey % 9 || '.example ' END AS email,
CASE WHEN p_partkey % 23 = 0 THEN p_brand ELSE p_type || '/' || p_brand || '/' || replace(p_name, ' ', '_') END AS path,
CASE WHEN l_orderkey % 29 <> 0 THEN CAST(trunc(l_quantity) AS BIGINT) END AS added, CASE WHEN l_orderkey % 29 <> 0 THEN CAST(l_linenumber AS BIGINT) END AS deleted, o_orderdate AS ts
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log documents: id, ts, level, source, message."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        "ts",
        F.col("event_type").alias("level"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 10).cast("string")).alias("source"),
        F.concat(F.lit("User-"), F.col("user_id").cast("string"), F.lit(" sent "), F.col("props")).alias("message"),
    )


LOGS_SQL = "logs AS (SELECT event_id AS id, ts, event_type AS level, 'svc-' || user_id % 10 AS source, 'User-' || user_id || ' sent ' || props AS message FROM events)"


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of page addresses without host, query and fragment: page_id, path."""
    path = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


PAGE_PATHS_SQL = "page_paths AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)"


def part_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a content tree: path (type/brand/key), content."""
    return table(spark, sf_dir, "part").select(F.concat_ws("/", F.regexp_replace("p_type", " ", "_"), "p_brand", F.concat(F.lit("p"), F.col("p_partkey").cast("string"))).alias("path"), F.concat_ws(":", "p_name", F.col("p_size").cast("string")).alias("content"))


PART_TREE_SQL = "part_tree AS (SELECT replace(p_type, ' ', '_') || '/' || p_brand || '/p' || p_partkey AS path, p_name || ':' || p_size AS content FROM part)"
