"""Queries over peers and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltmark.functions import paths
from siltmark.operators import history, swarm
from siltmark.plans.registry import Registry
from siltmark.sources.tables import table

R = Registry()
_PEERS = "peers AS (SELECT (event_id * 2654435761) % 4294967296 AS ip FROM events)"
_RANGES = "r AS (SELECT n_nationkey::BIGINT * 150000000 AS first, n_nationkey::BIGINT * 150000000 + 99999999 AS last, n_name AS name FROM nation UNION ALL SELECT n_nationkey::BIGINT * 150000000 + 5000000, n_nationkey::BIGINT * 150000000 + 5999999, n_name || '/city' FROM nation WHERE n_regionkey < 3)"


def _peers(spark, d):
    return table(spark, d, "events").select(((F.col("event_id") * 2654435761) % 4294967296).alias("ip"))


def _ranges(spark, d):
    nation = table(spark, d, "nation").withColumn("k", F.col("n_nationkey").cast("bigint") * 150_000_000)
    wide = nation.select(F.col("k").alias("first"), (F.col("k") + 99_999_999).alias("last"), F.col("n_name").alias("name"))
    return wide.unionByName(nation.where("n_regionkey < 3").select((F.col("k") + 5_000_000).alias("first"), (F.col("k") + 5_999_999).alias("last"), F.concat("n_name", F.lit("/city")).alias("name")))


@R.query(f"WITH {_PEERS} SELECT DISTINCT ip FROM peers WHERE NOT (ip // 16777216 IN (10, 127) OR ip // 1048576 = 2753 OR ip // 65536 = 49320 OR ip // 268435456 = 14)")
def ip_filter(spark, d):
    return _peers(spark, d).distinct().where(~swarm.is_special(F.col("ip")))


@R.query(f"WITH {_PEERS}, {_RANGES} SELECT ip, arg_min(name, last - first) AS name FROM (SELECT DISTINCT ip FROM peers) JOIN r ON ip BETWEEN first AND last GROUP BY ip")
def geo_join(spark, d):
    return swarm.locate(_peers(spark, d).distinct(), _ranges(spark, d))


@R.query(f"WITH {_PEERS}, {_RANGES}, l AS (SELECT ip, arg_min(name, last - first) AS name FROM (SELECT DISTINCT ip FROM peers) LEFT JOIN r ON ip BETWEEN first AND last GROUP BY ip) SELECT name, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM l), 4) AS percent FROM l WHERE name IS NOT NULL GROUP BY name")
def country_percent(spark, d):
    peers = _peers(spark, d).distinct()
    return swarm.shares(peers.join(swarm.locate(peers, _ranges(spark, d)), "ip", "left"), "name")


@R.query(
    """WITH c AS (SELECT n_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS rn FROM c)
SELECT CASE WHEN rn <= 8 THEN name ELSE '(other)' END AS name, CAST(sum(n) AS BIGINT) AS n, round(100.0 * sum(n) / (SELECT sum(n) FROM c), 4) AS percent FROM r GROUP BY 1"""
)
def share_topn(spark, d):
    counts = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return history.top_with_other(counts.select(F.col("n_name").alias("name"), "n"), "name", "n", 8)


@R.query(
    """WITH c AS (SELECT p_type AS row, split_part(trim(regexp_replace(p_name, '[/_]', ' ', 'g')), ' ', 1) AS client, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT client FROM c GROUP BY client ORDER BY sum(n) DESC, client LIMIT 6)
SELECT row, client, round(n / sum(n) OVER (PARTITION BY row), 6) AS share FROM c WHERE client IN (FROM t)"""
)
def client_matrix(spark, d):
    """Shares of the six commonest clients in each row, over those six."""
    counts = table(spark, d, "part").groupBy(F.col("p_type").alias("row"), swarm.client_name(F.col("p_name")).alias("client")).agg(F.count("*").alias("n"))
    top = counts.groupBy("client").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "client").limit(6).select("client")
    return swarm.row_shares(counts.join(F.broadcast(top), "client"), "row", "client", "n")


@R.query("SELECT c_nationkey AS tracker, round(avg(greatest(c_acctbal, 0)), 6) AS mean, round(median(greatest(c_acctbal, 0)), 6) AS median, max(greatest(c_acctbal, 0)) AS max, count(*) AS n FROM customer GROUP BY 1")
def swarm_stats(spark, d):
    """Statistics of each tracker's samples, differences below zero counted as zero."""
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("tracker"), F.greatest("c_acctbal", F.lit(0.0)).alias("v"))
    return swarm.sample_stats(rows, "tracker", "v")


@R.query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' -- ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", paths.slug(F.concat_ws(" -- ", "p_name", "p_brand")).alias("slug"))


_CHAIN_SQL = "c AS (SELECT s_suppkey AS peer, 1 AS step, sha256(s_name) AS hash FROM supplier UNION ALL SELECT peer, step + 1, sha256(hash) FROM c WHERE step < 5)"


@R.query(f"WITH RECURSIVE {_CHAIN_SQL} SELECT peer, CAST(step AS BIGINT) AS step, hash FROM c")
def route_chain(spark, d):
    return swarm.hash_chain(table(spark, d, "supplier").select(F.col("s_suppkey").alias("peer"), "s_name"), "s_name", 5).select("peer", "step", "hash")


@R.query(f"WITH RECURSIVE {_CHAIN_SQL}, a AS (SELECT peer AS announced, hash FROM c WHERE step = 1 + peer % 4) SELECT announced, c.peer, CAST(min(c.step) AS BIGINT) AS distance FROM a JOIN c USING (hash) GROUP BY ALL")
def route_match(spark, d):
    """Where an announced hash stands on a stored chain."""
    chain = route_chain(spark, d)
    announced = chain.where("step = 1 + peer % 4").select(F.col("peer").alias("announced"), "hash")
    return announced.join(chain, "hash").groupBy("announced", "peer").agg(F.min("step").alias("distance"))


@R.query("SELECT event_id, sha256('user' || user_id || strftime(date_trunc('hour', ts), '%Y-%m-%d %H')) AS key FROM events")
def hourly_key(spark, d):
    return table(spark, d, "events").select("event_id", swarm.hour_key(F.concat(F.lit("user"), F.col("user_id").cast("string")), F.col("ts")).alias("key"))


@R.query(
    f"""WITH RECURSIVE {_CHAIN_SQL}, m AS (SELECT peer * 10 + step AS id, hash FROM c WHERE (peer + step) % 3 <> 0 UNION ALL SELECT -peer, sha256('none' || peer) FROM c WHERE step = 1)
SELECT CAST(m.id AS BIGINT) AS id, k.peer, b.hash AS onward FROM m JOIN c k ON k.hash = m.hash LEFT JOIN c b ON b.peer = k.peer AND b.step = k.step - 1"""
)
def route_forward(spark, d):
    """Next peer of messages that name a hash of a chain, and the hash before it."""
    chain = route_chain(spark, d)
    messages = chain.where("(peer + step) % 3 <> 0").select((F.col("peer") * 10 + F.col("step")).alias("id"), "hash")
    messages = messages.unionByName(chain.where("step = 1").select((-F.col("peer")).alias("id"), F.sha2(F.concat(F.lit("none"), F.col("peer").cast("string")), 256).alias("hash")))
    return swarm.forward(chain, messages, 5)


@R.query(f"WITH RECURSIVE {_CHAIN_SQL} SELECT CAST(peer AS BIGINT) AS id FROM c WHERE step = 3 AND peer % 2 = 1 UNION ALL SELECT -CAST(peer AS BIGINT) FROM c WHERE step = 3 AND peer % 5 = 0")
def route_register(spark, d):
    """Announcements that are not of a longer path than one that is known, or of as long a one."""
    chain = route_chain(spark, d)
    near = chain.where("step = 3").select(F.col("peer").alias("id"), "hash", F.when(F.col("peer") % 2 == 1, 2).otherwise(4).cast("bigint").alias("step"))
    new = chain.where("step = 3 and peer % 5 = 0").select((-F.col("peer")).alias("id"), F.sha2(F.concat("hash", F.lit("x")), 256).alias("hash"), F.lit(9).cast("bigint").alias("step"))
    return swarm.announced(chain, near.unionByName(new)).select("id")


@R.query(
    """WITH f AS (SELECT source AS feed, count(*) AS files FROM documents GROUP BY 1), s AS (SELECT DISTINCT c_nationkey AS reader, 'src' || c_custkey % 30 AS feed FROM customer)
SELECT reader, feed, coalesce(files, 0) AS files FROM s LEFT JOIN f USING (feed)"""
)
def feed_subscriptions(spark, d):
    """Feeds that readers subscribe to, with the number of files that are here."""
    files = table(spark, d, "documents").groupBy(F.col("source").alias("feed")).agg(F.count("*").alias("files"))
    wanted = table(spark, d, "customer").select(F.col("c_nationkey").alias("reader"), F.concat(F.lit("src"), (F.col("c_custkey") % 30).cast("string")).alias("feed")).distinct()
    return wanted.join(files, "feed", "left").select("reader", "feed", F.coalesce("files", F.lit(0)).alias("files"))


QUERIES, ORACLES = R.queries, R.oracles
