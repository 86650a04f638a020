"""Queries over a typed keyspace: counters, texts, lists, maps, expiry, patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltmark.functions import paths, slices
from siltmark.operators import keyspace, versioned
from siltmark.plans.registry import Registry
from siltmark.sources.tables import KV_LOG_SQL, kv_log, table

R = Registry()
_NOW = "TIMESTAMP '2024-02-01 00:00:00'"


@R.query(
    """WITH c AS (SELECT user_id AS key, event_id AS seq, event_type = 'signup' AS is_set, event_id % 100 AS n FROM events WHERE event_type IN ('signup', 'view', 'click')),
s AS (SELECT key, max(seq) AS seq, arg_max(n, seq) AS n FROM c WHERE is_set GROUP BY key), k AS (SELECT DISTINCT key FROM c)
SELECT k.key, CAST(coalesce(any_value(s.n), 0) + coalesce(sum(c.n), 0) AS BIGINT) AS value FROM k LEFT JOIN s ON s.key = k.key LEFT JOIN c ON c.key = k.key AND NOT is_set AND (s.seq IS NULL OR c.seq > s.seq) GROUP BY k.key"""
)
def ks_counter(spark, d):
    events = table(spark, d, "events").where("event_type in ('signup', 'view', 'click')")
    cmd = F.when(F.col("event_type") == "signup", "SET").otherwise("INCR")
    return keyspace.counters(events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), cmd.alias("cmd"), (F.col("event_id") % 100).alias("n")))


@R.query("SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn, text) AS value, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM conversations GROUP BY conv_id")
def ks_append(spark, d):
    out = keyspace.appended(table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text")
    return out.withColumn("n_bytes", F.octet_length("value").cast("bigint"))


@R.query(
    """SELECT p_partkey, substr(p_name, 3, 5) AS middle, right(p_name, 4) AS tail, substr(p_name, 1, greatest(strlen(p_name) - 2, 0)) AS head, '' AS none FROM part"""
)
def ks_getrange(spark, d):
    """Inclusive byte ranges with negative ends; part names are ASCII, so the SQL may count characters."""
    text = lambda a, b: F.decode(slices.byte_range(F.col("p_name"), a, b), "UTF-8")
    return table(spark, d, "part").select("p_partkey", text(2, 6).alias("middle"), text(-4, -1).alias("tail"), text(0, -3).alias("head"), text(5, 2).alias("none"))


_LISTS_SQL = "l AS (SELECT user_id, list(event_id ORDER BY event_id) AS a FROM events GROUP BY user_id)"


def _lists(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("a"))


@R.query(f"WITH {_LISTS_SQL} SELECT user_id, array_to_string(a[2:4], ',') AS some, array_to_string(list_slice(a, greatest(len(a) - 2, 1), len(a)), ',') AS last3, len(a[1000:1004]) AS beyond FROM l")
def ks_lrange(spark, d):
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    a = F.col("a")
    return _lists(spark, d).select("user_id", text(slices.array_range(a, 1, 3)).alias("some"), text(slices.array_range(a, -3, -1)).alias("last3"), F.size(slices.array_range(a, 999, 1003)).cast("bigint").alias("beyond"))


@R.query(f"WITH {_LISTS_SQL} SELECT user_id, a[1] AS first, a[len(a)] AS last, a[51] AS at50, len(a) AS n FROM l")
def ks_lindex(spark, d):
    a = F.col("a")
    return _lists(spark, d).select("user_id", slices.array_at(a, 0).alias("first"), slices.array_at(a, -1).alias("last"), slices.array_at(a, 50).alias("at50"), F.size(a).cast("bigint").alias("n"))


@R.query(
    """WITH RECURSIVE c AS (SELECT user_id AS key, event_id AS item, event_type AS cmd, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE event_type <> 'error'),
f AS (SELECT key, 0::BIGINT AS i, []::BIGINT[] AS a FROM (SELECT DISTINCT key FROM c) UNION ALL
SELECT f.key, c.i, CASE cmd WHEN 'click' THEN list_prepend(item, a) WHEN 'view' THEN list_append(a, item) WHEN 'signup' THEN a[2:] ELSE a[:-2] END FROM f JOIN c ON c.key = f.key AND c.i = f.i + 1)
SELECT key, array_to_string(arg_max(a, i), ',') AS items FROM f GROUP BY key"""
)
def ks_push_pop(spark, d):
    """Lists after pushes at both ends and pops from both ends, in order."""
    cmd = F.when(F.col("event_type") == "click", "LPUSH").when(F.col("event_type") == "view", "RPUSH").when(F.col("event_type") == "signup", "LPOP").otherwise("RPOP")
    commands = table(spark, d, "events").where("event_type <> 'error'").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), cmd.alias("cmd"), F.col("event_id").alias("item"))
    return keyspace.fold_list(commands).select("key", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@R.query(
    """SELECT user_id AS key, 'f' || event_id % 5 AS field, arg_max(value, event_id) AS value FROM events GROUP BY ALL HAVING arg_max(event_type, event_id) <> 'error'"""
)
def ks_hash_fields(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), F.concat(F.lit("f"), (F.col("event_id") % 5).cast("string")).alias("field"), F.col("event_id").alias("seq"), "value", (F.col("event_type") == "error").alias("gone"))
    return keyspace.fields(rows)


@R.query(
    """WITH f AS (SELECT user_id AS key, event_id % 5 AS field, max(event_id) AS v FROM events GROUP BY ALL)
SELECT key, count(*) AS n, string_agg(field, ',' ORDER BY field) AS names, string_agg(v, ',' ORDER BY field) AS vals, max(v) FILTER (WHERE field = 3) AS f3 FROM f GROUP BY key"""
)
def ks_hash_read(spark, d):
    """Maps of latest fields: size, names, values, one field."""
    latest = table(spark, d, "events").groupBy(F.col("user_id").alias("key"), (F.col("event_id") % 5).alias("field")).agg(F.max("event_id").alias("v"))
    m = latest.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "v")))).alias("m"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return m.select("key", F.size("m").cast("bigint").alias("n"), text(F.map_keys("m")).alias("names"), text(F.map_values("m")).alias("vals"), F.try_element_at("m", F.lit(3).cast("bigint")).alias("f3"))


@R.query(
    f"""WITH k AS (SELECT user_id AS key, date_trunc('second', max(ts)) AS set_at, CASE WHEN user_id % 3 <> 0 THEN (user_id % 40) * 86400000 END AS ttl_ms FROM events GROUP BY user_id)
SELECT key, CAST(CASE WHEN ttl_ms IS NULL THEN -1 WHEN ttl_ms - (epoch_ms({_NOW}) - epoch_ms(set_at)) <= 0 THEN -2 ELSE ttl_ms - (epoch_ms({_NOW}) - epoch_ms(set_at)) END AS BIGINT) AS ttl FROM k"""
)
def ks_ttl(spark, d):
    keys = table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.date_trunc("second", F.max("ts").cast("timestamp")).alias("set_at"))
    keys = keys.withColumn("ttl_ms", F.when(F.col("key") % 3 != 0, (F.col("key") % 40) * 86_400_000))
    return keyspace.ttl(keys, F.expr(_NOW))


_KEYS_SQL = f"""k AS (SELECT 'user/' || user_id AS key, date_trunc('second', max(ts)) AS set_at, CASE WHEN user_id % 3 <> 0 THEN (user_id % 40) * 86400000 END AS ttl_ms, arg_max(value, event_id) AS value, ['string', 'list', 'hash'][1 + user_id % 3] AS type FROM events GROUP BY user_id),
a AS (SELECT *, ttl_ms IS NULL OR ttl_ms - (epoch_ms({_NOW}) - epoch_ms(set_at)) > 0 AS alive FROM k)"""


def _keys(spark, d):
    """Keys with the time they were set, the milliseconds they last, their latest value and type."""
    user = F.col("user_id")
    keys = table(spark, d, "events").groupBy("user_id").agg(F.date_trunc("second", F.max("ts").cast("timestamp")).alias("set_at"), F.max_by("value", "event_id").alias("value"))
    kinds = F.array(F.lit("string"), F.lit("list"), F.lit("hash"))
    return keys.select(F.concat(F.lit("user/"), user.cast("string")).alias("key"), "set_at", F.when(user % 3 != 0, (user % 40) * 86_400_000).alias("ttl_ms"), "value", F.element_at(kinds, (user % 3 + 1).cast("int")).alias("type"))


def _wanted(spark, d):
    return table(spark, d, "customer").select(F.concat(F.lit("user/"), F.col("c_custkey").cast("string")).alias("key"))


@R.query(f"WITH {_KEYS_SQL} SELECT w.key, a.value, a.key IS NOT NULL AS found FROM (SELECT 'user/' || c_custkey AS key FROM customer) w LEFT JOIN a ON a.key = w.key AND alive")
def ks_get(spark, d):
    """Values of wanted keys; expired ones are missing."""
    return keyspace.lookup(_keys(spark, d), _wanted(spark, d), F.expr(_NOW), "value")


@R.query(f"WITH {_KEYS_SQL} SELECT w.key, coalesce(a.type, 'none') AS type FROM (SELECT 'user/' || c_custkey AS key FROM customer) w LEFT JOIN a ON a.key = w.key AND alive")
def ks_type(spark, d):
    found = keyspace.lookup(_keys(spark, d), _wanted(spark, d), F.expr(_NOW), "type")
    return found.select("key", F.coalesce("type", F.lit("none")).alias("type"))


@R.query(f"WITH {_KEYS_SQL} SELECT key FROM a WHERE alive AND key GLOB 'user/1?*'")
def ks_keys_alive(spark, d):
    """Keys that match a pattern and have not expired."""
    return keyspace.unexpired(_keys(spark, d), F.expr(_NOW)).where(paths.glob(F.col("key"), "user/1?*")).select("key")


@R.query(f"WITH {_KEYS_SQL} SELECT key, CASE WHEN alive THEN 'kept' ELSE 'swept' END AS state FROM a")
def ks_sweep(spark, d):
    kept, swept = keyspace.sweep(_keys(spark, d), F.expr(_NOW))
    return kept.select("key", F.lit("kept").alias("state")).unionByName(swept.select("key", F.lit("swept").alias("state")))


@R.query("SELECT p_partkey, p_name FROM part WHERE p_name GLOB 's*l ?i*' OR p_name GLOB '*? gear'")
def ks_glob(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    return part.where(paths.glob(F.col("p_name"), "s*l ?i*") | paths.glob(F.col("p_name"), "*? gear"))


@R.query("SELECT key FROM (SELECT DISTINCT 'user/' || user_id AS key FROM events) WHERE key GLOB 'user/1?*'")
def ks_keys(spark, d):
    keys = kv_log(spark, d).select("key").distinct()
    return keys.where(paths.glob(F.col("key"), "user/1?*"))


@R.query("SELECT p_partkey, strlen(p_name) AS n_bytes FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def ks_exists(spark, d):
    """Existing keys (those in use) with the byte length of their text."""
    used = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(used, "p_partkey", "left_semi").select("p_partkey", F.octet_length("p_name").cast("bigint").alias("n_bytes"))


@R.query(f"WITH {KV_LOG_SQL}, l AS (SELECT key, arg_max(is_tombstone, \"offset\") AS gone FROM kv_log GROUP BY key) SELECT count(*) AS n_all, count(*) FILTER (WHERE NOT gone) AS n_live FROM l")
def ks_dbsize(spark, d):
    """Keys with and without those that are deleted but not swept."""
    log = kv_log(spark, d)
    live = versioned.latest(log).agg(F.count("*").alias("n_live"))
    return log.agg(F.count_distinct("key").alias("n_all")).crossJoin(F.broadcast(live))


QUERIES, ORACLES = R.queries, R.oracles
