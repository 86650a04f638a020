"""Queries over JSON-like documents, paths, base-64 numbers and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltmark.functions import paths, ron64
from siltmark.operators import documents
from siltmark.plans.registry import Registry
from siltmark.sources.tables import PAGE_PATHS_SQL, page_paths, table

R = Registry()


def _nested(spark, d):
    inner = F.struct(F.col("event_type").alias("c"), F.array(F.col("user_id").cast("string"), (F.col("user_id") % 3).cast("string")).alias("d"))
    return table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("a"), inner.alias("b"), (F.col("event_id") % 2 == 0).alias("e"), F.from_json("props", "k bigint").alias("props"))).alias("doc"))


@R.query(
    """SELECT event_id, unnest(['a', 'b/c', 'b/d/0', 'b/d/1', 'e', 'props/k']) AS path, unnest(['number', 'string', 'string', 'string', 'boolean', 'number']) AS type,
unnest([CAST(event_id AS VARCHAR), event_type, CAST(user_id AS VARCHAR), CAST(user_id % 3 AS VARCHAR), CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, json_extract_string(props, '$.k')]) AS value FROM events"""
)
def json_flatten(spark, d):
    return documents.flatten_json(_nested(spark, d), "event_id", "doc")


@R.query(
    """SELECT event_id, '{"a":' || event_id || ',"b":{"c":"' || event_type || '","d":["' || user_id || '","' || user_id % 3 || '"]},"e":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"props":{"k":' || json_extract_string(props, '$.k') || '}}' AS json FROM events"""
)
def json_unflatten(spark, d):
    """Documents rebuilt from their leaves."""
    return documents.unflatten(documents.flatten_json(_nested(spark, d), "event_id", "doc"), "event_id")


@R.query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def json_field_sum(spark, d):
    rows = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


_ALPHABET = ron64.DIGITS


@R.query(
    f"""SELECT o_orderkey, code, CAST(o_orderkey AS BIGINT) AS back FROM (SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN '0' ELSE ltrim(array_to_string(list_transform([60, 54, 48, 42, 36, 30, 24, 18, 12, 6, 0], lambda k: substr('{_ALPHABET}', CAST((o_orderkey >> k) & 63 AS INTEGER) + 1, 1)), ''), '0') END AS code FROM orders)"""
)
def ron64_codes(spark, d):
    """Order keys in base 64, and back."""
    coded = table(spark, d, "orders").select("o_orderkey", ron64.encode(F.col("o_orderkey")).alias("code"))
    return coded.withColumn("back", ron64.decode(F.col("code")))


@R.query(
    f"""WITH {PAGE_PATHS_SQL} SELECT page_id, array_to_string(list_filter(string_split(path, '/'), lambda s: s <> ''), '/') AS joined, len(list_filter(string_split(path, '/'), lambda s: s <> '')) AS n,
regexp_extract(path, '^(.*)/', 1) AS parent, regexp_extract(path, '([^/]*)$', 1) AS basename, NOT regexp_matches(path, '^/|/$|//') AS canonical FROM page_paths"""
)
def path_functions(spark, d):
    p = F.col("path")
    return page_paths(spark, d).select("page_id", paths.join(paths.split(p)).alias("joined"), F.size(paths.split(p)).cast("bigint").alias("n"), paths.parent(p).alias("parent"), paths.basename(p).alias("basename"), paths.canonical(p).alias("canonical"))


@R.query(
    f"""WITH {PAGE_PATHS_SQL}, l AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'boolean' WHEN 2 THEN 'index' ELSE 'string' END AS kind, CASE page_id % 3 WHEN 0 THEN '0' || page_id ELSE CAST(page_id AS VARCHAR) END AS value, path FROM page_paths)
SELECT page_id, (CASE WHEN kind = 'number' AND NOT regexp_matches(value, '^(0|-?[1-9][0-9]*|-?(0|[1-9][0-9]*)\\.[0-9]+)$') THEN 2 ELSE 0 END) + (CASE WHEN kind = 'boolean' AND value NOT IN ('true', 'false', '') THEN 128 ELSE 0 END)
 + (CASE WHEN kind = 'index' AND NOT regexp_matches(value, '^(0|[^0].*)$') THEN 256 ELSE 0 END) + (CASE WHEN regexp_matches(path, '^/|/$|//') THEN 512 ELSE 0 END) AS violations FROM l"""
)
def strictness(spark, d):
    k = F.col("page_id")
    kind = F.when(k % 4 == 0, "number").when(k % 4 == 1, "boolean").when(k % 4 == 2, "index").otherwise("string")
    value = F.when(k % 3 == 0, F.concat(F.lit("0"), k.cast("string"))).otherwise(k.cast("string"))
    return page_paths(spark, d).select("page_id", documents.violations(kind, value, F.col("path"), value).alias("violations"))


@R.query(
    """WITH c AS (SELECT user_id AS parent, event_id AS place, CAST(event_id % 10 AS VARCHAR) AS name FROM events), l AS (SELECT *, lag(name) OVER (PARTITION BY parent ORDER BY place) AS b FROM c)
SELECT parent, count(*) - count(DISTINCT name) AS repeated, count(*) FILTER (WHERE b >= name) AS unsorted, min(CAST(name AS BIGINT)) = 0 AND max(CAST(name AS BIGINT)) = count(*) - 1 AND count(DISTINCT name) = count(*) AS contiguous FROM l GROUP BY parent"""
)
def strictness_order(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("parent"), F.col("event_id").alias("place"), (F.col("event_id") % 10).cast("string").alias("name"))
    return documents.order_violations(rows, "parent", "place", "name")


_U32 = "lpad(to_hex({n} & 255), 2, '0') || lpad(to_hex(({n} >> 8) & 255), 2, '0') || lpad(to_hex(({n} >> 16) & 255), 2, '0') || lpad(to_hex(({n} >> 24) & 255), 2, '0')"
_RECORD_SQL = f"""CASE WHEN strlen(p_name) <= 15 AND strlen(p_type) <= 15 THEN '73' || lpad(to_hex(strlen(p_type) * 16 + strlen(p_name)), 2, '0')
ELSE '53' || {_U32.format(n="strlen(p_name)")} || lpad(to_hex(strlen(p_type)), 2, '0') END || hex(encode(p_type)) || hex(encode(p_name))"""


@R.query(f"SELECT p_partkey, lower({_RECORD_SQL}) AS record, p_type AS key, p_name AS value FROM part")
def leaf_records(spark, d):
    """Leaf records of parts, short and long, and what decoding them gives."""
    coded = table(spark, d, "part").select("p_partkey", documents.encode_leaf(F.lit("s"), F.col("p_type"), F.col("p_name")).alias("r"))
    _, key, value = documents.decode_leaf(F.col("r"))
    return coded.select("p_partkey", F.lower(F.hex("r")).alias("record"), key.alias("key"), value.alias("value"))


@R.query("SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) - 1 AS place, CASE WHEN strlen(p_name) <= 15 AND strlen(p_type) <= 15 THEN 's' ELSE 'S' END AS tag, p_type AS key, p_name AS value FROM part")
def record_stream(spark, d):
    """Records one after the other, decoded again."""
    coded = table(spark, d, "part").select("p_brand", "p_size", "p_partkey", F.hex(documents.encode_leaf(F.lit("s"), F.col("p_type"), F.col("p_name"))).alias("r"))
    streams = coded.groupBy("p_brand", "p_size").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "r"))), lambda x: x["r"]), "")).alias("s"))
    return streams.select("p_brand", "p_size", F.posexplode(documents.decode_records(F.col("s"))).alias("place", "x")).select("p_brand", "p_size", F.col("place").cast("bigint").alias("place"), "x.tag", "x.key", "x.value")


_CUT = "encode(coalesce(text, ''))[1:(doc_id % 40)]"


@R.query(
    f"""WITH b AS (SELECT doc_id, encode(lang || '/' || source) AS k, {_CUT} AS v FROM documents), x AS (SELECT doc_id, (CASE WHEN octet_length(k) > 15 OR octet_length(v) > 15 THEN 1 ELSE 0 END) + (CASE WHEN try(decode(v)) IS NULL THEN 4 ELSE 0 END) AS found FROM b)
SELECT doc_id, found, found & 1 = 0 AS is_short, found & 4 = 0 AS is_utf8, found & 5 = 0 AS is_valid FROM x"""
)
def strictness_bytes(spark, d):
    """Shortest form and UTF-8 of leaves whose value is the first bytes of a text, cut where they are cut; and masks."""
    v = F.call_function("substring", F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.lit(1), (F.col("doc_id") % 40).cast("int"))
    found = documents.byte_violations(F.encode(F.concat_ws("/", "lang", "source"), "UTF-8"), v)
    out = table(spark, d, "documents").select("doc_id", found.alias("found"))
    return out.select("doc_id", "found", *[documents.valid(F.col("found"), m).alias(n) for m, n in ((1, "is_short"), (4, "is_utf8"), (5, "is_valid"))])


@R.query("SELECT event_id, event_id % 3 = 0 AS mixed FROM events")
def strictness_mixed(spark, d):
    """Documents that nest containers and have keys that are paths."""
    inner = F.struct(F.col("user_id").alias("b"))
    doc = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(inner.alias("a"), F.array(F.struct(F.col("event_type").alias("x/y"))).alias("list")))).otherwise(F.to_json(F.struct(inner.alias("a"), F.lit("x/y").alias("c"))))
    return documents.mixed_paths(table(spark, d, "events").select("event_id", doc.alias("doc")), "event_id", "doc")


@R.query("SELECT event_id, '{\"a\":' || repeat('[{\"b\":', 1 + event_id % 5) || event_id || repeat('}]', 1 + event_id % 5) || '}' AS json FROM events")
def json_deep(spark, d):
    """Documents of up to 11 levels, taken apart and put together."""
    n = (1 + F.col("event_id") % 5).cast("int")
    doc = F.concat(F.lit('{"a":'), F.expr("repeat('[{\"b\":', cast(1 + event_id % 5 as int))"), F.col("event_id").cast("string"), F.repeat(F.lit("}]"), n), F.lit("}"))
    docs = table(spark, d, "events").select("event_id", doc.alias("doc"))
    return documents.unflatten(documents.flatten_json(docs, "event_id", "doc"), "event_id")


_LEAVES = "a AS (SELECT p_partkey AS k, p_name AS value FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN p_name || '*' ELSE p_name END AS value FROM part WHERE p_partkey % 3 <> 0)"


def _leaves(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("value"))
    b = part.where("k % 3 <> 0").withColumn("value", F.when(F.col("k") % 7 == 0, F.concat("value", F.lit("*"))).otherwise(F.col("value")))
    return part.where("k % 5 <> 0"), b


@R.query(f"WITH {_LEAVES} SELECT k, b.value FROM a FULL JOIN b USING (k) WHERE a.value IS DISTINCT FROM b.value")
def document_patch(spark, d):
    return documents.patch(*_leaves(spark, d), "k")


@R.query(
    f"""WITH {_LEAVES}, p AS (SELECT k, b.value FROM a FULL JOIN b USING (k) WHERE a.value IS DISTINCT FROM b.value), q AS (SELECT * FROM a WHERE k NOT IN (SELECT k FROM p) UNION ALL SELECT * FROM p WHERE value IS NOT NULL)
SELECT NOT EXISTS (FROM q EXCEPT ALL FROM b) AND NOT EXISTS (FROM b EXCEPT ALL FROM q) AS same_after, NOT EXISTS (FROM a EXCEPT ALL FROM b) AND NOT EXISTS (FROM b EXCEPT ALL FROM a) AS same_before"""
)
def document_equal(spark, d):
    """Patching one document into another makes them equal; they were not before."""
    a, b = _leaves(spark, d)
    patched = documents.apply_patch(a, documents.patch(a, b, "k"), "k")
    return documents.same(patched, b).withColumnRenamed("same", "same_after").crossJoin(F.broadcast(documents.same(a, b).withColumnRenamed("same", "same_before")))


@R.query(
    """WITH t AS (SELECT user_id AS account, event_id, CASE WHEN event_type IN ('signup', 'purchase') THEN 1 ELSE -1 END * (event_id % 20) AS amount FROM events), r AS (SELECT *, sum(amount) OVER (PARTITION BY account ORDER BY event_id) AS balance FROM t)
SELECT account, CAST(arg_max(balance, event_id) AS BIGINT) AS balance, min(balance) >= 0 AS valid FROM r GROUP BY account"""
)
def ledger_balances(spark, d):
    sign = F.when(F.col("event_type").isin("signup", "purchase"), 1).otherwise(-1)
    rows = table(spark, d, "events").select(F.col("user_id").alias("account"), "event_id", (sign * (F.col("event_id") % 20)).alias("amount"))
    return documents.balances(rows, "account", "event_id", "amount")


@R.query(
    """WITH e AS (SELECT user_id AS k, event_type AS path, event_id % 60 AS rev, CASE WHEN event_id % 8 = 0 THEN NULL ELSE CAST(round(value * 10) AS BIGINT) END AS value, event_id FROM events),
w AS (SELECT k, path, max(struct_pack(rev := rev, has := value IS NOT NULL, value := value)) AS w FROM e GROUP BY ALL) SELECT k, path, w.rev AS rev, w.value AS value FROM w WHERE w.value IS NOT NULL"""
)
def document_merge(spark, d):
    """Two halves of every document's changes, merged path by path."""
    e = F.col("event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("path"), (e % 60).alias("rev"), F.when(e % 8 != 0, F.round(F.col("value") * 10).cast("bigint")).alias("value"), "event_id")
    return documents.merged(rows.where("event_id % 3 = 0"), rows.where("event_id % 3 <> 0"), "k", "path")


@R.query(
    """WITH RECURSIVE b AS (SELECT event_id AS child, CASE WHEN event_id % 100 > 0 THEN event_id - least(event_id % 100, 1 + event_id % 100 % 3) WHEN event_id % 1000 = 0 THEN -7 END AS parent FROM events),
h AS (SELECT child AS version, 0::BIGINT AS height FROM b WHERE parent IS NULL OR parent NOT IN (SELECT child FROM b) UNION ALL SELECT b.child, height + 1 FROM h JOIN b ON b.parent = h.version),
t AS (SELECT arg_max(version, struct_pack(h := height, v := version)) AS version FROM h), c AS (SELECT version FROM t UNION SELECT b.parent FROM c JOIN b ON b.child = c.version WHERE b.parent IS NOT NULL)
SELECT version, height FROM h WHERE version IN (FROM c)"""
)
def longest_branch(spark, d):
    """Blocks of the longest of many branching chains."""
    e = F.col("event_id")
    blocks = table(spark, d, "events").select(e.alias("child"), F.when(e % 100 > 0, e - F.least(e % 100, 1 + e % 100 % 3)).when(e % 1000 == 0, -7).alias("parent"))
    return documents.longest_branch(blocks)


QUERIES, ORACLES = R.queries, R.oracles
