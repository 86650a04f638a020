"""Queries over record formats: what is written is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.functions import bencode
from siltmark.plans.registry import Registry
from siltmark.sources import formats
from siltmark.sources.tables import table

R = Registry()
_ROWS_SQL = """SELECT c_custkey, c_name AS name, 'u' || c_custkey AS login, substr(c_mktsegment, 1, 8) AS grp, c_custkey % 2 || ',' || c_custkey % 3 % 2 || ',1,0,0,1,0,1' AS practice,
'https://x.example/' || c_custkey AS repo, CAST(c_custkey % 11 AS INTEGER) AS project_mark, CAST(CAST(c_custkey % 101 AS FLOAT) / 8 AS DOUBLE) AS mark FROM customer"""


def _rows(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    practice = F.array((k % 2).cast("int"), (k % 3 % 2).cast("int"), *[F.lit(x) for x in (1, 0, 0, 1, 0, 1)])
    project = F.struct(F.concat(F.lit("https://x.example/"), k.cast("string")).alias("repo"), (k % 11).cast("int").alias("mark"))
    login, group = F.concat(F.lit("u"), k.cast("string")), F.substring("c_mktsegment", 1, 8)
    return table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), login.alias("login"), group.alias("grp"), practice.alias("practice"), project.alias("project"), ((k % 101).cast("float") / 8).cast("float").alias("mark"))


def _flat(rows: DataFrame, key: str = "c_custkey") -> DataFrame:
    practice = F.array_join(F.transform("practice", lambda x: x.cast("string")), ",")
    return rows.select(F.col(key).alias("c_custkey"), "name", "login", "grp", practice.alias("practice"), F.col("project.repo").alias("repo"), F.col("project.mark").alias("project_mark"), F.col("mark").cast("double").alias("mark"))


def _beside(rows: DataFrame) -> DataFrame:
    """The key, which these forms do not carry: the login holds it."""
    return rows.withColumn("c_custkey", F.expr("cast(substring(login, 2) as bigint)"))


@R.query(_ROWS_SQL)
def format_records(spark, d):
    """Fixed binary records."""
    return _flat(_beside(formats.parse_records(formats.write_records(_rows(spark, d)))))


@R.query(_ROWS_SQL)
def format_lines(spark, d):
    """One line for each leaf."""
    return _flat(formats.from_lines(formats.to_lines(_rows(spark, d), "c_custkey")), "place")


@R.query(_ROWS_SQL)
def format_json(spark, d):
    return _flat(_beside(formats.from_json(formats.to_json(_rows(spark, d)))))


@R.query(_ROWS_SQL)
def format_xml(spark, d):
    return _flat(_beside(formats.from_xml(formats.to_xml(_rows(spark, d)))))


@R.query(
    """SELECT '10.' || s_suppkey % 200 || '.0.' || s_suppkey % 250 AS ip, CASE WHEN s_suppkey % 7 <> 0 THEN n_name END AS country, CASE WHEN s_suppkey % 7 <> 0 THEN upper(substr(n_name, 1, 2)) END AS country_code, NULL::VARCHAR AS city,
CAST(s_suppkey % 90 AS DOUBLE) AS latitude, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 180 AS DOUBLE) / 4 END AS longitude, 64000 + s_suppkey AS asn, s_name AS aso FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
)
def peer_json(spark, d):
    """Enriched addresses written as JSON lines and read again."""
    k = F.col("s_suppkey")
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    known = lambda c, every: F.when(k % every != 0, c)
    ip = F.concat(F.lit("10."), (k % 200).cast("string"), F.lit(".0."), (k % 250).cast("string"))
    peers = table(spark, d, "supplier").join(nation, "s_nationkey").select(
        ip.alias("ip"), known(F.col("n_name"), 7).alias("country"), known(F.upper(F.substring("n_name", 1, 2)), 7).alias("country_code"), F.lit(None).cast("string").alias("city"),
        (k % 90).cast("double").alias("latitude"), known((k % 180).cast("double") / 4, 5).alias("longitude"), (k + 64_000).alias("asn"), F.col("s_name").alias("aso"),
    )
    return formats.parse_peers(formats.peer_lines(peers))


@R.query("SELECT event_id, event_id - 50 AS id, event_type AS type, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS second FROM events")
def bencode_fields(spark, d):
    """Fields of bencoded dictionaries; one in four has a list of one item only."""
    n = lambda c: F.concat(F.lit("i"), c.cast("string"), F.lit("e"))
    text = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    items = F.concat(F.lit("l"), n(F.col("event_id")), F.when(F.col("event_id") % 4 != 0, n(F.col("user_id"))).otherwise(""), F.lit("e"))
    whole = F.concat(F.lit("d2:id"), n(F.col("event_id") - 50), F.lit("4:list"), items, F.lit("4:type"), text(F.col("event_type")), F.lit("e"))
    found = table(spark, d, "events").select("event_id", bencode.to_json(F.encode(whole, "UTF-8")).alias("j"))
    at = lambda p, kind: F.get_json_object("j", p).cast(kind)
    return found.select("event_id", at("$.id", "bigint").alias("id"), at("$.type", "string").alias("type"), at("$.list[1]", "bigint").alias("second"))


QUERIES, ORACLES = R.queries, R.oracles
