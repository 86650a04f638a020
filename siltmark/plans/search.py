"""Queries over log documents and their inverted indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltmark.functions.tokens import tokens
from siltmark.operators import search
from siltmark.plans.registry import Registry
from siltmark.sources.tables import LOGS_SQL, logs, table

R = Registry()
_TOKENS = "list_sort(list_distinct(list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}_-]+'), lambda t: t <> '')))"
_POSTINGS = f"""{LOGS_SQL}, post AS (SELECT 'day' AS "index", CAST(CAST(ts AS DATE) AS VARCHAR) AS key, id FROM logs UNION ALL SELECT 'level', level, id FROM logs UNION ALL SELECT 'source', source, id FROM logs
UNION ALL SELECT 'term', unnest({_TOKENS.format("message || ' ' || source || ' ' || level")}), id FROM logs)"""


@R.query(f"SELECT doc_id, array_to_string({_TOKENS.format('text')}, ' ') AS tokens, len({_TOKENS.format('text')}) AS n FROM documents")
def log_tokens(spark, d):
    docs = table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("bigint").alias("n"))


@R.query(f"WITH {_POSTINGS} SELECT \"index\", key, count(DISTINCT id) AS n, min(id) AS first_id, max(id) AS last_id FROM post GROUP BY ALL")
def log_index(spark, d):
    return search.buckets(search.postings(logs(spark, d)))


@R.query(f"WITH {_POSTINGS} SELECT \"index\", count(DISTINCT key) AS n_buckets, count(*) AS n_entries FROM post GROUP BY 1")
def log_manifest(spark, d):
    return search.postings(logs(spark, d)).groupBy("index").agg(F.count_distinct("key").alias("n_buckets"), F.count("*").alias("n_entries"))


@R.query(f"WITH {_POSTINGS} SELECT \"index\", key, count(DISTINCT id) AS n, min(id) AS first_id, max(id) AS last_id FROM post WHERE id % 10 <> 3 GROUP BY ALL")
def log_index_increment(spark, d):
    """The index after one more batch of logs and the removal of some.

    The first nine tenths of the ids are indexed; the batch starts a hundredth earlier, so some of it is known, and
    goes to the end.
    """
    all_logs = logs(spark, d)
    marked = all_logs.crossJoin(F.broadcast(all_logs.agg(F.max("id").alias("_last"))))
    old, batch = marked.where("id * 10 < _last * 9").drop("_last"), marked.where("id * 100 >= _last * 89").drop("_last")
    index = search.add(search.postings(old), search.postings(batch), all_logs.where("id % 10 = 3").select("id"))
    return search.buckets(index)


@R.query(f"WITH {LOGS_SQL} SELECT id, ts, level, source, message FROM logs WHERE level = 'purchase' AND source = 'svc-3' AND contains(lower(message), 'sent') AND regexp_matches(lower(message), '(^|[^\\p{{L}}\\p{{N}}_-])user-13($|[^\\p{{L}}\\p{{N}}_-])')")
def log_search(spark, d):
    all_logs = logs(spark, d)
    return search.search(all_logs, search.postings(all_logs), "User-13 sent", level="purchase", source="svc-3")


@R.query(f"WITH {LOGS_SQL} SELECT id, ts, level, source, message FROM logs WHERE level = 'click' AND CAST(ts AS DATE) = DATE '2024-01-07'")
def log_search_day(spark, d):
    all_logs = logs(spark, d)
    return search.search(all_logs, search.postings(all_logs), level="click", day="2024-01-07")


QUERIES, ORACLES = R.queries, R.oracles
