"""Queries over change histories: contributors, churn, directories, co-change, concentration, grids, text patterns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltmark.functions import paths
from siltmark.operators import history
from siltmark.plans.registry import Registry
from siltmark.sources.tables import NUMSTAT_SQL, numstat, table

R = Registry()
_T = f"WITH {NUMSTAT_SQL}, t AS (SELECT *, added + deleted AS lines FROM numstat WHERE added IS NOT NULL)"
_CONTRIB = 'SELECT {by} AS name, count(DISTINCT "commit") AS commits, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted, CAST(sum(lines) AS BIGINT) AS total FROM t GROUP BY 1'
_ORG = "CASE WHEN instr(email, '@') = 0 OR trim(regexp_extract(email, '@(.*)$', 1)) = '' THEN 'unknown' ELSE lower(trim(regexp_extract(email, '@(.*)$', 1))) END"


@R.query(f"{_T}, c AS ({_CONTRIB.format(by='author')}) SELECT *, row_number() OVER (ORDER BY commits DESC, total DESC, name) AS rank FROM c ORDER BY rank LIMIT 100")
def contrib_top(spark, d):
    out = history.contributors(numstat(spark, d), F.col("author"))
    return history.top_n(out, 100, F.desc("commits"), F.desc("total"), F.col("name"))


@R.query(f"{_T} {_CONTRIB.format(by=_ORG)}")
def contrib_org(spark, d):
    return history.contributors(numstat(spark, d), paths.organisation(F.col("email")))


_RATIO = "CASE WHEN accumulated = 0 AND net = 0 THEN '-' WHEN net = 0 THEN 'inf' ELSE printf('%.2f', round(accumulated / net, 2)) END AS ratio"
_CHURN = "c AS (SELECT {key} AS key, CAST(sum(lines) AS BIGINT) AS accumulated, CAST(abs(sum(added - deleted)) AS BIGINT) AS net FROM t GROUP BY 1)"


@R.query(f"{_T}, {_CHURN.format(key='path')} SELECT key, accumulated, net, {_RATIO} FROM c ORDER BY accumulated DESC, key LIMIT 50")
def churn_file(spark, d):
    return history.churn(numstat(spark, d), F.col("path")).orderBy(F.desc("accumulated"), "key").limit(50)


@R.query(f"{_T}, {_CHURN.format(key="CASE WHEN instr(path, '/') = 0 THEN '(root)' ELSE string_split(path, '/')[1] END")} SELECT key, accumulated, net, {_RATIO} FROM c")
def churn_dir(spark, d):
    return history.churn(numstat(spark, d), paths.top_directory(F.col("path")))


@R.query(f"""{_T}, {_CHURN.format(key='path')} SELECT count(*) AS n_files, CAST(sum(accumulated) AS BIGINT) AS accumulated, CAST(sum(net) AS BIGINT) AS net, round(sum(accumulated) / sum(net), 6) AS ratio, arg_max(key, struct_pack(a := accumulated, b := key)) AS busiest,
(SELECT key FROM c WHERE net > 0 ORDER BY accumulated / net DESC, key LIMIT 1) AS worst FROM c""")
def churn_summary(spark, d):
    each = history.churn(numstat(spark, d), F.col("path"))
    return each.agg(F.count("*").alias("n_files"), F.sum("accumulated").alias("accumulated"), F.sum("net").alias("net"), F.round(F.sum("accumulated") / F.sum("net"), 6).alias("ratio"), F.max_by("key", F.struct("accumulated", "key")).alias("busiest"), F.min_by("key", F.struct((-F.col("accumulated") / F.nullif("net", F.lit(0))).alias("r"), F.col("key").alias("k"))).alias("worst"))


@R.query(
    f"""{_T}, q AS (SELECT path, quarter(ts) AS q, lines, added - deleted AS delta FROM t), h AS (SELECT DISTINCT path FROM q WHERE q = 4), a AS (SELECT path, sum(lines) AS s FROM q GROUP BY path),
f AS (SELECT path, sum(delta) AS s FROM q WHERE q = 1 GROUP BY path), m AS (SELECT path, sum(delta) AS s FROM q WHERE q = 2 GROUP BY path)
SELECT path, CAST(coalesce(a.s, 0) AS BIGINT) AS accumulated, CAST(abs(coalesce(f.s, 0)) AS BIGINT) AS first_net, CAST(abs(coalesce(m.s, 0)) AS BIGINT) AS middle_net FROM h LEFT JOIN a USING (path) LEFT JOIN f USING (path) LEFT JOIN m USING (path)"""
)
def churn_at_points(spark, d):
    """Paths of the last quarter with their sums over all time and over earlier quarters, missing ones 0."""
    rows = history.text_changes(numstat(spark, d)).select("path", F.quarter("ts").alias("q"), (F.col("added") + F.col("deleted")).alias("lines"), (F.col("added") - F.col("deleted")).alias("delta"))
    # one conditional aggregate in place of three joins over the same keys
    at = lambda q: F.abs(F.coalesce(F.sum(F.when(F.col("q") == q, F.col("delta"))), F.lit(0)))
    out = rows.groupBy("path").agg(F.sum("lines").alias("accumulated"), at(1).alias("first_net"), at(2).alias("middle_net"), F.max((F.col("q") == 4).cast("int")).alias("_head"))
    return out.where("_head = 1").drop("_head")


_DIR2 = "CASE WHEN instr(path, '/') = 0 THEN '(root)' ELSE array_to_string(list_slice(string_split(path, '/'), 1, least(2, len(string_split(path, '/')) - 1)), '/') || '/' END"


@R.query(
    f"""{_T}, c AS (SELECT {_DIR2} AS dir, CAST(sum(lines) AS BIGINT) AS lines FROM t GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY lines DESC, dir) AS rn FROM c)
SELECT CASE WHEN rn <= 10 THEN dir ELSE '(other)' END AS dir, CAST(sum(lines) AS BIGINT) AS lines, round(100.0 * sum(lines) / (SELECT sum(lines) FROM c), 4) AS percent FROM r GROUP BY 1"""
)
def dir_depth_topn_other(spark, d):
    return history.top_with_other(history.directory_counts(numstat(spark, d), 2).select("dir", "lines"), "dir", "lines", 10)


@R.query(
    """WITH u AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey = 7), o AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (FROM u) AND l_partkey <> 7)
SELECT l_partkey, count(*) AS together FROM o GROUP BY l_partkey ORDER BY together DESC, l_partkey LIMIT 5"""
)
def cochange_top(spark, d):
    return history.co_changed(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey", 7, 5)


def _has_sql(words) -> str:
    return "(" + " OR ".join(f"contains(m, '{w}')" for w in words) + ")"


_MESSAGE_SQL = "lower(CASE conv_id % 5 WHEN 0 THEN 'Merge branch ' WHEN 1 THEN 'Add ' WHEN 2 THEN 'Fix typo in ' WHEN 3 THEN 'clean up test of ' ELSE '' END || coalesce(text, ''))"


@R.query(
    f"WITH t AS (SELECT conv_id, turn, {_MESSAGE_SQL} AS m FROM conversations), f AS (SELECT conv_id, turn, {_has_sql(history.MERGE)} AS merge, "
    + ", ".join(f'{_has_sql(words)} AS "{name}"' for name, words in history.CLASSES.items())
    + " FROM t) SELECT conv_id, turn, merge, "
    + ", ".join(f'NOT merge AND "{name}" AS "{name}"' for name in history.CLASSES)
    + " FROM f"
)
def msg_classify(spark, d):
    """Messages by class; merges are of no other."""
    start = F.element_at(F.array(*map(F.lit, ("Merge branch ", "Add ", "Fix typo in ", "clean up test of ", ""))), (F.col("conv_id") % 5 + 1).cast("int"))
    found = history.classified(F.concat(start, F.coalesce("text", F.lit(""))))
    return table(spark, d, "conversations").select("conv_id", "turn", *[c.alias(n) for n, c in found.items()])


_FILE_SQL = "p_type || '/' || p_brand || '/' || CASE p_partkey % 7 WHEN 0 THEN 'Makefile' WHEN 1 THEN 'Makefile.inc' WHEN 2 THEN 'Kconfig' WHEN 3 THEN p_name || '.c' WHEN 4 THEN p_name || '.h' WHEN 5 THEN p_name || '.S' ELSE p_name || '.txt' END"


@R.query(
    f"""WITH f AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'README' ELSE {_FILE_SQL} END AS path, p_partkey % 7 AS kind, p_size % 5 AS own, CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size END AS total FROM part)
SELECT p_partkey, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '(root)' END AS subsystem,
CASE WHEN path = 'README' THEN 'other' WHEN kind <= 1 THEN 'Makefile' WHEN kind = 2 THEN 'Kconfig' WHEN kind = 3 THEN '.c' WHEN kind = 4 THEN '.h' WHEN kind = 5 THEN '.S' ELSE 'other' END AS file_type,
CAST(len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS INTEGER) AS depth, round(own / greatest(total, 1), 9) AS share FROM f"""
)
def path_columns(spark, d):
    """Subsystem, file type, depth and share of lines (over one line at least) of each path."""
    key, name = F.col("p_partkey"), F.col("p_name")
    endings = F.array(F.lit("Makefile"), F.lit("Makefile.inc"), F.lit("Kconfig"), F.concat(name, F.lit(".c")), F.concat(name, F.lit(".h")), F.concat(name, F.lit(".S")), F.concat(name, F.lit(".txt")))
    path = F.when(key % 11 == 0, "README").otherwise(F.concat_ws("/", "p_type", "p_brand", F.element_at(endings, (key % 7 + 1).cast("int"))))
    own, total = F.col("p_size") % 5, F.when(F.col("p_size") % 4 == 0, 0).otherwise(F.col("p_size"))
    rows = table(spark, d, "part").select("p_partkey", path.alias("path"), own.alias("own"), total.alias("total"))
    return rows.select("p_partkey", paths.top_directory(F.col("path")).alias("subsystem"), paths.file_type(F.col("path")).alias("file_type"), paths.depth(F.col("path")).alias("depth"), F.round(F.col("own") / F.greatest("total", F.lit(1)), 9).alias("share"))


@R.query(
    """WITH n AS (SELECT p_type || '/' || p_partkey AS path, CAST(sum(CAST(l_quantity AS BIGINT) - 20 - l_linenumber) AS BIGINT) AS net, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS delta FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT path, net, delta, delta / net AS bytes_per_line FROM n WHERE net > 0 ORDER BY bytes_per_line DESC, path LIMIT 20"""
)
def bytes_per_line(spark, d):
    """Twenty files with most bytes for each line they grew by."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_linenumber", "l_extendedprice")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_type", F.col("p_partkey").cast("string")).alias("path"))
    rows = lines.join(parts, "l_partkey").groupBy("path").agg(F.sum(F.col("l_quantity").cast("bigint") - 20 - F.col("l_linenumber")).alias("net"), F.sum(F.floor("l_extendedprice").cast("bigint")).alias("delta"))
    return history.bytes_per_line(rows, 20)


@R.query(
    """WITH a AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1)
SELECT CASE WHEN n = 1 THEN 'one-time' ELSE 'repeat' END AS profile, count(*) AS authors, CAST(sum(n) AS BIGINT) AS commits, count(*) FILTER (WHERE kinds = 1) AS pure, round(100.0 * sum(n) / (SELECT sum(n) FROM a), 4) AS percent FROM a GROUP BY 1"""
)
def author_profile(spark, d):
    each = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("o_orderpriority").alias("kinds"))
    total = F.broadcast(each.agg(F.sum("n").alias("_t")))
    out = each.groupBy(F.when(F.col("n") == 1, "one-time").otherwise("repeat").alias("profile")).agg(F.count("*").alias("authors"), F.sum("n").alias("commits"), F.count_if(F.col("kinds") == 1).alias("pure"))
    return out.crossJoin(total).select("profile", "authors", "commits", "pure", F.round(F.lit(100.0) * F.col("commits") / F.col("_t"), 4).alias("percent"))


@R.query(f"{_T}, c AS (SELECT author, count(DISTINCT \"commit\") AS commits FROM t GROUP BY author) SELECT author, commits, round(100.0 * commits / (SELECT sum(commits) FROM c), 4) AS percent FROM c ORDER BY commits DESC, author LIMIT 30")
def top_authors_share(spark, d):
    each = history.contributors(numstat(spark, d), F.col("author")).select(F.col("name").alias("author"), "commits")
    total = F.broadcast(each.agg(F.sum("commits").alias("_t")))
    return each.orderBy(F.desc("commits"), "author").limit(30).crossJoin(total).select("author", "commits", F.round(F.lit(100.0) * F.col("commits") / F.col("_t"), 4).alias("percent"))


@R.query(f"{_T}, o AS (SELECT path, count(*) AS total_lines, count(*) FILTER (WHERE hash_c < 3) AS own_lines FROM (SELECT path, CAST(substr(author, 2) AS BIGINT) % 10 AS hash_c FROM t) GROUP BY path) SELECT path, own_lines, total_lines, round(own_lines / greatest(total_lines, 1), 6) AS share FROM o WHERE own_lines > 0")
def ownership(spark, d):
    """Lines of a chosen group of authors in each file, and their share; files without any are left out."""
    own = F.expr("cast(substring(author, 2) as bigint)") % 10 < 3
    out = history.text_changes(numstat(spark, d)).groupBy("path").agg(F.count_if(own).alias("own_lines"), F.count("*").alias("total_lines"))
    return out.where("own_lines > 0").select("path", "own_lines", "total_lines", F.round(F.col("own_lines") / F.greatest("total_lines", F.lit(1)), 6).alias("share"))


@R.query(f"{_T} SELECT year(ts) || '.' || month(ts) AS version, count(DISTINCT path) AS n_files, CAST(sum(lines) AS BIGINT) AS total, round(avg(lines), 6) AS mean, round(median(lines), 6) AS median FROM t GROUP BY 1")
def by_version(spark, d):
    rows = history.text_changes(numstat(spark, d)).withColumn("lines", F.col("added") + F.col("deleted"))
    version = F.concat_ws(".", F.year("ts").cast("string"), F.month("ts").cast("string"))
    return rows.groupBy(version.alias("version")).agg(F.count_distinct("path").alias("n_files"), F.sum("lines").alias("total"), F.round(F.avg("lines"), 6).alias("mean"), F.round(F.median("lines"), 6).alias("median"))


_VS = "v AS (SELECT year(ts) || '.' || month(ts) AS version, string_split(path, '/')[1] AS subsystem, CAST(sum(lines) AS BIGINT) AS lines FROM t GROUP BY ALL)"


def _version_subsystem(spark, d):
    rows = history.text_changes(numstat(spark, d)).withColumn("lines", F.col("added") + F.col("deleted"))
    version = F.concat_ws(".", F.year("ts").cast("string"), F.month("ts").cast("string"))
    return rows.groupBy(version.alias("version"), F.substring_index("path", "/", 1).alias("subsystem")).agg(F.sum("lines").alias("lines"))


@R.query(f"{_T}, {_VS} SELECT *, row_number() OVER (ORDER BY CAST(string_split(version, '.')[1] AS INT), CAST(string_split(version, '.')[2] AS INT), lines DESC, subsystem) AS place FROM v")
def by_version_subsystem(spark, d):
    """The rollup in numeric version order, not text order, with places.

    Rows are numbered inside each version and shifted by the rows of the versions before: no order runs through one
    task but that of one small row for each version.
    """
    parts = F.transform(F.split("version", r"\."), lambda x: x.cast("int"))
    rollup = _version_subsystem(spark, d)
    before = Window.orderBy(parts).rowsBetween(Window.unboundedPreceding, -1)
    shifts = rollup.groupBy("version").agg(F.count("*").alias("_n")).select("version", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("version").orderBy(F.desc("lines"), "subsystem"))
    placed = rollup.withColumn("_i", inside).join(F.broadcast(shifts), "version")
    return placed.select("version", "subsystem", "lines", (F.col("_i") + F.col("_shift")).cast("bigint").alias("place")).orderBy("place")


@R.query(f"{_T}, {_VS}, r AS (SELECT *, row_number() OVER (PARTITION BY version ORDER BY lines DESC, subsystem) AS rank FROM v) SELECT * FROM r WHERE rank <= 10")
def top10_per_version(spark, d):
    return history.top_per_group(_version_subsystem(spark, d), "version", 10, F.desc("lines"), F.col("subsystem"))


@R.query(f"{_T}, {_VS} SELECT subsystem, count(DISTINCT version) AS n_versions, CAST(sum(lines) AS BIGINT) AS lines, CASE WHEN subsystem IN ('ECONOMY', 'STANDARD') THEN 'core' ELSE 'periphery' END AS area FROM v GROUP BY subsystem")
def overall_by_subsystem(spark, d):
    out = _version_subsystem(spark, d).groupBy("subsystem").agg(F.count_distinct("version").alias("n_versions"), F.sum("lines").alias("lines"))
    return out.withColumn("area", F.when(F.col("subsystem").isin("ECONOMY", "STANDARD"), "core").otherwise("periphery"))


@R.query("SELECT year(o_orderdate) AS y, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def pivot_type(spark, d):
    rows = table(spark, d, "orders").select(F.year("o_orderdate").cast("bigint").alias("y"), "o_orderstatus")
    return rows.groupBy("y").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@R.query("WITH c AS (SELECT isodow(ts) - 1 AS weekday, hour(ts) AS hour, count(*) AS n FROM events GROUP BY ALL) SELECT w.weekday, h.hour, coalesce(n, 0) AS n FROM (SELECT unnest(range(7)) AS weekday) w CROSS JOIN (SELECT unnest(range(24)) AS hour) h LEFT JOIN c ON c.weekday = w.weekday AND c.hour = h.hour")
def crosstab_week_hour(spark, d):
    """A full grid of 7 weekdays by 24 hours, zero where nothing happened."""
    counts = table(spark, d, "events").groupBy(F.weekday("ts").cast("bigint").alias("weekday"), F.hour("ts").cast("bigint").alias("hour")).agg(F.count("*").alias("n"))
    grid = spark.range(7 * 24).select(F.floor(F.col("id") / 24).alias("weekday"), (F.col("id") % 24).alias("hour"))
    return grid.join(counts, ["weekday", "hour"], "left").na.fill(0, ["n"])


@R.query("WITH c AS (SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL) SELECT r_name, round(sum(CAST(n AS DOUBLE) * n) / (CAST(sum(n) AS DOUBLE) * sum(n)), 9) AS hhi FROM c GROUP BY r_name")
def hhi(spark, d):
    counts = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    named = counts.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return history.concentration(named, "r_name", "n")


@R.query("WITH q AS (SELECT quantile_cont(value, 0.95) AS q95, quantile_cont(value, 0.99) AS q99 FROM events) SELECT event_type, count(*) FILTER (WHERE value <= q95) AS below_95, count(*) FILTER (WHERE value <= q99) AS below_99, count(*) AS n FROM events, q GROUP BY event_type")
def quantile_cut(spark, d):
    events = table(spark, d, "events").select("event_type", "value")
    cuts = F.broadcast(events.agg(F.percentile("value", 0.95).alias("q95"), F.percentile("value", 0.99).alias("q99")))
    return events.crossJoin(cuts).groupBy("event_type").agg(F.count_if(F.col("value") <= F.col("q95")).alias("below_95"), F.count_if(F.col("value") <= F.col("q99")).alias("below_99"), F.count("*").alias("n"))


@R.query("WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(least(floor((value - lo) * 30 / (hi - lo)), 29) AS INTEGER) AS bin, count(*) AS n FROM events, b GROUP BY 1")
def value_histogram(spark, d):
    return history.histogram(table(spark, d, "events").select("value"), "value", 30)


@R.query(f"WITH {NUMSTAT_SQL} SELECT \"commit\", CAST(sum(coalesce(added, 0)) AS BIGINT) AS added, round(CASE WHEN sum(coalesce(added, 0)) <= 0 THEN 0 ELSE sum(coalesce(deleted, 0)) / sum(coalesce(added, 0)) END, 6) AS churn FROM numstat GROUP BY 1")
def churn_ratio(spark, d):
    """Deleted over added lines of each commit; 0 where nothing was added."""
    out = numstat(spark, d).groupBy("commit").agg(F.sum(F.coalesce("added", F.lit(0))).alias("added"), F.sum(F.coalesce("deleted", F.lit(0))).alias("_del"))
    return out.select("commit", "added", F.round(F.when(F.col("added") <= 0, 0.0).otherwise(F.col("_del") / F.nullif("added", F.lit(0))), 6).alias("churn"))


@R.query("SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, count(DISTINCT source) AS n_sources FROM documents GROUP BY lang UNION ALL SELECT 'all', count(*), round(avg(n_chars), 6), count(DISTINCT source) FROM documents")
def language_summary(spark, d):
    docs = table(spark, d, "documents").select("lang", "n_chars", "source")
    out = lambda key: docs.groupBy(key.alias("lang")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.count_distinct("source").alias("n_sources"))
    return out(F.col("lang")).unionByName(out(F.lit("all")))


@R.query("WITH s AS (SELECT c_nationkey, c_custkey, c_acctbal, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_acctbal > 0 AND n >= 5), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_custkey) AS rank FROM s) SELECT c_nationkey, c_custkey, n, rank FROM r WHERE rank <= 3")
def eligible_per_group(spark, d):
    """First three of each group that meet every threshold."""
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")).where("n >= 5")
    rows = table(spark, d, "customer").where("c_acctbal > 0").join(counts, "c_custkey")
    return history.top_per_group(rows, "c_nationkey", 3, F.desc("n"), F.col("c_custkey")).select("c_nationkey", "c_custkey", "n", "rank")


@R.query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM documents) WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 20")
def explode_topk(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(20)


_PATTERNS = {"the": 1, "an[dt]": 2, "tion": 3, "license": 20, "password|token": 30}


@R.query(
    "WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line FROM pages) SELECT page_id, CAST(sum("
    + " + ".join(f"CASE WHEN regexp_matches(line, '(?i){p}') THEN {w} ELSE 0 END" for p, w in _PATTERNS.items())
    + ") AS BIGINT) AS score FROM l GROUP BY page_id ORDER BY score DESC, page_id LIMIT 10"
)
def pattern_score(spark, d):
    out = history.pattern_scores(table(spark, d, "pages").select("page_id", "html"), "page_id", "html", _PATTERNS)
    return out.orderBy(F.desc("score"), "page_id").limit(10)


@R.query(
    "WITH l AS (SELECT page_id, unnest(string_split(html || chr(10) || CASE page_id % 3 WHEN 0 THEN 'static inline void *p = mmap(0, n << 2); /* fast path */' WHEN 1 THEN 'char pad[16]; struct bitmap *b;' ELSE '' END, chr(10))) AS line FROM pages) SELECT page_id, CAST(sum("
    + " + ".join(f"CASE WHEN regexp_matches(line, '(?i){p}') THEN {w} ELSE 0 END" for p, w in history.TUNED.items())
    + ") AS BIGINT) AS score FROM l GROUP BY page_id ORDER BY score DESC, page_id LIMIT 10"
)
def pattern_score_code(spark, d):
    """Ten texts with most lines of hand-tuned code."""
    more = F.when(F.col("page_id") % 3 == 0, "static inline void *p = mmap(0, n << 2); /* fast path */").when(F.col("page_id") % 3 == 1, "char pad[16]; struct bitmap *b;").otherwise("")
    rows = table(spark, d, "pages").select("page_id", F.concat("html", F.lit("\n"), more).alias("html"))
    return history.pattern_scores(rows, "page_id", "html", history.TUNED).orderBy(F.desc("score"), "page_id").limit(10)


@R.query("SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) WHERE regexp_matches(line, '(licen[cs]e|AKIA|password)')")
def history_grep(spark, d):
    return history.grep(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", "(licen[cs]e|AKIA|password)")


_DIFF_SQL = """WITH l AS (SELECT conv_id, turn, unnest(string_split(text, '. ')) AS line FROM conversations), c AS (SELECT DISTINCT * FROM l),
g AS (SELECT conv_id, turn, '+' AS sign, line FROM c n WHERE turn > 0 AND NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = n.conv_id AND p.turn = n.turn - 1 AND p.line = n.line)
UNION ALL SELECT conv_id, turn + 1, '-', line FROM c p WHERE EXISTS (SELECT 1 FROM c q WHERE q.conv_id = p.conv_id AND q.turn = p.turn + 1) AND NOT EXISTS (SELECT 1 FROM c n WHERE n.conv_id = p.conv_id AND n.turn = p.turn + 1 AND n.line = p.line))
SELECT * FROM g"""


@R.query(_DIFF_SQL)
def grep_diff(spark, d):
    """Lines that each version adds to, or drops from, the one before."""
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", r"\. ")).alias("line")).distinct()
    old = lines.withColumn("turn", F.col("turn") + 1)
    keys = ["conv_id", "turn", "line"]
    added = lines.where("turn > 0").join(old, keys, "left_anti").select("conv_id", "turn", F.lit("+").alias("sign"), "line")
    gone = old.join(lines.select("conv_id", "turn").distinct(), ["conv_id", "turn"], "left_semi").join(lines, keys, "left_anti").select("conv_id", "turn", F.lit("-").alias("sign"), "line")
    return added.unionByName(gone)


@R.query(f"{_DIFF_SQL} WHERE regexp_matches(line, '(tion|ung|[Cc]i.n) ')")
def grep_diff_match(spark, d):
    """Changed lines that match."""
    return grep_diff(spark, d).where(F.col("line").rlike("(tion|ung|[Cc]i.n) "))


@R.query("SELECT year(o_orderdate) AS version, count(DISTINCT l_partkey) AS n_files, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_name LIKE '%e' GROUP BY 1")
def files_by_extension(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    named = table(spark, d, "part").where(F.col("p_name").like("%e")).select(F.col("p_partkey").alias("l_partkey"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").cast("bigint").alias("version"))
    return lines.join(named, "l_partkey").join(orders, "l_orderkey").groupBy("version").agg(F.count_distinct("l_partkey").alias("n_files"), F.sum(F.col("l_quantity").cast("bigint")).alias("n_lines"))


@R.query("WITH r AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (3, 5, 8))) SELECT o_orderkey, rn AS place FROM r WHERE rn <= 25")
def path_history(spark, d):
    """Newest 25 commits that contain a path."""
    touching = table(spark, d, "lineitem").where(F.col("l_partkey").isin(3, 5, 8)).select(F.col("l_orderkey").alias("o_orderkey"))
    commits = table(spark, d, "orders").select("o_orderkey", "o_orderdate").join(touching, "o_orderkey", "left_semi")
    return history.top_n(commits, 25, F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", F.col("rank").alias("place"))


QUERIES, ORACLES = R.queries, R.oracles
