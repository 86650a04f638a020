"""Benchmark decontamination by a distributed positional inverted index; DataFrame functions only.

Postings (term, document, position) of training texts are kept for the terms that searches start from. A phrase is
found by intersecting the lists of its rarest terms, each shifted by the term's place in the phrase; what is left is
compared word by word with the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.llm.common import keyed, sized
from siltmark.sources.durable import stored

#: Words of a window; an item of fewer words is one window.
WINDOW = 13
#: Posting lists that are intersected before the text is looked at: those of a window's rarest terms.
PROBES = 2
#: A document is contaminated when at least one in so many of its words is hit.
HIT_SHARE = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are the runs of what is left once letters are lower-cased; splitting at the others costs a tenth of matching them.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the faster way to the same result."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Words of a text, in order; none for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), _BETWEEN), ""), F.array().cast("array<string>"))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: window_id, words, items (array of item ids as text, null ids left out)."""
    cut = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    cut = cut.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, size))).alias("words"))
    found = cut.groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return found.select(F.xxhash64("words").alias("window_id"), "words", "items")


def term_counts(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of ``terms`` (one column, term) occurs in the texts; terms that do not occur are absent."""
    # outer, or the words would be cut twice: once to see whether there are any; the join drops the null of an empty text
    seen = keyed(documents).select(F.explode_outer(words(F.col("_t"))).alias("term"))
    return seen.join(sized(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def postings(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index for ``terms``: term, _d, _h (the document's key), pos (from 0)."""
    seen = keyed(documents).select("_d", "_h", F.posexplode_outer(words(F.col("_t"))).alias("pos", "term"))
    return seen.join(sized(terms), "term", "left_semi").select("term", "_d", "_h", "pos")


def phrase_matches(documents: DataFrame, phrases: DataFrame, probes: int = PROBES) -> DataFrame:
    """Exact occurrences of ``phrases`` (window_id, words): _d, _h, start, length, window_id.

    The corpus is read for the counts of the phrases' terms, for the lists of each phrase's ``probes`` rarest terms,
    and where candidates were found. Lists meet on (document, term, position), so a frequent term or a passage that
    many documents hold is spread over tasks.
    """
    phrases = stored(phrases.select("window_id", "words", F.size("words").alias("length")), "phrases")
    placed = phrases.select("window_id", "length", F.posexplode("words").alias("place", "term"))
    counts = stored(term_counts(documents, placed.select("term").distinct()), "term_counts")
    ranked = placed.join(counts, "term")
    window = Window.partitionBy("window_id")
    # a phrase with a term that occurs nowhere cannot occur
    ranked = ranked.withColumn("known", F.count("*").over(window)).where("known = length").withColumn("rank", F.row_number().over(window.orderBy("n", "term", "place")))
    ranked = ranked.where(F.col("rank") <= probes).groupBy("window_id", "length").agg(F.array_sort(F.collect_list(F.struct("rank", "term", "place"))).alias("p"))
    ranked = stored(ranked, "probes")
    index = stored(postings(documents, ranked.select(F.explode("p.term").alias("term")).distinct()), "postings")

    first = ranked.select(F.col("p")[0]["term"].alias("term"), F.col("p")[0]["place"].alias("place"), "window_id", "length", "p")
    found = index.join(sized(first), "term").select("_d", "_h", (F.col("pos") - F.col("place")).alias("start"), "window_id", "length", "p").where("start >= 0")
    for k in range(1, probes):
        other = index.select("term", "_d", "_h", "pos")
        probe = F.coalesce(F.get("p", F.lit(k)), F.get("p", F.lit(0)))  # a phrase of fewer terms meets its first list again
        found = found.withColumn("term", probe["term"]).withColumn("pos", F.col("start") + probe["place"]).join(other, ["_d", "_h", "term", "pos"], "left_semi")
    # places alone travel to the texts; the words that stand there come back and meet the phrases
    sites = stored(found.groupBy("_d", "_h").agg(F.collect_set(F.struct("start", "length", "window_id")).alias("sites")), "candidates")
    texts = keyed(documents).join(sized(sites), ["_d", "_h"]).select("_d", "_h", "sites", words(F.col("_t")).alias("w"))
    there = F.transform("sites", lambda s: F.struct(s["start"], s["length"], s["window_id"], F.slice(F.col("w"), s["start"] + 1, s["length"]).alias("there")))
    read = texts.select("_d", "_h", F.explode(there).alias("s")).select("_d", "_h", "s.*")
    return read.join(sized(phrases.select("window_id", "words")), "window_id").where("there = words").select("_d", "_h", "start", "length", "window_id").distinct()


def proximity_matches(documents: DataFrame, terms: list[str], slop: int) -> DataFrame:
    """Documents and positions where all of ``terms`` stand within ``slop`` words: doc_id, first, last.

    One row for each occurrence of the first-listed place where a span of at most ``slop`` + 1 words begins; terms
    are lower-cased words. Null ids come back null. Without terms there are no matches.
    """
    wanted = sorted({t for t in terms if t})
    spark = documents.sparkSession
    index = postings(documents, spark.createDataFrame([(t,) for t in wanted], "term string"))
    # within a document, each term's nearest occurrence at or after every position
    ahead = Window.partitionBy("_d", "_h").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    for i, t in enumerate(wanted):
        index = index.withColumn(f"n{i}", F.min(F.when(F.col("term") == t, F.col("pos"))).over(ahead))
    nearest = [F.col(f"n{i}") for i in range(len(wanted))]
    last = F.greatest(*nearest) if len(nearest) > 1 else (nearest[0] if nearest else F.col("pos"))
    complete = F.lit(bool(wanted))
    for n in nearest:
        complete = complete & n.isNotNull()
    found = index.where(complete).select("_d", "pos", last.alias("last")).where(F.col("last") - F.col("pos") <= slop)
    return found.select(F.nullif("_d", F.lit(-(1 << 63))).alias("doc_id"), F.col("pos").alias("first"), "last").distinct()


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """How far each document repeats benchmark items.

    One row per input row: doc_id, n_words, n_hit (words inside an occurring window), n_items, items_sha256,
    contaminated (n_hit > 0 and 20 * n_hit >= n_words), text_hash. Null and empty texts have no words; items without words have
    no window; repeated items count once; a null item id hits words but is not listed. Rows that repeat a doc_id, or
    have none, are judged by their own text. Other columns are ignored; an empty table gives no rows.
    """
    cut = stored(windows(benchmark), "windows")
    hits = stored(phrase_matches(documents, cut.select("window_id", "words")), "matches")
    before = Window.partitionBy("_d", "_h").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    spans = hits.groupBy("_d", "_h", "start").agg(F.max("length").alias("length"))
    spans = spans.withColumn("done", F.coalesce(F.max(end).over(before), F.lit(0)))
    n_hit = spans.groupBy("_d", "_h").agg(F.sum(F.greatest(end - F.greatest("start", "done"), F.lit(0))).alias("n_hit"))
    listed = hits.select("_d", "_h", "window_id").distinct().join(sized(cut.select("window_id", "items")), "window_id")
    listed = listed.select("_d", "_h", F.explode("items").alias("item")).groupBy("_d", "_h").agg(F.array_sort(F.collect_set("item")).alias("items"))
    verdicts = stored(n_hit.join(listed, ["_d", "_h"], "left"), "verdicts")
    rows = keyed(documents).select("doc_id", "_d", "_h", F.size(words(F.col("_t"))).cast("bigint").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(verdicts, ["_d", "_h"], "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (HIT_SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.col("_h").alias("text_hash"),
    )


#: DuckDB SQL with the rows of contamination(documents, benchmark).
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, list_slice(w, s, s + least(len(w), 13) - 1) AS g FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, s, n, list_slice(w, s, s + n - 1) AS g FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, lens WHERE len(w) >= n)),
m AS (SELECT r, s, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM m) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
