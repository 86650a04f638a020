"""Change-history statistics over rows (commit, author, email, path, added, deleted, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.functions import paths


def text_changes(numstat: DataFrame) -> DataFrame:
    """Rows with line counts; binary changes have none and are dropped."""
    return numstat.where("added is not null and deleted is not null")


def contributors(numstat: DataFrame, by: Column) -> DataFrame:
    """Commits and lines of each name that ``by`` gives."""
    rows = text_changes(numstat).select(by.alias("name"), "commit", "added", "deleted")
    # commits first collapse, so that the distinct count is a plain one
    each = rows.groupBy("name", "commit").agg(F.sum("added").alias("a"), F.sum("deleted").alias("d"))
    return each.groupBy("name").agg(F.count("*").alias("commits"), F.sum("a").alias("added"), F.sum("d").alias("deleted")).withColumn("total", F.col("added") + F.col("deleted"))


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First ``n`` rows in ``order``, numbered from 1. Spark keeps n rows a task and merges them."""
    first = df.orderBy(*order).limit(n)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def churn(numstat: DataFrame, key: Column) -> DataFrame:
    """Accumulated lines and distance between first and last half for each key: key, accumulated, net, ratio as text."""
    rows = text_changes(numstat).select(key.alias("key"), "added", "deleted")
    out = rows.groupBy("key").agg(F.sum(F.col("added") + F.col("deleted")).alias("accumulated"), F.abs(F.sum(F.col("added") - F.col("deleted"))).alias("net"))
    return out.withColumn("ratio", ratio(F.col("accumulated"), F.col("net")))


def ratio(x: Column, y: Column) -> Column:
    """x / y with two decimals as text; '-' for 0 / 0 and 'inf' for x / 0."""
    return F.when((x == 0) & (y == 0), "-").when(y == 0, "inf").otherwise(F.format_string("%.2f", F.round(x / F.nullif(y, F.lit(0)), 2)))


def top_with_other(counts: DataFrame, name: str, value: str, n: int) -> DataFrame:
    """The ``n`` greatest and one '(other)' row for the rest, each with its percentage of the total."""
    top = counts.orderBy(F.desc(value), name).limit(n).select(name, F.lit(True).alias("_top"))
    total = counts.agg(F.sum(value).alias("_total"))
    named = counts.join(F.broadcast(top), name, "left").select(F.when(F.col("_top"), F.col(name)).otherwise(F.lit("(other)")).alias(name), value)
    out = named.groupBy(name).agg(F.sum(value).alias(value)).crossJoin(F.broadcast(total))
    return out.select(name, value, F.round(F.lit(100.0) * F.col(value) / F.col("_total"), 4).alias("percent"))


def directory_counts(numstat: DataFrame, depth: int) -> DataFrame:
    rows = text_changes(numstat).select(paths.directory_at(F.col("path"), depth).alias("dir"), (F.col("added") + F.col("deleted")).alias("lines"))
    return rows.groupBy("dir").agg(F.sum("lines").alias("lines"), F.count("*").alias("changes"))


def co_changed(changes: DataFrame, unit: str, item: str, target, n: int) -> DataFrame:
    """Items most often changed together with ``target``: the units that have it, joined with their other items."""
    units = changes.where(F.col(item) == target).select(unit).distinct()
    others = changes.join(units, unit, "left_semi").where(F.col(item) != target).select(unit, item).distinct()
    return others.groupBy(item).agg(F.count("*").alias("together")).orderBy(F.desc("together"), item).limit(n)


def concentration(counts: DataFrame, group: str, value: str) -> DataFrame:
    """Sum of squared shares of each group's total (1 for a single holder)."""
    totals = counts.groupBy(group).agg(F.sum(value).alias("_t"), F.sum(F.col(value).cast("double") * F.col(value)).alias("_s"))
    return totals.select(group, F.round(F.col("_s") / (F.col("_t").cast("double") * F.col("_t")), 9).alias("hhi"))


def top_per_group(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins between least and greatest value; the last is closed on the right. Empty bins are left out."""
    bounds = F.broadcast(df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")))
    place = F.floor((F.col(value) - F.col("_lo")) * bins / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)))
    return df.crossJoin(bounds).select(F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def pattern_scores(texts: DataFrame, key: str, text: str, patterns: dict[str, int]) -> DataFrame:
    """Weighted score of each text: every pattern counts once for each line that it matches, in either case."""
    lines = texts.select(key, F.explode(F.split(text, "\n")).alias("_line"))
    score = sum((F.when(F.col("_line").rlike("(?i)" + p), w).otherwise(0) for p, w in patterns.items()), F.lit(0))
    return lines.groupBy(key).agg(F.sum(score).alias("score"))


#: What the messages of each class contain, in either case.
CLASSES = {
    "bugfix": ("fix", "bug", "revert", "regress", "broken", "error", "crash", "oops", "patch"),
    "feature": ("feat", "add ", "new ", "support ", "implement", "introduce", "enable ", "initial "),
    "doc": ("doc", "readme", "comment", "typo", "spelling", "grammar"),
    "test": ("test", "spec", "check", "unittest"),
    "refactor": ("refactor", "clean", "tidy", "rename", "move ", "simplif"),
}
MERGE = ("merge branch", "merge pull req", "merge remote", "merge tag")
#: Patterns of hand-tuned code and what a line that matches is worth.
TUNED = {
    "(<<|>>|& [_a-zA-Z0-9]+)": 1,
    "(mem_pool|blob_alloc|xcalloc)": 1,
    r"(inline|__attribute__\s*\(\s*\(always_inline\)\)|prefetch)": 1,
    r"(__attribute__\s*\(\s*\(?\s*packed\s*\)?\s*\)|#pragma pack|__packed|PACKED)": 1,
    r"(__attribute__\s*\(\s*\(?\s*aligned\s*\(\s*64\s*\)\s*\)|__cacheline_aligned|CACHELINE_SIZE|aligned\(CACHE_LINE\)|__aligned\(64\))": 1,
    r"(char\s+(pad|reserved|_padding)\[[0-9]+\]|unsigned\s+(char|int)\s+padding\[[0-9]+\])": 1,
    "(ewah_|bitmap|hashmap_entry)": 1,
    r"(/\*.*(optimize|speed|fast path|performance|hack).*\*/)": 2,
    "(lstat|mmap|O_NOATIME)": 1,
}


def classified(message: Column) -> dict[str, Column]:
    """Whether a message is a merge, and, for others, whether it is of each class; a message may be of several."""
    text = F.lower(message)
    has = lambda words: F.coalesce(F.greatest(*[F.contains(text, F.lit(w)) for w in words]), F.lit(False))
    merge = has(MERGE)
    return {"merge": merge} | {name: ~merge & has(words) for name, words in CLASSES.items()}


def bytes_per_line(rows: DataFrame, n: int) -> DataFrame:
    """Files (path, net lines, delta bytes) with more lines than before, most bytes a line first: with bytes_per_line."""
    grown = rows.where("net > 0").withColumn("bytes_per_line", F.col("delta") / F.col("net"))
    return grown.orderBy(F.desc("bytes_per_line"), "path").limit(n)


def grep(texts: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Lines that match, with their numbers from 1."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("_n", "line"))
    return lines.where(F.col("line").rlike(pattern)).select(key, (F.col("_n") + 1).cast("bigint").alias("line_no"), "line")
