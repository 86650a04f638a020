"""Document fingerprints by SpotSigs; DataFrame functions only.

A signature is a common word and the chain of content words that follow it. A document's fingerprint is the set of
its signatures' hashes; sets are compared by Jaccard similarity, and the pair search prunes by set length first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.sources.durable import stored

# Common words of English, German, French and Spanish at which signatures begin.
ANCHORS = ("the of and to that is for with", "der die das und zu den von mit nicht", "de la le et les des que un", "el en los las y del por una")
#: Content words of a chain, and anchors that a chain may pass over before it ends.
CHAIN, REACH = 2, 5
#: Hex digits of a signature's hash.
DIGITS = 8
#: Documents that a range of ids should hold, and largest number of ranges.
RANGE_ROWS, MAX_RANGES = 2_000, 20_000
_ANCHOR = " (" + "|".join(sorted({w for line in ANCHORS for w in line.split()})) + ") "
_FIRST = -(1 << 63)


def signatures(text: Column) -> Column:
    """Sorted distinct signature hashes of a text; the text's start counts as an anchor. None without words."""
    # every word has a space of its own on either side, so that neighbouring anchors both match
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    pieces = F.split(F.regexp_replace(spaced, _ANCHOR, "\x01$1\x02"), "\x01")
    tails = F.transform(pieces, lambda p: F.substring_index(p, "\x02", -1))

    def one(piece: Column, i: Column, tails: Column) -> Column:
        after = F.trim(F.array_join(F.slice(tails, i + 1, REACH + 1), " "))
        anchor = F.when(i == 0, F.lit("")).otherwise(F.substring_index(piece, "\x02", 1))
        chain = F.array_join(F.slice(F.split(after, " +", CHAIN + 1), 1, CHAIN), " ")
        return F.when(chain != "", F.concat(anchor, F.lit(":"), chain))

    # a one-element array binds the tails, so that they are made once for a text
    found = F.transform(F.array(F.struct(pieces.alias("p"), tails.alias("t"))), lambda b: F.transform(b["p"], lambda p, i: one(p, i, b["t"])))
    chains = F.filter(found[0], lambda s: s.isNotNull())
    return F.array_sort(F.array_distinct(F.transform(F.array_distinct(chains), lambda s: F.substring(F.md5(s), 1, DIGITS))))


def likeness(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 without looking inside where the lengths alone put it below ``floor``.

    Two empty sets are alike (1), an empty and another set are not (0).
    """
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    exact = both / (F.size(a) + F.size(b) - both).cast("double")
    return F.when(high == 0, F.lit(1.0)).when((low == 0) | (low < floor * high), F.lit(0.0)).otherwise(exact)


def fingerprint(sigs: Column) -> Column:
    """A set as text: its hashes joined."""
    return F.array_join(sigs, "")


def similar_pairs(documents: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Pairs (a, b, likeness) of representatives of different sets, of likeness ``threshold`` or more.

    Equal sets are one class, represented by the smallest doc_id. Sets are partitioned by length: one of n hashes can
    only be like sets of up to n / threshold. Each set enters the index with the few hashes of its prefix that any
    like set must share (in hash order), so pairs that cannot reach the threshold never meet.
    """
    sets = documents.select(F.col("doc_id"), signatures(F.col("text")).alias("s")).where("size(s) > 0 and doc_id is not null")
    sets = stored(sets.groupBy("s").agg(F.min("doc_id").alias("id")).withColumn("n", F.size("s")), "spot_sets")
    # length classes grow by 1 / threshold: a set meets those of its own class and the next
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(max(1 / threshold, 1.0001))))
    entered = sets.withColumn("level", level).withColumn("h", F.explode(F.slice("s", 1, (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))))
    left = entered.select("h", "level", F.col("id").alias("a"), F.col("n").alias("n_a"))
    right = entered.withColumn("level", F.explode(F.array(F.col("level"), F.col("level") - 1))).select("h", "level", F.col("id").alias("b"), F.col("n").alias("n_b"))
    met = left.join(right, ["h", "level"]).where("(n_a < n_b or (n_a = n_b and a < b)) and n_a >= n_b * " + str(threshold)).select("a", "b").distinct()
    met = met.join(sets.select(F.col("id").alias("a"), F.col("s").alias("s_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("s_b")), "b")
    return met.select("a", "b", likeness(F.col("s_a"), F.col("s_b"), threshold).alias("likeness")).where(F.col("likeness") >= threshold)


def _part(cuts: list[int], key: Column) -> Column:
    """Number of ``cuts`` (sorted) that are not above ``key``, by binary search in a constant array."""
    if not cuts:
        return F.lit(0)
    bounds = F.array(*[F.lit(c).cast("bigint") for c in cuts])
    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = (s["lo"] < s["hi"]) & (F.element_at(bounds, F.least(mid, F.lit(len(cuts) - 1)) + 1) <= key)
        return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(F.least(mid, s["hi"])).alias("hi"))

    return F.aggregate(steps, start, halve)["lo"]


def edit_likeness(documents: DataFrame) -> DataFrame:
    """Fingerprints of texts and of edited texts, and their likeness.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many, or all, of the next
    document: the next row by doc_id, then text, after the last row the first. One row per input row: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text is empty; a null doc_id sorts
    first; repeated ids follow one another. Other columns are ignored; an empty table gives no rows.

    Ids alone are looked at to cut the table into ranges of ids. Every row goes to its range, and the first document
    of each range to the range before as well, so neighbours meet in one shuffle and no order runs through one task.
    """
    rows = documents.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_FIRST)).alias("_d"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    count = rows.count()
    ranges = max(1, min(MAX_RANGES, count // RANGE_ROWS))
    cuts: list[int] = []
    if ranges > 1:
        found = rows.agg(F.percentile_approx("_d", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
        cuts = sorted(set(found or []))
    rows = rows.withColumn("_part", _part(cuts, F.col("_d")).cast("int"))
    firsts = sorted((r["_part"], r["m"]) for r in rows.groupBy("_part").agg(F.min("_d").alias("m")).collect())
    before = {p: firsts[i - 1][0] for i, (p, _) in enumerate(firsts)}
    top = (firsts[-1][0] if firsts else 0) + 1
    lookup = F.array(*[F.lit(before.get(p, 0)) for p in range(top)])
    lowest = F.array(*[F.lit(dict(firsts).get(p, 0)).cast("bigint") for p in range(top)])
    wrap = F.lit(firsts[0][0] if firsts else 0)
    own = F.struct(F.col("_part").alias("part"), F.lit(0).alias("guest"))
    guest = F.struct(F.element_at(lookup, F.col("_part") + 1).alias("part"), F.when(F.col("_part") == wrap, 2).otherwise(1).alias("guest"))
    rows = rows.withColumn("_s", signatures(F.col("_t"))).withColumn("_to", F.explode(F.when(F.col("_d") == F.element_at(lowest, F.col("_part") + 1), F.array(own, guest)).otherwise(F.array(own))))
    # guests come after the range's own rows; the first document of all comes last of all
    order = Window.partitionBy("_to.part").orderBy("_to.guest", "_d", "_t")
    rows = rows.select("*", F.lead("_t").over(order).alias("_next"), F.lead("_s").over(order).alias("_next_s")).where("_to.guest = 0")
    n = F.length("_t")
    rows = rows.select("doc_id", "_s", "_next_s", n.cast("bigint").alias("n_chars"), F.concat(F.expr("substring(_t, 1, length(_t) - length(_t) div 4)"), F.expr("substring(_next, 1, cast(length(_t) div 4 as int))")).alias("_edited"))
    rows = rows.withColumn("_edited_s", signatures(F.col("_edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint(F.col("_s")).alias("fingerprint"),
        fingerprint(F.col("_edited_s")).alias("edited_fingerprint"),
        likeness(F.col("_s"), F.col("_edited_s")).alias("near_edited"),
        likeness(F.col("_s"), F.col("_next_s")).alias("near_next"),
    )


def _sql_signatures(text: str) -> str:
    pieces = f"string_split(regexp_replace(' ' || regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' ', '{_ANCHOR}', chr(1) || '\\1' || chr(2), 'g'), chr(1))"
    return pieces


#: DuckDB SQL with the rows of edit_likeness(documents).
ORACLE = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS r, doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT d.*, coalesce(lead(t) OVER (ORDER BY r), first_value(t) OVER (ORDER BY r)) AS nt FROM d),
x AS (SELECT r, t AS own, left(t, length(t) - length(t) // 4) || left(nt, length(t) // 4) AS edited FROM e),
p AS (SELECT r, 'own' AS k, {_sql_signatures("own")} AS p FROM x UNION ALL SELECT r, 'edited', {_sql_signatures("edited")} FROM x),
q AS (SELECT r, k, p, list_transform(p, lambda y: string_split(y, chr(2))[-1]) AS tails FROM p),
c AS (SELECT r, k, i, CASE WHEN i = 1 THEN '' ELSE string_split(p[i], chr(2))[1] END AS anchor,
  array_to_string(list_slice(list_filter(string_split(array_to_string(list_slice(tails, i, i + {REACH}), ' '), ' '), lambda y: y <> ''), 1, {CHAIN}), ' ') AS chain
  FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM q)),
s AS (SELECT r, k, list(DISTINCT substr(md5(anchor || ':' || chain), 1, {DIGITS}) ORDER BY substr(md5(anchor || ':' || chain), 1, {DIGITS})) FILTER (WHERE chain <> '') AS s FROM c GROUP BY r, k),
j AS (SELECT x.r, x.edited, coalesce(a.s, []) AS a, coalesce(b.s, []) AS b FROM x LEFT JOIN s a ON a.r = x.r AND a.k = 'own' LEFT JOIN s b ON b.r = x.r AND b.k = 'edited'),
n AS (SELECT *, coalesce(lead(a) OVER (ORDER BY r), first_value(a) OVER (ORDER BY r)) AS na FROM j)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
  CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE END AS near_edited,
  CASE WHEN len(a) = 0 AND len(na) = 0 THEN 1.0 ELSE len(list_intersect(a, na)) / (len(a) + len(na) - len(list_intersect(a, na)))::DOUBLE END AS near_next
FROM n JOIN d USING (r)
"""
