"""Queries over content-addressed trees, version chains and Merkle trees."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltmark.operators import merkle, tree
from siltmark.plans.registry import Registry
from siltmark.sources.durable import stored
from siltmark.sources.tables import PART_TREE_SQL, part_tree, table

R = Registry()
_DEPTH = 3


def _tree_sql(files: str = PART_TREE_SQL, name: str = "part_tree", dirs: str = "part_tree", more: str = "") -> str:
    """Objects o of the tree over ``name``; directories are those over the files of ``dirs``, empty or not."""
    base = "regexp_extract(path, '([^/]*)$', 1)"
    up = "regexp_extract(path, '^(.*)/', 1)"
    lines = lambda mark: f"coalesce(string_agg(c.name || '{mark}' || chr(9) || c.hash || chr(10), '' ORDER BY c.name || '{mark}' || chr(9) || c.hash), '')"
    return f"""{files}, f AS (SELECT path, sha256(content) AS hash FROM {name}),
k2 AS (SELECT DISTINCT {up} AS path FROM {dirs}{more}), c2 AS (SELECT {up} AS up, {base} AS name, hash FROM f),
d2 AS (SELECT k2.path, {lines(":")} AS text FROM k2 LEFT JOIN c2 c ON c.up = k2.path GROUP BY 1),
c1 AS (SELECT {up} AS up, {base} AS name, sha256(text) AS hash FROM d2), d1 AS (SELECT up AS path, {lines("/")} AS text FROM c1 c GROUP BY 1),
c0 AS (SELECT path AS name, sha256(text) AS hash FROM d1), d0 AS (SELECT '' AS path, {lines("/")} AS text FROM c0 c),
o AS (SELECT path, 'file' AS kind, hash, NULL AS text FROM f UNION ALL SELECT path, 'dir', sha256(text), text FROM (FROM d2 UNION ALL FROM d1 UNION ALL FROM d0))"""


_TREE_SQL = _tree_sql()


def _objects(spark, d):
    """The stored objects of the tree over the parts, and the hash of its root."""
    objects = stored(tree.build(part_tree(spark, d), _DEPTH), "tree")
    root = objects.where("path = ''").first()
    return objects, root["hash"] if root else ""


@R.query(f"WITH {_TREE_SQL} SELECT path, kind, hash FROM o")
def tree_objects(spark, d):
    """Every object of the tree over the parts, directories hashed from their sorted lines."""
    return tree.build(part_tree(spark, d), _DEPTH).select("path", "kind", "hash")


@R.query(f"WITH {_TREE_SQL} SELECT path, kind, hash FROM o WHERE path <> ''")
def tree_ls(spark, d):
    """Recursive listing from the root hash, through the directories' texts alone."""
    objects, root = _objects(spark, d)
    return tree.listing(spark, tree.entries(objects), root)


@R.query(f"""WITH {_TREE_SQL} SELECT path, kind, hash, NOT (path LIKE '%/p_2') AS verified FROM o WHERE path LIKE 'ECONOMY%' AND path <> 'ECONOMY'""")
def tree_get(spark, d):
    """Paths followed from the root, over a store that spoilt the content of some files; and some that do not exist."""
    objects, root = _objects(spark, d)
    files = part_tree(spark, d).select("path", F.when(F.col("path").like("%/p_2"), F.concat("content", F.lit("?"))).otherwise(F.col("content")).alias("content"))
    held = objects.join(files, "path", "left")
    wanted = objects.where(F.col("path").like("ECONOMY_%")).select("path")
    wanted = wanted.unionByName(wanted.select(F.concat("path", F.lit("/none")).alias("path")))
    return tree.walk(tree.entries(objects), held, wanted, root, _DEPTH + 1)


_NEW_FILES = "UNION ALL SELECT 'ECONOMY/Brand#new/n' || r_regionkey, r_name FROM region"
_PUT_SQL = _tree_sql(f"""{PART_TREE_SQL}, put_tree AS (SELECT path, CASE WHEN path LIKE '%/p1' THEN content || '!' ELSE content END AS content FROM part_tree {_NEW_FILES})""", "put_tree", "put_tree")
_TOUCHED = "path = '' OR path LIKE '%/p1' OR path LIKE 'ECONOMY/Brand#new%' OR path = 'ECONOMY' OR path IN (SELECT regexp_extract(path, '^(.*)/', 1) FROM part_tree WHERE path LIKE '%/p1') OR path IN (SELECT regexp_extract(path, '^([^/]*)/', 1) FROM part_tree WHERE path LIKE '%/p1')"


@R.query(f"WITH {_PUT_SQL} SELECT path, kind, hash FROM o WHERE {_TOUCHED}")
def tree_put(spark, d):
    """A changed file and new files in a new directory: they, and their ancestors up to the new root."""
    objects, _ = _objects(spark, d)
    changed = part_tree(spark, d).where(F.col("path").like("%/p1")).select("path", F.concat("content", F.lit("!")).alias("content"))
    new = table(spark, d, "region").select(F.concat(F.lit("ECONOMY/Brand#new/n"), F.col("r_regionkey").cast("string")).alias("path"), F.col("r_name").alias("content"))
    changes = changed.unionByName(new).select("path", F.lit("file").alias("kind"), F.sha2("content", 256).alias("hash"), F.lit(None).cast("string").alias("text"))
    return tree.rewrite(objects, changes, _DEPTH).select("path", "kind", "hash")


_RM_SQL = _tree_sql(f"{PART_TREE_SQL}, rm_tree AS (SELECT * FROM part_tree WHERE NOT (path LIKE '%/p1' OR path LIKE '%/p1_'))", "rm_tree")
_ABOVE_RM = "path = '' OR path IN (SELECT regexp_extract(path, '^(.*)/', 1) FROM part_tree WHERE path LIKE '%/p1' OR path LIKE '%/p1_') OR path IN (SELECT regexp_extract(path, '^([^/]*)/', 1) FROM part_tree WHERE path LIKE '%/p1' OR path LIKE '%/p1_')"


@R.query(f"WITH {_RM_SQL} SELECT path, kind, hash FROM o WHERE {_ABOVE_RM}")
def tree_rm(spark, d):
    """Directories above removed files, up to the new root."""
    objects, _ = _objects(spark, d)
    gone = objects.where(F.col("path").like("%/p1") | F.col("path").like("%/p1_")).select("path", "kind", F.lit(None).cast("string").alias("hash"), F.lit(None).cast("string").alias("text"))
    return tree.rewrite(objects, gone, _DEPTH).select("path", "kind", "hash")


_MKDIR_SQL = _tree_sql(more=" UNION SELECT DISTINCT regexp_extract(path, '^([^/]*)/', 1) || '/empty' FROM part_tree")


@R.query(f"WITH {_MKDIR_SQL} SELECT path, kind, hash FROM o WHERE NOT contains(path, '/') OR path LIKE '%/empty'")
def tree_mkdir(spark, d):
    """An empty directory below every type, and their ancestors up to the new root."""
    objects, _ = _objects(spark, d)
    made = objects.where("parent = ''").select(F.concat("path", F.lit("/empty")).alias("path"), F.lit("dir").alias("kind"), F.sha2(F.lit(""), 256).alias("hash"), F.lit("").alias("text"))
    return tree.rewrite(objects, made, _DEPTH).select("path", "kind", "hash")


_COMMIT_SQL = f"{_TREE_SQL}, r AS (SELECT hash, text, 'Root: ' || hash || chr(10) || 'Date: 12 Feb 2024 08:00:00 UTC' || chr(10) || chr(10) || 'All parts' || chr(10) AS note FROM o WHERE path = ''), n AS (SELECT '.commit:' || chr(9) || sha256(note) || chr(10) || '.parent/' || chr(9) || hash || chr(10) || text AS text FROM r)"


@R.query(f"WITH {_COMMIT_SQL} SELECT '.commit' AS path, sha256(note) AS hash FROM r UNION ALL SELECT '', sha256(text) FROM n")
def tree_commit(spark, d):
    """A commit of the root: its note and the new root, which lists the note and the root before."""
    objects, _ = _objects(spark, d)
    return tree.commit(objects.where("path = ''"), "All parts", "12 Feb 2024 08:00:00 UTC").select("path", "hash")


@R.query(f"WITH {_TREE_SQL} SELECT path, kind, hash FROM o WHERE path <> '' AND hash IN (SELECT hash FROM o WHERE path LIKE '%/p1_') AND hash NOT IN (SELECT hash FROM o WHERE NOT (path LIKE '%/p1_'))")
def tree_check(spark, d):
    """Reachable paths whose object is missing from a store that lost some files."""
    objects, root = _objects(spark, d)
    walked = tree.listing(spark, tree.entries(objects), root)
    return tree.missing(walked, objects.where(~F.col("path").like("%/p1_")))


@R.query(
    f"""WITH {_TREE_SQL} SELECT path, 'hash' AS fault FROM o WHERE kind = 'file' AND path LIKE '%/p_2' UNION ALL
SELECT path, 'line' FROM o WHERE kind = 'dir' AND path LIKE '%/Brand#1_' UNION ALL SELECT path, 'hash' FROM o WHERE kind = 'dir' AND path LIKE '%/Brand#1_'"""
)
def tree_faults(spark, d):
    """Stored objects whose content does not have their hash, and directories with lines out of grammar."""
    objects, _ = _objects(spark, d)
    spoilt = objects.withColumn("text", F.when((F.col("kind") == "dir") & F.col("path").like("%/Brand#1_"), F.concat("text", F.lit("no entry\n"))).otherwise(F.col("text")))
    files = part_tree(spark, d).select("path", F.when(F.col("path").like("%/p_2"), F.concat("content", F.lit("?"))).otherwise(F.col("content")).alias("content"))
    held = spoilt.join(files, "path", "left").select("path", "hash", F.coalesce("content", "text").alias("content"), "text")
    wrong = tree.mismatched(held).select("path", F.lit("hash").alias("fault"))
    lines = tree.malformed(held).select("hash").distinct().join(held.select("hash", "path"), "hash").select("path", F.lit("line").alias("fault"))
    return wrong.unionByName(lines)


_SIDES = "a AS (SELECT path, sha256(content) AS hash FROM part_tree), b AS (SELECT path, sha256(CASE WHEN length(content) % 5 = 0 THEN content || '!' ELSE content END) AS hash FROM part_tree WHERE length(path) % 7 <> 0 UNION ALL SELECT path || '.new', sha256(content) FROM part_tree WHERE length(content) % 9 = 0), c AS (SELECT path, sha256(CASE WHEN length(content) % 3 = 0 THEN content || '?' ELSE content END) AS hash FROM part_tree WHERE length(path) % 11 <> 0)"


def _sides(spark, d):
    files = part_tree(spark, d)
    size, content = F.length("content"), F.col("content")
    hashed = lambda df, text: df.select("path", F.sha2(text, 256).alias("hash"))
    a = hashed(files, content)
    b = hashed(files.where(F.length("path") % 7 != 0), F.when(size % 5 == 0, F.concat(content, F.lit("!"))).otherwise(content))
    b = b.unionByName(files.where(size % 9 == 0).select(F.concat("path", F.lit(".new")).alias("path"), F.sha2("content", 256).alias("hash")))
    c = hashed(files.where(F.length("path") % 11 != 0), F.when(size % 3 == 0, F.concat(content, F.lit("?"))).otherwise(content))
    return a, b, c


@R.query(f"WITH {PART_TREE_SQL}, {_SIDES} SELECT path, CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'removed' ELSE 'changed' END AS status FROM a FULL JOIN b USING (path) WHERE a.hash IS DISTINCT FROM b.hash")
def tree_diff(spark, d):
    a, b, _ = _sides(spark, d)
    return tree.diff(a, b)


@R.query(
    f"""WITH {PART_TREE_SQL}, {_SIDES}, j AS (SELECT path, a.hash AS o, b.hash AS x, c.hash AS y FROM a FULL JOIN b USING (path) FULL JOIN c USING (path))
SELECT path, CASE WHEN o IS NOT DISTINCT FROM x THEN y ELSE x END AS hash, o IS DISTINCT FROM x AND o IS DISTINCT FROM y AND x IS DISTINCT FROM y AS conflict FROM j"""
)
def tree_merge3(spark, d):
    return tree.merge(*_sides(spark, d))


@R.query(
    f"""WITH {PART_TREE_SQL}, {_SIDES}, j AS (SELECT path, a.hash AS o, b.hash AS x, c.hash AS y FROM a FULL JOIN b USING (path) FULL JOIN c USING (path)),
m AS (SELECT regexp_extract(path, '^([^/]*/[^/]*)/', 1) AS merge, bool_or(o IS DISTINCT FROM x AND o IS DISTINCT FROM y AND x IS DISTINCT FROM y) AS conflict FROM j GROUP BY 1)
SELECT count(*) AS merges, count(*) FILTER (WHERE conflict) AS conflicts, round(100.0 * count(*) FILTER (WHERE conflict) / count(*), 4) AS percent FROM m"""
)
def conflict_rate(spark, d):
    """Share of three-way merges, one for each directory of files, in which a file conflicts."""
    merged = tree.merge(*_sides(spark, d)).groupBy(F.regexp_extract("path", "^([^/]*/[^/]*)/", 1).alias("merge")).agg(F.bool_or("conflict").alias("conflict"))
    return merged.agg(F.count("*").alias("merges"), F.count_if("conflict").alias("conflicts")).select("merges", "conflicts", F.round(F.lit(100.0) * F.col("conflicts") / F.col("merges"), 4).alias("percent"))


def _chain(turns):
    """Versions of the turns of conversations, each with the turn before as its parent."""
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    return turns.select(F.struct("conv_id", "turn").alias("root"), F.when(known, F.struct("conv_id", (F.col("turn") - 1).alias("turn"))).alias("parent"))


@R.query("WITH RECURSIVE v AS (SELECT conv_id, turn FROM conversations), u AS (SELECT conv_id, turn AS last, turn FROM v UNION ALL SELECT u.conv_id, u.last, v.turn FROM u JOIN v ON v.conv_id = u.conv_id AND v.turn = u.turn - 1) SELECT conv_id, last, turn AS ancestor, last - turn AS distance FROM u")
def version_log(spark, d):
    """Every version with all of its ancestors."""
    up = tree.ancestors(spark, _chain(table(spark, d, "conversations")))
    last, ancestor = F.col("root.turn"), F.col("ancestor.turn")
    return up.select("root.conv_id", last.alias("last"), ancestor.alias("ancestor"), (last - ancestor).alias("distance"))


@R.query(
    """WITH v AS (SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS made FROM conversations), l AS (SELECT conv_id, max(turn) AS last FROM v GROUP BY 1)
SELECT v.conv_id, l.last, v.turn, sha256(v.conv_id || ':' || v.made) AS "commit" FROM v JOIN l USING (conv_id) WHERE v.turn = v.made"""
)
def version_commits(spark, d):
    """The log of the last version of every chain: only versions made by a commit. Users' turns commit; the versions
    after them carry the same commit file until the next."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    carried = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id").orderBy("turn"))
    versions = turns.withColumn("_made", carried).select("conv_id", "turn", F.when(F.col("_made").isNotNull(), F.sha2(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("_made").cast("string")), 256)).alias("commit"))
    tips = turns.groupBy("conv_id").agg(F.max("turn").alias("turn")).select(F.struct("conv_id", "turn").alias("root"))
    log = tree.ancestors(spark, _chain(turns), tips).select("root.conv_id", F.col("root.turn").alias("last"), F.col("ancestor.turn").alias("turn"), "distance")
    return tree.commits_only(log, versions, "conv_id", "last").select("conv_id", "last", "turn", "commit")


_EDGES_SQL = "e AS (SELECT o_orderkey AS child, o_orderkey // 2 AS parent FROM orders WHERE o_orderkey > 0 UNION SELECT o_orderkey, o_orderkey // 3 FROM orders WHERE o_orderkey > 0 AND o_orderkey % 3 = 0)"
_REACH_SQL = f"WITH RECURSIVE {_EDGES_SQL}, r AS (SELECT 700 AS tip, 700 AS version UNION SELECT 900, 900 UNION SELECT tip, parent FROM r JOIN e ON child = version)"


def _edges(spark, d):
    """A history of versions with one or two parents each."""
    keys = table(spark, d, "orders").where("o_orderkey > 0").select(F.col("o_orderkey").alias("child"))
    halves = keys.select("child", F.floor(F.col("child") / 2).alias("parent"))
    return halves.union(keys.where("child % 3 = 0").select("child", F.floor(F.col("child") / 3).alias("parent"))).distinct()


@R.query(f"{_REACH_SQL} SELECT CAST(version AS BIGINT) AS version FROM r WHERE tip = 900 EXCEPT SELECT version FROM r WHERE tip = 700")
def revision_range(spark, d):
    return tree.revision_range(spark, _edges(spark, d), 700, 900)


@R.query(f"{_REACH_SQL} SELECT CAST(version AS BIGINT) AS version FROM r GROUP BY version HAVING count(*) = 1")
def revision_symmetric(spark, d):
    return tree.revision_range(spark, _edges(spark, d), 700, 900, symmetric=True)


@R.query("WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn FROM c WHERE rn = n // 2 + 1")
def middle_version(spark, d):
    each = Window.partitionBy("conv_id")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(each.orderBy("turn")).alias("rn"), F.count("*").over(each).alias("n"))
    return rows.where("rn = n div 2 + 1").select("conv_id", "turn")


def _level_sql(n: int) -> str:
    return f"l{n} AS MATERIALIZED (SELECT \"offset\" // 2 AS \"offset\", sha256(arg_min(hash, \"offset\") || chr(10) || arg_max(hash, \"offset\") || chr(10)) AS hash FROM l{n - 1} GROUP BY 1 HAVING count(*) = 2)"


_LEVELS = 20
_MERKLE_SQL = "l0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS \"offset\", sha256(text) AS hash FROM documents), " + ", ".join(_level_sql(n) for n in range(1, _LEVELS + 1))
_NODES_SQL = _MERKLE_SQL + ", nodes AS MATERIALIZED (" + " UNION ALL ".join(f'SELECT {n} AS level, "offset", hash FROM l{n}' for n in range(_LEVELS + 1)) + "), k AS (SELECT count(*) AS n FROM documents)"
_PEAKS_SQL = _NODES_SQL + ', p AS (SELECT level, "offset", hash FROM nodes, k WHERE (n >> level) & 1 = 1 AND "offset" = (n >> level) - 1)'


@R.query(f"WITH {_NODES_SQL} SELECT level, CAST(\"offset\" AS BIGINT) AS \"offset\", CAST((2 << level) * \"offset\" + (1 << level) - 1 AS BIGINT) AS bin, hash FROM nodes")
def merkle_nodes(spark, d):
    leaves, n = merkle.document_leaves(spark, d)
    return merkle.build(leaves, n).select("level", "offset", merkle.bin_number(F.col("level"), F.col("offset")).alias("bin"), "hash")


@R.query(f"WITH {_PEAKS_SQL} SELECT level, CAST(\"offset\" AS BIGINT) AS \"offset\", hash FROM p")
def merkle_peaks(spark, d):
    leaves, n = merkle.document_leaves(spark, d)
    return merkle.peaks(merkle.build(leaves, n), n)


@R.query(f"WITH {_PEAKS_SQL} SELECT sha256(string_agg(coalesce(hash, repeat('0', 64)) || chr(10), '' ORDER BY i)) AS root FROM (SELECT unnest(range(32)) AS i) LEFT JOIN p ON level = i")
def merkle_root(spark, d):
    leaves, n = merkle.document_leaves(spark, d)
    return merkle.root(merkle.peaks(merkle.build(leaves, n), n))


@R.query(
    f"""WITH {_PEAKS_SQL}, h AS (SELECT l0."offset" AS idx, p.level AS h FROM l0 JOIN p ON l0."offset" >> p.level = p."offset"), s AS (SELECT idx, unnest(range(h)) AS level FROM h)
SELECT CAST(idx AS BIGINT) AS idx, CAST(s.level AS INTEGER) AS level, hash FROM s JOIN nodes ON nodes.level = s.level AND nodes."offset" = xor(idx >> s.level, 1)"""
)
def merkle_proof(spark, d):
    leaves, n = merkle.document_leaves(spark, d)
    return merkle.proofs(merkle.build(leaves, n), leaves, n)


@R.query(f"WITH {_PEAKS_SQL} SELECT CAST(l0.\"offset\" AS BIGINT) AS idx, p.level AS peak_level, p.hash AS peak FROM l0 JOIN p ON l0.\"offset\" >> p.level = p.\"offset\"")
def merkle_verify(spark, d):
    """Peak that every leaf's proof folds up to."""
    leaves, n = merkle.document_leaves(spark, d)
    return merkle.folded(merkle.proofs(merkle.build(leaves, n), leaves, n), leaves.select("idx", "hash"))


@R.query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def content_dedup(spark, d):
    """Stored contents by their hash."""
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@R.query(
    """WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), p AS (SELECT doc_id, b, unnest(generate_series(0, greatest((octet_length(b) + 1023) // 1024 - 1, 0))) AS i FROM t)
SELECT doc_id, i AS block, 2 * i AS bin, sha256(b[i * 1024 + 1:(i + 1) * 1024]) AS hash FROM p"""
)
def block_hashes(spark, d):
    """Leaves of every text's hash tree: blocks of 1 KiB."""
    return merkle.blocks(table(spark, d, "documents"), "doc_id", "text")


@R.query(
    """WITH r AS (SELECT 'v' || p_size || '.' || p_partkey % 10 AS name, p_partkey AS made FROM part), c AS (SELECT name, min(made) AS made FROM r GROUP BY 1)
SELECT name, made FROM c WHERE name NOT IN (SELECT 'v' || p_size || '.3' FROM part)"""
)
def release_list(spark, d):
    """Releases by name: of those created under one name the first counts, and some are deleted."""
    made = table(spark, d, "part").select(F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string")).alias("name"), F.col("p_partkey").alias("made"))
    gone = table(spark, d, "part").select(F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit(".3")).alias("name")).distinct()
    return tree.releases(made, gone)


QUERIES, ORACLES = R.queries, R.oracles
