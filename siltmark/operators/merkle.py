"""Merkle trees over numbered blocks: nodes, peaks, root, proofs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.sources.durable import stored
from siltmark.sources.tables import table

#: Levels that a tree may have, and those that one pass makes.
LEVELS, FOLD = 32, 10
#: Bytes of a block.
BLOCK = 1024
#: Ranges of keys in which rows are numbered.
NUMBER_RANGES = 100_000
ZERO = "0" * 64


def bin_number(level: Column, offset: Column) -> Column:
    """In-order place of a node: 2^(level + 1) * offset + 2^level - 1."""
    one = F.lit(1).cast("bigint")
    return F.call_function("shiftleft", one, level + 1) * offset + F.call_function("shiftleft", one, level) - 1


def parent_hash(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(left, F.lit("\n"), right, F.lit("\n")), 256)


def number(df: DataFrame, order: str) -> DataFrame:
    """Add idx, rows numbered from 0 by ``order``, a whole number that must be unique.

    Rows are numbered inside NUMBER_RANGES ranges of equal width at most, and shifted by the sizes of the ranges
    before: no order runs through one task but that of one small row for each range.
    """
    low, high = df.agg(F.min(order), F.max(order)).first()
    width = ((high or 0) - (low or 0)) // NUMBER_RANGES + 1
    ranged = df.withColumn("_part", F.floor((F.col(order) - F.lit(low or 0)) / F.lit(width)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return ranged.withColumn("_i", inside).join(F.broadcast(sizes), "_part").withColumn("idx", F.col("_i") + F.col("_shift")).drop("_part", "_i", "_shift")


def _fold(level: DataFrame, first: int) -> DataFrame:
    """Complete nodes of levels first + 1 to first + FOLD over a level (offset, hash): level, offset, hash.

    A group of 2 ** FOLD neighbours is one array, halved FOLD times inside its task.
    """
    groups = level.groupBy(F.shiftright("offset", FOLD).alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", "hash"))), lambda x: x["hash"]).alias("l0"))

    def halved(below: Column) -> Column:
        places = F.sequence(F.lit(1), F.floor(F.size(below) / 2).cast("int"))
        pairs = F.transform(places, lambda i: parent_hash(F.element_at(below, 2 * i - 1), F.element_at(below, 2 * i)))
        return F.when(F.size(below) > 1, pairs).otherwise(F.array().cast("array<string>"))

    def made(k: int) -> Column:
        return F.transform(f"l{k}", lambda h, i: F.struct(F.lit(first + k).alias("level"), (F.shiftleft("g", FOLD - k) + i).alias("offset"), h.alias("hash")))

    for k in range(1, FOLD + 1):
        groups = groups.withColumn(f"l{k}", halved(F.col(f"l{k - 1}")))
    return groups.select(F.inline(F.concat(*[made(k) for k in range(1, FOLD + 1)])))


def build(leaves: DataFrame, count: int) -> DataFrame:
    """All complete nodes over ``count`` leaves (idx, hash): level, offset, hash.

    FOLD levels are made in one grouped pass, so a billion leaves take three; each pass is stored, and the next one
    starts from its top level.
    """
    out = stored(leaves.select(F.lit(0).alias("level"), F.col("idx").alias("offset"), "hash"), "merkle")
    last = out
    for first in range(0, max(count.bit_length() - 1, 0), FOLD):
        last = stored(_fold(last.where(F.col("level") == first).select("offset", "hash"), first), "merkle")
        out = out.unionByName(last)
    return out


def peaks(nodes: DataFrame, count: int) -> DataFrame:
    """Roots of the maximal complete subtrees: one for each bit of ``count``, at the offset that its higher bits give."""
    wanted = [(k, (count >> k) - 1) for k in range(LEVELS) if count >> k & 1]
    cond = F.lit(False)
    for k, offset in wanted:
        cond = cond | ((F.col("level") == k) & (F.col("offset") == offset))
    return nodes.where(cond)


def root(peak_nodes: DataFrame) -> DataFrame:
    """SHA-256 of the 32 peak cells, a line each, zeros where there is none."""
    cells = F.map_from_entries(F.collect_list(F.struct("level", "hash")))
    filled = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.concat(F.coalesce(F.try_element_at("m", k), F.lit(ZERO)), F.lit("\n")))
    return peak_nodes.agg(cells.alias("m")).select(F.sha2(F.array_join(filled, ""), 256).alias("root"))


def proofs(nodes: DataFrame, leaves: DataFrame, count: int) -> DataFrame:
    """Siblings on the way from each leaf (idx) to its peak: idx, level, hash."""
    tops = [(k, (count >> k) - 1) for k in range(LEVELS) if count >> k & 1]
    # the peak above a leaf is the first whose subtree ends after it
    height = F.lit(0)
    for k, offset in tops:
        height = F.when((F.col("idx") >= offset << k) & (F.col("idx") < (offset + 1) << k), k).otherwise(height)
    steps = leaves.select("idx", height.alias("h")).where("h > 0").select("idx", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("level"))
    sibling = F.call_function("shiftright", F.col("idx"), F.col("level")).bitwiseXOR(F.lit(1).cast("bigint"))
    return steps.withColumn("offset", sibling).join(nodes, ["level", "offset"]).select("idx", "level", "hash")


def folded(proof: DataFrame, leaves: DataFrame) -> DataFrame:
    """Peak hash that each leaf and its proof give: idx, peak_level, peak."""
    path = proof.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("level", "hash"))).alias("p"))
    step = lambda acc, s: F.when(F.call_function("shiftright", F.col("idx"), s["level"]) % 2 == 0, parent_hash(acc, s["hash"])).otherwise(parent_hash(s["hash"], acc))
    both = leaves.join(path, "idx", "left").withColumn("p", F.coalesce("p", F.array().cast("array<struct<level:int,hash:string>>")))
    return both.select("idx", F.size("p").alias("peak_level"), F.aggregate("p", F.col("hash"), step).alias("peak"))


def document_leaves(spark, sf_dir: str) -> tuple[DataFrame, int]:
    """Leaves of the documents by id, and their number."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return number(docs, "doc_id"), docs.count()


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks of BLOCK bytes of every text: key, block (from 0), bin (its place among its tree's nodes), hash. An empty text has one."""
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    cut = df.select(key, data.alias("_b")).select(key, "_b", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("_b") / BLOCK).cast("int") - 1, F.lit(0)))).alias("_i"))
    part = F.call_function("substring", F.col("_b"), F.col("_i") * BLOCK + 1, F.lit(BLOCK))
    return cut.select(key, F.col("_i").cast("bigint").alias("block"), bin_number(F.lit(0), F.col("_i").cast("bigint")).alias("bin"), F.sha2(part, 256).alias("hash"))
