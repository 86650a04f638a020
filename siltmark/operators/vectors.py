"""Version vectors and causal logs: merge, compare, what to send, gaps, reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltmark.sources.durable import stored


def merge(*vectors: DataFrame) -> DataFrame:
    """Greatest seq of each source; a source at 0 is present, unlike one that is absent."""
    out = vectors[0].select("src", "seq")
    for v in vectors[1:]:
        out = out.unionByName(v.select("src", "seq"))
    return out.groupBy("src").agg(F.max("seq").alias("seq"))


def _against(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("src", "seq").join(b.select("src", F.col("seq").alias("other")), "src", "left")


def news(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entries of ``a`` that are ahead of ``b``, or not in it."""
    return _against(a, b).where(F.col("seq") > F.coalesce("other", F.lit(-1))).select("src", "seq")


def interest(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sources where ``a`` is ahead of ``b``, with where to start: b's seq, or 0."""
    return _against(a, b).where(F.col("seq") > F.coalesce("other", F.lit(-1))).select("src", F.coalesce("other", F.lit(0)).alias("start"))


def seen(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether ``a`` dominates ``b``."""
    behind = _against(b, a).agg(F.coalesce(F.bool_and(F.coalesce(F.col("other"), F.lit(-1)) >= F.col("seq")), F.lit(True)).alias("seen"))
    return behind


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sources of both vectors where ``a`` is newer."""
    return _against(a, b).where("seq > other").select("src", "seq")


def beyond(packets: DataFrame, vector: DataFrame) -> DataFrame:
    """Packets that a peer with this vector lacks."""
    joined = packets.join(vector.select("src", F.col("seq").alias("_have")), "src", "left")
    return joined.where(F.col("seq") > F.coalesce("_have", F.lit(-1))).drop("_have")


def within(packets: DataFrame, vector: DataFrame) -> DataFrame:
    """Snapshot: packets that the vector covers."""
    return packets.join(vector.select("src", F.col("seq").alias("_have")), "src").where("seq <= _have").drop("_have")


def islands(packets: DataFrame) -> DataFrame:
    """Runs of consecutive packets of each source: src, first, last."""
    order = Window.partitionBy("src").orderBy("seq")
    runs = packets.select("src", "seq").distinct().withColumn("_run", F.col("seq") - F.row_number().over(order))
    return runs.groupBy("src", "_run").agg(F.min("seq").alias("first"), F.max("seq").alias("last")).drop("_run")


def held(packets: DataFrame, references: str = "ref") -> DataFrame:
    """Packets whose referenced packet is absent: src, seq, ref. What causal delivery must hold back."""
    known = packets.select(F.col("src").alias("_s"), F.col("seq").alias("_q"))
    wanting = packets.where(F.col(references).isNotNull())
    return wanting.join(known, (F.col("src") == F.col("_s")) & (F.col(references) == F.col("_q")), "left_anti")


def reach(spark, edges: DataFrame, rounds: int) -> DataFrame:
    """Peers that gossip reaches from each start, and the first round in which it does: start, peer, round."""
    edges.createOrReplaceTempView("_gossip_edges")
    return spark.sql(f"""
        WITH RECURSIVE r(start, peer, round) MAX RECURSION LEVEL {rounds + 1} AS (
          SELECT DISTINCT a, a, 0 FROM _gossip_edges UNION ALL
          SELECT r.start, e.b, r.round + 1 FROM r JOIN _gossip_edges e ON e.a = r.peer WHERE r.round < {rounds})
        SELECT start, peer, min(round) AS round FROM r GROUP BY start, peer""")


def reachable(edges: DataFrame, tips: DataFrame, max_depth: int = 1000) -> DataFrame:
    """Versions that tips (tip, version) reach over edges (child, parent), themselves included: distinct tip, version.

    One semi-naive round for each step: only versions that are new in a round are followed further.
    """
    found = stored(tips.select("tip", "version").distinct(), "reached")
    fresh = found
    for _ in range(max_depth):
        fresh = fresh.join(edges, F.col("version") == F.col("child")).select("tip", F.col("parent").alias("version")).distinct()
        fresh = stored(fresh.join(found, ["tip", "version"], "left_anti"), "reached")
        if fresh.isEmpty():
            return found
        found = found.unionByName(fresh)
    raise RuntimeError(f"versions reach further than {max_depth} steps")


def closures(edges: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Versions (version) that two sets reach, themselves included: version, side (both, only a, only b)."""
    tips = a.select(F.lit(0).alias("tip"), "version").unionByName(b.select(F.lit(1).alias("tip"), "version"))
    sides = reachable(edges, tips).groupBy("version").agg(F.bool_or(F.col("tip") == 0).alias("_a"), F.bool_or(F.col("tip") == 1).alias("_b"))
    return sides.select("version", F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "only a").otherwise("only b").alias("side"))


def heights(edges: DataFrame) -> DataFrame:
    """Distance of every version from the one that it begins with: version, height. ``edges``: child, parent.

    A version whose parent is null, or absent, begins.

    Each round doubles the distance that a version looks back, so a chain of n takes log2(n) joins.
    """
    held = edges.select(F.col("child").alias("_held"))
    edges = edges.join(held, F.col("parent") == F.col("_held"), "left").select("child", F.col("_held").alias("parent"))
    far = stored(edges.select(F.col("child").alias("version"), F.col("parent").alias("up"), F.when(F.col("parent").isNotNull(), 1).otherwise(0).cast("bigint").alias("height")), "heights")
    while not far.where("up is not null").isEmpty():
        above = far.select(F.col("version").alias("_v"), F.col("up").alias("_up"), F.col("height").alias("_h"))
        far = stored(far.join(above, F.col("up") == F.col("_v"), "left").select("version", F.col("_up").alias("up"), (F.col("height") + F.coalesce("_h", F.lit(0))).alias("height")), "heights")
    return far.select("version", "height")


def stack_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Entries (key, place, item) of two stacks of a name that are not in their common beginning: with the side that has them."""
    both = a.select(key, "place", F.col("item").alias("_a")).join(b.select(key, "place", F.col("item").alias("_b")), [key, "place"], "full_outer")
    first = both.where(~F.col("_a").eqNullSafe(F.col("_b"))).groupBy(key).agg(F.min("place").alias("_first"))
    left = both.join(first, key).where(F.col("place") >= F.col("_first"))
    sides = F.array(F.struct(F.lit("a").alias("side"), F.col("_a").alias("item")), F.struct(F.lit("b").alias("side"), F.col("_b").alias("item")))
    return left.select(key, "place", F.inline(sides)).where("item is not null")
