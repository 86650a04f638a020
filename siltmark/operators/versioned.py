"""Reads and maintenance of versioned key-value logs (key, offset, value, is_tombstone) and of their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, as_of: int | None = None, start: str = "", end: str = "") -> DataFrame:
    """The newest live version of every key, of offsets up to ``as_of`` and keys in [start, end).

    A key whose newest version is a tombstone is absent. One shuffle, of one pre-aggregated row for each key and
    task; range and offset filters reach the scan.
    """
    if as_of is not None:
        log = log.where(F.col("offset") <= as_of)
    if start:
        log = log.where(F.col("key") >= start)
    if end:
        log = log.where(F.col("key") < end)
    newest = log.groupBy("key").agg(F.max(F.struct("offset", "value", "is_tombstone")).alias("v"))
    return newest.where("not v.is_tombstone").select("key", "v.offset", "v.value")


def merge(*sources: DataFrame) -> DataFrame:
    """K-way merge: all versions of all sources, the newest of each key first seen as latest() sees it."""
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more)
    return out


def keep_versions(log: DataFrame, horizon: int, bottom: bool = True) -> DataFrame:
    """Compaction that live snapshots survive: all versions from ``horizon`` on, and the newest older one of each key.

    An older tombstone goes only at the ``bottom`` level: with deeper files an older value could reappear.
    """
    old = F.col("offset") < horizon
    newest = Window.partitionBy("key", old).orderBy(F.desc("offset"))
    kept = log.withColumn("_rank", F.row_number().over(newest)).where(~old | (F.col("_rank") == 1))
    if bottom:
        kept = kept.where(~old | ~F.col("is_tombstone"))
    return kept.drop("_rank")


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``base`` with rows of ``changes`` put in by ``key``; changes with op 'delete' remove, others replace or insert."""
    rest = base.join(changes.select(key), key, "left_anti")
    return rest.unionByName(changes.where("op <> 'delete'").drop("op"))


def overlaps(files: DataFrame, others: DataFrame, width: int) -> DataFrame:
    """Pairs of files (file, other) whose closed key ranges meet.

    An interval join without a nested loop: both sides are entered in buckets of ``width`` keys, and a pair counts
    in the bucket where the later of the two begins.
    """
    buckets = lambda df: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
    a = buckets(files).select("_b", "file", "first", "last")
    b = buckets(others).select("_b", F.col("file").alias("other"), F.col("first").alias("o_first"), F.col("last").alias("o_last"))
    met = a.join(b, "_b").where("first <= o_last and o_first <= last")
    return met.where(F.col("_b") == F.floor(F.greatest("first", "o_first") / width)).select("file", "other")


def live_files(edits: DataFrame) -> DataFrame:
    """Manifest replay: attributes of each file whose last edit adds it."""
    last = edits.groupBy("file").agg(F.max(F.struct("edit_id", "op", "level", "file_size")).alias("e"))
    return last.where("e.op = 'add'").select("file", "e.level", "e.file_size")


def committed(log: DataFrame, marker: str) -> DataFrame:
    """Rows before the last row of kind ``marker``: what recovery keeps. The bound is one row, pre-aggregated."""
    bound = log.where(F.col("kind") == marker).agg(F.max("offset").alias("_bound"))
    return log.join(F.broadcast(bound), F.col("offset") < F.col("_bound")).drop("_bound")


def internal_key(key, offset):
    """Sort key of a version as hex: the key, a zero byte, and the offset so inverted that newer sorts first."""
    inverted = F.lpad(F.hex(F.lit((1 << 63) - 1) - offset), 16, "0")
    return F.concat(F.hex(F.encode(key, "UTF-8")), F.lit("00"), inverted)


def lookup(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted key (key): whether any version of it is stored, and its newest live value (null without one).

    The log is cut down to the wanted keys before versions are grouped.
    """
    keys = wanted.select("key").distinct()
    held = log.join(keys, "key", "left_semi").groupBy("key").agg(F.max(F.struct("offset", "value", "is_tombstone")).alias("v"))
    live = F.when(~F.col("v.is_tombstone"), F.col("v.value"))
    return keys.join(held, "key", "left").select("key", F.col("v").isNotNull().alias("contained"), live.alias("value"))


def compaction(files: DataFrame, level: int, width: int) -> DataFrame:
    """What compacting a level merges: files (file, level, first, last) with their role, and whether tombstones may go.

    All files of level 0, or of a deeper level the one that meets most files of the next (the first of equals); and
    the files of the next level that its inputs' whole range meets. Tombstones may go where no deeper file meets it.
    """
    own, rest = files.where(F.col("level") == level), files.where(F.col("level") > level)
    if level:
        met = overlaps(own, rest.where(F.col("level") == level + 1), width).groupBy("file").agg(F.count("*").alias("n"))
        best = own.join(met, "file", "left").orderBy(F.desc(F.coalesce("n", F.lit(0))), "file").limit(1).select("file")
        own = own.join(best, "file", "left_semi")
    reach = F.broadcast(own.agg(F.min("first").alias("_first"), F.max("last").alias("_last")))
    hit = rest.crossJoin(reach).where("first <= _last and last >= _first").drop("_first", "_last")
    bottom = F.broadcast(hit.where(F.col("level") > level + 1).agg((F.count("*") == 0).alias("drop_tombstones")))
    merged = own.withColumn("role", F.lit("input")).unionByName(hit.where(F.col("level") == level + 1).withColumn("role", F.lit("target")))
    return merged.select("file", "level", "role").crossJoin(bottom)
