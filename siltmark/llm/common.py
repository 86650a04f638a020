"""Helpers that the corpus operators share: table access, parts, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.sources.durable import stored

#: A side is broadcast only when it was measured to have at most so many rows and bytes (as UTF-8 text of its columns).
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: Spark partitions that parts are dealt to, at most; each then works through its parts one after the other.
MAX_PARTITIONS = 20_000
#: Key of a null doc_id: it is smaller than any other.
FIRST_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the input folder, which may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its rows and bytes are within bounds, else as it is, for a shuffled join."""
    text = F.concat_ws("", *[F.col(c).cast("string") if not t.startswith(("array", "map", "struct", "binary")) else F.hex(c) if t == "binary" else F.to_json(c) for c, t in df.dtypes])
    rows, size = df.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, _d, _h, _t: the text under a key that repeated or null ids share only if their texts are equal too."""
    rows = documents.select("doc_id", F.col("text").cast("string").alias("_t"))
    return rows.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST_ID)).alias("_d"), F.xxhash64("_t").alias("_h"), "_t")


def part_count(documents: DataFrame, bytes_per_part: int) -> int:
    """Parts into which the texts are to be dealt, by their total size."""
    return 1 + int(documents.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0) // bytes_per_part


def dealt(df: DataFrame, part: Column | str, parts: int) -> DataFrame:
    """Rows by part (0 to parts - 1), the parts of a partition one after the other, for part_runs()."""
    part = F.col(part) if isinstance(part, str) else part
    n = min(parts, MAX_PARTITIONS)
    return df.withColumn("part", part).repartitionById(n, (F.col("part") % n).cast("int")).sortWithinPartitions("part")


def part_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(part, its rows) from batches sorted by their first column: memory is that of one part."""
    part, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != part:
                if held:
                    yield part, held
                part, held = row[0], []
            held.append(row[1:])
    if held:
        yield part, held


_kept: dict[str, Callable[[], None]] = {}


def sole_cache(name: str, clear: Callable[[], None]) -> None:
    """Say, in a worker process, that ``name`` keeps a cache from now on: what other operators keep there is dropped.

    Spark reuses workers from one stage to the next, and their caches would add up.
    """
    for other in [n for n in _kept if n != name]:
        _kept.pop(other)()
    _kept[name] = clear


def packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def components(edges: DataFrame, name: str = "components", max_rounds: int = 40) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (id, component), component = smallest id reached.

    Alternating large-star and small-star rounds. A round's minima are grouped with partial results in every task and
    stored before edges meet them: the join is with a table of one row for each id, broadcast while it is small, and
    beyond that one whose edge side can be split where an id has very many edges. Only counts and sums come to the
    driver. Ids without an edge do not appear. Self-loops are ignored; an empty input gives an empty result.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = stored(edges, name)
    mark = None
    for _ in range(max_rounds):
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = both.join(sized(low), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, name)
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(sized(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a <> b").distinct(), name)
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (row[0], row[1]) == mark:
            break
        mark = (row[0], row[1])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(roots)
