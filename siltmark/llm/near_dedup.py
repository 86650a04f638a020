"""MinHash near-dedup by a multi-index Hamming join over b-bit signatures.

A signature has K symbols of B bits, one for each hash function. It is cut into chunks; by pigeonhole two signatures
that differ in at most MAX_DISTANCE symbols have a chunk with at most one differing symbol. Every chunk is entered
once for each place where that one error may be, with the place left out, so such a pair shares an entry.
Pairs of candidates are confirmed on the full shingle sets.

A pair of Jaccard similarity exactly 0.75 differs in more than MAX_DISTANCE of 64 symbols with a chance of about
3e-5 (8e-9 at 0.8); nothing else is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.llm.common import components, sized, sole_cache
from siltmark.sources.durable import stored

#: Words of a shingle.
SHINGLE = 5
#: Symbols of a signature, bits of a symbol, symbols of a chunk.
K, B, CHUNK = 64, 16, 4
CHUNKS = K // CHUNK
#: Largest number of differing symbols for which a common entry is guaranteed: one error in each chunk but for the last.
MAX_DISTANCE = 2 * CHUNKS - 1
#: Linked when LINK_DEN * intersection >= LINK_NUM * union.
LINK_NUM, LINK_DEN = 75, 100
#: Rows of a bucket or cluster that are compared with one another in one task; larger ones are dealt out as pairs of blocks.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 400_000
#: Words whose hashes a worker keeps.
CACHE_WORDS = 500_000

_draw = np.random.default_rng(20240229)
_MULTIPLY = _draw.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _draw.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _draw.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


_words = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles; the whole word sequence is one if it is shorter."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out += h[i : len(words) - n + 1 + i] * _PLACE[i]
    return np.unique(_mix(out))


def signature(found: np.ndarray) -> np.ndarray:
    """K symbols of B bits of a set that is not empty."""
    out = np.empty(K, np.uint64)
    for at in range(0, len(found), 4096):  # a long text in blocks, so that memory stays small
        low = (found[at : at + 4096, None] * _MULTIPLY + _ADD).min(axis=0)
        out = low if at == 0 else np.minimum(out, low)
    return (_mix(out) >> np.uint64(64 - B)).astype(np.uint16)


def entries(symbols: np.ndarray) -> np.ndarray:
    """Index entries of signatures (n, K): (n, CHUNKS * CHUNK) of 64 bits, one for each chunk and left-out place."""
    s = symbols.astype(np.uint64).reshape(len(symbols), CHUNKS, CHUNK)
    out = np.empty((len(symbols), CHUNKS, CHUNK), np.uint64)
    for gap in range(CHUNK):
        key = np.zeros((len(symbols), CHUNKS), np.uint64)
        for i in range(CHUNK):
            if i != gap:
                key = (key << np.uint64(B)) | s[:, :, i]
        # 48 bits of symbols; the chunk and the gap go above them
        out[:, :, gap] = key | (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(gap)) << np.uint64(48)
    return out.reshape(len(symbols), -1)


def first_entry(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of signatures (n, K) the number of the first entry that they share (0 if none)."""
    same = (a == b).reshape(len(a), CHUNKS, CHUNK)
    # all places but one agree: all but at most one do, and the others of the gap
    shared = (same.sum(axis=2)[:, :, None] - same) == CHUNK - 1
    return shared.reshape(len(a), -1).argmax(axis=1)


def signatures(documents: DataFrame) -> DataFrame:
    """For every document: doc_id, n_shingles, c1, c2 (digest of the set), sig (K * B bits; null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("shingles", _words.clear)
        for batch in batches:
            sizes, first, second, sigs = [], [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py())
                digest = xxhash.xxh3_128_intdigest(found.tobytes())
                sizes.append(len(found))
                first.append((digest >> 64) - (1 << 63))
                second.append((digest & ((1 << 64) - 1)) - (1 << 63))
                sigs.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "c1", "c2", "sig"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, c1 bigint, c2 bigint, sig binary")


def _forest(n: int, neighbours) -> list[tuple[int, int]]:
    """Edges of a spanning forest over 0..n-1. neighbours(i, others) gives those of ``others`` that are linked with i."""
    left, out = np.arange(n), []
    while len(left):
        seed, left = left[0], left[1:]
        queue = [seed]
        while queue and len(left):
            i = queue.pop()
            hit = neighbours(i, left)
            if hit.any():
                out += [(i, j) for j in left[hit]]
                queue += list(left[hit])
                left = left[~hit]
    return out


def _deal(rows: DataFrame, sizes: DataFrame, limit: int) -> DataFrame:
    """Give each row (key, id, ...) its tasks: key, part. ``sizes``: key, n (rows), weight (sum of what ``limit`` bounds).

    Groups within ``limit`` are one part. A larger group is cut into blocks, and each pair of blocks is a part: a
    block's rows go to as many parts as the group has blocks, and every two rows of a group meet in some part.
    Groups of one row are left out.
    """
    blocks = F.greatest(F.ceil(F.col("weight") / limit), F.ceil(F.col("n") / BLOCK_ROWS)).cast("int")
    rows = rows.join(sizes.where("n > 1").select("key", blocks.alias("_blocks")), "key")
    mine = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: F.least(o, mine) * F.col("_blocks") + F.greatest(o, mine))
    return rows.withColumn("part", F.explode(parts)).drop("_blocks")


def candidate_edges(sigs: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the ids which pairs within MAX_DISTANCE connect. ``sigs``: id, sig.

    Entries of one document alone are dropped before signatures travel. Within an entry's bucket a spanning forest
    of the near pairs is returned, never all of them; and of that only what no earlier entry connects already: two
    signatures that share an earlier entry are near there too.
    """

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                if part.num_rows:
                    symbols = np.frombuffer(b"".join(x.as_py() for x in part.column(1)), np.uint16).reshape(-1, K)
                    keys = entries(symbols)
                    ids = np.repeat(part.column(0).to_numpy(), keys.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], ["key", "id"])

    keyed = sigs.mapInArrow(enter, "key bigint, id bigint")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"))
    met = _deal(keyed, shared.select("key", "n", F.col("n").alias("weight")), BLOCK_ROWS)
    met = met.select("key", "part", "id").join(sigs.select("id", "sig"), "id")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, sig in _runs(batches):
            symbols = np.frombuffer(b"".join(sig), np.uint16).reshape(-1, K)
            heads = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            ends = np.append(heads[1:], len(keys))
            lead = np.repeat(heads, ends - heads)
            ok = (symbols != symbols[lead]).sum(axis=1) <= MAX_DISTANCE
            a, b = [lead[ok]], [np.flatnonzero(ok)]
            for h in np.unique(lead[~ok]):  # some member is far from its bucket's first
                e = ends[np.searchsorted(heads, h)]
                if e - h > 2:
                    own = symbols[h:e]
                    found = np.array(_forest(e - h, lambda i, rest, own=own: (own[rest] != own[i]).sum(axis=1) <= MAX_DISTANCE), np.int64).reshape(-1, 2)
                    a.append(h + found[:, 0])
                    b.append(h + found[:, 1])
            a, b = np.concatenate(a), np.concatenate(b)
            new = ids[a] != ids[b]
            a, b = a[new], b[new]
            new = first_entry(symbols[a], symbols[b]) == (keys[a, 0] >> 48)
            a, b = ids[a[new]], ids[b[new]]
            edges = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    parts = met.repartition("key", "part").sortWithinPartitions("key", "part", "id").select("key", "part", "id", "sig")
    return parts.mapInArrow(near, "a bigint, b bigint").distinct()


def _runs(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[tuple]:
    """Whole runs of equal (key, part) from batches sorted by them: (n, 2) keys, ids, third column's values."""
    held: list[tuple] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)], axis=1), batch.column(2).to_numpy(), batch.column(3).to_pylist()))
        count += batch.num_rows
        if count < rows:
            continue
        keys, ids, rest = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), list(chain.from_iterable(x[2] for x in held))
        same = (keys == keys[-1]).all(axis=1)
        cut = len(keys) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield keys[:cut], ids[:cut], rest[:cut]
        held, count = [(keys[cut:], ids[cut:], rest[cut:])], len(keys) - cut
    if count:
        yield np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), list(chain.from_iterable(x[2] for x in held))


def linked(sets: list[np.ndarray], symbols: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links among ``sets`` whose signatures are within MAX_DISTANCE, confirmed on full sets."""
    sizes = np.array([len(s) for s in sets])
    ids, place = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(place, kind="stable")
    listed, begins = owner[order], np.searchsorted(place[order], np.arange(len(ids) + 1))

    def neighbours(i: int, rest: np.ndarray) -> np.ndarray:
        close = (symbols[rest] != symbols[i]).sum(axis=1) <= MAX_DISTANCE
        if close.sum() <= 4:
            both = np.array([len(np.intersect1d(sets[i], sets[j], True)) if c else 0 for j, c in zip(rest, close, strict=True)])
        else:
            own = place[starts[i] : starts[i + 1]]
            counts = np.zeros(len(sets), np.int64)
            for at in range(0, len(own), 512):
                counts += np.bincount(np.concatenate([listed[begins[p] : begins[p + 1]] for p in own[at : at + 512]]), minlength=len(sets))
            both = counts[rest]
        return close & (LINK_DEN * both >= LINK_NUM * (sizes[i] + sizes[rest] - both))

    return _forest(len(sets), neighbours)


def confirmed_edges(clusters: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b), as spanning forests, inside clusters of candidates.

    ``clusters``: id, key (cluster), n (shingles); ``texts``: id, text. The sizes of clusters come from n, so texts
    are read once, for the members alone.
    """
    sizes = clusters.groupBy("key").agg(F.count("*").alias("n"), F.sum("n").alias("weight"))
    dealt = stored(_deal(clusters.select("key", "id"), sizes, BLOCK_SHINGLES), "dealt")
    rows = texts.join(sized(dealt), "id")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("shingles", _words.clear)
        for keys, ids, found in _runs(batches, 256):
            sets = [shingles(t) for t in found]
            a, b = [], []
            heads = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            for h, e in zip(heads, np.append(heads[1:], len(keys)), strict=True):
                own = [i for i in range(h, e) if len(sets[i])]
                if len(own) > 1:
                    for i, j in linked([sets[i] for i in own], np.stack([signature(sets[i]) for i in own])):
                        a.append(ids[own[i]])
                        b.append(ids[own[j]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    parts = rows.repartition("key", "part").sortWithinPartitions("key", "part").select("key", "part", "id", "text")
    return parts.mapInArrow(confirm, "a bigint, b bigint")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Groups of near-copies: one row per input row with doc_id, n_shingles, component_id, kept.

    Texts link at a Jaccard similarity of 0.75 or more on five-word shingle sets. component_id is the smallest
    doc_id reachable. A text without words has an empty set and links with nothing. Equal sets are one class from
    the start, however many rows have them. Rows that repeat a doc_id are versions of one document: what links with
    one links with all. A null doc_id joins no group (component_id null) and is kept. Other columns are ignored; an
    empty table gives no rows.
    """
    rows = stored(signatures(documents), "signatures")
    full = rows.where("doc_id is not null and n_shingles > 0")
    classes = stored(full.groupBy("c1", "c2").agg(F.min("doc_id").alias("id"), F.min("sig").alias("sig"), F.min("n_shingles").alias("n")), "classes")
    clusters = components(candidate_edges(classes.select("id", "sig").distinct()), "candidate_clusters")
    clusters = clusters.withColumnRenamed("component", "key").join(classes.groupBy("id").agg(F.max("n").alias("n")), "id")
    # the text of a class is read from the row, or rows, of its smallest id
    texts = documents.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    edges = confirmed_edges(stored(clusters, "clusters"), texts)
    # versions: a doc_id in several classes ties their representatives together
    members = full.join(classes.select("c1", "c2", "id"), ["c1", "c2"]).select("doc_id", "id")
    several = members.groupBy("doc_id").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("doc_id", "low")
    versions = members.join(several, "doc_id").select(F.col("low").alias("a"), F.col("id").alias("b"))
    found = components(edges.unionByName(versions), "links").withColumnRenamed("id", "_rep")
    named = classes.select("c1", "c2", F.col("id").alias("_rep")).join(found, "_rep", "left").select("c1", "c2", F.coalesce("component", "_rep").alias("component"))
    out = rows.join(named, ["c1", "c2"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


#: DuckDB SQL with the rows of near_duplicates(documents), for tables whose doc_id is a key.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + least(len(w), 5) - 1) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""
