"""Suffix-array dedup: remove every byte covered by a LENGTH-byte string that also starts in a smaller document.

Positions are sampled by content: of the ANCHOR-byte strings inside any LENGTH bytes, the one of smallest hash (the
leftmost of equals) is their anchor, so equal strings have equal anchors at equal places. Three steps follow.

1. Anchors of a slice of documents are sent, once for each slice, to where the same anchors of other slices go; the
   documents that hold an anchor of more than one document learn it, and whether more windows than a shard holds do.
2. Around such anchors the text that they stand for, a window, goes to the anchor's shard, once for each slice. A shard's
   windows get a suffix array by Larsson-Sadakane refinement, common prefixes by Kasai's rule, and for each run of
   LENGTH common bytes the smallest document. Windows of an anchor that is too frequent for one shard stay where they
   are: each slice is a shard of its own, and its sorted strings are sent, by content, to where those of other slices
   go and are merged with them by binary search. What is found is compared byte by byte; hashes only choose the way.
3. Documents learn at which places strings start that a smaller document has, and drop the bytes.

Slices answer for their own copies, so a passage that very many documents share costs each step one record a slice.
The number of parts follows from the size of the corpus, and a task works through its parts one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.llm.common import FIRST_ID, dealt, keyed, packed, part_count, part_runs

#: Bytes of a repeated string, and of an anchor.
LENGTH, ANCHOR = 50, 24
#: Strings that one anchor can stand for, and bytes that they span.
STARTS = LENGTH - ANCHOR + 1
SPAN = LENGTH + STARTS - 1
#: String starts that are worked on at once (longer documents are cut, with overlap).
PIECE = 1 << 20
#: Windows of a shard; with SPAN + 1 symbols each, fewer symbols than 2 ** PLACE_BITS.
SHARD_TEXTS, PLACE_BITS = 20_000, 21
#: Bytes of text for each part, and of a slice whose anchors, or whose windows, are sent together.
PART_BYTES, SLICE_BYTES, WINDOW_SLICE_BYTES = 16 << 20, 24 << 20, 8 << 20
_DOC = np.dtype([("d", "<i8"), ("h", "<i8")])
#: 48 bits of an anchor's hash, its document's place in the slice; how many windows it has there: at most 2 ** n.
_SEEN = np.dtype([("key", "<u8"), ("doc", "<u2"), ("n", "u1")])
#: A window's document (place in a list), where it starts in it, and which of its strings start in a smaller document.
_MASK = np.dtype([("doc", "<u4"), ("at", "<u4"), ("mask", "<u4")])
_KEY = np.dtype([("key", "<u8")])
#: Mark of a frequent anchor, above the 48 bits.
_FREQUENT = np.uint64(1 << 63)
_draw = np.random.default_rng(50)
_ODD = _draw.integers(0, 1 << 63, 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (document's place, offset, bytes), each of about PIECE starts; documents under LENGTH have none."""
    held, size = [], 0
    for at, text in enumerate(texts):
        for offset in range(0, max(len(text) - LENGTH + 1, 0), PIECE):
            part = text[offset : offset + PIECE + LENGTH - 1]
            if held and size + len(part) > PIECE:
                yield held
                held, size = [], 0
            held.append((at, offset, part))
            size += len(part)
    if held:
        yield held


def contexts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of string starts with one anchor: document's place, offset of the first, number, anchor's key, buffer, place in it."""
    for held in _pieces(texts):
        buffer = np.frombuffer(b"".join(p for _, _, p in held) + bytes(SPAN + 16), np.uint8)
        n = len(buffer) - SPAN - 16
        word = np.zeros(n + SPAN, np.uint64)
        for i in range(8):
            word |= buffer[i : i + n + SPAN].astype(np.uint64) << np.uint64(56 - 8 * i)
        low = word[:n] * _ODD[0] + word[8 : n + 8] * _ODD[1] + word[16 : n + 16] * _ODD[2]
        low = hashed = _mix(low)
        place = np.arange(n, dtype=np.int32)
        width = 1
        for step in (1, 2, 4, 8, STARTS - 16):  # widths 2, 4, 8, 16 and STARTS
            other, where = low[step:], place[step:]
            take = other < low[: len(other)]
            low, place = np.where(take, other, low[: len(other)]), np.where(take, where, place[: len(other)])
            width += step
        sizes = np.array([len(p) for _, _, p in held])
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        owner = np.repeat(np.arange(len(held)), sizes - LENGTH + 1)
        starts = np.arange(len(owner)) + np.repeat(begins - np.concatenate([[0], np.cumsum(sizes - LENGTH + 1)[:-1]]), sizes - LENGTH + 1)
        anchor = place[starts]
        head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
        count = np.diff(np.append(head, len(starts)))
        at, offset = np.array([h[0] for h in held]), np.array([h[1] for h in held])
        own = owner[head]
        yield at[own], offset[own] + starts[head] - begins[own], count, hashed[anchor[head]] >> np.uint64(16), buffer, starts[head]


def _pack(found: np.ndarray) -> bytes:
    """Records as bytes: each field's bytes of one place together, compressed; 64-bit fields as steps from one to the next."""
    planes = []
    for name in found.dtype.names:
        own = np.ascontiguousarray(found[name])
        if own.dtype.itemsize == 8:
            own = np.diff(own.view(np.uint64), prepend=np.uint64(0))
        planes.append(own.view(np.uint8).reshape(len(own), own.dtype.itemsize).T.ravel())
    return zstandard.compress(np.concatenate(planes).tobytes(), 1)


def _unpack(blob: bytes, kind: np.dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    out, at = np.zeros(len(raw) // kind.itemsize, kind), 0
    for name in kind.names:
        size = kind[name].itemsize
        own = np.ascontiguousarray(raw[at : at + size * len(out)].reshape(size, -1).T).view(kind[name]).ravel()
        out[name] = np.cumsum(own.view(np.uint64), dtype=np.uint64).view(kind[name]) if size == 8 else own
        at += size * len(out)
    return out


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, list[bytes], pa.RecordBatch]]:
    """(keys of documents, texts, rows) of slices of about ``size`` bytes and at most 10,000 rows; columns _d, _h, _t first."""
    for batch in batches:
        texts = [(x.as_py() or "").encode("utf-8", "replace") for x in batch.column(2)]
        ends = np.cumsum([len(t) for t in texts])
        at = 0
        while at < len(texts):
            end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            end = min(max(end, at + 1), at + 10_000, len(texts))
            docs = np.zeros(end - at, _DOC)
            docs["d"], docs["h"] = batch.column(0).to_numpy()[at:end], batch.column(1).to_numpy()[at:end]
            yield docs, texts[at:end], batch.slice(at, end - at)
            at = end


def _groups(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of the runs of equal values."""
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    for h, e in zip(heads, np.append(heads[1:], len(values))[: len(heads)], strict=True):
        yield int(values[h]), int(h), int(e)


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places that have it), in the places' order."""
    order = np.argsort(part, kind="stable")
    for p, s, e in _groups(part[order]):
        yield p, order[s:e]


# ---- step 1: which anchors several documents have


_SENT = pa.schema([("part", pa.int64()), ("slice", pa.int64()), ("docs", pa.binary()), ("x", pa.binary())])
_SENT_SQL = "part bigint, slice bigint, docs binary, x binary"


def _send_anchors(parts: int):
    """Anchors by part; for the slice itself its documents, and those of its anchors that several of them have.

    A slice is named by its documents, so one that is made anew after a loss is the same slice or another one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, texts, _ in _slices(batches, SLICE_BYTES):
            keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for at, _, _, key, _, _ in contexts(texts):
                keys.append(key)
                owners.append(at)
            key, own = np.concatenate(keys), np.concatenate(owners).astype(np.uint64)
            both = np.sort(key << np.uint64(16) | own)  # 48 bits and 16
            key, own = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.uint16)
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
            size = np.diff(np.append(head, len(key)))
            found = np.zeros(len(key), _SEEN)
            found["key"], found["doc"] = key, own
            last = np.append(head[1:], len(key))[: len(head)] - 1
            several = np.repeat(own[head] != own[last], size)
            fresh = np.concatenate([[True], both[1:] != both[:-1]])[: len(key)]
            mine = xxhash.xxh3_64_intdigest(docs.tobytes()) - (1 << 63)
            rows = [(parts + mine % parts, mine, docs.tobytes(), _pack(found[several & fresh]))]
            sent = found[head]
            sent["n"] = np.ceil(np.log2(size)).astype(np.uint8) if len(size) else 0
            rows += [(p, mine, None, _pack(sent[chosen])) for p, chosen in _by_part((key[head] % np.uint64(parts)).astype(np.int64))]
            yield packed(rows, _SENT)

    return run


def _meet_anchors(parts: int):
    """Back to each slice the anchors that others sent too, or that have more windows than a shard; those are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in part_runs(batches):
            if part >= parts:
                yield packed([(part, *r) for r in rows], _SENT)
                continue
            each = [_unpack(r[2], _SEEN) for r in rows]
            found, sender = np.concatenate(each), np.repeat(np.arange(len(rows)), [len(x) for x in each])
            key = found["key"]
            order = np.argsort(key)
            key = key[order]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
            size = np.diff(np.append(head, len(key)))
            frequent = np.add.reduceat(np.int64(1) << found["n"][order].astype(np.int64), head) > SHARD_TEXTS
            told = np.repeat((size > 1) | frequent, size)
            order, marks = order[told], np.repeat(frequent, size)[told]
            answer = found[order].copy()
            answer["n"] = marks
            out = []
            for s, chosen in _by_part(sender[order]):
                out.append((parts + rows[s][0] % parts, rows[s][0], None, _pack(answer[chosen])))
            yield packed(out, _SENT)

    return run


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of a slice that shares anchors: their keys, frequent ones marked."""
    schema = pa.schema([("d", pa.int64()), ("h", pa.int64()), ("keys", pa.binary())])
    for _, rows in part_runs(batches):
        by_slice: dict[int, list[tuple]] = {}
        for name, docs, x in rows:
            by_slice.setdefault(name, []).append((docs, _unpack(x, _SEEN)))
        for own in by_slice.values():
            docs = next((np.frombuffer(d, _DOC) for d, _ in own if d is not None), None)
            if docs is None:
                raise RuntimeError("a slice's documents are not those that were sent: the input gives other rows each time it is read")
            found = np.concatenate([x for _, x in own])
            key = found["key"]
            frequent = np.unique(key[found["n"] > 0]) if any(d is None for d, _ in own) else key[:0]
            key = np.where(np.isin(key, frequent), key | _FREQUENT, key)
            order = np.argsort(found["doc"], kind="stable")
            key = key[order]
            out = [(int(docs["d"][d]), int(docs["h"][d]), _pack(np.unique(key[s:e]).view(_KEY))) for d, s, e in _groups(found["doc"][order])]
            for at in range(0, len(out), 5000):
                yield packed(out[at : at + 5000], schema)


# ---- step 2: suffix arrays


def _texts_of(buffer: np.ndarray, starts: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Windows as rows of SPAN bytes, zero beyond their end, their number of strings in the last of SPAN + 4."""
    rows = np.zeros((len(starts), SPAN + 4), np.uint8)
    rows[:, :SPAN] = buffer[starts[:, None] + np.arange(SPAN)]
    rows[:, :SPAN] *= np.arange(SPAN) < (count + LENGTH - 1)[:, None]
    rows[:, SPAN] = count
    return rows


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(rows).view(np.uint64)
    return _mix((words * _ODD[: words.shape[1]]).sum(axis=1, dtype=np.uint64))


def suffix_array(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix order over texts laid end to end, by Larsson-Sadakane refinement.

    ``symbols``: 1 to 256 inside a text, 0 at its end; ``ends``: for each place that of its text's end. Sorted by 4
    symbols at first; then every group of equals is sorted by the rank of what follows, doubling the depth, until the
    texts of a group have ended; groups of one are not touched again. A suffix ends with its text: equal ones keep the
    order of their texts, as Kasai's rule needs. Key and place are sorted as one number: fewer than 2 ** PLACE_BITS.
    """
    n = len(symbols)
    if n >= 1 << PLACE_BITS:
        raise ValueError("too many symbols for one shard")
    bits, mask = np.int64(PLACE_BITS), np.int64((1 << PLACE_BITS) - 1)
    padded = np.concatenate([symbols, np.zeros(4, symbols.dtype)]).astype(np.int64)
    part = padded[:n]
    key = part.copy()
    for i in range(1, 4):
        part = np.where(part > 0, padded[i : i + n], 0)
        key = key << 9 | part
    both = np.sort(key << bits | np.arange(n))
    order, key = both & mask, both >> bits
    head = np.concatenate([[True], key[1:] != key[:-1]])[:n]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = 4
    while True:
        size = np.diff(np.append(np.flatnonzero(head), n))
        slots = np.flatnonzero(np.repeat(size > 1, size))
        at = order[slots]
        live = ends[at] - at >= h  # a group that has ended is one of equal suffixes
        slots, at = slots[live], at[live]
        if not len(slots):
            return order
        both = np.sort(rank[at] << 2 * bits | rank[at + h] << bits | at)
        order[slots] = at = both & mask
        key = both >> bits
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        head[slots] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0))
        h *= 2


def kasai(symbols: np.ndarray, order: np.ndarray, begins: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Common prefix of suffixes with the one before in ``order``: for each text its first ``columns``, (texts, most).

    Kasai's rule: a suffix's common prefix is at most one shorter than that of the suffix one symbol before. The texts
    are independent chains, so all go on side by side.
    """
    before = np.full(len(symbols), -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros((len(begins), int(columns.max()) if len(columns) else 0), np.int64)
    h = np.zeros(len(begins), np.int64)
    for j in range(out.shape[1]):
        own = np.flatnonzero(columns > j)
        here = begins[own] + j
        there = before[here]
        h[own] = np.where(there >= 0, np.maximum(h[own] - 1, 0), 0)
        live = own[there >= 0]
        there = there[there >= 0]
        while len(live):
            a, b = symbols[begins[live] + j + h[live]], symbols[there + h[live]]
            same = (a == b) & (a != 0)
            live, there = live[same], there[same]
            h[live] += 1
        out[own, j] = h[own]
    return out


def smallest_document(rows: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each string of each window of a shard the smallest document that holds it, (windows, STARTS); absent strings get their own.

    Also windows and columns of all strings in their order.
    """
    count = rows[:, SPAN].astype(np.int64)
    width = count + LENGTH
    begins = np.cumsum(width) - width
    inside = np.arange(SPAN + 1) < (width - 1)[:, None]
    symbols = np.zeros(int(width.sum()), np.int16)
    row, column = np.nonzero(inside)
    symbols[begins[row] + column] = rows[row, column].astype(np.int16) + 1
    owner = np.repeat(np.arange(len(rows)), width)
    order = suffix_array(symbols, (begins + width - 1)[owner])
    common = kasai(symbols, order, begins, count)
    row = owner[order]
    column = order - begins[row]
    whole = column < count[row]
    row, column = row[whole], column[whole]
    # what stands between two whole strings is a shorter suffix, whose common prefixes are too short to join them
    head = np.flatnonzero(common[row, column] < LENGTH)
    low = np.minimum.reduceat(documents[row], head)
    out = np.repeat(documents[:, None], STARTS, axis=1)
    out[row, column] = np.repeat(low, np.diff(np.append(head, len(row))))
    return out, row, column


def distinct_windows(rows: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """For each window the number of the first equal one, of the smallest document; equal means byte by byte."""
    digest = _hash_rows(rows)
    order = np.lexsort((documents, digest))
    head = np.flatnonzero(np.concatenate([[True], digest[order][1:] != digest[order][:-1]])[: len(order)])
    first = np.repeat(order[head], np.diff(np.append(head, len(order))))
    out = np.empty(len(rows), np.int64)
    out[order] = np.where((rows[order] == rows[first]).all(axis=1), first, order)
    return out


def smaller_elsewhere(rows: np.ndarray, documents: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which strings of each window start in a smaller document: bits of an unsigned number for each window.

    Equal windows are sorted once, under the smallest of their documents. Shards are of whole anchors; an anchor has
    no more windows than a shard holds.
    """
    first = distinct_windows(rows, documents)
    kept, place = np.unique(first, return_inverse=True)
    low = np.empty((len(kept), STARTS), np.int64)
    order = np.argsort(keys[kept], kind="stable")
    at = 0
    for _, s, e in [*_groups(keys[kept][order]), (0, len(kept), len(kept) + 2 * SHARD_TEXTS)]:
        if e - at > SHARD_TEXTS and s > at:
            chosen = kept[order[at:s]]
            low[order[at:s]] = smallest_document(rows[chosen], documents[chosen])[0]
            at = s
    low = low[place]
    mask = ((low < documents[:, None]) @ (np.uint32(1) << np.arange(STARTS, dtype=np.uint32))).astype(np.uint32)
    return mask & ((np.uint32(1) << rows[:, SPAN].astype(np.uint32)) - np.uint32(1))


def _strings(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Strings as values that sort like their bytes; a mark at their end keeps zero bytes."""
    out = np.ones((len(rows), LENGTH + 1), np.uint8)
    out[:, :LENGTH] = rows[np.arange(len(rows))[:, None], columns[:, None] + np.arange(LENGTH)]
    return out.view(f"S{LENGTH + 1}").ravel()


def merged(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted strings of several shards as one sorted list of distinct ones, each with its smallest document.

    Two lists at a time: the places of one in the other are found by binary search.
    """
    for i, (strings, low) in enumerate(lists):
        head = np.flatnonzero(np.concatenate([[True], strings[1:] != strings[:-1]])[: len(strings)])
        lists[i] = (strings[head], np.minimum.reduceat(low, head)) if len(strings) else (strings, low)
    while len(lists) > 1:
        paired = []
        for (a, low_a), (b, low_b) in zip(lists[::2], lists[1::2], strict=False):
            at = np.searchsorted(a, b)
            known = (at < len(a)) & (a[np.minimum(at, len(a) - 1)] == b) if len(a) else np.zeros(len(b), bool)
            low_a = low_a.copy()
            low_a[at[known]] = np.minimum(low_a[at[known]], low_b[known])
            paired.append((np.insert(a, at[~known], b[~known]), np.insert(low_a, at[~known], low_b[~known])))
        lists = paired + lists[len(lists) - len(lists) % 2 :]
    return lists[0]


_WINDOWS = pa.schema([("part", pa.int64()), ("kind", pa.string()), ("docs", pa.binary()), ("x", pa.binary()), ("text", pa.binary())])
_WINDOWS_SQL = "part bigint, kind string, docs binary, x binary, text binary"
#: A window that is sent: document, start, bits of its anchor's hash; a string: the same, and its place in the window.
_SHIPPED = np.dtype([("doc", "<u4"), ("at", "<u4"), ("anchor", "<u4"), ("column", "u1")])


def _rows_of(kind: str, docs: np.ndarray, found: np.ndarray, part: np.ndarray, text: np.ndarray | None = None) -> list[tuple]:
    """Rows of one kind by part, each with the documents that it needs."""
    out = []
    for p, chosen in _by_part(part):
        own = found[chosen].copy()
        used, own["doc"] = np.unique(own["doc"], return_inverse=True)
        blob = None if text is None else zstandard.compress(np.ascontiguousarray(text[chosen]).tobytes(), 3)
        out.append((p, kind, _pack(docs[used]), _pack(own), blob))
    return out


def _answers(kind: str, docs: np.ndarray, doc: np.ndarray, at: np.ndarray, mask: np.ndarray, parts: int) -> list[tuple]:
    """Rows for the parts of documents, numbered from ``parts`` on."""
    found = np.zeros(len(doc), _MASK)
    found["doc"], found["at"], found["mask"] = doc, at, mask
    return _rows_of(kind, docs, found, parts + (docs["d"][doc] ^ docs["h"][doc]) % parts)


def _send_windows(parts: int):
    """For rows (_d, _h, _t, keys): windows of shared anchors by part, and answers for windows that the slice has in a smaller document.

    A document's repeats of a window are sent as the place of the first (kind "same").
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, texts, batch in _slices(batches, WINDOW_SLICE_BYTES):
            salt = _mix(np.arange(1, len(docs) + 1, dtype=np.uint64)) & ~_FREQUENT
            shared = [np.zeros(0, np.uint64)]
            for at, blobs in enumerate(batch.column(3).to_pylist()):
                shared += [_unpack(blob, _KEY)["key"] ^ salt[at] for blob in blobs]
            shared = np.concatenate(shared)
            frequent = shared & _FREQUENT > 0
            shared = shared & ~_FREQUENT
            order = np.argsort(shared)
            shared, frequent = shared[order], frequent[order]
            texts_, found, often, keys = [np.zeros((0, SPAN + 4), np.uint8)], [np.zeros(0, _SHIPPED)], [np.zeros(0, bool)], [np.zeros(0, np.uint64)]
            for at, offset, count, key, buffer, place in contexts(texts):
                probe = key ^ salt[at]
                near = np.minimum(np.searchsorted(shared, probe), max(len(shared) - 1, 0))
                hit = np.flatnonzero(shared[near] == probe) if len(shared) else np.zeros(0, np.int64)
                own = np.zeros(len(hit), _SHIPPED)
                own["doc"], own["at"], own["anchor"] = at[hit], offset[hit], key[hit] & np.uint64(0xFFFFFFFF)
                keys.append(key[hit])
                texts_.append(_texts_of(buffer, place[hit], count[hit]))
                found.append(own)
                often.append(frequent[near[hit]] if len(shared) else np.zeros(0, bool))
            text, found, often, keys = np.concatenate(texts_), np.concatenate(found), np.concatenate(often), np.concatenate(keys)
            ids = docs["d"][found["doc"]]
            first = distinct_windows(text, ids)
            every = (np.uint32(1) << text[:, SPAN].astype(np.uint32)) - np.uint32(1)
            settled = ids > ids[first]
            out = _answers("mask", docs, found["doc"][settled], found["at"][settled], every[settled], parts)
            # the first of each document's equal windows
            order = np.lexsort((found["at"], found["doc"], first))
            fresh = np.concatenate([[True], (first[order][1:] != first[order][:-1]) | (found["doc"][order][1:] != found["doc"][order][:-1])])[: len(order)]
            lead = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))] if len(order) else order
            again = ~fresh & ~settled[order] & (ids[order] != FIRST_ID)
            out += _answers("same", docs, found["doc"][order[again]], found["at"][order[again]], found["at"][lead[again]], parts)
            ship = np.zeros(len(found), bool)
            ship[order[fresh]] = True
            ship &= ~settled
            # nothing is smaller than a null id: of its equal windows one is enough
            ship &= (ids != FIRST_ID) | (first == np.arange(len(first)))
            rare = np.flatnonzero(ship & ~often)
            out += _rows_of("window", docs, found[rare], (keys[rare] % np.uint64(parts)).astype(np.int64), text[rare])
            often = np.flatnonzero(ship & often)
            for at in range(0, len(often), SHARD_TEXTS):
                own = often[at : at + SHARD_TEXTS]
                low, row, column = smallest_document(text[own], ids[own])
                mask = ((low < ids[own][:, None]) @ (np.uint32(1) << np.arange(STARTS, dtype=np.uint32))).astype(np.uint32) & every[own]
                out += _answers("mask", docs, found["doc"][own[mask > 0]], found["at"][own[mask > 0]], mask[mask > 0], parts)
                open_ = low[row, column] == ids[own][row]
                row, column = row[open_], column[open_]
                sent = found[own[row]].copy()
                sent["column"] = column
                strings = text[own[row]][np.arange(len(row))[:, None], column[:, None] + np.arange(LENGTH)]
                wide = np.zeros((len(row), 56), np.uint8)
                wide[:, :LENGTH] = strings
                out += _rows_of("string", docs, sent, (_hash_rows(wide) % np.uint64(parts)).astype(np.int64), strings)
            yield packed(out, _WINDOWS)

    return run


def _gathered(rows: list[tuple], kind: np.dtype) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Documents and records of several rows as one list of each, and the number of records of each row."""
    docs, found, sizes, base = [np.zeros(0, _DOC)], [np.zeros(0, kind)], [], 0
    for _, d, x, _ in rows:
        own = _unpack(x, kind)
        own["doc"] += base
        docs.append(_unpack(d, _DOC))
        base += len(docs[-1])
        found.append(own)
        sizes.append(len(own))
    return np.concatenate(docs), np.concatenate(found), sizes


def _meet_windows(parts: int):
    """Answers for the windows and strings of each part; rows for parts of documents pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in part_runs(batches):
            if part >= parts:
                yield packed([(part, *r) for r in rows], _WINDOWS)
                continue
            out = []
            own = [r for r in rows if r[0] == "window"]
            if own:
                docs, found, _ = _gathered(own, _SHIPPED)
                text = np.concatenate([np.frombuffer(zstandard.decompress(r[3]), np.uint8).reshape(-1, SPAN + 4) for r in own])
                mask = smaller_elsewhere(text, docs["d"][found["doc"]], found["anchor"])
                hit = mask > 0
                out += _answers("mask", docs, found["doc"][hit], found["at"][hit], mask[hit], parts)
            own = [r for r in rows if r[0] == "string"]
            if own:
                docs, found, sizes = _gathered(own, _SHIPPED)
                text = np.concatenate([np.frombuffer(zstandard.decompress(r[3]), np.uint8).reshape(-1, LENGTH) for r in own])
                strings, ids, cuts = _strings(text, np.zeros(len(text), np.int64)), docs["d"][found["doc"]], np.cumsum(sizes)[:-1]
                known, low = merged(list(zip(np.split(strings, cuts), np.split(ids, cuts), strict=True)))
                hit = low[np.searchsorted(known, strings)] < ids
                out += _answers("mask", docs, found["doc"][hit], found["at"][hit], np.uint32(1) << found["column"][hit].astype(np.uint32), parts)
            yield packed(out, _WINDOWS)

    return run


# ---- step 3: what documents drop


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of a part: starts of windows and masks of the strings that go."""
    schema = pa.schema([("d", pa.int64()), ("h", pa.int64()), ("masks", pa.binary())])
    for _, rows in part_runs(batches):
        docs, found, _ = _gathered([r for r in rows if r[0] == "mask"], _MASK)
        if not len(found):
            continue
        others, same, _ = _gathered([r for r in rows if r[0] == "same"], _MASK)
        docs, which = np.unique(np.concatenate([docs, others]), return_inverse=True)
        whose = lambda x, base: which[x["doc"].astype(np.int64) + base].astype(np.uint64) << np.uint64(32)
        name, base = whose(found, 0) | found["at"], len(which) - len(others)
        order = np.argsort(name)
        name, mask = name[order], found["mask"][order]
        head = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        name, mask = name[head], np.bitwise_or.reduceat(mask, head)
        lead = whose(same, base) | same["mask"]
        near = np.minimum(np.searchsorted(name, lead), len(name) - 1)
        hit = name[near] == lead
        name, mask = np.concatenate([name, (whose(same, base) | same["at"])[hit]]), np.concatenate([mask, mask[near[hit]]])
        order = np.argsort(name)
        name, mask = name[order], mask[order]
        both = np.stack([(name & np.uint64(0xFFFFFFFF)).astype(np.uint32), mask], axis=1)
        out = [(int(docs["d"][d]), int(docs["h"][d]), both[s:e].tobytes()) for d, s, e in _groups((name >> np.uint64(32)).astype(np.int64))]
        for at in range(0, len(out), 5000):
            yield packed(out[at : at + 5000], schema)


def _drop_bytes(keep_text: bool):
    """For rows (doc_id, text, masks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, hashes, kept_texts = [], [], [], [], []
            for text, masks in zip(batch.column(1), batch.column(2), strict=True):
                kept = text = (text.as_py() or "").encode("utf-8", "replace")
                n_removed = n_spans = 0
                if masks.is_valid:
                    at, mask = np.frombuffer(masks.as_py(), np.uint32).reshape(-1, 2).T
                    row, column = np.nonzero((mask[:, None] >> np.arange(STARTS, dtype=np.uint32)) & np.uint32(1))
                    starts = at[row].astype(np.int64) + column
                    edge = np.bincount(starts, minlength=len(text) + 1) - np.bincount(starts + LENGTH, minlength=len(text) + 1)
                    gone = np.cumsum(edge[:-1]) > 0
                    n_removed = int(gone.sum())
                    n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                sizes.append(len(text))
                removed.append(n_removed)
                spans.append(n_spans)
                hashes.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept if keep_text else None)
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(hashes, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(kept_texts, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeated_bytes(documents: DataFrame, keep_text: bool = True) -> DataFrame:
    """Drop from every text the bytes covered by LENGTH-byte strings that also start in a smaller document.

    One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256[, kept]. Strings are
    judged on the input; they never cross documents; a null text is empty, and a text under LENGTH bytes keeps all. A
    null doc_id is smaller than any other; rows that repeat a doc_id do not count as smaller than one another. Other
    columns are ignored; an empty table gives no rows.
    """
    parts = part_count(documents, PART_BYTES)
    rows = keyed(documents)
    key = ["_d", "_h"]
    sent = rows.select(*key, "_t").mapInArrow(_send_anchors(parts), _SENT_SQL)
    met = dealt(sent, "part", 2 * parts).mapInArrow(_meet_anchors(parts), _SENT_SQL)
    shared = dealt(met, F.col("part") - parts, parts).mapInArrow(_learn, "d bigint, h bigint, keys binary")
    # slices that repeat rows tell the same document twice
    shared = shared.groupBy(F.col("d").alias("_d"), F.col("h").alias("_h")).agg(F.collect_list("keys").alias("keys"))
    # doc_id goes along so that both joins have one and the same shuffle of the texts
    asked = rows.join(shared, key).select(*key, "_t", "keys", "doc_id")
    windows = asked.mapInArrow(_send_windows(parts), _WINDOWS_SQL)
    found = dealt(windows, "part", 2 * parts).mapInArrow(_meet_windows(parts), _WINDOWS_SQL)
    masks = dealt(found, F.col("part") - parts, parts).mapInArrow(_gather, "d bigint, h bigint, masks binary")
    masks = masks.select(F.col("d").alias("_d"), F.col("h").alias("_h"), "masks")
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if keep_text else "")
    return rows.join(masks, key, "left").select("doc_id", "_t", "masks").mapInArrow(_drop_bytes(keep_text), schema)
