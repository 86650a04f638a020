"""Substring dedup by sliding sentence spans.

Every run of several consecutive sentences is hashed; runs are joined over the whole corpus; the sentences of a run
that occurred before - in a document of smaller id, or earlier in the same one - are removed.

Hashes travel in packed arrays, to parts whose number follows from the size of the corpus. A batch of documents
settles its own repeats and sends each hash once, so a passage that very many documents share costs the join one
record a batch. Answers are packed too and gathered, so that one row for each document meets the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.llm.common import dealt, keyed, packed, part_count, part_runs, sole_cache

#: A span is the shortest run from a sentence on with at least so many sentences and so many words.
SPAN_SENTENCES, SPAN_WORDS = 2, 20
#: Words of a sentence that is left whole. A longer one - text without marks - is cut after the word of smallest hash
#: of every WORD_CUT in a row (the first of equals), so it is cut alike wherever it stands but for the first
#: WORD_CUT - 1 and last WORD_CUT words; its pieces have at most WORD_CUT words.
#: What stands before a passage moves nothing beyond its first sentence, or first 2 * WORD_CUT - 1 words of one that
#: is cut. So a passage of over 50 words that ends with a sentence holds SPAN_WORDS of whole sentences, two at least:
#: it holds a span wherever it stands.
LONG_SENTENCE, WORD_CUT = 24, 8
#: Bytes of text for each part of the hashes.
PART_BYTES = 16 << 20
#: A sentence ends after . ! or ? before white space, and at a line's end.
_END = re.compile(r"[.!?](?=\s|\Z)|\n")
_WORD = re.compile(r"\S+")


class _Hashes(dict):
    """Word -> its hash; a bounded number is kept."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return out


_hashes = _Hashes()


def _smallest(hashes: list[int]) -> list[int]:
    """Places of the smallest of every WORD_CUT hashes in a row, the first of equals, in order."""
    out, k = [], -1
    for i in range(len(hashes) - WORD_CUT + 1):
        last = i + WORD_CUT - 1
        if k < i:
            k = min(range(i, last + 1), key=hashes.__getitem__)
        elif hashes[last] < hashes[k]:
            k = last
        if not out or out[-1] != k:
            out.append(k)
    return out


def sentences(text: str) -> list[tuple[int, str, int]]:
    """Sentences of a text: (end in code points, the words joined by spaces, number of words).

    A sentence begins where the one before ends, so white space belongs to the sentence that follows it.
    """
    out, start = [], 0
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    for end in ends:
        words = text[start:end].split()
        n = len(words)
        if n > LONG_SENTENCE:
            at, places = 0, [m.end() for m in _WORD.finditer(text, start, end)]
            for k in _smallest([_hashes[w] for w in words]):
                if k < n - 1:
                    out.append((places[k], " ".join(words[at : k + 1]), k + 1 - at))
                    at = k + 1
            out.append((places[-1], " ".join(words[at:]), n - at))
        elif n:
            out.append((end - 1 if text[end - 1] == "\n" else end, " ".join(words), n))
        start = end
    return out


def spans(found: list[tuple[int, str, int]]) -> list[tuple[int, int, bytes]]:
    """Spans over sentences: (first, one past the last, 128-bit hash). A document of less than one span has none.

    A document of one sentence of SPAN_WORDS or more has that as its span.
    """
    if len(found) == 1 and found[0][2] >= SPAN_WORDS:
        return [(0, 1, xxhash.xxh3_128_digest(found[0][1].encode("utf-8", "replace")))]
    digests = [xxhash.xxh3_128_digest(s[1].encode("utf-8", "replace")) for s in found]
    counts = [s[2] for s in found]
    out, end, total = [], 0, 0
    for i in range(len(found)):
        while end < len(found) and (end - i < SPAN_SENTENCES or total < SPAN_WORDS):
            total += counts[end]
            end += 1
        if end - i < SPAN_SENTENCES or total < SPAN_WORDS:
            break
        out.append((i, end, xxhash.xxh3_128_digest(b"".join(digests[i:end]))))
        total -= counts[i]
    return out


_SENT = pa.schema([("part", pa.int64()), ("docs", pa.binary()), ("spans", pa.binary())])
_SENT_SQL = "part bigint, docs binary, spans binary"
_DOC = np.dtype([("d", "<i8"), ("h", "<i8")])
#: 96 bits of a hash, the document's place in the list beside, first sentence, number of sentences.
_SPAN = np.dtype([("a", "<u8"), ("b", "<u4"), ("doc", "<u4"), ("first", "<u4"), ("n", "<u2")])
#: The document's place in the list beside, first sentence, number of sentences.
_PLACE = np.dtype([("doc", "<u4"), ("first", "<u4"), ("n", "<u2")])


def _lists(docs: np.ndarray, found: np.ndarray, part: np.ndarray, first_part: int = 0) -> list[tuple]:
    """Rows (part, documents, records) for the parts of ``found``, whose field doc is made to count the row's own documents."""
    order = np.argsort(part, kind="stable")
    part, found = part[order], found[order]
    heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(part)])
    out = []
    for s, e in zip(heads, np.append(heads[1:], len(part))[: len(heads)], strict=True):
        chosen = found[s:e].copy()
        used, chosen["doc"] = np.unique(chosen["doc"], return_inverse=True)
        out.append((int(part[s]) + first_part, docs[used].tobytes(), chosen.tobytes()))
    return out


def _joined(rows: list[tuple[bytes, bytes]], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Documents and records of several rows, as one list of each."""
    docs, found, base = [], [], 0
    for d, x in rows:
        own = np.frombuffer(x, kind).copy()
        own["doc"] += base
        docs.append(np.frombuffer(d, _DOC))
        base += len(docs[-1])
        found.append(own)
    return np.concatenate(docs), np.concatenate(found)


def _later(docs: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans sorted by hash, document and place; whether each stands after the first of its hash."""
    found = found[np.lexsort((found["first"], docs["d"][found["doc"]], found["b"], found["a"]))]
    d = docs["d"][found["doc"]]
    head = np.concatenate([[True], (found["a"][1:] != found["a"][:-1]) | (found["b"][1:] != found["b"][:-1])])[: len(found)]
    lead = np.maximum.accumulate(np.where(head, np.arange(len(found)), 0)) if len(found) else np.zeros(0, np.int64)
    return found, (d > d[lead]) | (d == d[lead]) & (found["first"] > found["first"][lead])


def _places(docs: np.ndarray, found: np.ndarray, parts: int) -> list[tuple]:
    """Places of repeated spans for the parts of documents, numbered from ``parts`` on."""
    out = np.zeros(len(found), _PLACE)
    for name in _PLACE.names:
        out[name] = found[name]
    return _lists(docs, out, (docs["d"] ^ docs["h"])[found["doc"]] % parts, parts)


def _send(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("spans", _hashes.clear)
        for whole in batches:
            for at in range(0, whole.num_rows, 10_000):
                batch = whole.slice(at, 10_000)
                docs = np.zeros(batch.num_rows, _DOC)
                docs["d"], docs["h"] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                columns, hashes = [], []
                for i, text in enumerate(batch.column(2)):
                    found = spans(sentences(text.as_py() or ""))
                    columns += [(i, first, last - first) for first, last, _ in found]
                    hashes += [digest for _, _, digest in found]
                own = np.zeros(len(hashes), _SPAN)
                if hashes:
                    digest = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
                    own["a"], own["b"] = digest[:, 0], digest[:, 1] >> np.uint64(32)
                    own["doc"], own["first"], own["n"] = np.array(columns, np.int64).T
                own, later = _later(docs, own)
                sent = own[~later]
                yield packed(_places(docs, own[later], parts) + _lists(docs, sent, (sent["a"] % np.uint64(parts)).astype(np.int64)), _SENT)

    return run


def _meet(parts: int):
    """Of the spans of each part those that stand after the first of their hash; rows for parts of documents pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in part_runs(batches):
            if part >= parts:
                yield packed([(part, *r) for r in rows], _SENT)
            else:
                docs, found = _joined(rows, _SPAN)
                found, later = _later(docs, found)
                yield packed(_places(docs, found[later], parts), _SENT)

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of a part: its packed places."""
    schema = pa.schema([("d", pa.int64()), ("h", pa.int64()), ("places", pa.binary())])
    for _, rows in part_runs(batches):
        docs, found = _joined(rows, _PLACE)
        docs, which = np.unique(docs, return_inverse=True)
        own = which[found["doc"]]
        order = np.argsort(own, kind="stable")
        found, ends = found[order], np.searchsorted(own[order], np.arange(len(docs)), "right")
        out = [(int(d["d"]), int(d["h"]), found[s:e].tobytes()) for d, s, e in zip(docs, np.append(0, ends[:-1]), ends, strict=True)]
        for at in range(0, len(out), 5000):
            yield packed(out[at : at + 5000], schema)


def repeated_spans(documents: DataFrame) -> DataFrame:
    """Spans that occurred before, one row for each document that has any: d, h (its key), places (packed first sentence and number). No text travels."""
    parts = part_count(documents, PART_BYTES)
    sent = keyed(documents).select("_d", "_h", "_t").mapInArrow(_send(parts), _SENT_SQL)
    met = dealt(sent, "part", 2 * parts).mapInArrow(_meet(parts), _SENT_SQL)
    return dealt(met, F.col("part") - parts, parts).mapInArrow(_gather, "d bigint, h bigint, places binary")


def remove_repeats(documents: DataFrame) -> DataFrame:
    """Every document without the sentences of spans that occurred before.

    One row per input row: doc_id, n_sentences, n_removed (sentences), n_removed_words, text (what is kept; white
    space before a removed sentence goes with it). Null and empty texts are kept as an empty text. A null doc_id
    counts as smaller than any other. Rows that repeat a doc_id are versions of one document: among them only the
    place in the text decides which span is first, and equal rows are treated alike. Other columns are ignored; an
    empty table gives no rows.
    """
    gone = repeated_spans(documents).select(F.col("d").alias("_d"), F.col("h").alias("_h"), "places")
    rows = keyed(documents).join(gone, ["_d", "_h"], "left").select("doc_id", "_t", "places")
    kind = documents.schema["doc_id"].dataType.simpleString()

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, words, texts = [], [], [], []
            for text, places in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py() or ""
                found = sentences(text)
                counts.append(len(found))
                if not places:
                    removed.append(0)
                    words.append(0)
                    texts.append(text)
                    continue
                edge = np.zeros(len(found) + 1, np.int64)
                gone = np.frombuffer(places, _PLACE)
                np.add.at(edge, gone["first"].astype(np.int64), 1)
                np.add.at(edge, gone["first"].astype(np.int64) + gone["n"], -1)
                covered = np.cumsum(edge[:-1]) > 0
                removed.append(int(covered.sum()))
                words.append(sum(s[2] for s, c in zip(found, covered, strict=True) if c))
                out, at = [], 0
                for (e, _, _), c in zip(found, covered, strict=True):
                    if not c:
                        out.append(text[at:e])
                    at = e
                texts.append("".join([*out, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(words, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_sentences", "n_removed", "n_removed_words", "text"])

    return rows.mapInArrow(drop, f"doc_id {kind}, n_sentences bigint, n_removed bigint, n_removed_words bigint, text string")
