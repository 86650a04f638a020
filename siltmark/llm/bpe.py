"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece the table keeps the one token that can end a valid encoding of that prefix.
It is unique, so appending bytes only adds entries, and after an edit all entries before it stay as they are.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.llm.common import sole_cache

#: Entries of a worker's cache of encoded pieces; beyond it the cache starts anew.
CACHE_PIECES = 300_000
#: Entries of a worker's cache of answers for two tokens side by side.
CACHE_PAIRS = 1_000_000
#: Entries of a worker's table of prefixes, and bytes of a piece beyond which it has a table of its own.
CACHE_PREFIXES, LONG_PIECE = 800_000, 96
#: Above every rank.
EVERY = 1 << 60


class Vocabulary:
    """Ranks of a byte-level BPE and the test whether two tokens can stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {t: b for b, t in ranks.items()}
        #: Every suffix of a token -> the token that it is, or -1: walking back from a byte stops where no token can begin.
        self.suffixes: dict[bytes, int] = {}
        for piece, token in ranks.items():
            for i in range(1, len(piece)):
                self.suffixes.setdefault(piece[i:], -1)
            self.suffixes[piece] = token
        self.parts: dict[int, tuple[int, int]] = {}
        self.whole: set[int] = set()
        self.pairs: dict[int, bool] = {}
        for piece, token in sorted(ranks.items(), key=lambda kv: kv[1]):
            if len(piece) == 1:
                self.parts[token] = (token, token)
                self.whole.add(token)
                continue
            halves = self._walk(piece, PrefixTable(self, below=token))
            if len(halves) == 2:
                self.parts[token] = (halves[0], halves[1])
                self.whole.add(token)

    @staticmethod
    def _walk(piece: bytes, prefix: PrefixTable) -> list[int]:
        prefix.append(piece)
        return prefix.tokens()

    def adjacent(self, left: int, right: int, below: int = EVERY) -> bool:
        """Whether encoding the bytes of ``left`` and ``right`` together, with the ranks under ``below``, gives these two tokens again.

        Undoes the merges on both sides of the border, the latest first: a merge across the border that would
        have come before the one undone last shows that the pair never arises.
        """
        limit, good = below, None
        ranks, bytes_of, parts = self.ranks, self.bytes_of, self.parts
        while good is None:
            across = ranks.get(bytes_of[left] + bytes_of[right])
            if across is not None and across < limit:
                good = False
                break
            split_left, split_right = parts[left][1] != left, parts[right][0] != right
            if split_left and (left > right or not split_right):
                limit, left = left, parts[left][1]
            elif split_right:
                limit, right = right + 1, parts[right][0]
            else:
                good = True
        return good


class PrefixTable:
    """The last token of every byte prefix of one piece. ``append`` extends it, ``cut`` drops a tail."""

    def __init__(self, vocabulary: Vocabulary, below: int = EVERY):
        self.vocabulary, self.below = vocabulary, below
        self.data, self.last = b"", [-2]

    def append(self, more: bytes) -> None:
        vocabulary, below, last, every = self.vocabulary, self.below, self.last, EVERY
        if len(vocabulary.pairs) > CACHE_PAIRS:
            vocabulary.pairs.clear()
        suffix, whole, pairs, adjacent = vocabulary.suffixes.get, vocabulary.whole, vocabulary.pairs, vocabulary.adjacent
        start, data = len(self.data), self.data + more
        self.data = data
        for end in range(start + 1, len(data) + 1):
            found, begin = -1, end
            while begin > 0:
                begin -= 1
                token = suffix(data[begin:end])
                if token is None:
                    break
                before = last[begin]
                if token < 0 or before == -1 or token >= below:
                    continue
                if before == -2:
                    good = token in whole
                elif below is every:
                    good = pairs.get(before << 32 | token)
                    if good is None:
                        good = token in whole and adjacent(before, token)
                        pairs[before << 32 | token] = good
                else:
                    good = token in whole and adjacent(before, token, below)
                if good:
                    found = token
                    break
            last.append(found)

    def cut(self, length: int) -> None:
        self.data = self.data[:length]
        del self.last[length + 1 :]

    def tokens(self) -> list[int]:
        out, end, bytes_of = [], len(self.data), self.vocabulary.bytes_of
        while end > 0:
            token = self.last[end]
            out.append(token)
            end -= len(bytes_of[token])
        return out[::-1]


class PieceCache(dict):
    """Piece of text -> its ids as little-endian 32-bit bytes.

    Pieces share one table of prefixes: a new piece is walked only from the longest prefix that is known.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.prefixes: dict[bytes, int] = {b"": -2}
        self.written = [t.to_bytes(4, "little") for t in range(max(vocabulary.bytes_of, default=-1) + 1)]

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode("utf-8")
        token = self.vocabulary.ranks.get(data)
        if token is not None:
            out = self.written[token]
        elif len(data) > LONG_PIECE:
            prefix = PrefixTable(self.vocabulary)
            prefix.append(data)
            return b"".join([self.written[t] for t in prefix.tokens()])  # not kept, so that what is kept is bounded in bytes
        else:
            out = self._walk(data)
        if len(self) >= CACHE_PIECES:
            self.clear()
        self[piece] = out
        return out

    def _walk(self, data: bytes) -> bytes:
        last, vocabulary = self.prefixes, self.vocabulary
        suffix, pairs, adjacent = vocabulary.suffixes.get, vocabulary.pairs, vocabulary.adjacent
        whole = vocabulary.whole
        if len(last) > CACHE_PREFIXES:
            last.clear()
            last[b""] = -2
        if len(pairs) > CACHE_PAIRS:
            pairs.clear()
        known = len(data)
        while data[:known] not in last:
            known -= 1
        for end in range(known + 1, len(data) + 1):
            found, begin = -1, end
            while begin > 0:
                begin -= 1
                token = suffix(data[begin:end])
                if token is None:
                    break
                if token < 0:
                    continue
                before = last[data[:begin]]
                if before == -2:
                    good = token in whole
                elif before == -1:
                    continue
                else:
                    good = pairs.get(before << 32 | token)
                    if good is None:
                        pairs[before << 32 | token] = good = token in whole and adjacent(before, token)
                if good:
                    found = token
                    break
            last[data[:end]] = found
        out, end, bytes_of = [], len(data), vocabulary.bytes_of
        while end > 0:
            token = last[data[:end]]
            out.append(self.written[token])
            end -= len(bytes_of[token])
        return b"".join(out[::-1])


class Codec:
    """Encoder and decoder of whole texts for one vocabulary file and one splitting pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.vocabulary = Vocabulary(ranks)
        self.split = regex.compile(pattern).findall
        self.pieces = PieceCache(self.vocabulary)

    def encode_bytes(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        pieces = self.pieces
        return b"".join([pieces[p] for p in self.split(text)])

    def encode(self, text: str) -> list[int]:
        return list(memoryview(self.encode_bytes(text)).cast("I"))

    def decode_bytes(self, ids: bytes) -> bytes:
        bytes_of = self.vocabulary.bytes_of
        return b"".join([bytes_of[t] for t in memoryview(ids).cast("I")])


class EditableEncoding:
    """The encoding of a text that grows or changes.

    Keeps the pieces and a prefix table for each. ``replace`` splits the text anew from just before the edit on; pieces
    that are there already keep their tables, and one that grew at its end appends to its own.
    """

    def __init__(self, codec: Codec, text: str = ""):
        self.codec = codec
        self.pieces = codec.split(text)
        self.tables = [self._table(p) for p in self.pieces]

    def _table(self, piece: str, old: PrefixTable | None = None) -> PrefixTable:
        data = piece.encode("utf-8")
        if old is not None:
            same = next((i for i, (a, b) in enumerate(zip(old.data, data, strict=False)) if a != b), min(len(old.data), len(data)))
            old.cut(same)
            old.append(data[same:])
            return old
        prefix = PrefixTable(self.codec.vocabulary)
        prefix.append(data)
        return prefix

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def append(self, more: str) -> None:
        self.replace(sum(map(len, self.pieces)), 0, more)

    def replace(self, at: int, length: int, new: str) -> None:
        """Put ``new`` in place of ``length`` code points from ``at``."""
        text = self.text
        text = text[:at] + new + text[at + length :]
        first, begin = 0, 0
        while first < len(self.pieces) and begin + len(self.pieces[first]) < at:
            begin += len(self.pieces[first])
            first += 1
        while first > 0 and len(self.pieces) - first < 2 and begin > 0:
            first -= 1
            begin -= len(self.pieces[first])
        for _ in range(2):  # a contraction or a white-space run may reach back over a border
            if first > 0:
                first -= 1
                begin -= len(self.pieces[first])
        pieces = self.codec.split(text[begin:])
        reuse = self.tables[first] if first < len(self.tables) else None
        old = {}
        for piece, prefix in zip(self.pieces[first + 1 :], self.tables[first + 1 :], strict=True):
            old.setdefault(piece, prefix)
        tables = []
        for i, piece in enumerate(pieces):
            if i == 0 and reuse is not None:
                tables.append(self._table(piece, reuse))
            else:
                tables.append(old[piece] if piece in old else self._table(piece))
        self.pieces[first:], self.tables[first:] = pieces, tables

    def ids(self) -> list[int]:
        ranks, out = self.codec.vocabulary.ranks, []
        for prefix in self.tables:
            token = ranks.get(prefix.data)
            out += prefix.tokens() if token is None else [token]
        return out


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker and vocabulary."""
    return Codec(path, pattern)


def encode_documents(documents: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode and decode every whole text: one row (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) per input row.

    ``ids`` is the ids as little-endian 32-bit binary. Null and empty texts give no ids and the hash of no bytes;
    null, tied and repeated ids are carried as they are; other columns are ignored; an empty table gives no rows.
    Rows are independent: no shuffle, memory bounded by one Arrow batch.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids binary" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("bpe", codec.cache_clear)
        own = codec(path, pattern)
        for batch in batches:
            counts, hashes, decoded, blobs = [], [], [], []
            for text in batch.column(1):
                ids = own.encode_bytes(text.as_py() or "")
                counts.append(len(ids) // 4)
                hashes.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(own.decode_bytes(ids)).hexdigest())
                if keep_ids:
                    blobs.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(blobs, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Texts of the ``ids`` that encode_documents returned: rows (doc_id, text)."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [own.decode_bytes(x.as_py() or b"").decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
