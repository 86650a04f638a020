"""Secret scans: plain patterns, and multipart credentials linked inside a scope.

Strong candidates (the base patterns) are always reported. A weak candidate - an access identifier, a bare
random-looking string or an endpoint - says little alone and is reported only when the parts that make it a
credential stand near it in the same scope.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the same spans as [0-9a-f]+ of 16 or more: both take whole runs
#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "identifier", "opaque", "endpoint")
BASE = KINDS[:3]

IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_])(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._+-]{3,})", re.I | re.A)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"(?:[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]{4,}|(?<![A-Za-z0-9.-])(?:[a-z0-9-]+\.)+[a-z]{2,}:\d{2,5}(?!\d))")
#: A blank line ends a scope.
SCOPE_END = re.compile(r"\n[\x20\t\r]*\n")
#: Code points within which the parts of one credential stand.
REACH = 400
#: Bits a character that a bare string must have to count as random.
RANDOM_BITS = 3.5


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the three base patterns: (start, kind's place in KINDS, end), sorted."""
    out = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 12:
            out.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                out.append((m.start(), 1, m.end()))
    for m in HEX.finditer(text):
        out.append((m.start(), 2, m.end()))
    return sorted(out)


def _random(value: str) -> bool:
    n = len(value)
    kinds = any(c.isdigit() for c in value) + any(c.islower() for c in value) + any(c.isupper() for c in value)
    return kinds >= 2 and -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= RANDOM_BITS


def linked_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak candidates whose complementary parts co-occur, as base_spans gives them.

    Parts: identifiers (access spans and user names), secrets (assign and hex spans, and random strings) and
    endpoints. An interval join inside each scope pairs every secret with every identifier within REACH; two make
    a credential if one is strong or an endpoint is in reach of the secret too. The weak parts of all credentials
    are reported, and the endpoints in reach of their secrets.
    """
    if not base and "://" not in text and not IDENTIFIER.search(text):
        return []

    def clear_of(spans: list[tuple]):
        """Whether a span overlaps none of the sorted ``spans``, which may overlap each other."""
        starts, furthest = [x[0] for x in spans], list(accumulate((x[1] for x in spans), max))
        return lambda s, e: not (i := bisect_left(starts, e)) or furthest[i - 1] <= s

    free = clear_of([(s, e) for s, _, e in base])

    identifiers = [(s, e, True) for s, k, e in base if k == 1] + [(*m.span(), False) for m in IDENTIFIER.finditer(text) if free(*m.span())]
    if not identifiers:
        return []
    endpoints = [m.span() for m in ENDPOINT.finditer(text)]
    identifiers.sort()
    secrets = [(s, e, True) for s, k, e in base if k != 1]
    no_identifier, no_endpoint = clear_of(identifiers), clear_of(endpoints)
    for m in OPAQUE.finditer(text):
        if free(*m.span()) and no_identifier(*m.span()) and no_endpoint(*m.span()) and _random(m.group()):
            secrets.append((*m.span(), False))
    ends = [m.start() for m in SCOPE_END.finditer(text)]
    scope = lambda at: bisect_left(ends, at)

    def within(spans: list[tuple]):
        """The spans that stand within REACH of one and in its scope; ``spans`` are sorted and do not overlap."""
        starts, stops = [x[0] for x in spans], [x[1] for x in spans]
        return lambda s, e: [x for x in spans[bisect_left(stops, s - REACH) : bisect_right(starts, e + REACH)] if scope(x[0]) == scope(s)]

    found, identifiers_near, endpoints_near = set(), within(identifiers), within(endpoints)
    for s, e, strong in secrets:
        sites = endpoints_near(s, e)
        credentials = [x for x in identifiers_near(s, e) if strong or x[2] or sites]
        if not credentials:
            continue
        found.update((a, 3, b) for a, b, known in credentials if not known)
        if not strong:
            found.add((s, 4, e))
        found.update((x, 5, y) for x, y in sites)
    return sorted(found)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. Null and empty texts have no
    spans (the hash is that of no bytes); ids may be null, tied or repeated: each row is scanned for itself; other
    columns are ignored; an empty table gives no rows. No shuffle; memory is bounded by one Arrow batch.
    """
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                more = linked_spans(text, base)
                counts = Counter(k for _, k, _ in base)
                rows.append((counts[0], counts[1], counts[2], hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_linked bigint"
    )


def mask_secrets(documents: DataFrame, text_col: str = "text", mask: str = "[SECRET]", count_col: str | None = "n_chars") -> DataFrame:
    """``documents`` with every span that scan_secrets reports, endpoints apart, replaced by ``mask``.

    All rows and columns stay; a null text stays null; ``count_col``, if the table has it, is the new number of
    code points (null where the text is null). Overlapping spans become one mask.
    """
    schema, columns = documents.schema, documents.columns
    at, count_at = columns.index(text_col), columns.index(count_col) if count_col in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for value in batch.column(at):
                text = value.as_py()
                if text:
                    base = base_spans(text)
                    out, end = [], 0
                    for s, k, e in sorted(base + linked_spans(text, base)):
                        if KINDS[k] != "endpoint" and e > end:
                            if s >= end:
                                out += [text[end:s], mask]
                            end = e
                    text = "".join([*out, text[end:]])
                texts.append(text)
                counts.append(None if text is None else len(text))
            arrays = list(batch.columns)
            arrays[at] = pa.array(texts, pa.string())
            if count_at is not None:
                arrays[count_at] = pa.array(counts, arrays[count_at].type)
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return documents.mapInArrow(run, schema)
