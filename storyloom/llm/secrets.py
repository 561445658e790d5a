"""Secret scans with multipart credential linking.

Strong findings (kinds assign, access, hex) stand on their own. Weak candidates are parts of a credential that mean
nothing alone: an identifier (kind id), a random-looking token (key), an address (endpoint). They are linked by an
interval join: a scope is the interval between two blank lines, each part is joined by bisection with the scope that
holds it, and parts of one scope are complementary, however far apart. A key is reported with an identifier, an
identifier with a secret, an endpoint with both; strong access findings count as identifiers and strong assign
findings as secrets. n candidates cost n log n however many share a scope, and no pairs are formed.

A document is scanned whole, in one pass over its row: nothing is shuffled. Offsets are code points, ends
exclusive. Defined results: null text counts as empty and has no spans; null ids and repeated rows keep a row each;
an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import prepare, raw, rows_of

KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
STRONG = KINDS[:3]

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Names under which identifiers stand, followed by their value.
ID = re.compile(r"(?:access_?key_?id|client_?id|account_?id|user_?name|user|login|tenant)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]{3,})", re.I | re.A)
#: A long run of letters and digits of both kinds.
KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}")
#: Addresses. Both begin where a run of their characters does and give nothing back, so they cost one pass over a text.
URL = re.compile(r"(?<![A-Za-z0-9+.-])[0-9+.-]*+([A-Za-z][A-Za-z0-9+.-]*+://[^\s\"'<>]+)")
HOST = re.compile(r"(?<![A-Za-z0-9.-])[.]*+([A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++:[0-9]{2,5})")
BLANK = re.compile(r"\n[^\S\n]*\n")

Span = tuple[str, int, int]


def strong_spans(text: str) -> list[Span]:
    """The findings that need no partner; matches that are too short are dropped after matching."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def _free(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that overlap none of the taken ones (sorted, disjoint or nested)."""
    starts, tops, top = [], [], -1
    for a, b in sorted(taken):
        top = max(top, b)
        starts.append(a)
        tops.append(top)
    out = []
    for a, b in spans:
        k = bisect_left(starts, b)
        if k == 0 or tops[k - 1] <= a:
            out.append((a, b))
    return out


def endpoints(text: str) -> list[tuple[int, int]]:
    """Addresses with a scheme, and host:port outside those."""
    urls = [m.span(1) for m in URL.finditer(text)]
    return urls + _free([m.span(1) for m in HOST.finditer(text)], urls)


def linked_spans(text: str, strong: list[Span]) -> list[Span]:
    """The weak candidates that have their complementary parts."""
    taken = [(a, b) for _, a, b in strong]
    ids = _free([m.span(1) for m in ID.finditer(text)], taken)
    all_ids = ids + [(a, b) for k, a, b in strong if k == "access"]
    if not all_ids:
        return []
    keys = _free([m.span() for m in KEY.finditer(text)], taken + ids)
    secrets = keys + [(a, b) for k, a, b in strong if k == "assign"]
    if not secrets:
        return []
    blanks = [m.start() + 1 for m in BLANK.finditer(text)]
    scope = lambda span: bisect_right(blanks, span[0])  # noqa: E731  no part holds a line's end
    of_ids, of_secrets = set(map(scope, all_ids)), set(map(scope, secrets))
    found = [("id", *s) for s in ids if scope(s) in of_secrets]
    found += [("key", *s) for s in keys if scope(s) in of_ids]
    places = _free(endpoints(text), taken + ids + keys)
    return found + [("endpoint", *s) for s in places if scope(s) in of_ids and scope(s) in of_secrets]


def spans_of(text: str) -> list[Span]:
    """All spans by start, then kind as listed."""
    strong = strong_spans(text)
    return sorted(strong + linked_spans(text, strong), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for b in rows_of(batches):
        found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans_of(t.decode("utf-8", "replace"))] for t in raw(b.column(1))]
        yield pa.record_batch({"id": b.column(0), "spans": pa.array(found, kind)})


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, spans (kind, start, end)."""
    prepare(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(_scan, f"id long, spans {SPANS}")


def listed(spans: Column | str, strong_only: bool = False) -> Column:
    """kind:start:end of the spans, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*STRONG)) if strong_only else F.col(spans) if isinstance(spans, str) else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
