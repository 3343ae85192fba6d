"""Secrets in texts: fixed patterns, and strings that a primed compressor finds new.

The patterns find assignments to secret names, access keys and runs of hex digits.  Beyond these, any
string of ``SHORTEST`` or more key characters within ``REACH`` bytes of a sensitive word (password, token,
auth and so on), on either side of it, is a candidate.  Its novelty is what it adds to a zstandard frame
that holds common prose and the text around it and starts from a dictionary of common identifiers, as a
share of its own length.  Names, repeated strings and the text's own prose compress away, in whatever
alphabet; random strings do not.  A candidate at or above ``NOVELTY`` is reported with the kind ``novel``;
the patterns' spans always stay.

One pass over the strings and one over the sensitive words, met by binary search, so the work grows with the
text's length.  Spans are in code points, the end exclusive.  Null and empty texts have no spans.  Only
ASCII letters match in either case.  Rows with equal ids are scanned each on its own.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Words that make a context sensitive (fixed values).
SENSITIVE = ("password", "passwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "credential", "private_key", "private-key", "privatekey", "access_key", "access-key", "accesskey", "auth", "authorization", "bearer", "signature", "client_id", "client-id", "clientid", "session_id", "session-id", "sessionid")
_SENSITIVE = re.compile(("(?:" + "|".join(map(re.escape, SENSITIVE)) + r")s?(?-i:(?![a-z]))").encode(), re.I)
#: Bytes of the shortest candidate; bytes between it and a sensitive word, at most; bytes of text on each side that the compressor sees.
SHORTEST, REACH, AROUND = 12, 128, 512
_FIRST = re.compile(rb"[A-Za-z0-9]")
_STRING = re.compile(rb"[A-Za-z0-9][A-Za-z0-9+/_.~-]{%d,}[A-Za-z0-9+/_]={0,2}" % (SHORTEST - 2))
#: Bytes that a candidate must add for each byte of its own.
NOVELTY = 0.75
#: What the compressor knows beforehand: names that code and configuration are full of (fixed values).
IDENTIFIERS = (
    "password passwd passphrase secret token api_key apikey access_key secret_key private_key public_key client_id client_secret "
    "authorization authentication bearer basic signature session_id session_token refresh_token credentials username user_name "
    "configuration environment variable default example placeholder changeme undefined required optional string integer boolean "
    "application development production localhost database connection https://www. http:// .example.com .example.org .example.net "
    "import return function class public static private const self this null true false begin end certificate encrypted "
    "2023-01-01T00:00:00 2024-10-12T12:30:45 2025-06-08T18:15:59 2026-11-27 "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 xxxxxxxxxxxxxxxx ****************"
).encode()


#: Common words, for the frequencies of letters (fixed values).
PROSE = (
    b"the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were when we "
    b"there can an your which their said if do will each about how up out them then she many some so these would other into has more "
    b"der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    b"le de un est pas pour que dans ce il qui ne sur se plus par je avec tout faire son mettre autre on mais nous comme ou si leur "
    b"la que el en y los del se las por un para con no una su al lo como pero sus le ya este porque esta entre cuando muy sin sobre "
)


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int


class Novelty:
    """Marginal compressed bytes of a string against the text around it and the identifier dictionary."""

    def __init__(self, level: int = 3):
        form = zstandard.ZstdCompressionParameters.from_level(level, min_match=3, write_content_size=False, write_dict_id=False)
        self._frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=form)

    def of(self, before: bytes, candidate: bytes, after: bytes) -> float:
        """Added bytes for each byte of ``candidate``."""
        around = PROSE + after + b"\n" + before
        return (len(self._frame.compress(around + candidate)) - len(self._frame.compress(around))) / len(candidate)


_novelty = Novelty()


def base_spans(data: bytes) -> list[Span]:
    """Pattern matches in UTF-8 bytes, by byte position."""
    out = []
    low = data.lower()
    if any(n in low for n in _NAMES):
        out += [Span("assign", m.start(), m.end()) for m in _ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in data:
        out += [Span("access", m.start(), m.end()) for m in _ACCESS.finditer(data) if m.end() - m.start() >= 18]
    out += [Span("hex", m.start(), m.end()) for m in _HEX.finditer(data)]
    return out


def candidates(data: bytes, base: list[Span]) -> Iterator[tuple[int, int]]:
    """Strings in reach of a sensitive word that overlap no pattern's span, by byte position.

    Where a word stands inside a string, what comes before it is part of its name, and the rest the candidate."""
    words = [m.span() for m in _SENSITIVE.finditer(data)]
    if not words:
        return
    starts, ends = [a for a, _ in words], [b for _, b in words]
    taken = sorted((s.start, s.end) for s in base)
    opened, closed = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for m in _STRING.finditer(data):
        a, b = m.span()
        k = bisect.bisect_left(starts, b)
        if k and ends[k - 1] > a:
            first = _FIRST.search(data, ends[k - 1], b)
            if not first or not _STRING.match(data, first.start(), b):
                continue
            a = first.start()
        elif not (k and a - ends[k - 1] <= REACH or k < len(starts) and starts[k] - b <= REACH):
            continue
        t = bisect.bisect_left(opened, b)
        if not t or closed[t - 1] <= a:
            yield a, b


def novel_spans(data: bytes, base: list[Span], novelty: float = NOVELTY) -> list[Span]:
    """Candidates that stay incompressible."""
    return [Span("novel", a, b) for a, b in candidates(data, base) if _novelty.of(data[max(0, a - AROUND) : a], data[a:b], data[b : b + AROUND]) >= novelty]


def spans_of(text: str | None, novelty: float = NOVELTY) -> list[Span]:
    """All spans of a text in code points, by start and kind."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    base = base_spans(data)
    low = data.lower()
    found = base + (novel_spans(data, base, novelty) if any(w.encode() in low for w in SENSITIVE) else [])
    if len(data) != len(text):
        at = {p: 0 for s in found for p in (s.start, s.end)}
        chars, last = 0, 0
        for p in sorted(at):
            chars += len(data[last:p].decode("utf-8", "surrogatepass"))
            at[p], last = chars, p
        found = [Span(s.kind, at[s.start], at[s.end]) for s in found]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def masked(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with every span, or run of overlapping spans, replaced by ``mark``."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], mark]
        at = max(at, s.end)
    return "".join(out) + text[at:]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in K.chunks(batch.column(1)):
            texts = batch.column(1).slice(a, b - a).to_pylist()
            spans = [spans_of(t) for t in texts]
            base = [[s for s in x if s.kind != "novel"] for x in spans]
            n = [[sum(s.kind == k for s in x) for x in base] for k in KINDS[:3]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), *(pa.array(c, pa.int64()) for c in n), pa.array([hashlib.sha256(_joined(x).encode()).hexdigest() for x in base]), pa.array([_joined(x) for x in spans], pa.string())],
                ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_assign, n_access, n_hex, base_sha256, spans)`` for each document."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(K.tidied(_rows), "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of its texts masked; other columns are as they were, null texts stay null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in K.chunks(batch.column(at)):
                part = batch.slice(a, b - a)
                texts = [t if t is None else masked(t, spans_of(t)) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(K.tidied(run), docs.schema)
