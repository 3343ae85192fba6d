"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document.  A visitor flattens it into text
with ordered placeholders and records each attachment's reference and the tokens that it expands to.
The template marks turns with control strings; inside texts and roles a backslash splits every control
string, so a formatted conversation can be read back exactly.  Neighbouring texts are joined before that,
so that none arises where they meet; every control string has its only "<" or "[" in front, so none arises
where a text meets a placeholder either.  The loss mask covers the assistant's turns.

A row has a ``text``, or a list ``parts`` of structs (kind, text, ref, width, height, seconds, pages) that
goes before it; a null part is left out, an empty list is an empty text, a missing size is the default.

A conversation is formatted in segments of whole turns, so one of any length passes through a task of
bounded memory.  Turns come by turn number, then role, then text; null turn numbers come first, a null
role or text is empty.  Rows with a null conversation id form one conversation.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of the template (fixed values).
OPEN = {"system": "[SYS]", "user": "[INST]", "assistant": "[OUT]"}
OTHER, NAME_END, BEGIN, END = "[ROLE]", "[/ROLE]", "<s>", "</s>"
CONTROL = (*OPEN.values(), "[/SYS]", "[/INST]", "[/OUT]", OTHER, NAME_END, BEGIN, END, "<image>", "<audio>", "<document>")
_CONTROL = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_PLACEHOLDER = re.compile(r"\\.|<(image|audio|document)>", re.S)
_ROLE_OF = {v: k for k, v in OPEN.items()}
_TURN = re.compile("(" + "|".join(map(re.escape, OPEN.values())) + ")|" + re.escape(OTHER) + "(.*?)" + re.escape(NAME_END), re.S)
#: Code points of text in a segment, about.
SEGMENT = 1 << 20


@dataclass(frozen=True)
class TextPart:
    text: str | None

    def accept(self, visitor: "Flattener") -> None:
        visitor.text(self)


@dataclass(frozen=True)
class ImagePart:
    ref: str | None
    width: int = 224
    height: int = 224

    def accept(self, visitor: "Flattener") -> None:
        visitor.image(self)


@dataclass(frozen=True)
class AudioPart:
    ref: str | None
    seconds: float = 0.0

    def accept(self, visitor: "Flattener") -> None:
        visitor.audio(self)


@dataclass(frozen=True)
class DocumentPart:
    ref: str | None
    pages: int = 1

    def accept(self, visitor: "Flattener") -> None:
        visitor.document(self)


Part = TextPart | ImagePart | AudioPart | DocumentPart


def part_of(row: dict) -> Part:
    """The part that a struct of a table describes."""
    kind, given = row.get("kind") or "text", lambda name, default: default if row.get(name) is None else row[name]
    if kind == "text":
        return TextPart(row.get("text"))
    if kind == "image":
        return ImagePart(row.get("ref"), given("width", 224), given("height", 224))
    if kind == "audio":
        return AudioPart(row.get("ref"), given("seconds", 0.0))
    if kind == "document":
        return DocumentPart(row.get("ref"), given("pages", 1))
    raise ValueError(f"no part is of kind {kind!r}")


@dataclass(frozen=True)
class Attachment:
    """The ``index``-th placeholder of a conversation, what it stands for, and the tokens that it expands to."""

    index: int
    kind: str
    ref: str | None
    tokens: int


@dataclass
class Flattener:
    """Visits parts in order.  ``patch``: pixels of an image token's side; ``rate``: audio tokens a second;
    ``page``: tokens of a document's page."""

    patch: int = 14
    rate: float = 25.0
    page: int = 512
    attachments: list[Attachment] = field(default_factory=list)
    _out: list[str] = field(default_factory=list)

    def flatten(self, parts: Iterable[Part]) -> str:
        self._out = []
        for text, run in groupby(parts, key=lambda p: isinstance(p, TextPart)):
            for part in [TextPart("".join(p.text or "" for p in run))] if text else run:
                part.accept(self)
        return "".join(self._out)

    def text(self, part: TextPart) -> None:
        self._out.append(escape(part.text or ""))

    def image(self, part: ImagePart) -> None:
        self._attach("image", part.ref, math.ceil(part.width / self.patch) * math.ceil(part.height / self.patch))

    def audio(self, part: AudioPart) -> None:
        self._attach("audio", part.ref, math.ceil(part.seconds * self.rate))

    def document(self, part: DocumentPart) -> None:
        self._attach("document", part.ref, part.pages * self.page)

    def _attach(self, kind: str, ref: str, tokens: int) -> None:
        self.attachments.append(Attachment(len(self.attachments), kind, ref, tokens))
        self._out.append(f"<{kind}>")


def escape(text: str) -> str:
    """Control strings are split by a backslash after their first character, backslashes are doubled."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parts_of(body: str) -> list[tuple[str, str]]:
    """``(kind, text)`` of a flattened turn's parts in order; a placeholder has no text."""
    out, at = [], 0
    for m in _PLACEHOLDER.finditer(body):
        if m[1]:
            out += [("text", unescape(body[at : m.start()]))] * (m.start() > at) + [(m[1], "")]
            at = m.end()
    return out + [("text", unescape(body[at:]))] * (len(body) > at)


@dataclass
class Segment:
    """Formatted turns; ``loss``: code point ranges of ``text`` under the loss mask; and their attachments."""

    text: str
    loss: list[tuple[int, int]]
    attachments: list[Attachment]
    first: bool
    last: bool = False


def format_turns(turns: Iterable[tuple[str | None, Iterable[Part]]], flattener: Flattener | None = None, most: int = SEGMENT) -> Iterator[Segment]:
    """Formats ``(role, parts)`` in order, as segments of whole turns that join to the conversation."""
    flattener = flattener or Flattener()
    out, size, loss, first, seen = [BEGIN], len(BEGIN), [], True, len(flattener.attachments)
    for role, parts in turns:
        role = role or ""
        head = OPEN.get(role) or OTHER + escape(role) + NAME_END
        body = flattener.flatten(parts)
        if role == "assistant":
            loss.append((size + len(head), size + len(head) + len(body)))
        out += [head, body, END]
        size += len(head) + len(body) + len(END)
        if size >= most:
            yield Segment("".join(out), loss, flattener.attachments[seen:], first)
            out, size, loss, first, seen = [], 0, [], False, len(flattener.attachments)
    yield Segment("".join(out), loss, flattener.attachments[seen:], first, last=True)


def read_back(segment: Segment) -> tuple[list[tuple[str, str]], list[str]]:
    """``(role, text)`` of the turns in a formatted segment, and the texts under its loss mask."""
    body = segment.text[len(BEGIN) :] if segment.first else segment.text
    turns = []
    for part in body.split(END)[:-1]:
        head = _TURN.match(part)
        turns.append((_ROLE_OF[head[1]] if head[1] else unescape(head[2]), unescape(part[head.end() :])))
    return turns, [unescape(segment.text[a:b]) for a, b in segment.loss]


def sorted_turns(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Turns of a conversation in order within one partition: one shuffle by conversation."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ties = [F.to_json("parts")] if "parts" in rows.columns else []
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", *ties)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[Segment]]]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True)

    def turn(role: str | None, text: str | None, parts: list[dict | None] | None = None) -> tuple[str | None, list[Part]]:
        return role, [TextPart(text)] if parts is None else [part_of(p) for p in parts if p is not None]

    for conv, turns in groupby(rows(), key=lambda r: r[0]):
        yield conv, format_turns(turn(*r[1:]) for r in turns)


_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("segment", pa.int32()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("attachments", pa.list_(pa.struct([("index", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])))])


def format_conversations(rows: DataFrame) -> DataFrame:
    """``(conv_id, segment, text, loss, attachments)``: formatted conversations of ``rows (conv_id, turn, role,
    text[, parts])``.  Attachments count from 0 in their conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, segments in _conversations(batches):
            for k, s in enumerate(segments):
                yield pa.RecordBatch.from_pylist([{"conv_id": conv, "segment": k, "text": s.text, "loss": [{"start": a, "end": b} for a, b in s.loss], "attachments": [vars(a) for a in s.attachments]}], schema=_SEGMENTS)

    ordered = sorted_turns(_typed(rows)).drop("turn")
    return ordered.mapInArrow(run, "conv_id long, segment int, text string, loss array<struct<start: long, end: long>>, attachments array<struct<index: long, kind: string, ref: string, tokens: long>>")


def _typed(rows: DataFrame) -> DataFrame:
    text = F.col("text").cast("string") if "text" in rows.columns else F.lit(None).cast("string").alias("text")
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), text, *(["parts"] if "parts" in rows.columns else []))


_DIGESTS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def conversation_digests(rows: DataFrame) -> DataFrame:
    """Formats conversations, reads them back, and gives counts and digests of what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv, segments in _conversations(batches):
            turns, loss, n, masked, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for s in segments:
                read, under = read_back(s)
                chars += len(s.text)
                n += len(read)
                for role, text in read:
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for text in under:
                    masked += len(text)
                    loss.update(text.encode("utf-8", "surrogatepass"))
            out.append((conv, n, turns.hexdigest(), masked, loss.hexdigest(), chars))
            if len(out) >= 1000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    ordered = sorted_turns(_typed(rows)).drop("turn")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], list(_DIGESTS))
